"""Files that Python reads by parts, on this machine or in a store that pyarrow knows."""

from __future__ import annotations

import os
import re
from typing import BinaryIO
from urllib.parse import unquote, urlparse

_SCHEME = re.compile(r"([a-z][a-z0-9+.-]*):")
#: Schemes of stores that pyarrow opens.
STORES = ("hdfs", "s3", "s3a", "gs", "gcs", "abfs", "abfss")


def _scheme(path: str) -> str:
    found = _SCHEME.match(path)
    return found[1] if found else "file"


def reachable(path: str) -> bool:
    """Whether tasks can open the file; other stores are left to Spark's own readers."""
    return _scheme(path) in ("file", *STORES)


def _in_store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^s3a:", "s3:", path))


def opened(path: str) -> BinaryIO:
    """A file to read from any place of."""
    if _scheme(path) == "file":
        return open(unquote(urlparse(path).path) if path.startswith("file:") else path, "rb")
    store, name = _in_store(path)
    return store.open_input_file(name)


def created(path: str) -> BinaryIO:
    """A new file to write to; its folder is made."""
    if _scheme(path) == "file":
        path = unquote(urlparse(path).path) if path.startswith("file:") else path
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb")
    store, name = _in_store(path)
    return store.open_output_stream(name)


def size(path: str) -> int:
    with opened(path) as source:
        return source.seek(0, 2)
