"""Chat formatting by token-level assembly.

Each turn's role and text are encoded on their own; reserved ids, which no
encoding yields, are spliced between them, and the loss mask comes from a prefix
sum over +1 and -1 at the borders of assistant texts. Control strings inside
texts are broken up reversibly, so that a reader of the formatted text can't
mistake them for the template's marks.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidweave.llm.common import materialise, prepare, release

#: Reserved ids past the vocabulary's, and the marks they stand for in the formatted text.
TURN, SAYS, END = 50257, 50258, 50259
MARKS = {TURN: "<|turn|>", SAYS: "<|says|>", END: "<|end|>"}
#: Strings with a meaning to this or other common templates. None starts another.
CONTROLS = (
    *MARKS.values(),
    "<|im_start|>",
    "<|im_end|>",
    "<|endoftext|>",
    "<|startoftext|>",
    "<|user|>",
    "<|assistant|>",
    "<|system|>",
    "<s>",
    "</s>",
    "[INST]",
    "[/INST]",
    "<<SYS>>",
    "<</SYS>>",
)
_control = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS))
_escape = re.compile(r"\\([\\-])")
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    r"""Double each backslash, then put ``\-`` after the first character of every control string."""
    return _control.sub(lambda m: m[0] + r"\-", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    """The inverse of ``escape``."""
    return _escape.sub(lambda m: "\\" if m[1] == "\\" else "", text)


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


SEGMENTS = "conv_id long, segment long, first_token long, ids binary, loss binary, part int, n_tokens long"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"
#: Letters of a text that tell where a task's rows end among rows of one conversation, turn and role.
OPENING = 64


def format_conversations(turns: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per turn: conv_id, segment (from 0), first_token, ids (little-endian unsigned 32-bit) and loss (a byte an id).

    Turns stand in the order of turn (null first), then role, then text, by code points; equal ones stay. Null role or
    text counts as empty; rows without conv_id make one conversation; other columns are not read; an empty table gives
    no rows. Rows are dealt out by ranges of that order, so a conversation of any length is split among tasks: each
    counts from 0, and where a conversation goes on in the next one, the counts before are added afterwards. A text is
    encoded whole.
    """
    spark = turns.sparkSession
    prepare(spark)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoding(path, pattern)
        part = TaskContext.get().partitionId()
        conv, segment, place, inside = object(), 0, 0, 0
        for batch in batches:
            rows: list[tuple] = []
            for conv_id, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if conv_id != conv:
                    conv, segment, place, inside = conv_id, 0, 0, 0
                front = [TURN, *own.encode_ordinary(escape(role)), SAYS]
                ids = [*front, *own.encode_ordinary(escape(text)), END]
                n = len(ids)
                step = np.zeros(n + 1, dtype=np.int8)
                if role == LOSS_ROLE:
                    step[len(front)] += 1
                    step[n - 1] -= 1
                mask = inside + np.cumsum(step[:n], dtype=np.int8)
                inside = int(mask[-1] + step[n])
                rows.append((conv_id, segment, place, np.array(ids, dtype="<u4").tobytes(), mask.tobytes(), part, n))
                segment += 1
                place += n
            columns = list(zip(*rows, strict=True)) or [()] * 7
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int64()]
            names = [x.split()[0] for x in SEGMENTS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=names)

    clean = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    encoded, scratch = materialise(
        clean.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, OPENING))
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .mapInArrow(encode, SEGMENTS),
        "segments",
    )
    # A task's rows end within one conversation at most, so there are no more of these than tasks.
    counts = encoded.groupBy("conv_id", "part").agg(F.count("*").alias("segments"), F.sum("n_tokens").alias("tokens"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    goes_on = counts.withColumns({"segments": F.sum("segments").over(before), "tokens": F.sum("tokens").over(before)}).where(F.col("segments").isNotNull())
    goes_on = goes_on.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), "segments", "tokens")
    joined = encoded.join(F.broadcast(goes_on), F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")), "left")
    out = joined.select(
        "conv_id",
        (F.col("segment") + F.coalesce("segments", F.lit(0))).alias("segment"),
        (F.col("first_token") + F.coalesce("tokens", F.lit(0))).alias("first_token"),
        "ids",
        "loss",
    )
    release(spark, scratch)
    return out


def read_back(segments: DataFrame, path: str, pattern: str) -> DataFrame:
    """Digests of each conversation, read from nothing but the assembled ids and masks, in the order of their segments.

    A digest runs through its conversation from end to end, so a conversation is read in one task, a batch at a time.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoding(path, pattern)
        none = object()
        conv = none
        rows: list[tuple] = []
        turns = loss = None
        counts = [0] * 5

        def close() -> None:
            rows.append((conv, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), *counts[2:]))

        for batch in batches:
            for conv_id, ids, mask in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if conv_id != conv:
                    if conv is not none:
                        close()
                    conv, turns, loss, counts = conv_id, hashlib.sha256(), hashlib.sha256(), [0] * 5
                got = np.frombuffer(ids, dtype="<u4")
                under = np.frombuffer(mask, dtype=np.int8).astype(bool)
                text = []
                marks = np.flatnonzero(got > 50256).tolist()
                for at, to in zip(marks, [*marks[1:], len(got)], strict=True):
                    counts[2] += len(MARKS[int(got[at])])
                    text.append(own.decode(got[at + 1 : to].tolist()))
                counts[2] += sum(map(len, text))
                role, said = unescape(text[0]), unescape(text[1])
                turns.update(f"{role}\n{said}\n".encode())
                trained = unescape(own.decode(got[under].tolist()))
                loss.update(trained.encode())
                counts[0] += 1
                counts[1] += len(trained)
                counts[3] += len(got)
                counts[4] += int(under.sum())
            names = [x.split()[0] for x in DIGEST.split(", ")]
            if rows:
                columns = list(zip(*rows, strict=True))
                types = [pa.string() if n.endswith("sha256") else pa.int64() for n in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=names)
                rows.clear()
        if conv is not none:
            close()
            columns = list(zip(*rows, strict=True))
            names = [x.split()[0] for x in DIGEST.split(", ")]
            types = [pa.string() if n.endswith("sha256") else pa.int64() for n in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=names)

    ordered = segments.select("conv_id", "segment", "ids", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return ordered.mapInArrow(read, DIGEST)
