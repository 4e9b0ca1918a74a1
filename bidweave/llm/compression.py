"""Quality rules by compression bands.

A text that zstandard shrinks far more than prose of its length repeats itself;
one that it hardly shrinks is noise. Both the whole text and fixed chunks of it,
the last one included, are compressed, and each ratio is held against limits for
its length. The limits are fitted to the ratios of all documents of the table.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidweave.llm.common import prepare

#: (bytes at least, least ratio, greatest ratio) of raw to compressed size. Short texts carry frame
#: overhead and little context, so their band lies lower and they are never called incompressible below 64 bytes.
WHOLE_BANDS = (
    (0, 0.0, 2.0),
    (64, 0.55, 2.2),
    (128, 0.75, 2.4),
    (256, 0.95, 2.6),
    (512, 1.10, 2.8),
    (1024, 1.20, 3.0),
    (2048, 1.25, 3.2),
    (4096, 1.30, 3.4),
    (16384, 1.35, 3.8),
    (65536, 1.35, 4.5),
)
#: Bytes of a fixed chunk, and the share of a text's bytes that may stand in chunks outside the limits for their length.
CHUNK_BYTES = 4096
CHUNK_SHARE = 1 / 3
#: Fitted limits, always within the bands above: the median of a class of lengths (half octaves; their neighbours count
#: too, less by NEIGHBOUR for each half octave) and so many robust deviations, at least LEAST_WIDTH of the median. They
#: take the bands' place by n / (n + CLASS_DOCS), where n documents count, so verdicts change smoothly with a table's
#: size. Ratios are counted in steps of 1 / STEPS.
DEVIATIONS = 3.5
LEAST_WIDTH = 0.05
NEIGHBOUR = 1 / 16
FAR = 8
CLASS_DOCS = 8
STEPS = 200
TOP_STEP = 100 * STEPS
LEVEL = 3

#: Fixed values of the base rules.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
LEAST_WORDS = 10
_word = re.compile(rb"[^\x20\x09-\x0D]+").finditer
REPEAT_PERCENT = 20


@dataclass(frozen=True)
class Verdict:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    base_failed: bool
    ratio: float
    n_chunks: int
    n_bad_chunks: int
    kept: bool


#: Texts of so many bytes or more have their words numbered one by one, since a list of them would not do.
LONG = 1 << 20


def word_numbers(raw: bytes) -> np.ndarray:
    """The words of a text by the number of their first occurrence; memory by distinct words, and four bytes a word."""
    known: dict[bytes, int] = {}
    out = array("i")
    for m in _word(raw):
        out.append(known.setdefault(m[0], len(known)))
    return np.frombuffer(out, dtype=np.int32) if out else np.zeros(0, dtype=np.int32)


def _paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Numbers that are equal where both numbers are."""
    return np.unique(left.astype(np.int64) << 32 | right, return_inverse=True)[1]


def repeated_words(words: list | np.ndarray) -> int:
    """Words covered by windows of five that stand twice or more in the text, the first included."""
    if len(words) < WINDOW:
        return 0
    if isinstance(words, np.ndarray):
        twos = _paired(words[:-1], words[1:])
        fives = _paired(_paired(twos[:-2], twos[2:])[:-1], words[4:])
        hit = np.bincount(fives)[fives] > 1
    else:
        grams = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
        if len(set(grams)) == len(grams):
            return 0
        counts = Counter(grams)
        hit = np.fromiter((counts[g] > 1 for g in grams), dtype=bool, count=len(grams))
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(hit)
    cover[: len(hit)] += hit
    cover[WINDOW : WINDOW + len(hit)] -= hit
    return int((np.cumsum(cover) > 0).sum()) if len(at) else 0


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif line.strip(SPACES):
            seen.add(line)
    return n


def band(n_bytes: int) -> tuple[float, float]:
    """The limits for a text of so many bytes."""
    return next((low, high) for least, low, high in reversed(WHOLE_BANDS) if n_bytes >= least)


def class_of(n_bytes: int, n_chars: int) -> tuple[int, int]:
    """Bytes a letter, rounded (scripts of wider letters shrink otherwise), and the half octave of the length."""
    return round(n_bytes / n_chars), int(2 * math.log2(n_bytes))


def fit(counts: dict[tuple[int, int, int], int]) -> dict[tuple[int, int], tuple[float, float, float]]:
    """(low, high, weight) by class, from the documents counted by (bytes a letter, half octave, ratio in steps)."""
    limits: dict[tuple[int, int], tuple[float, float, float]] = {}
    for width in sorted({w for w, _, _ in counts}):
        own = [(o, step, n) for (w, o, step), n in sorted(counts.items()) if w == width]
        for octave in range(own[0][0] - FAR, own[-1][0] + FAR + 1):
            held: Counter[int] = Counter()
            for o, step, n in own:
                if abs(o - octave) <= FAR:
                    held[step] += n * NEIGHBOUR ** abs(o - octave)
            if held:
                middle = _median(held)
                off: Counter[int] = Counter()
                for step, n in held.items():
                    off[abs(step - middle)] += n
                reach = max(DEVIATIONS * 1.4826 * _median(off), LEAST_WIDTH * middle)
                n = sum(held.values())
                limits[width, octave] = ((middle - reach) / STEPS, (middle + reach) / STEPS, n / (n + CLASS_DOCS))
    return limits


def _median(counts: Counter[int]) -> int:
    """The lower median of values that count as much as their weights say."""
    half, found = sum(counts.values()) / 2, 0.0
    for value in sorted(counts):
        found += counts[value]
        if found >= half:
            return value
    raise ValueError("nothing counted")


def within(ratio: float, n_bytes: int, n_chars: int, limits: dict) -> bool:
    """Whether a ratio lies within the band of its length, drawn in towards the fitted limits by their weight."""
    low, high = band(n_bytes)
    if fitted := limits.get(class_of(n_bytes, n_chars)):
        low += fitted[2] * max(0.0, fitted[0] - low) if low else 0.0
        high -= fitted[2] * max(0.0, high - fitted[1])
    return low <= ratio <= high


def judge(text: str | None, compress=zstandard.ZstdCompressor(level=LEVEL).compress, limits: dict | None = None) -> Verdict:
    """Base counts and the compression verdict of one whole text. Null counts as empty; an empty text fails.

    ``limits`` are those of :func:`fit`; without them the bands alone hold.
    """
    limits = limits or {}
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split() if len(raw) < LONG else word_numbers(raw)
    repeats = repeated_words(words)
    failed = len(words) < LEAST_WORDS or 100 * repeats > REPEAT_PERCENT * len(words)
    ratio = len(raw) / len(compress(raw)) if raw else 0.0
    chunks = range(0, len(raw), CHUNK_BYTES)
    bad = bad_bytes = 0
    for at in chunks:
        part = raw[at : at + CHUNK_BYTES]
        r = ratio if len(part) == len(raw) else len(part) / len(compress(part))
        # The letters of a chunk, in proportion: a letter may be cut in two.
        if not within(r, len(part), max(1, round(len(text) * len(part) / len(raw))), limits):
            bad += 1
            bad_bytes += len(part)
    kept = bool(raw) and not failed and within(ratio, len(raw), len(text), limits) and bad_bytes <= CHUNK_SHARE * len(raw)
    return Verdict(
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        duplicate_lines(text),
        repeats,
        failed,
        ratio,
        len(chunks),
        bad,
        kept,
    )


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, n_chunks long, n_bad_chunks long, kept boolean"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each batch by class and ratio in steps."""
    compress = zstandard.ZstdCompressor(level=LEVEL).compress
    for batch in batches:
        counts: Counter[tuple[int, int, int]] = Counter()
        for t in batch.column(0):
            if text := t.as_py():
                raw = text.encode("utf-8", "surrogatepass")
                counts[*class_of(len(raw), len(text)), min(TOP_STEP, round(STEPS * len(raw) / len(compress(raw))))] += 1
        rows = [(*k, n) for k, n in counts.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=pa.int64()) for i in range(4)], names=["width", "octave", "step", "n"])


def fitted_limits(docs: DataFrame) -> dict[tuple[int, int], tuple[float, float, float]]:
    """The limits fitted to all documents of a table; only counts by class and step leave the executors."""
    prepare(docs.sparkSession)
    counted = docs.select("text").mapInArrow(_count, "width long, octave long, step long, n long")
    rows = counted.groupBy("width", "octave", "step").agg(F.sum("n").alias("n")).collect()
    return fit({(r["width"], r["octave"], r["step"]): r["n"] for r in rows})


def _measure(batches: Iterator[pa.RecordBatch], limits: dict) -> Iterator[pa.RecordBatch]:
    names = SCHEMA.replace(",", "").split()[2::2]
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
    types = [kinds[k] for k in SCHEMA.replace(",", "").split()[3::2]]
    for batch in batches:
        found = [judge(t.as_py(), limits=limits) for t in batch.column(1)]
        columns = [batch.column(0).cast(pa.int64())]
        columns += [pa.array([getattr(v, n) for v in found], type=t) for n, t in zip(names, types, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *names])


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """One row per document: base counts, ratios and ``kept``.

    Limits are fitted first, in a pass of its own; then rows are independent: no text is shuffled, repeated rows give
    repeated rows, a null id stays null, an empty table gives no rows, and other columns are never read. A null text
    counts as empty, and an empty one fails. Texts of any length are judged whole; a ratio at a limit is within it.
    """
    limits = fitted_limits(docs)
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _measure(batches, limits), SCHEMA)


def keep_compressible(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns as they came."""
    limits = fitted_limits(docs)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([judge(t.as_py(), limits=limits).kept for t in batch.column(at)], type=pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
