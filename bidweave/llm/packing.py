"""Packing by vector bin packing.

Examples are vectors of demands (tokens, segments, loss-bearing tokens); a
sequence has a limit in each. A sequence is filled by taking, again and again,
the example whose demand has the greatest dot product with what is left of it.
Every partition packs its own rows, and no text is shuffled; the pieces of the one sequence
that each partition leaves part-filled are gathered and packed once more. Documents bear loss on
every token; conversations bring a mask, and all three limits bind.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bidweave.llm.common import materialise, prepare, release

END_ID = 1


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold, and the shortest piece that is cut to fill a gap."""

    tokens: int = 2048
    segments: int = 64
    loss_tokens: int = 2048
    least_cut: int = 16

    def __post_init__(self) -> None:
        if min(self.tokens, self.segments, self.loss_tokens, self.least_cut) < 1:
            raise ValueError("every limit must be 1 or more")


#: Plain documents: nothing but the tokens is scarce, so a sequence may hold as many pieces as tokens.
DOCUMENTS = Limits(segments=2048)
#: Instruction data: few turns of many conversations, and no more than half of a sequence under the loss.
INSTRUCTIONS = Limits(loss_tokens=1024)
#: Examples that wait for a place at once; bounds memory and the cost of a choice.
WAITING = 4096


_plain = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([.,!?;:%$#&*|]*)", re.ASCII).fullmatch
_other_blank = re.compile(r"[\t\r]").search
_blank = str.maketrans("\n\t\r", "   ")


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write for bytes: printable ones as they are, the rest from 256 on."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(moved)}


#: How the tokenizer file must fold and split text for words to be encoded one by one.
WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
}


class WordCache(dict):
    """Ids of whole texts, one distinct word at a time.

    The tokenizer's pattern never matches white space, its normaliser acts within words and its special tokens
    hold no white space, so a text's ids are those of its blank-separated words in order. A word of plain Latin
    letters with marks after it is two matches, which the tokenizer's model takes as they are, folded; all others go
    through the whole tokenizer. Looking a word up for the first time works it out; long words aren't remembered. A
    tokenizer file that folds or splits otherwise gets whole texts.
    """

    MAX_WORDS = 400_000
    MAX_LENGTH = 48

    def __init__(self, path: str) -> None:
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as lines:
            config = json.load(lines)
        added = config.get("added_tokens") or []
        self.wordwise = all(config.get(k) == v for k, v in WORDWISE.items()) and not any(
            x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] or re.search(r"\s", x["content"]) or _plain(x["content"]) for x in added
        )
        self.tokenize = self.tokenizer.model.tokenize
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.runs: dict[str, bytes] = {"": b""}

    def _run(self, run: str) -> bytes:
        got = self.runs.get(run)
        if got is None:
            text = run if run.isascii() else run.encode().decode("latin-1").translate(self.letters)
            got = array("I", [t.id for t in self.tokenize(text)]).tobytes()
            if len(run) <= self.MAX_LENGTH:
                if len(self.runs) >= self.MAX_WORDS:
                    self.runs.clear()
                self.runs[run] = got
        return got

    def __missing__(self, word: str) -> bytes:
        plain = _plain(word)
        if plain:
            run, marks = plain.groups()
            got = self._run(run.lower()) + (self._run(marks) if marks else b"")
        else:
            got = self._whole(word)
        if len(word) <= self.MAX_LENGTH:
            if len(self) >= self.MAX_WORDS:
                self.clear()
            self[word] = got
        return got

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if not self.wordwise:
            return [self._whole(t) for t in texts]
        ids = self.__getitem__
        out = []
        for t in texts:
            words = t.translate(_blank) if _other_blank(t) else t.replace("\n", " ")
            out.append(b"".join(map(ids, words.split(" "))))
        return out


@lru_cache(maxsize=2)
def word_cache(path: str) -> WordCache:
    return WordCache(path)


@dataclass
class Example:
    """A document's ids from ``start`` on that still want a place.

    ``loss`` counts the loss-bearing tokens before each token, and all of them at its end; without it all bear loss.
    ``first`` tells how many ids of the document come before ``ids``.
    """

    doc_id: int | None
    ids: bytes
    start: int
    length: int
    total: int
    loss: np.ndarray | None = None
    first: int = 0

    def losses(self, size: int) -> int:
        """Loss-bearing tokens of the next ``size`` ones."""
        return size if self.loss is None else int(self.loss[self.start + size] - self.loss[self.start])

    def most(self, losses: int) -> int:
        """How many tokens come next with no more than so many loss-bearing ones."""
        if self.loss is None:
            return min(self.length, losses)
        return min(self.length, int(np.searchsorted(self.loss, self.loss[self.start] + losses, side="right")) - 1 - self.start)


class Packer:
    """Fills sequences one after the other; ``place`` is called with (example, start, length, sequence, offset)."""

    def __init__(self, limits: Limits, place: Callable[[Example, int, int, int, int], None]) -> None:
        self.limits, self.place = limits, place
        self.waiting: list[Example] = []
        self.sequence = 0

    def add(self, example: Example) -> None:
        """Take an example; whole sequences are cut off it at once."""
        full = self.limits.tokens
        while example.length >= full and example.losses(full) <= self.limits.loss_tokens:
            self.place(example, example.start, full, self.sequence, 0)
            self.sequence += 1
            example.start += full
            example.length -= full
        if example.length:
            self.waiting.append(example)
            if len(self.waiting) >= WAITING:
                self.fill(WAITING // 8)

    def fill(self, leave: int = 0) -> None:
        """Fill sequences until at most ``leave`` examples wait. Ties go to the example that came first.

        Where nothing fits whole, the first example that waits is cut, if the piece is no shorter than ``least_cut``;
        into an empty sequence a piece of any length goes, so each sequence takes something and this ends.
        """
        lim = self.limits
        scale = np.array([1 / lim.tokens, 1 / lim.segments, 1 / lim.loss_tokens])
        items = self.waiting
        length = np.array([x.length for x in items], dtype=np.int64)
        loss = np.array([x.losses(x.length) for x in items], dtype=np.int64)
        demand = np.stack([length * scale[0], np.full(len(items), scale[1]), loss * scale[2]])
        here = np.ones(len(items), dtype=bool)
        waiting = len(items)
        while waiting > leave:
            left = np.array([lim.tokens, lim.segments, lim.loss_tokens], dtype=np.int64)
            offset = 0
            while left[0] > 0 and left[1] > 0 and waiting:
                fits = here & (length <= left[0]) & (loss <= left[2])
                if fits.any():
                    value = (left * scale) @ demand
                    value[~fits] = -1
                    i = int(value.argmax())
                    size = int(length[i])
                else:
                    i = int(np.flatnonzero(here)[0])
                    size = min(int(left[0]), items[i].most(int(left[2])))
                    if offset and size < lim.least_cut:
                        break
                x = items[i]
                used = x.losses(size)
                self.place(x, x.start, size, self.sequence, offset)
                offset += size
                left -= (size, 1, used)
                x.start += size
                x.length -= size
                if x.length:  # cut: the rest waits on
                    length[i], loss[i] = x.length, loss[i] - used
                    demand[0, i], demand[2, i] = length[i] * scale[0], loss[i] * scale[2]
                else:
                    here[i] = False
                    waiting -= 1
            self.sequence += 1
        self.waiting = [x for x, stays in zip(items, here.tolist(), strict=True) if stays]


PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("ids", pa.binary()),
    ]
)


#: Part-filled sequences of the first pass that one task of the second packs again.
GATHERED = 256
#: Second-pass sequences are numbered from here on.
SECOND = 1 << 60


def _pieces(docs: DataFrame, limits: Limits, with_ids: bool, examples: Callable[[Iterator[pa.RecordBatch]], Iterator[Example | None]], id_name: str) -> DataFrame:
    """Packs the examples of each partition as they come; a None among them lets pieces out.

    The sequence that a partition leaves part-filled comes out as leftovers, with the pieces' ids and masks. The first
    pass is written; then leftovers, ``GATHERED`` sequences in a task, are packed as examples of their own.
    """
    named = [pa.field(id_name, pa.int64()), *list(PIECES)[1:]]
    whole = pa.schema([*named, pa.field("loss", pa.binary()), pa.field("left", pa.bool_())])
    ddl = ", ".join(f"{f.name} {({pa.int64(): 'long', pa.bool_(): 'boolean'}).get(f.type, 'binary')}" for f in whole)
    result = [f.name for f in (named if with_ids else named[:-1])]

    def packed(examples: Callable[[Iterator[pa.RecordBatch]], Iterator[Example | None]], first: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            base = first + (TaskContext.get().partitionId() << 36)
            rows: list[tuple[Example, int, int, int, int]] = []

            def out(left: int | None = None) -> pa.RecordBatch:
                """The rows so far; those of one sequence are leftovers."""
                made = []
                for x, start, size, sequence, offset in rows:
                    ids = x.ids[4 * start : 4 * (start + size)]
                    again = sequence == left
                    mask = np.diff(x.loss[start : start + size + 1]).astype(np.int8).tobytes() if again and x.loss is not None else None
                    made.append((x.doc_id, x.first + start, size, zlib.crc32(ids), x.total, base + sequence, offset, ids if with_ids or again else None, mask, again))
                columns = list(zip(*made, strict=True)) or [()] * len(whole)
                rows.clear()
                return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, whole, strict=True)], schema=whole)

            packer = Packer(limits, lambda *placed: rows.append(placed))
            for example in examples(batches):
                if example is None:
                    yield out()
                else:
                    packer.add(example)
            yield out()
            packer.fill()
            last = packer.sequence - 1
            used = sum(size for _, _, size, sequence, _ in rows if sequence == last)
            yield out(last if 0 < used <= limits.tokens - limits.least_cut else None)

        return run

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[Example | None]:
        for batch in batches:
            for doc_id, start, size, total, ids, mask in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                loss = None if mask is None else np.concatenate([[0], np.cumsum(np.frombuffer(mask, dtype=np.int8), dtype=np.int64)])
                yield Example(doc_id, ids, 0, size, total, loss, start)
            yield None

    spark = docs.sparkSession
    once, path = materialise(docs.mapInArrow(packed(examples, 0), ddl), "packed")
    release(spark, path)
    left = once.where("left")
    sequences = left.select("sequence_id").distinct().count()
    tasks = max(1, -(-sequences // GATHERED))
    dealt = left.repartitionByRange(tasks, "sequence_id").sortWithinPartitions("sequence_id", "offset") if tasks > 1 else left.coalesce(1).sortWithinPartitions("sequence_id", "offset")
    second = dealt.select(id_name, "start", "length", "doc_tokens", "ids", "loss").mapInArrow(packed(again, SECOND), ddl)
    return once.where(~F.col("left")).select(*result).unionByName(second.select(*result))


def pack_documents(docs: DataFrame, path: str, limits: Limits = DOCUMENTS, with_ids: bool = True) -> DataFrame:
    """One row per piece: which ids of which document stand where in which sequence.

    A document's ids are its tokens and an end id; null counts as empty, so every row, one without doc_id too, has one
    id at least. All ids bear loss. A sequence's id is its partition and its number there (from ``SECOND`` on for those
    packed from leftovers); at most one sequence for each ``GATHERED`` partitions is left part-filled, up to gaps below
    ``least_cut``. ``ids`` holds the piece's ids as little-endian
    unsigned 32-bit integers. Texts of any length are taken whole; repeated rows are packed as often as they occur,
    and of examples as good as another the first goes first; other columns are not read; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    end = np.array([END_ID], dtype="<u4").tobytes()

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[Example | None]:
        cache = word_cache(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc_id, ids in zip(part.column(0).to_pylist(), cache.encode(texts), strict=True):
                    n = len(ids) // 4 + 1
                    yield Example(doc_id, ids + end, 0, n, n)
            yield None

    return _pieces(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), limits, with_ids, examples, "doc_id")


def pack_conversations(segments: DataFrame, limits: Limits = INSTRUCTIONS, with_ids: bool = True) -> DataFrame:
    """One row per piece of formatted conversations (``chat.format_conversations``), under all three limits.

    The loss-bearing tokens are those under the segments' masks. Examples are runs of a conversation's segments as
    they come, up to a sequence long, so a conversation of any length needs the memory of one; ``start`` counts from the
    conversation's first token, ``doc_tokens`` the tokens of the run. Each token lies in exactly one piece. A null
    conv_id stays null; an empty table gives no rows.
    """
    prepare(segments.sparkSession)

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[Example | None]:
        held: list[tuple[bytes, bytes]] = []
        conv, first, size = None, 0, 0

        def closed() -> Iterator[Example]:
            if held:
                ids = b"".join(x for x, _ in held)
                mask = np.frombuffer(b"".join(y for _, y in held), dtype=np.int8)
                loss = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
                held.clear()
                yield Example(conv, ids, 0, len(mask), len(mask), loss, first)

        for batch in batches:
            for conv_id, place, ids, mask in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if conv_id != conv or place != first + size or size + len(mask) > limits.tokens:
                    yield from closed()
                    conv, first, size = conv_id, place, 0
                held.append((ids, mask))
                size += len(mask)
            yield None
        yield from closed()

    return _pieces(segments.select("conv_id", "first_token", "ids", "loss"), limits, with_ids, examples, "conv_id")
