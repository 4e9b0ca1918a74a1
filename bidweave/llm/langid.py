"""Language identification by cross-parsing entropy.

A suffix automaton per language holds every substring of that language's
training text. A text is parsed greedily into the longest phrases that each
automaton knows; the language that needs the fewest phrases, normalised by what
a phrase costs (log2 of its training length), wins.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidweave.llm.common import held_out, prepare

#: Bounds of the training sample: documents and characters a language, and characters of the passage taken of a document.
SAMPLE_DOCS = 96
SAMPLE_CHARS = 24_000
DOC_CHARS = 800
#: One passage in so many is not learnt from; it tells how long a language's phrases are in texts of that language.
CHECK_EACH = 8
UNKNOWN = "und"
#: A document whose winner's phrases are shorter than this share of what the language's passages have (their median),
#: or than LEAST_PHRASE letters, is in no known language. A letter that no training text has is a phrase of its own.
PHRASE_SHARE = 0.45
LEAST_PHRASE = 1.1
#: Bytes of the table of frequent letters, letters walked without a break, and characters of texts walked at once.
TABLE_BYTES = 64 << 20
BLOCK = 2048
BATCH_CHARS = 4_000_000


def suffix_automaton(text: Sequence) -> tuple[list[dict], list[int], list[int]]:
    """Transitions, suffix links and longest lengths of the states (online construction, linear time)."""
    moves: list[dict] = [{}]
    link, length = [-1], [0]
    last = 0
    for ch in text:
        new = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at >= 0 and ch not in moves[at]:
            moves[at][ch] = new
            at = link[at]
        if at >= 0:
            to = moves[at][ch]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                copy = len(moves)
                moves.append(dict(moves[to]))
                link.append(link[to])
                length.append(length[at] + 1)
                while at >= 0 and moves[at].get(ch) == to:
                    moves[at][ch] = copy
                    at = link[at]
                link[to] = link[new] = copy
        last = new
    return moves, link, length


class Model:
    """Transitions of all languages' automata.

    Every letter of the training texts has a code, and each run of other characters is one blank. The most frequent
    letters, as many as ``TABLE_BYTES`` allow for, have columns of a table; transitions by the others are found by
    bisection. An entry holds the next state and, in its lowest bit, whether a new phrase began. A letter that a
    language's text lacks is a phrase of its own there. Many texts are walked side by side, one step at a time.
    """

    def __init__(self, texts: dict[str, str], checks: dict[str, tuple[str, ...]] | None = None) -> None:
        self.langs = sorted(k for k, v in texts.items() if v)
        counts = Counter(ch for k in self.langs for ch in texts[k] if ch.isalpha())
        letters = [ch for ch, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]
        self.code = np.full(0x110000, 1, dtype=np.int32)  # 1: a letter without a code, 2: the blank
        alpha = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
        self.code[~alpha] = 2
        for i, ch in enumerate(letters):
            self.code[ord(ch)] = i + 3
        self.n_codes = len(letters) + 3
        automata = [suffix_automaton(self.encode(texts[k]).tolist())[0] for k in self.langs]
        # The last state of each language comes before a text and after a letter that it lacks.
        sizes = [len(moves) + 1 for moves in automata]
        states = sum(sizes)
        self.width = min(self.n_codes, max(3, TABLE_BYTES // (4 * max(1, states))))
        self.table = np.empty((states, self.width), dtype=np.int32)
        self.fresh = np.zeros((len(self.langs), 1), dtype=np.int64)
        keys, values = [], []
        self.cost = [math.log2(max(2, len(texts[k]))) for k in self.langs]
        base = 0
        for i, (moves, n) in enumerate(zip(automata, sizes, strict=True)):
            fresh = self.fresh[i, 0] = base + n - 1
            first = np.full(self.width, fresh << 1 | 1, dtype=np.int32)
            for at, out in ((n - 1, moves[0]), *enumerate(moves)):
                began = at in (0, n - 1)
                if at == n - 1:
                    for ch, to in out.items():
                        if ch < self.width:
                            first[ch] = (base + to) << 1 | 1
                    self.table[base : base + n] = first
                for ch, to in out.items():
                    if ch >= self.width:
                        keys.append((base + at) * self.n_codes + ch)
                        values.append((base + to) << 1 | began)
                    elif not began:
                        self.table[base + at, ch] = (base + to) << 1
            base += n
        order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
        self.keys, self.values = np.array(keys, dtype=np.int64)[order], np.array(values, dtype=np.int32)[order]
        self.table = self.table.ravel()
        self.limit = [LEAST_PHRASE] * len(self.langs)
        for i, k in enumerate(self.langs):
            encoded = [codes for codes in map(self.encode, (checks or {}).get(k, ())) if len(codes)]
            if encoded:
                lengths = np.array(list(map(len, encoded))) / self.phrases(encoded)[:, i]
                self.limit[i] = max(LEAST_PHRASE, PHRASE_SHARE * float(np.median(lengths)))

    def _seldom(self, state: np.ndarray, step: np.ndarray) -> np.ndarray:
        """The entries for letters without a column."""
        if not len(self.keys):
            return np.broadcast_to(self.fresh << 1 | 1, state.shape)

        def found(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            return self.keys[at] == key, self.values[at]

        known, entry = found(state.astype(np.int64) * self.n_codes + step)
        begins, anew = found(self.fresh * self.n_codes + step[None, :])
        return np.where(known, entry, np.where(begins, anew, self.fresh << 1 | 1))

    def encode(self, text: str) -> np.ndarray:
        """Codes of a text: folded letters, one blank for each run of others, none at its ends."""
        codes = self.code[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        blank = codes == 2
        keep = ~blank
        keep[1:] |= ~blank[:-1]
        codes = codes[keep]
        start, end = 0, len(codes)
        if end and codes[0] == 2:
            start = 1
        if end > start and codes[-1] == 2:
            end -= 1
        return codes[start:end]

    def phrases(self, encoded: list[np.ndarray]) -> np.ndarray:
        """Phrases by text and language; a text is walked in blocks, and no phrase spans two of them."""
        owner, blocks = [], []
        for i, codes in enumerate(encoded):
            for at in range(0, len(codes), BLOCK):
                owner.append(i)
                blocks.append(codes[at : at + BLOCK])
        out = np.zeros((len(encoded), len(self.langs)), dtype=np.int64)
        if not blocks or not self.langs:
            return out
        lengths = np.array([len(x) for x in blocks])
        order = np.argsort(-lengths, kind="stable")
        steps = np.zeros((lengths[order[0]], len(blocks)), dtype=np.int32)
        for lane, i in enumerate(order):
            steps[: lengths[i], lane] = blocks[i]
        active = np.searchsorted(-lengths[order], -np.arange(1, len(steps) + 1), side="right")
        state = np.repeat(self.fresh.astype(np.int32), len(blocks), axis=1)
        ends = np.zeros(state.shape, dtype=np.int32)
        width = np.int32(self.width)
        seldom = steps >= width
        any_seldom = seldom.any(axis=1)
        for at, (step, n) in enumerate(zip(steps, active.tolist(), strict=True)):
            if any_seldom[at]:
                rare = np.flatnonzero(seldom[at, :n])
                got = self.table.take(state[:, :n] * width + np.where(seldom[at, :n], 1, step[:n]))
                got[:, rare] = self._seldom(state[:, rare], step[rare])
            else:
                got = self.table.take(state[:, :n] * width + step[:n])
            ends[:, :n] += got & 1
            state[:, :n] = got >> 1
        np.add.at(out, np.array(owner)[order], ends.T)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float, bool]]:
        """Language, score, letters a phrase, and whether the phrases are long enough for the language.

        Null and letterless text, and an empty model, give ``und``, 0, 0. A text whose letters no training text has is
        all phrases of one letter: the language with the least cost wins, and the phrases are too short for it.
        """
        found: list[tuple[str, float, float, bool]] = []
        start = 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and size < BATCH_CHARS:
                size += len(texts[end] or "")
                end += 1
            encoded = [self.encode(t or "") for t in texts[start:end]]
            for codes, counts in zip(encoded, self.phrases(encoded), strict=True):
                if not self.langs or not (codes != 2).any():
                    found.append((UNKNOWN, 0.0, 0.0, False))
                    continue
                costs = [c * w for c, w in zip(counts.tolist(), self.cost, strict=True)]
                best = min(range(len(costs)), key=lambda i: (costs[i], self.langs[i]))
                total = sum(math.exp(max(-60.0, (costs[best] - c) / self.cost[best])) for c in costs)
                length = len(codes) / int(counts[best])
                found.append((self.langs[best], 1.0 / total, length, length >= self.limit[best] and bool((codes > 2).any())))
            start = end
        return found


def training_texts(docs: DataFrame) -> dict[str, tuple[str, tuple[str, ...]]]:
    """Bounded training text, and passages to check it on, by language, from rows with a language whose id is not held out.

    At most ``SAMPLE_DOCS`` passages a language, in the order of a hash of the documents' ids; a passage is
    ``DOC_CHARS`` characters from a place that a hash sets. Equal passages count once.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    key = F.col("doc_id").cast("string")
    rank = F.crc32(F.concat(F.lit("lang"), key).cast("binary"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    picked = F.lit(False)
    for lang, n in counts.items():
        share = min(1.0, (1.2 * SAMPLE_DOCS + 40) / n)
        picked |= (F.col("lang") == lang) & (rank <= int(share * 0xFFFFFFFF))
    start = 1 + F.pmod(F.crc32(F.concat(F.lit("passage"), key).cast("binary")), F.greatest(F.lit(1), F.length("text") - DOC_CHARS + 1))
    sample = rows.where(picked).select("lang", rank.alias("_rank"), F.lower(F.substring("text", start.cast("int"), F.lit(DOC_CHARS))).alias("_passage")).distinct()
    first = Window.partitionBy("lang").orderBy("_rank", "_passage")
    sample = sample.withColumn("_at", F.row_number().over(first)).where(F.col("_at") <= 2 * SAMPLE_DOCS).drop("_at")
    passages: dict[str, dict[str, None]] = {lang: {} for lang in counts}
    for r in sorted(sample.collect(), key=tuple):
        if len(passages[r["lang"]]) < SAMPLE_DOCS:
            passages[r["lang"]].setdefault(r["_passage"])
    out = {}
    for lang, parts in passages.items():
        every = list(parts)
        checks = every[CHECK_EACH - 1 :: CHECK_EACH]
        held = set(checks)
        out[lang] = ("\n".join(x for x in every if x not in held)[:SAMPLE_CHARS], tuple(checks))
    return out


_models: dict[tuple, Model] = {}


def _model(key: tuple[tuple[str, tuple[str, tuple[str, ...]]], ...]) -> Model:
    """One model a worker and training set."""
    if key not in _models:
        _models.clear()
        _models[key] = Model({k: v[0] for k, v in key}, {k: v[1] for k, v in key})
    return _models[key]


def identify(docs: DataFrame, texts: dict[str, tuple[str, tuple[str, ...]]] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and phrase_chars of every whole text.

    Rows are independent and no text is shuffled: repeated rows repeat, a row without doc_id is judged as any other
    (and not held out), other columns are not read, and an empty table gives no rows. A text of any length is walked
    in blocks. Null or letterless text: ``und`` with score 0; a text in letters that no training text has gets the
    language that costs it least, by phrases of a letter each. No training rows: ``und`` for all. Ties go to the language first in the alphabet.
    """
    spark = docs.sparkSession
    prepare(spark)
    key = spark.sparkContext.broadcast(tuple(sorted((texts if texts is not None else training_texts(docs)).items())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(key.value)
        for batch in batches:
            found = model.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    batch.column(1),
                    pa.array([f[0] for f in found], type=pa.string()),
                    pa.array([f[1] for f in found], type=pa.float64()),
                    pa.array([f[2] for f in found], type=pa.float64()),
                ],
                names=["doc_id", "held_out", "lang_pred", "score", "phrase_chars"],
            )

    schema = "doc_id long, held_out boolean, lang_pred string, score double, phrase_chars double"
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, schema)


def keep_known_language(docs: DataFrame) -> DataFrame:
    """The documents in a learned language, with all their columns; ``und``, those of too short phrases and those without a learned letter go.

    Repeated rows stay as often as they occur; an empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    key = spark.sparkContext.broadcast(tuple(sorted(training_texts(docs).items())))
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(key.value)
        for batch in batches:
            found = model.predict(batch.column(at).to_pylist())
            yield batch.filter(pa.array([f[3] for f in found], type=pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
