"""The training-data operators against brute force, round trips and planted cases."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bidweave.llm import bpe, chat, components, compression, embed_dedup, jaccard, langid, license_scan, packing, sharding, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, slot long, size long, key long"


def words(rng: random.Random, n: int, pool: int = 5000) -> str:
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Texts with nulls, blanks, copies, near copies, a long one, repeated rows and clashing columns."""
    rng = random.Random(4)
    base = words(rng, 120)
    texts = [words(rng, rng.randrange(10, 80)) for _ in range(40)] + [base] * 5
    for k in range(12):
        parts = base.split()
        parts[10 * k % 110] = f"edit{k}"
        texts.append(" ".join(parts))
    texts += [None, "", "   ", "\n", "one two", "one two", "é ß 漢字 x y z", words(rng, 30000), "a b c d e", "a b c d e"]
    out = [(i, t, "en" if i % 2 else None, f"src{i % 3}", None, 1, 2, 3) for i, t in enumerate(texts)]
    return [*out, out[0], out[0], (None, "nameless row of a few words", "en", None, None, 1, 2, 3), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- 1 ----------------------------------------------------------------------------------------------------------


def test_shards_are_even_gapless_and_whole(docs, rows, empty):
    slotted = sharding.with_slots(docs).persist()
    sums = sharding.slot_sums(slotted)
    first = sharding.SlotMap.initial(8)
    then = first.rebalanced({k: b for k, (_, b) in sums.items()})
    got = sharding.shard_documents(slotted, then, sums).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
        assert then.shard_of[r["virtual_slot"]] == r["shard"] and r["grown_shard"] is None and r["law"] == "bytes"
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.shard_documents(sharding.with_slots(empty), then, {}).count() == 0


def test_repeated_rows_are_spread(spark):
    rng = random.Random(1)
    made = [(1, "the same text")] * 6000 + [(None, None)] * 300 + [(i, words(rng, 5)) for i in range(2, 3000)]
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(5)
    slotted = sharding.with_slots(df).persist()
    sums = sharding.slot_sums(slotted)
    assert max(n for n, _ in sums.values()) < 100

    def slots(rows, partitions):
        found = sharding.with_slots(spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)).collect()
        return Counter({(r["doc_id"], r["text_crc32"], r["virtual_slot"]): r["copies"] for r in found})

    # Slots depend on the rows alone, and rows that come later move none.
    few = made[5900:6400]
    assert slots(few, 1) == slots(few, 7) and slots(few, 3) <= slots(few + [(1, "the same text")] * 33 + [(9999, "new")], 2)
    then = sharding.SlotMap.initial(8).rebalanced({k: b for k, (_, b) in sums.items()})
    load, places = Counter(), defaultdict(list)
    for r in sharding.shard_documents(slotted, then, sums).collect():
        load[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
    assert max(load.values()) - min(load.values()) < 0.001 * sum(load.values())
    assert all(sorted(v) == list(range(len(v))) for v in places.values()) and sum(map(len, places.values())) == len(made)


def test_rebalancing_is_close_and_moves_little():
    rng = random.Random(2)
    sums = {s: rng.randrange(1, 40_000) for s in range(sharding.SLOTS)}
    sums[7] = 4_000_000
    first = sharding.SlotMap.initial(8)
    then = first.rebalanced(sums)
    load = Counter()
    for s, k in enumerate(then.shard_of):
        load[k] += sums[s]
    assert max(load.values()) - min(load.values()) <= 1e-3 * sum(load.values()) / 8
    assert then.version == 2 and first.moved(then) < sharding.SLOTS / 4
    grown = then.rebalanced(sums, shards=9)
    assert set(grown.shard_of) == set(range(9)) and grown.version == 3


def test_slot_map_round_trip(spark, tmp_path):
    m = sharding.SlotMap.initial(8).rebalanced({0: 5, 8: 9})
    m.save(spark, f"file://{tmp_path}/map")
    assert sharding.SlotMap.load(spark, f"file://{tmp_path}/map", 2) == m


# --- 2 ----------------------------------------------------------------------------------------------------------


def brute_links(vectors):
    good = {}
    for vec_id, v, label in vectors:
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        good[vec_id] = (label, np.array(v, dtype=np.float64))
    ids = sorted(good)
    near = defaultdict(set)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            (la, va), (lb, vb) = good[a], good[b]
            if la == lb and len(va) == len(vb) and va @ vb / np.linalg.norm(va) / np.linalg.norm(vb) >= 0.98:
                near[a].add(b)
                near[b].add(a)
    part = {}
    for a in ids:
        if a not in part:
            stack = [a]
            while stack:
                x = stack.pop()
                if x not in part:
                    part[x] = a
                    stack += near[x]
    return {v[0]: (len(near[v[0]]), part.get(v[0], v[0])) for v in vectors if v[0] is not None}


def test_embedding_links_are_exact(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vectors = []
    centres = rng.normal(size=(6, 16))
    for i in range(600):
        v = centres[i % 6] + rng.normal(size=16) * rng.choice([0.05, 0.2, 1.0])
        vectors.append((i, v.astype(np.float32).tolist(), i % 2))
    vectors += [(600 + i, vectors[3][1], 1) for i in range(40)] + [(700, None, 1), (701, [0.0] * 16, 1), (702, [float("nan")] * 16, 1)]
    vectors += [(703, [None] + [1.0] * 15, 1), (704, vectors[0][1], None), (705, [1.0, 2.0], 1), (None, vectors[0][1], 0)]
    monkeypatch.setattr(embed_dedup, "CELL", 64)
    monkeypatch.setattr(embed_dedup, "BLOCK", 32)
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.near_duplicates(df).collect()}
    assert got.pop(None) == (0, None)
    assert got == brute_links(vectors)
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


# --- 3 ----------------------------------------------------------------------------------------------------------


def plain_phrases(train, text):
    n, at = 0, 0
    while at < len(text):
        size = 1
        while at + size <= len(text) and text[at : at + size] in train:
            size += 1
        at += max(1, size - 1)
        n += 1
    return n


def test_phrases_equal_plain_parsing(monkeypatch):
    rng = random.Random(3)
    train = {"a": "".join(rng.choice("abc d") for _ in range(300)), "b": "".join(rng.choice("cde f") for _ in range(300))}
    train = {k: " ".join(v.split()) for k, v in train.items()}
    texts = ["".join(rng.choice("abcdefz1, ") for _ in range(rng.randrange(1, 200))) for _ in range(50)]
    texts.append("abc" * 2 * langid.BLOCK)
    folded = [" ".join("".join(c if c.isalpha() else " " for c in t).split()) for t in texts]
    for table_bytes in (langid.TABLE_BYTES, 24_000, 1):  # all letters have a column, a few do, none does
        monkeypatch.setattr(langid, "TABLE_BYTES", table_bytes)
        model = langid.Model(train)
        got = model.phrases([model.encode(t) for t in texts])
        for t, f, n in zip(texts, folded, got, strict=True):
            blocks = [f[i : i + langid.BLOCK] for i in range(0, len(f), langid.BLOCK)]
            assert n.tolist() == [sum(plain_phrases(train[k], b) for b in blocks) for k in ("a", "b")], t
    assert model.width == 3


def plain_score(texts, text):
    """Cost by language as the definition has it."""
    folded = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())
    blocks = [folded[i : i + langid.BLOCK] for i in range(0, len(folded), langid.BLOCK)]
    cost = {}
    for k, t in texts.items():
        train = " ".join("".join(c if c.isalpha() else " " for c in t).split())
        w = math.log2(len(t))
        cost[k] = (sum(plain_phrases(train, b) for b in blocks) * w, w)
    best = min(cost, key=lambda k: (cost[k][0], k))
    return best, 1 / sum(math.exp(max(-60.0, (cost[best][0] - c) / cost[best][1])) for c, _ in cost.values())


def test_scores_equal_the_definition():
    rng = random.Random(12)
    texts = {k: " ".join("".join(rng.choice(s) for _ in range(rng.randrange(2, 6))) for _ in range(80)) for k, s in {"p": "abcdef", "q": "cdefgh", "r": "漢字仮名交文"}.items()}
    model = langid.Model(texts)
    for _ in range(40):
        t = " ".join("".join(rng.choice("abcdefgh漢字z") for _ in range(4)) for _ in range(rng.randrange(1, 12)))
        lang, score, _, _ = model.predict([t])[0]
        assert (lang, round(score, 9)) == (plain_score(texts, t)[0], round(plain_score(texts, t)[1], 9))


def test_scripts_that_were_not_learnt_are_rejected(spark):
    rng = random.Random(13)
    han = [chr(0x4E00 + i) for i in range(1500)]
    common = ["".join(rng.choice(han[:300]) for _ in range(2)) for _ in range(300)]

    def chinese():
        return "".join(rng.choice(common) if rng.random() < 0.8 else rng.choice(han) for _ in range(120))

    vocab = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(2, 7))) for _ in range(200)]
    made = [(i, chinese() if i % 2 else " ".join(rng.choice(vocab) for _ in range(60)), "zh" if i % 2 else "en") for i in range(300)]
    made += [(1000 + i, "".join(chr(0x0E01 + rng.randrange(40)) for _ in range(200)), None) for i in range(3)]  # Thai
    made += [(1010 + i, " ".join("".join(chr(0xAC00 + rng.randrange(3000)) for _ in range(4)) for _ in range(40)), None) for i in range(3)]  # Hangul
    df = spark.createDataFrame(made, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in langid.identify(df).collect()}
    # In the query such texts get a learned language (of as good as no score beyond the others'), the filter drops them.
    assert all(out[i]["lang_pred"] in ("en", "zh") and out[i]["phrase_chars"] < 1.5 for i in out if i >= 1000)
    assert all(out[i]["lang_pred"] == lang for i, _, lang in made if lang)
    kept = {r["doc_id"] for r in langid.keep_known_language(df).collect()}
    assert kept == set(range(300))


def test_two_hundred_languages_fit_in_memory():
    rng = random.Random(14)
    texts = {}
    for k in range(200):
        own = [chr(0x4E00 + rng.randrange(8000)) for _ in range(40)]
        texts[f"l{k:03}"] = " ".join("".join(rng.choice(own) for _ in range(4)) for _ in range(200))
    model = langid.Model(texts)
    assert model.table.nbytes <= langid.TABLE_BYTES and len(model.langs) == 200
    assert all(model.predict([t[100:400]])[0][0] == k for k, t in list(texts.items())[::20])


def test_languages_are_told_apart(spark, empty):
    rng = random.Random(5)
    vocab = {k: [("".join(rng.choice(s) for _ in range(rng.randrange(2, 7)))) for _ in range(200)] for k, s in {"xx": "abcdefgh", "yy": "efghijkl", "zz": "ijklmnop"}.items()}
    made = [(i, " ".join(rng.choice(vocab[k]) for _ in range(60)), k) for i, k in enumerate(["xx", "yy", "zz"] * 80)]
    made += [(900, None, "xx"), (901, "12 !! 34", "yy"), (902, "", "zz"), (None, made[0][1], "xx")]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    out = langid.identify(df).collect()
    truth = {i: k for i, _, k in made}
    scored = [r for r in out if r["doc_id"] is not None and r["doc_id"] < 900]
    held = [r for r in scored if r["held_out"]]
    assert held and all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["held_out"] for r in scored)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in out)
    assert {r["lang_pred"] for r in out if r["doc_id"] in (900, 901, 902)} == {"und"}
    assert langid.identify(empty).count() == 0
    kept = langid.keep_known_language(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()}.isdisjoint({900, 901, 902})
    assert {r["lang_pred"] for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# --- 4 ----------------------------------------------------------------------------------------------------------


def plain_counts(text):
    import re

    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen = Counter(grams)
    cover = {j for i, g in enumerate(grams) if seen[g] > 1 for j in range(i, i + 5)}
    earlier, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in earlier
            earlier.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


def test_base_counts_equal_plain_ones(docs, rows, empty):
    extra = ["a b c d e f a b c d e", "x\nx\n \n \nx y", "a\x1cb\x85c\xa0d # * $", "# | < > & % $ *" * 3]
    for t in [r[1] for r in rows] + extra:
        v = compression.judge(t)
        assert (v.n_words, v.word_chars, v.n_symbols, v.n_dup_lines, v.n_repeat_words) == plain_counts(t)
        assert v.base_failed == (v.n_words < 10 or 100 * v.n_repeat_words > 20 * v.n_words)
        assert not (v.kept and v.base_failed)
    got = compression.quality_verdicts(docs)
    assert got.count() == len(rows) and compression.quality_verdicts(empty).count() == 0
    kept = compression.keep_compressible(docs)
    limits = compression.fitted_limits(docs)
    assert kept.schema == docs.schema
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in docs.collect() if compression.judge(r["text"], limits=limits).kept)


def test_bands_reject_loops_and_noise():
    rng = random.Random(1)
    prose = words(rng, 400)
    assert compression.judge(prose).kept
    # Repetition that windows of five words miss: few words in random order.
    assert not compression.judge(" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "la", "mu"]) for _ in range(3000))).kept
    noise = " ".join(base64.b64encode(rng.randbytes(9)).decode() for _ in range(600))
    assert compression.judge(noise).ratio < compression.judge(prose).ratio
    half = words(rng, 900) + " " + " ".join(rng.choice("ab") * 6 for _ in range(2000))
    assert compression.judge(half).n_bad_chunks > 0


def test_limits_follow_the_documents(spark):
    rng = random.Random(7)
    prose = [words(rng, rng.randrange(100, 400)) for _ in range(1500)]
    junk = " ".join(f"w{rng.randrange(100)}" for _ in range(300))
    assert compression.judge(junk).kept  # within the bands, but far from the rest
    df = spark.createDataFrame(list(enumerate([*prose, junk])), "doc_id long, text string").repartition(3)
    rows = {r["doc_id"]: r for r in compression.quality_verdicts(df).collect()}
    assert not rows[len(prose)]["kept"] and not rows[len(prose)]["base_failed"]
    assert sum(not rows[i]["kept"] for i in range(len(prose))) < 0.03 * len(prose)
    kept = {r["doc_id"] for r in compression.keep_compressible(df).collect()}
    assert kept == {i for i, r in rows.items() if r["kept"]}


def plain_limits(texts):
    """Limits by class, from the ratios themselves."""
    by = defaultdict(list)
    for t in texts:
        if t:
            raw = t.encode()
            ratio = len(raw) / len(zstandard.ZstdCompressor(level=3).compress(raw))
            by[round(len(raw) / len(t)), math.floor(2 * math.log2(len(raw)))].append(min(20_000, round(200 * ratio)))
    limits = {}

    def middle(weighed):
        half, found = sum(w for _, w in weighed) / 2, 0
        for x, w in sorted(weighed):
            found += w
            if found >= half:
                return x

    for width in {w for w, _ in by}:
        octaves = [o for w, o in by if w == width]
        for octave in range(min(octaves) - 8, max(octaves) + 9):
            weighed = [(x, 16.0 ** -abs(o - octave)) for o in octaves if abs(o - octave) <= 8 for x in by[width, o]]
            if weighed:
                mid = middle(weighed)
                mad = middle([(abs(x - mid), w) for x, w in weighed])
                reach = max(3.5 * 1.4826 * mad, 0.05 * mid)
                n = sum(w for _, w in weighed)
                limits[width, octave] = (mid - reach) / 200, (mid + reach) / 200, n / (n + 8)
    return limits


def plain_kept(text, limits):
    n_words, _, _, _, repeats = plain_counts(text)
    if n_words < 10 or 100 * repeats > 20 * n_words:
        return False
    raw = text.encode()

    def inside(part, n_chars):
        ratio = len(part) / len(zstandard.ZstdCompressor(level=3).compress(part))
        low, high = next((lo, hi) for least, lo, hi in reversed(compression.WHOLE_BANDS) if len(part) >= least)
        own = limits.get((round(len(part) / n_chars), math.floor(2 * math.log2(len(part)))))
        if own:
            low, high = (low + own[2] * max(0, own[0] - low) if low else low), high - own[2] * max(0, high - own[1])
        return low <= ratio <= high

    chunks = [raw[i : i + 4096] for i in range(0, len(raw), 4096)]
    bad = sum(len(c) for c in chunks if not inside(c, max(1, round(len(text) * len(c) / len(raw)))))
    return inside(raw, len(text)) and bad <= len(raw) / 3


def test_verdicts_equal_plain_ones(spark):
    rng = random.Random(17)
    texts = [words(rng, rng.randrange(12, 900)) for _ in range(1200)] + ["漢字仮名 交文 " * 3 + words(rng, 20) for _ in range(10)]
    texts += [" ".join(f"w{rng.randrange(rng.choice([5, 60, 300]))}" for _ in range(rng.randrange(50, 900))) for _ in range(80)]
    texts += [" ".join(base64.b64encode(rng.randbytes(9)).decode() for _ in range(rng.randrange(10, 600))) for _ in range(40)] + [None, "", "short"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    limits = plain_limits(texts)
    got = {r["doc_id"]: r["kept"] for r in compression.quality_verdicts(df).collect()}
    assert limits and got == {i: plain_kept(t, limits) for i, t in enumerate(texts)}
    assert 0 < sum(not got[i] and not compression.judge(t).base_failed for i, t in enumerate(texts)) < 200


def test_long_texts_count_as_short_ones(monkeypatch):
    rng = random.Random(18)
    texts = [" ".join(f"w{rng.randrange(rng.choice([4, 40, 4000]))}" for _ in range(rng.randrange(0, 300))) for _ in range(60)]
    short = [compression.judge(t) for t in texts]
    monkeypatch.setattr(compression, "LONG", 0)
    assert [compression.judge(t) for t in texts] == short


def test_the_last_chunk_is_judged():
    rng = random.Random(8)
    head = words(rng, 2000)[: compression.CHUNK_BYTES - 1] + " "
    tail = " ".join(rng.choice(["ab", "cd", "ef"]) for _ in range(1300))[:3500]
    v = compression.judge(head + tail)
    assert (v.n_chunks, v.n_bad_chunks) == (2, 1)


# --- 5 ----------------------------------------------------------------------------------------------------------


def test_chat_reads_back(spark):
    hard = [c + "x" + c for c in chat.CONTROLS] + ["\\", "\\-", "<\\-/s>", "<<<SYS>>", "é\n漢", "", None, "[INST[INST]]"]
    made = [(i // 5, i % 5, ["user", "assistant", "system", None, "assistant"][i % 5], t) for i, t in enumerate(hard)]
    made += [(None, 0, "user", "no conversation"), (50, 1, "assistant", "tie b"), (50, 1, "assistant", "tie a"), (50, None, "user", "first")]
    rng = random.Random(15)
    made += [(7, None if k % 3 == 0 else k % 40, rng.choice(["assistant", "user"]), words(rng, rng.randrange(0, 9))) for k in range(3000)]  # a hot conversation
    df = spark.createDataFrame(made, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(1))
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    segments = chat.format_conversations(df, path, public_tokenizers.PATTERN)
    got = {r["conv_id"]: r for r in chat.read_back(segments, path, public_tokenizers.PATTERN).collect()}
    by = defaultdict(list)
    for c, t, role, text in made:
        by[c].append((t if t is not None else -1, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        if turns:
            turns.sort()
            said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
            loss = "".join(x for _, r, x in turns if r == "assistant")
            assert got[c]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
            assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
            assert got[c]["loss_chars"] == len(loss) and got[c]["n_turns"] == len(turns)
            assert got[c]["formatted_chars"] == sum(24 + len(chat.escape(r)) + len(chat.escape(x)) - 24 + sum(map(len, chat.MARKS.values())) for _, r, x in turns)
    assert got[50]["n_turns"] == 3 and got[7]["n_turns"] == 3000
    places = defaultdict(list)
    for r in segments.collect():
        places[r["conv_id"]].append((r["segment"], r["first_token"], len(r["loss"])))
    for rows in places.values():
        at = 0
        for k, (segment, first, n) in enumerate(sorted(rows)):
            assert (segment, first) == (k, at)
            at += n
    for t in hard:
        if t:
            assert chat.unescape(chat.escape(t)) == t and not any(c in chat.escape(t) for c in chat.CONTROLS)
    assert chat.read_back(chat.format_conversations(df.limit(0), path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN).count() == 0


# --- 6 ----------------------------------------------------------------------------------------------------------


def check_pieces(got, rows, limit=2048):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in rows:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1]
        want[(r[0], len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))] += 1
    by_seq = defaultdict(list)
    for r in got:
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    for pieces in by_seq.values():
        pieces.sort()
        at = 0
        for offset, length in pieces:
            assert offset == at
            at += length
        assert at <= limit
    found = Counter()
    by_doc = defaultdict(list)
    for r in got:
        by_doc[(r["doc_id"], r["doc_tokens"])].append((r["start"], bytes(r["ids"])))
    for (doc_id, total), pieces in by_doc.items():
        copies = sum(len(b) for _, b in pieces) // (4 * total)
        starts = Counter(s for s, _ in pieces)
        if copies == 1:
            ids = b"".join(b for _, b in sorted(pieces))
            assert len(ids) == 4 * total
            found[(doc_id, total, zlib.crc32(ids))] += 1
        else:
            assert starts[0] == copies
            found.update({k: v for k, v in want.items() if k[0] == doc_id and k[1] == total})
    assert found == want


def test_packing_keeps_every_id(docs, rows, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack_documents(docs.coalesce(1), path).collect()
    check_pieces(got, rows)
    used = Counter()
    for r in got:
        used[r["sequence_id"]] += r["length"]
    assert sum(used.values()) / (2048 * len(used)) > 0.95
    assert packing.pack_documents(empty, path).count() == 0


def test_short_rows_share_sequences(spark):
    rows = [(i, None if i % 2 else "word") for i in range(5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = packing.pack_documents(df, public_tokenizers.path("word_bpe_49k.json")).collect()
    used = Counter()
    for r in got:
        used[r["sequence_id"]] += r["length"]
    assert len(got) == 5000 and sum(used.values()) / (2048 * len(used)) > 0.9


def test_many_partitions_are_packed_as_tight(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").repartition(64)
    path = public_tokenizers.path("word_bpe_49k.json")
    for gathered, least in ((packing.GATHERED, 0.99), (8, 0.985)):  # one task takes all leftovers, or eight do
        monkeypatch.setattr(packing, "GATHERED", gathered)
        got = packing.pack_documents(docs, path).collect()
        used, whole = Counter(), defaultdict(list)
        for r in got:
            used[r["sequence_id"]] += r["length"]
            whole[r["doc_id"]].append((r["start"], r["length"], r["doc_tokens"], r["ids_crc32"] == zlib.crc32(bytes(r["ids"]))))
        assert max(used.values()) <= 2048 and sum(used.values()) / (2048 * len(used)) > least
        for pieces in whole.values():
            at = 0
            for start, size, _, same in sorted(pieces):
                assert start == at and same
                at += size
            assert at == pieces[0][2]


@pytest.mark.parametrize("limits", [packing.Limits(100, 4, 40, 4), packing.Limits(100, 4, 10, 16), packing.Limits(10, 64, 10, 16), packing.Limits(100, 1, 1, 1)])
def test_packer_respects_all_limits(limits):
    rng = random.Random(6)
    seen = defaultdict(list)
    masks, sizes = {}, {}

    def place(x, start, size, seq, offset):
        assert offset == sum(p[2] for p in seen[seq]) and size > 0
        seen[seq].append((x.doc_id, start, size))

    packer = packing.Packer(limits, place)
    for i in range(500):
        n = rng.randrange(1, 300)
        share = rng.choice([0.0, 0.3, 1.0])
        masks[i] = [int(rng.random() < share) for _ in range(n)]
        sizes[i] = n
        packer.add(packing.Example(i, b"", 0, n, n, None if share == 1.0 else np.concatenate([[0], np.cumsum(masks[i])])))
    packer.fill()
    whole = defaultdict(list)
    for pieces in seen.values():
        assert sum(p[2] for p in pieces) <= limits.tokens and len(pieces) <= limits.segments
        assert sum(sum(masks[d][start : start + size]) for d, start, size in pieces) <= limits.loss_tokens
        for d, start, size in pieces:
            whole[d].append((start, size))
    assert set(whole) == set(sizes)
    for d, pieces in whole.items():
        at = 0
        for start, size in sorted(pieces):
            assert start == at
            at += size
        assert at == sizes[d]
    if limits.loss_tokens == 40:  # where the loss limit binds, hardly any sequence is filled to its tokens
        assert max(sum(sum(masks[d][start : start + size]) for d, start, size in p) for p in seen.values()) == 40


def test_limits_below_one_are_refused():
    with pytest.raises(ValueError):
        packing.Limits(loss_tokens=0)


def test_instruction_data_is_packed_under_its_masks(spark):
    rng = random.Random(16)
    turns = []
    for c in [*range(40), None]:
        for t in range(rng.randrange(1, 9)):
            turns.append((c, t, ["user", "assistant"][t % 2], words(rng, rng.choice([3, 60, 400]), 500)))
    turns += [(99, t, "assistant", words(rng, 20, 500)) for t in range(400)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    segments = chat.format_conversations(df, path, public_tokenizers.PATTERN).coalesce(2).persist()
    limits = packing.Limits(tokens=1024, segments=8, loss_tokens=300, least_cut=16)
    got = packing.pack_conversations(segments, limits).collect()
    ids, masks = defaultdict(dict), defaultdict(dict)
    for r in segments.collect():
        for k, (token, loss) in enumerate(zip(np.frombuffer(r["ids"], "<u4").tolist(), bytes(r["loss"]), strict=True)):
            ids[r["conv_id"]][r["first_token"] + k] = token
            masks[r["conv_id"]][r["first_token"] + k] = loss
    by, placed, losses = defaultdict(list), defaultdict(dict), Counter()
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
        for k, token in enumerate(np.frombuffer(r["ids"], "<u4").tolist()):
            assert r["start"] + k not in placed[r["conv_id"]]
            placed[r["conv_id"]][r["start"] + k] = token
            losses[r["sequence_id"]] += masks[r["conv_id"]][r["start"] + k]
    assert placed == ids
    for pieces in by.values():
        assert sum(n for _, n in pieces) <= 1024 and len(pieces) <= 8
        assert sorted(o for o, _ in pieces) == [sum(n for o2, n in pieces if o2 < o) for o in sorted(o for o, _ in pieces)]
    assert max(losses.values()) == 300 and sum(v > 280 for v in losses.values()) > 20
    assert packing.pack_conversations(segments.limit(0), limits).count() == 0


def test_word_cache_equals_the_tokenizer():
    cache = packing.word_cache(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(7)
    letters = "abcXYZ  \n\t'’éßñÀÉİΣςσ漢字😀\x1c\x85\xa00123.,;!?-_é"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 40))) for _ in range(3000)] + ["<|endoftext|> a", "it's we're I'M", ""]
    want = [e.ids for e in cache.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in cache.encode(texts)] == want


# --- 7 ----------------------------------------------------------------------------------------------------------


def brute_join(rows):
    texts = {}
    for r in rows:
        if r[0] is not None:
            texts[(r[0], r[1])] = r[1]
    sets = {}
    for k, t in texts.items():
        w = (t or "").encode().split()
        sets[k] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    links, near = Counter(), defaultdict(set)
    keys = sorted(sets, key=str)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both / len(sets[a] | sets[b]) >= 0.8:
                links[a] += 1
                links[b] += 1
                near[a].add(b)
                near[b].add(a)
    part = {}
    for a in keys:
        if a not in part:
            group, stack = set(), [a]
            while stack:
                x = stack.pop()
                if x not in group:
                    group.add(x)
                    stack += near[x]
            for x in group:
                part[x] = min(y[0] for y in group)
    return {k[0]: (links[k], part[k]) for k in keys}


@pytest.mark.parametrize("settings", [jaccard.Settings(), jaccard.Settings(bucket=3, block=4), jaccard.Settings(block=4, sparse=0), jaccard.Settings(block_tokens=300)])
def test_jaccard_join_equals_brute_force(docs, rows, empty, settings):
    got = jaccard.jaccard_join(docs, settings).collect()
    named = {r["doc_id"]: (r["n_links"], r["component_id"]) for r in got if r["doc_id"] is not None}
    assert named == brute_join(rows)
    assert len(got) == len(named) + 2 and all(r["kept"] for r in got if r["doc_id"] is None)
    assert jaccard.jaccard_join(empty, settings).count() == 0


def test_many_near_copies_and_a_shared_passage(spark):
    rng = random.Random(8)
    base, passage = words(rng, 150).split(), words(rng, 60)
    made = []
    for i in range(300):
        parts = list(base)
        for _ in range(rng.randrange(0, 4)):
            parts[rng.randrange(150)] = f"n{rng.randrange(10**6)}"
        made.append((i, " ".join(parts)))
    made += [(300 + i, words(rng, 80) + " " + passage) for i in range(300)]
    df = spark.createDataFrame(made, "doc_id long, text string")
    settings = jaccard.Settings(bucket=16, block=64, sparse=1)
    got = {r["doc_id"]: (r["n_links"], r["component_id"]) for r in jaccard.jaccard_join(df, settings).collect()}
    assert got == brute_join(made)


def test_one_document_of_each_group_stays(docs, rows):
    kept = jaccard.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    part = {k: v[1] for k, v in brute_join(rows).items()}
    blank = {r[0] for r in rows if not (r[1] or "").split()}
    got = Counter(r["doc_id"] for r in kept.collect())
    assert got.pop(None) == 2
    assert set(got) == {k for k, p in part.items() if p == k or k in blank}
    assert all(n == 1 for n in got.values())


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100)] + [(200, 200 + i) for i in range(1, 80)] + [(500, 500), (300, 301), (301, 300)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long"))[0].collect()}
    assert got == {**{i: 0 for i in range(101)}, **{200 + i: 200 for i in range(80)}, 300: 300, 301: 300}


# --- 8 ----------------------------------------------------------------------------------------------------------


def test_bpe_equals_the_library(spark, docs, rows, empty):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    codec = bpe.codec(path, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyzABC  \n\t'’éßñ漢字😀\x1c\x85\xa00123.,;!?-_"
    entries = list(codec.ranks)
    texts = [r[1] or "" for r in rows]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 60))) for _ in range(4000)]
    texts += [b"".join(rng.choice(entries) for _ in range(rng.randrange(1, 6))).decode("utf-8", "ignore") for _ in range(4000)]
    texts += ["<|endoftext|>", "a" * 500, " " * 40 + "x", "ab " * 3000 + "\n\n  c"]
    for t in texts:
        ids = codec.encode(t)
        assert np.frombuffer(ids, dtype="<u4").tolist() == library.encode_ordinary(t), t
        assert codec.decode(ids) == t.encode()
    got = bpe.encode_decode(docs, path, public_tokenizers.PATTERN).collect()
    want = Counter()
    for r in rows:
        ids = np.array(library.encode_ordinary(r[1] or ""), dtype="<u4").tobytes()
        want[(r[0], len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest())] += 1
    assert Counter(map(tuple, got)) == want
    assert bpe.encode_decode(empty, path, public_tokenizers.PATTERN).count() == 0


def test_other_patterns_see_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    pattern = r"\p{L}{1,3}|\s+|[^\s\p{L}]"
    codec = bpe.Codec(path, pattern)
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=codec.ranks, special_tokens={})
    for t in ["plain words, and  more\n\nof  them", "x" * 100, "é漢字 12 34", "  "]:
        assert np.frombuffer(codec.encode(t), dtype="<u4").tolist() == library.encode_ordinary(t)


def test_what_is_remembered_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_PIECES", 20)
    codec = bpe.Codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(20)
    t = words(rng, 400) + " " + "q" * 5000
    assert np.frombuffer(codec.encode(t), dtype="<u4").tolist() == library.encode_ordinary(t)
    assert len(codec.pieces) <= 20 and len(codec.matches) <= 20 and max(map(len, codec.matches)) <= bpe.MAX_LENGTH


# --- 9 ----------------------------------------------------------------------------------------------------------

NOTICES = {
    "Released under the MIT License.": "MIT",
    "foo\nLicensed under the Apache License, Version 2.0.\nbar": "Apache-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL",
    "thher onted Licensed under CC BY-NC 4.0.": "CC-BY-NC",
    "The driver lost his license.": None,
    "MIT is a university with a license": None,
    "plain words only": None,
    "": None,
}


def test_license_scan_equals_plain_scoring(spark):
    made = [(i, t) for i, t in enumerate([*NOTICES, None, *(t for v in license_scan.TEMPLATES.values() for t in v), *license_scan.DECOYS])]
    made += [(0, made[0][1]), (None, made[0][1])]
    df = spark.createDataFrame(made, "doc_id long, text string").withColumn("family", F.lit("clash"))
    got = license_scan.scan(df)
    rows = got.collect()
    assert len(rows) == len(made)
    found = Counter((r["doc_id"], r["n_candidates"], r["families"], r["family"], r["line"]) for r in rows)
    want = Counter()
    for i, t in made:
        x = license_scan.scan_text(t)
        want[(i, x["n_candidates"], x["families"], x["family"], x["line"])] += 1
    assert found == want
    by = {r["doc_id"]: r["family"] for r in rows if r["doc_id"] is not None}
    for i, (_, family) in enumerate(NOTICES.items()):
        assert by[i] == family
    assert license_scan.scan(df.limit(0)).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "ArrowEval", "MapInArrow"))


def test_short_notices_are_confirmed(spark):
    made = {
        "All rights reserved.": "Proprietary",
        "some words of a page.\nAll rights reserved.": "Proprietary",
        "Copyright 2020 Some Body. All rights reserved.": "Proprietary",
        "All rights reserved.\nReleased under the MIT License.": "MIT",
        "Rights of way are reserved for all.": None,
    }
    got = {r["doc_id"]: r["family"] for r in license_scan.scan(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(made.values())) == {i: license_scan.scan_text(t)["family"] for i, t in enumerate(made)}


WRAPPED = {
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
    "copyright notice and this permission notice appear in all copies.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the "
    "Software without restriction.",
    "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
    "Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
}


def test_wrapped_notices_are_found(spark):
    made = []
    for family, text in WRAPPED.items():
        for width in (50, 72, 80):
            for lead in ("", " * ", "# ", "-- "):
                lines = [lead + line for part in text.split("\n\n") for line in [*textwrap.wrap(part, width), ""]]
                made.append((len(made), "\n".join(["first line", *lines, "last line"]), family))
    rows = spark.createDataFrame(made, "doc_id long, text string, want string")
    got = {r["doc_id"]: (r["n_candidates"], r["families"], r["family"], r["line"]) for r in license_scan.scan(rows).collect()}
    for i, text, family in made:
        x = license_scan.scan_text(text)
        assert got[i] == (x["n_candidates"], x["families"], x["family"], x["line"])
        assert x["families"] == family, text


def test_decoys_stay_unknown():
    fresh = ["Her license to teach expired in May.", "Permission was asked and given.", "A warranty is not a promise.", "The commons are creative places."]
    assert all(license_scan.scan_text(t)["family"] is None for t in [*fresh, *license_scan.DECOYS])


# --- 10 ---------------------------------------------------------------------------------------------------------


def test_toxicity_finds_documents_and_sentences(spark):
    rng = random.Random(11)
    made, labels = [], []
    for i in range(1500):
        sentences = [words(rng, 8, 300) + "." for _ in range(rng.randrange(2, 9))]
        toxic = rng.random() < 0.2
        if toxic:
            at = rng.randrange(len(sentences))
            sentences[at] = f"you {rng.choice(['blorkish', 'blorka', 'snarg', 'frell'])} " + sentences[at]
        made.append((i, " ".join(sentences)))
        labels.append((i, 1, int(toxic)))
    made += [(5000, None), (5001, ""), (5002, "fine."), (None, "you snarg."), (3, made[3][1])]
    docs = spark.createDataFrame(made, "doc_id long, text string").withColumn("score", F.lit("clash"))
    lab = spark.createDataFrame([*labels, (None, 1, 1), (7000, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, lab)
    out = [r for r in toxicity.score_documents(docs, model).collect()]
    assert len(out) == len(made)
    truth = {i: t for i, _, t in labels}
    held = [r for r in out if r["doc_id"] in truth and r["held_out"]]
    hits = [r for r in held if truth[r["doc_id"]]]
    assert sum(r["predicted"] for r in hits) / len(hits) > 0.95
    assert sum(r["predicted"] for r in held if not truth[r["doc_id"]]) == 0
    texts = {i: t for i, t in made if i is not None}
    for r in hits:
        if r["predicted"]:
            worst = [toxicity.sentences(texts[r["doc_id"]])[k] for k in r["offending"]]
            assert any(w.startswith("you ") for w in worst)
    assert {r["score"] for r in out if r["doc_id"] in (5000, 5001)} == {0.0}
    assert toxicity.score_documents(docs.limit(0), model).count() == 0
    untrained = toxicity.train(docs, lab.limit(0))
    assert all(r["score"] == 0 for r in toxicity.score_documents(docs, untrained).collect())


def test_scores_are_the_noisy_or_of_sentences(spark):
    model = toxicity.Model(-3.0, {"bad": 2.5, "awfu-": 1.5, "good": -1.0, "awful": 0.5})
    texts = ["bad thing. good bad awful!\nnothing here", "good. good", "awfully bad? bad", "", None, "bad " * 20_000 + ". " + "fine. " * 5000]

    def plain(text):
        none, offending = 1.0, []
        for i, sentence in enumerate(toxicity.sentences(text or "")):
            marks = set()
            for w in __import__("re").findall(r"\w+", sentence.lower()):
                marks |= {w} | {w[:n] + "-" for n in (4, 5) if len(w) >= n}
            hits = [model.weights[m] for m in marks if m in model.weights]
            if hits:
                p = 1 / (1 + math.exp(3.0 - sum(hits)))
                none *= 1 - p
                if p >= toxicity.SENTENCE_THRESHOLD:
                    offending.append(i)
        return round(1 - none, 12), offending

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"toxic": F.lit(1), "predicted": F.lit("clash")})
    for r in toxicity.score_documents(df, model).collect():
        assert (round(r["score"], 12), r["offending"]) == plain(texts[r["doc_id"]])
        assert r["predicted"] == (r["score"] >= 0.3)


def test_long_labelled_texts_are_learnt_from(spark, monkeypatch):
    rng = random.Random(19)
    made, labels = [], []
    for i in range(400):
        sentences = [words(rng, 12, 300) + "." for _ in range(60)]
        if i % 4 == 0:
            sentences[rng.randrange(60)] = "you snarg " + words(rng, 6, 300) + "."
        made.append((i, " ".join(sentences)))
        labels.append((i, int(i % 4 == 0)))
    made += made[:50]  # repeated rows count once
    docs = spark.createDataFrame(made, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    assert min(len(t) for _, t in made) > 2_000
    model = toxicity.train(docs, lab)
    fresh = [words(rng, 12, 300) + "." for _ in range(30)]

    def tells_apart(m):
        score = toxicity.Scorer(m)
        return score("you snarg. " + " ".join(fresh))[0] >= toxicity.THRESHOLD > score(" ".join(fresh))[0]

    assert tells_apart(model)
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 300_000)
    assert tells_apart(toxicity.train(docs, lab))
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 10)
    with pytest.warns(UserWarning):
        assert toxicity.train(docs, lab) == toxicity.Model()
