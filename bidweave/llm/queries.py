"""Queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidweave.llm import bpe, chat, compression, embed_dedup, hard_negatives, jaccard, langid, license_scan, packing, quality_crf, sharding, toxicity, whitening
from bidweave.llm.common import finish, materialise, scratch_path

SHARDS = 8
#: A conversation whose texts hold control strings.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near-equal bytes by a rebalanced, stored slot map."""
    slotted, path = materialise(sharding.with_slots(_read(spark, sf_dir, "documents")), "slotted")
    sums = sharding.slot_sums(slotted)
    root = scratch_path(spark, "slot-map")
    first = sharding.SlotMap.initial(SHARDS)
    first.save(spark, root)
    first.rebalanced({k: b for k, (_, b) in sums.items()}).save(spark, root)
    return finish(sharding.shard_documents(slotted, sharding.SlotMap.load(spark, root, first.version + 1), sums), "sharded", path, root)


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return embed_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return langid.identify(_read(spark, sf_dir, "documents"))


def op4_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdicts of every document."""
    return compression.quality_verdicts(_read(spark, sf_dir, "documents"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and a probe, formatted and read back."""
    turns = _read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    turns = turns.unionByName(spark.createDataFrame(PROBE, turns.schema))
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    digests = chat.read_back(chat.format_conversations(turns, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    return digests.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op6_vector_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2,048 tokens."""
    return packing.pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op7_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes, link counts and components of all documents by five-word shingles."""
    return jaccard.jaccard_join(_read(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return bpe.encode_decode(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families of every document."""
    return license_scan.scan(_read(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from labels that are not held out."""
    docs = _read(spark, sf_dir, "documents")
    scored = toxicity.score_documents(docs, toxicity.train(docs, _read(spark, sf_dir, "labels")))
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("offending").alias("n_offending"), F.array_join(F.col("offending").cast("array<string>"), ",").alias("offending"), "worst")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding, a seventh of the labels moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.quantised(_read(spark, sf_dir, "embeddings").withColumn("label", label))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight whitened components of all embeddings. A deviation beyond a long is null; it stands whole beside."""
    out = whitening.whiten(_read(spark, sf_dir, "embeddings"))
    short = F.col("deviation").try_cast("long").alias("deviation")
    return out.select("vec_id", "component", "n", short, "whitened", "explained", "identity_error", F.col("deviation").alias("deviation_whole"))


def op13_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from labels that are not held out."""
    docs = _read(spark, sf_dir, "documents")
    scored = quality_crf.score_documents(docs, quality_crf.train(docs, _read(spark, sf_dir, "labels")))
    bad = F.array_join(F.col("bad_lines").cast("array<string>"), ",").alias("bad_lines")
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("bad_lines").alias("n_bad_lines"), bad)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_virtual_slots, op2_embedding_near_dedup, op3_language_id, op4_compression_bands, op5_chat_formatting,
        op6_vector_bin_packing, op7_chosen_path_join, op8_byte_bpe, op9_license_scan, op10_toxicity, op11_hard_negatives,
        op12_embedding_whitening, op13_quality_crf,
    )
    return {f.__name__: f for f in own}


def _chat_sql() -> str:
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def length(column: str) -> str:
        marks = " + ".join(f"2 * ((length({column}) - length(replace({column}, {quoted(c)}, ''))) // {len(c)})" for c in chat.CONTROLS)
        return f"(length({column}) + length({column}) - length(replace({column}, {quoted(chr(92))}, '')) + {marks})"

    fixed = sum(map(len, chat.MARKS.values()))
    probe = " UNION ALL ".join(f"SELECT {c}, {t}, {quoted(r)}, {quoted(x)}" for c, t, r, x in PROBE)
    return f"""
        WITH turns AS (
            SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
            FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL {probe})
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
            CAST(sum({fixed} + {length("role")} + {length("text")}) AS BIGINT) AS formatted_chars
        FROM turns GROUP BY conv_id
    """


def _components_sql(nodes: str, links: str, extra: str) -> str:
    """Common table expressions n_links and component by node, from ``nodes`` (id) and ``links`` (a, b, either way)."""
    return f"""
        reach(id, other) AS (SELECT id, id FROM {nodes} UNION SELECT reach.id, {links}.b FROM reach JOIN {links} ON {links}.a = reach.other),
        part AS (SELECT id, min(other) AS component_id FROM reach GROUP BY 1),
        counted AS (SELECT a AS id, count(*) AS n FROM {links} GROUP BY 1){extra}
    """


def _embedding_sql() -> str:
    return f"""
        WITH RECURSIVE v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        good AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND list_bool_and(list_transform(e, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(e, lambda x: x <> 0))),
        link AS (SELECT x.id AS a, y.id AS b FROM good x JOIN good y ON x.label = y.label AND x.id <> y.id AND len(x.e) = len(y.e)
            WHERE list_cosine_similarity(x.e, y.e) >= {embed_dedup.SIMILARITY}),
        {_components_sql("v", "link", "")}
        SELECT v.id AS vec_id, coalesce(n, 0) AS n_links, component_id, v.id = component_id AS kept
        FROM v JOIN part ON part.id = v.id LEFT JOIN counted ON counted.id = v.id
    """


def _jaccard_sql() -> str:
    return f"""
        WITH RECURSIVE doc AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        gram AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM doc),
        size AS (SELECT id, count(*) AS n FROM gram GROUP BY 1),
        both_in AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM gram x JOIN gram y ON x.g = y.g AND x.id <> y.id GROUP BY ALL),
        link AS (SELECT a, b, c = x.n AND c = y.n AS same FROM both_in JOIN size x ON x.id = a JOIN size y ON y.id = b WHERE 10 * c >= 8 * (x.n + y.n - c)),
        {_components_sql("doc", "link", ", class AS (SELECT a AS id, min(b) AS b FROM link WHERE same GROUP BY 1)")}
        SELECT doc.id AS doc_id, least(doc.id, coalesce(class.b, doc.id)) AS class_id, coalesce(n, 0) AS n_links, component_id, doc.id = component_id AS kept
        FROM doc JOIN part ON part.id = doc.id LEFT JOIN counted ON counted.id = doc.id LEFT JOIN class ON class.id = doc.id
    """


def _negatives_sql() -> str:
    low, high, first, best = hard_negatives.LOW, hard_negatives.HIGH, hard_negatives.POSITIVES, hard_negatives.NEGATIVES
    return f"""
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        ),
        x AS (SELECT vec_id, label, list_transform(e, lambda c: floor(256 * c)) AS x FROM v WHERE list_bool_and(list_transform(e, lambda c: c IS NOT NULL AND isfinite(c)))),
        met AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
            FROM x a JOIN x b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
        ),
        pos AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM met WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {first})
        SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
            id AS negative_id, positive_score, score AS negative_score
        FROM pos JOIN met USING (anchor_id)
        WHERE NOT same AND {low} * positive_score <= 100 * score AND 100 * score <= {high} * positive_score
        QUALIFY rank <= {best}
    """


def oracle_sql() -> dict[str, str]:
    """SQL twins; the other operators need a compressor, a tokenizer or a trained model and are tested by brute force."""
    return {"op2_embedding_near_dedup": _embedding_sql(), "op5_chat_formatting": _chat_sql(), "op7_chosen_path_join": _jaccard_sql(), "op11_hard_negatives": _negatives_sql()}
