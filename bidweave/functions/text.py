"""Tokens, TF-IDF weights, citations and amounts in text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidweave.functions.normalize import _col, normalize_contract_id

#: Words that carry no meaning here.
STOPWORDS = (
    "a", "an", "and", "any", "are", "as", "at", "be", "by", "for", "from", "has", "have", "in", "into", "is", "it",
    "its", "of", "on", "or", "our", "such", "that", "the", "their", "this", "to", "was", "were", "will", "with",
    "within", "without", "shall", "should", "must", "may", "can", "all", "other", "igf", "ot", "ct", "cl", "cn", "fy", "po",
)
#: Units of amounts.
UNITS = {"billion": 1e9, "bn": 1e9, "b": 1e9, "million": 1e6, "mm": 1e6, "m": 1e6, "thousand": 1e3, "k": 1e3}
LEAST_AMOUNT = 10_000.0
_AMOUNT = r"\$\s?(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)\s*((?i:billion|million|thousand|bn|mm|[bmk]))?\b"
#: Runs of capitals and digits, single dashes between them, that are long enough for a number; shorter ones never match.
_ID_RUN = r"[A-Z0-9](?:-?[A-Z0-9]){7,}"
#: A whole run of letters and digits, of two or more, with a letter.
_TOKEN = r"(?<![a-z0-9])(?=[0-9]*[a-z])[a-z0-9]{2,}"


def _folded(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit(_TOKEN), F.lit(0))


def tokens(c: Column | str) -> Column:
    """Folded words of two characters or more with a letter that aren't stopwords."""
    return F.filter(_folded(c), lambda w: ~w.isin(*STOPWORDS))


def words(docs: DataFrame, keys: list[str], text: str, once: bool = False) -> DataFrame:
    """``tokens`` in long form: keys, word; each word once a row with ``once``. Stopwords go outside of lambdas, in generated code."""
    every = F.array_distinct(_folded(text)) if once else _folded(text)
    return docs.select(*keys, F.explode(every).alias("word")).where(~F.col("word").isin(*STOPWORDS))


def term_counts(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, word, tf."""
    return words(docs, keys, text).groupBy(*keys, "word").agg(F.count("*").alias("tf"))


def document_frequency(docs: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """(word, df) and one row (n); documents without text count in n."""
    df = words(docs, [], text, once=True).groupBy("word").agg(F.count("*").alias("df"))
    return df, docs.agg(F.count("*").alias("n"))


def frequency_of_counts(tf: DataFrame) -> DataFrame:
    """(word, df) from the term counts of a corpus."""
    return tf.groupBy("word").agg(F.count("*").alias("df"))


def term_weights(docs: DataFrame, keys: list[str], text: str, df: DataFrame, n: DataFrame) -> DataFrame:
    """``weights`` of texts."""
    return weights(term_counts(docs, keys, text), keys, df, n)


def weights(tf: DataFrame, keys: list[str], df: DataFrame, n: DataFrame) -> DataFrame:
    """Sparse unit vectors in long form: keys, word, norm, w = (1 + ln tf)(ln((1 + n) / (1 + df)) + 1) / norm.

    ``n`` is one row, so its broadcast has a fixed size; words unseen in the corpus have a df of 0.
    """
    raw = (
        tf.join(df, "word", "left")
        .crossJoin(F.broadcast(n))
        .select(*keys, "word", ((1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.coalesce("df", F.lit(0)))) + 1)).alias("raw"))
    )
    # A window needs the rows of a text together once; a join would compute and move them twice.
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(*keys)))
    return raw.withColumn("norm", norm).select(*keys, "word", "norm", (F.col("raw") / F.col("norm")).alias("w"))


def shared_terms(products: Column, words: Column, limit: int = 3) -> Column:
    """Words that add most to a product, ties in the order of the alphabet; an aggregate."""
    return F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-products).alias("p"), words.alias("word")))), 1, limit), lambda x: x["word"])


def product(x: Column, y: Column) -> Column:
    """The words that a vector (array of word and w) and another one (map) share, with their products: an array of -p and word."""
    both = F.filter(x, lambda e: F.map_contains_key(y, e["word"]))
    return F.transform(both, lambda e: F.struct((-(e["w"] * F.try_element_at(y, e["word"]))).alias("p"), e["word"].alias("word")))


def looks_like_contract_number(c: Column | str) -> Column:
    """8 to 20 capitals and digits, with a letter and four digits or more."""
    c = _col(c)
    return c.rlike("^[A-Z0-9]{8,20}$") & c.rlike("[A-Z]") & c.rlike("([0-9][^0-9]*){4}")


def cited_numbers(df: DataFrame, text: str, own: str) -> DataFrame:
    """The rows of ``df``, once for each contract number that ``text`` cites, with c: piid_norm, raw and at (from 1).

    A number counts once, as it is first written; the notice's ``own`` solicitation number does not count. Places are
    those of a run's first whole occurrence. Text is folded and searched once a row; what is worked out from each run
    follows the explode, in generated code.
    """
    upper = F.upper(text)
    runs = F.array_distinct(F.regexp_extract_all(upper, F.lit(_ID_RUN), F.lit(0)))
    # The explodes keep the optimizer from working text and runs out again for every run.
    found = df.select(*df.columns, normalize_contract_id(own).alias("_own"), F.explode(F.array(F.struct(F.concat(F.lit(" "), upper, F.lit(" ")).alias("u"), runs.alias("r")))).alias("_x"))
    found = found.where(F.size("_x.r") > 0).select(*df.columns, "_own", F.col("_x.u").alias("_text"), F.col("_x.r").alias("_runs"), F.posexplode("_x.r").alias("_k", "_run"))
    found = found.withColumn("_norm", F.replace(F.col("_run"), F.lit("-"), F.lit("")))
    first = (F.col("_k") == 0) | (F.array_position(F.transform("_runs", lambda r: F.replace(r, F.lit("-"), F.lit(""))), F.col("_norm")) == F.col("_k") + 1)
    found = found.where(looks_like_contract_number("_norm") & (F.col("_own").isNull() | (F.col("_norm") != F.col("_own"))) & first)
    # A place counts where the run stands between characters that can't belong to one: the first place as a rule. Of a run
    # that stands within a longer one before, the first whole place is looked for among blanks.
    place = F.instr("_text", F.col("_run"))
    edges = F.concat(F.substring("_text", place - 1, F.lit(1)), F.substring("_text", place + F.length("_run"), F.lit(1)))
    whole = F.instr(F.regexp_replace("_text", r"[^A-Z0-9-]", " "), F.concat(F.lit(" "), F.col("_run"), F.lit(" ")))
    at = F.when(~edges.rlike("[A-Z0-9-]"), place - 1).when(whole > 0, whole).otherwise(place - 1).cast("int")
    return found.select(*df.columns, F.struct(F.col("_norm").alias("piid_norm"), F.substring(text, at, F.length("_run")).alias("raw"), at.alias("at")).alias("c"))


def context_words(text: Column | str, at: Column, length: Column, words: tuple[str, ...], chars: int) -> Column:
    """Which words stand within so many characters of a citation, in their own order."""
    start = F.greatest(F.lit(1), at - chars)
    window = F.lower(F.substring(_col(text), start, at - start + length + chars))
    # Written out for every word: the window is then cut and folded once, in generated code.
    return F.array_compact(F.array(*(F.when(F.contains(window, F.lit(w.lower())), F.lit(w)) for w in words)))


def stated_amounts(text: Column | str) -> Column:
    """Dollar amounts in a text with their units, at least ten thousand, each once, first seen first."""
    text = F.coalesce(_col(text), F.lit(""))
    numbers = F.regexp_extract_all(text, F.lit(_AMOUNT), F.lit(1))
    units = F.regexp_extract_all(text, F.lit(_AMOUNT), F.lit(2))
    factor = F.create_map(*(F.lit(x) for pair in UNITS.items() for x in pair))
    values = F.zip_with(
        numbers, units, lambda n, u: F.regexp_replace(n, ",", "").cast("double") * F.coalesce(F.try_element_at(factor, F.lower(u)), F.lit(1.0))
    )
    return F.array_distinct(F.filter(values, lambda v: v >= LEAST_AMOUNT))
