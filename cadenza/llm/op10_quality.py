"""Quality rules: base counts and distribution divergence, DataFrame functions only.

Two rules reject a document: the base rule (too few words, or too many words in
repeated three-word windows) and the divergence rule. The latter compares two
histograms of the document with those of its language: characters by class and
words by "one of the language's common words, or another". The distance is the
square root of the Jensen-Shannon divergence in bits (0 to 1). The references
are means over all documents of the language that pass the base rule, from the
data given. Every language with ``MIN_REFERENCE_DOCS`` such documents has one; its
common words are fixed for four languages and counted over its documents for all
others. A document without a reference is judged by the base rule alone.

Edge cases: NULL or empty text has no words, so it fails the base rule. Every
row gives one row, repeated rows too. NULL languages and those of few documents
have no reference, so both distances are NULL. Documents under ``min_words`` skip the divergence rule
(they fail the base rule already). An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.llm.common import SPACES, table, written

# fixed values: common words of the four languages
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "it", "was", "for", "with", "this"],
    "fr": ["le", "la", "de", "et", "les", "des", "en", "un", "une", "du", "que", "qui"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "ist"],
    "es": ["el", "la", "de", "que", "y", "en", "un", "los", "se", "del", "las", "por"],
}
# fixed values: character classes of the first histogram (the rest is the last bin)
CHAR_CLASSES = {
    "c_lower": r"[a-z]+", "c_mark": r"[#*$%&|]+", "c_angle": r"[<>]+", "c_upper": r"[A-Z]+", "c_digit": r"[0-9]+",
    "c_symbol": r"[@^~{}\[\]\\_=+/]+", "c_stop": r"[.,;:!?'\"()-]+",
}
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_CHAR_DISTANCE = 0.22
MAX_WORD_DISTANCE = 0.275
MIN_REFERENCE_DOCS = 20
N_COMMON = 12


def common_words(docs: DataFrame) -> DataFrame:
    """(own_lang, own_words): the most frequent words of every language without a fixed list."""
    d = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    d = d.where(F.col("lang").isNotNull() & ~F.col("lang").isin(list(COMMON_WORDS)))
    enough = d.groupBy("lang").count().where(F.col("count") >= MIN_REFERENCE_DOCS).select("lang")
    words = d.select("lang", F.explode(F.array_remove(F.split("text", SPACES), "")).alias("w"))
    words = words.groupBy("lang", F.lower("w").alias("w")).count().join(enough, "lang", "left_semi")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "w"))
    top = words.withColumn("place", place).where(F.col("place") <= N_COMMON)
    return top.groupBy(F.col("lang").alias("own_lang")).agg(F.sort_array(F.collect_list("w")).alias("own_words"))


def base_counts(docs: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """One row per document with its counts; ``docs``: doc_id, text, lang; ``own``: see ``common_words``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    carry = [F.col("row")] if "row" in docs.columns else []
    d = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), text.alias("text"), *carry)
    d = d.withColumn("words", F.array_remove(F.split("text", SPACES), ""))
    d = d.withColumn("n_words", F.size("words").cast("long"))
    # three-word windows as hashes, in order of hash and place
    d = d.withColumn("grams", F.expr(
        "CASE WHEN n_words >= 3 THEN transform(slice(words, 1, size(words) - 2),"
        " (w, i) -> xxhash64(w, get(words, i + 1), get(words, i + 2))) ELSE array() END"))
    d = d.withColumn("repeats", F.expr("size(array_distinct(grams)) < size(grams)"))
    d = d.withColumn("sorted", F.expr("CASE WHEN repeats THEN sort_array(transform(grams, (h, i) -> named_struct('h', h, 'i', i))) END"))
    d = d.withColumn("hits", F.expr(
        "CASE WHEN repeats THEN sort_array(transform(filter(sorted, (x, i) ->"
        " x.h <=> get(sorted, i - 1).h OR x.h <=> get(sorted, i + 1).h), x -> x.i)) END"))
    repeat_words = F.expr(
        "CASE WHEN repeats THEN aggregate(transform(hits, (p, i) ->"
        " least(3, coalesce(get(hits, i + 1), p + 3) - p)), 0, (a, x) -> a + x) ELSE 0 END")
    d = d.withColumn("lines", F.expr("filter(split(text, '\\n'), l -> l RLIKE '[^\\\\x20\\\\x09-\\\\x0D]')"))
    # what is left after each class of characters is taken away; each step scans less
    d = d.withColumn("rest", F.array_join("words", "")).withColumn("word_chars", F.length("rest").cast("long"))
    for name, pattern in CHAR_CLASSES.items():
        d = d.withColumn("left", F.regexp_replace("rest", pattern, ""))
        d = d.withColumn(name, (F.length("rest") - F.length("left")).cast("long"))
        d = d.drop("rest").withColumnRenamed("left", "rest")
    listed = ", ".join(f"'{w}'" for w in sorted({w for ws in COMMON_WORDS.values() for w in ws}))
    d = d.withColumn("listed", F.expr(f"transform(filter(words, w -> lower(w) IN ({listed})), w -> lower(w))"))
    found = F.expr("CASE lang " + " ".join(
        f"WHEN '{lang}' THEN transform({_sql_list(ws)}, w -> cast(size(listed) - size(array_remove(listed, w)) AS bigint))"
        for lang, ws in COMMON_WORDS.items()) + " ELSE array(cast(size(listed) AS bigint)) END")
    if own is not None:
        d = d.join(own, F.col("lang") == F.col("own_lang"), "left")
        d = d.withColumn("hits_own", F.expr(
            "CASE WHEN own_words IS NOT NULL THEN filter(transform(words, w -> lower(w)), w -> array_contains(own_words, w)) END"))
        found = F.coalesce(F.expr("transform(own_words, w -> cast(size(hits_own) - size(array_remove(hits_own, w)) AS bigint))"), found)
    out = d.select(
        "doc_id", "lang", "n_words", "word_chars", *CHAR_CLASSES,
        (F.col("c_mark") + F.col("c_angle")).alias("n_symbols"),
        F.expr("size(lines) - size(array_distinct(lines))").cast("long").alias("n_dup_lines"),
        repeat_words.cast("long").alias("n_repeat_words"), found.alias("common"), *carry)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def _sql_list(ws: list[str]) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in ws) + ")"


def _histograms(counts: DataFrame) -> DataFrame:
    """Adds the two histograms as arrays of shares."""
    named = [F.col(c) for c in CHAR_CLASSES]
    rest = F.greatest(F.lit(0), F.col("word_chars") - sum(named[1:], named[0]))
    chars = F.array(*named, rest)
    counts = counts.withColumn("chars", F.transform(chars, lambda c: c / F.greatest(F.col("word_chars"), F.lit(1))))
    other = F.expr("greatest(0, n_words - aggregate(common, 0L, (a, x) -> a + x))")
    bins = F.concat("common", F.array(other))
    return counts.withColumn("word_bins", F.transform(bins, lambda c: c / F.greatest(F.col("n_words"), F.lit(1))))


def _distance(p: str, q: str):
    """Jensen-Shannon distance of two arrays of shares of one length."""
    half = f"zip_with({p}, {q}, (x, y) -> (x + y) / 2)"
    kl = "aggregate(zip_with({0}, {1}, (x, m) -> CASE WHEN x > 0 THEN x * log2(x / m) ELSE 0D END), 0D, (a, x) -> a + x)"
    return F.sqrt(F.greatest(F.lit(0.0), F.expr(f"0.5 * {kl.format(p, half)} + 0.5 * {kl.format(q, half)}")))


def references(hist: DataFrame) -> DataFrame:
    """A language and its mean histograms, for every language with enough good documents."""
    good = hist.where(~F.col("base_failed") & F.col("lang").isNotNull())
    n_chars, n_words = len(CHAR_CLASSES) + 1, max(N_COMMON, *map(len, COMMON_WORDS.values())) + 1
    means = [F.array(*[F.avg(F.get("chars", F.lit(i))) for i in range(n_chars)]).alias("ref_chars"),
             F.array(*[F.avg(F.get("word_bins", F.lit(i))) for i in range(n_words)]).alias("ref_words"),
             F.count("*").alias("ref_docs")]
    return good.groupBy("lang").agg(*means).where(F.col("ref_docs") >= MIN_REFERENCE_DOCS)


def judge(docs: DataFrame, max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """One row per document: counts, both distances, ``base_failed``, ``kept``."""
    own = written(common_words(docs), "quality-common-words")
    hist = _histograms(written(base_counts(docs, None if own.isEmpty() else own), "quality-counts"))
    ref = written(references(hist), "quality-reference")   # one row a language; Spark broadcasts it while it is small
    ref = ref.select(F.col("lang").alias("ref_lang"), "ref_chars", "ref_words")
    j = hist.join(ref, F.col("lang") == F.col("ref_lang"), "left")
    j = j.withColumn("ref_words", F.slice("ref_words", F.lit(1), F.size("word_bins")))
    judged = (F.col("n_words") >= MIN_WORDS) & F.col("ref_lang").isNotNull()
    j = j.withColumn("char_distance", F.when(judged, _distance("chars", "ref_chars")))
    j = j.withColumn("word_distance", F.when(judged, _distance("word_bins", "ref_words")))
    diverges = (F.coalesce("char_distance", F.lit(0.0)) > max_char) | (F.coalesce("word_distance", F.lit(0.0)) > max_word)
    return j.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    (~F.col("base_failed") & ~diverges).alias("kept"), "char_distance", "word_distance",
                    *([F.col("row")] if "row" in docs.columns else []))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, row by row, with the columns they had."""
    rows = docs.select("doc_id", "lang", "text", F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    return judge(rows).where("kept").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
