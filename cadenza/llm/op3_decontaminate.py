"""Benchmark decontamination, DataFrame functions only.

Both tables' texts become lower-case words; an item gives its windows of
``WINDOW`` consecutive words (a shorter item gives one window, itself). Window
hashes of the documents meet the item windows in a hash join; the item side is
broadcast only if its counted rows are at most ``MAX_BROADCAST_ROWS``, beyond
that Spark shuffles both sides. Hits are then verified word by word against the
texts, so equal hashes alone never mark a document.

Edge cases: NULL, empty or wordless texts have no words: the document gets zero
counts, the item never occurs. Rows that repeat a doc_id count as one document
(their hits united, the larger word count); rows without a doc_id are one document
for each different text. Items that repeat, or share windows, are each counted once by
item_id; NULL item_ids are ignored. Empty tables give zero counts or no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import ascii_lower, id_text, table, written

WINDOW = 13
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"   # of lower-cased text
MAX_BROADCAST_ROWS = 1_000_000                     # at most about 100 MB of item windows or documents' keys
SHARE = 20                                         # contaminated: at least 1/SHARE of the words are hit


def _keyed(docs: DataFrame) -> DataFrame:
    """Adds what names a document: its doc_id, or a hash of its text and that it has no id."""
    own = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return docs.withColumn("doc__key", own).withColumn("doc__none", F.col("doc_id").isNull())


_KEY = ["doc__key", "doc__none"]


def _bounded(rows: DataFrame) -> DataFrame:
    """A small side to broadcast, if counted as small; else as it is."""
    return F.broadcast(rows) if rows.count() <= MAX_BROADCAST_ROWS else rows


def _words(df: DataFrame) -> DataFrame:
    text = ascii_lower(F.coalesce("text", F.lit("")))
    return df.withColumn("words", F.array_remove(F.split(text, SEPARATORS), ""))


def _windows(hashes: str, length: int) -> str:
    """SQL: hash of every window of ``length`` words, in order. (The array is
    named more than once, which keeps the optimizer from moving its making into
    the lambda, where it would run once a window.)"""
    return (f"CASE WHEN size({hashes}) >= {length} THEN transform(sequence(1, size({hashes}) - {length - 1}),"
            f" i -> xxhash64(slice({hashes}, i, {length}))) ELSE array() END")


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, length, key, window_text), one row per different window of an item."""
    w = _words(items.select("item_id", F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL"))
    w = w.where(F.size("words") > 0).withColumn("length", F.least(F.lit(window), F.size("words")))
    w = w.withColumn("start", F.explode(F.expr("sequence(1, size(words) - length + 1)")))
    w = w.withColumn("own", F.expr("slice(words, start, length)"))
    return w.select("item_id", "length", F.expr("xxhash64(transform(own, w -> xxhash64(w)))").alias("key"),
                    F.array_join("own", " ").alias("window_text")).distinct()


def find_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(word counts per document, verified hits (start, length, item_id)), both with doc_id and _KEY."""
    grams = written(item_windows(items, window), "benchmark-windows")
    lengths = [r.length for r in grams.select("length").distinct().collect()]   # at most ``window`` numbers
    keys = _bounded(grams.select("key", "length").distinct())
    d = _words(_keyed(id_text(docs))).withColumn("hashes", F.expr("transform(words, w -> xxhash64(w))"))
    d = d.withColumn("n_words", F.size("hashes").cast("long"))
    scanned = None
    for n in sorted(set(lengths) | {window}, reverse=True):
        keyed = d.select("doc_id", *_KEY, "n_words", F.expr(_windows("hashes", n)).alias("found"))
        if n == window:   # one more row per document carries its word count
            keyed = keyed.withColumn("found", F.expr("array_append(found, cast(NULL AS bigint))"))
        else:
            keyed = keyed.where("n_words > 0")
        # the outer form: for the inner one the optimizer adds a filter on the array, which makes it twice
        part = keyed.select("doc_id", *_KEY, "n_words", F.posexplode_outer("found").alias("start", "key")).withColumn("length", F.lit(n))
        part = part if n == window else part.where("key IS NOT NULL")
        scanned = part if scanned is None else scanned.unionByName(part)
    known = keys.select("key", "length", F.lit(True).alias("known"))
    seen = scanned.join(known, ["key", "length"], "left").where("known OR key IS NULL")
    seen = written(seen.select("doc_id", *_KEY, "n_words", "start", "length", "key"), "benchmark-hits")
    counts = seen.where("key IS NULL").groupBy("doc_id", *_KEY).agg(F.max("n_words").alias("n_words"))
    candidates = seen.where("key IS NOT NULL").select("doc_id", *_KEY, "start", "length", "key").distinct()
    # only the words of documents with a candidate are fetched
    own = _keyed(id_text(docs)).join(_bounded(candidates.select(*_KEY).distinct()), _KEY, "left_semi")
    own = _words(own).select(*_KEY, "words")
    placed = candidates.join(own, _KEY).select(
        "doc_id", *_KEY, "start", "length", "key", F.array_join(F.expr("slice(words, start + 1, length)"), " ").alias("window_text"))
    hits = placed.join(grams, ["key", "length", "window_text"]).select("doc_id", *_KEY, "start", "length", "item_id").distinct()
    return counts, hits


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: words, words inside hits, items, verdict."""
    return _report(docs, items, window).drop(*_KEY)


def _report(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    counts, hits = find_hits(docs, items, window)
    spans = hits.groupBy(*_KEY).agg(
        F.sort_array(F.collect_set(F.struct("start", "length"))).alias("spans"),
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    # words inside the union of the spans, left to right
    covered = F.expr(
        "aggregate(spans, named_struct('n', 0L, 'until', 0L), (a, s) -> named_struct("
        "'n', a.n + greatest(0L, s.start + s.length - greatest(a.until, cast(s.start AS bigint))),"
        "'until', greatest(a.until, cast(s.start + s.length AS bigint))), a -> a.n)")
    spans = spans.select(*_KEY, covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                         F.array_join("items", ",").alias("item_list"))
    j = counts.join(spans, _KEY, "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return j.select("doc_id", *_KEY, "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
                    F.sha2(F.coalesce("item_list", F.lit("")).cast("binary"), 256).alias("items_sha256"),
                    ((n_hit > 0) & (SHARE * n_hit >= F.col("n_words"))).alias("contaminated"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that aren't contaminated, whole and with all columns."""
    bad = _report(docs, items, window).where("contaminated").select(*_KEY)
    return _keyed(docs).join(bad, _KEY, "left_anti").drop(*_KEY)


def remove_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text): every document as its normalised words without the hit ones."""
    _, hits = find_hits(docs, items, window)
    gone = hits.groupBy(*_KEY).agg(F.array_distinct(F.flatten(F.collect_set(
        F.expr("sequence(start, start + length - 1)")))).alias("gone"))
    d = _words(_keyed(id_text(docs))).join(gone, _KEY, "left")
    # places that stay, in order; each names its word
    d = d.withColumn("stay", F.expr("array_except(CASE WHEN size(words) > 0 THEN sequence(0, size(words) - 1) ELSE array() END, coalesce(gone, array()))"))
    kept = F.expr("CASE WHEN gone IS NULL THEN words ELSE transform(stay, i -> get(words, i)) END")
    return d.select("doc_id", F.array_join(kept, " ").alias("text"))
