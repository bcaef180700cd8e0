"""URL filter by a character language-model ratio, DataFrame functions only.

Rules decide the URLs they fit; the longest rule wins. The URLs that rules allow
and block train two variable-order Markov models over host and path: 31 symbols
(letters, one for all digits, three marks, one for the rest) and the URL's edge.
A context of up to ``ORDER`` symbols has counts of its own where the training URLs
show it ``MIN_EVIDENCE`` times or more, else the next shorter one stands for it; its
probabilities are blended with those of the shorter context by the number of its
different continuations (Witten and Bell). Both models are compiled into tables of
log ratios, of at most 32**3 and 32**4 rows whatever the input's size, so the
broadcast joins that look up every position have a fixed bound. A URL's score is
the mean log ratio of its symbols, its end included.

The threshold is calibrated on the quarter of ruled URLs (by their crc32) that
didn't train: among cuts a thousandth of a nat apart, the middle of those with the
largest sum of allowed and blocked shares judged rightly.

Log ratios are whole millionths, so sums don't depend on their order. Rows are
written with a number of their own first; only that number goes along with the
symbols, so neither long nor repeated URLs weigh on the sums or their exchange.

Edge cases: a NULL url, or one without "://", has an empty host and path, fits no
rule and is judged by its end alone. NULL page_ids and repeated rows keep one row
each. If rules give no URL of one kind, the score is 0 and its verdict allow. An
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import ascii_lower, table, written

# fixed values: (host, path, verdict) of the registered query
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
         ("com", "/de/", "block")]
ORDER = 3
MIN_EVIDENCE = 4
HELD_OUT = 4                    # one in so many ruled URLs calibrates
MICRO = 1_000_000
MAX_NATS = 20
_SYMBOLS = "abcdefghijklmnopqrstuvwxyz0/.-~"      # 1 to 31; 0 is the edge, 0 a digit, ~ all others
_BITS = 5
_WIDTH = 1 << _BITS


def split_url(url) -> tuple:
    """(host, path) columns of a url column."""
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substr(url, at + 3))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(after, r"^[^/?#]*(/[^?#]*)?", 1)
    return ascii_lower(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def rule_of(rules, host, path) -> tuple:
    """(rule, verdict) columns: the longest rule that fits, or NULL."""
    name = verdict = None
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return (F.lit(None).cast("string"),) * 2 if name is None else (name, verdict)


def _codes(text):
    """For every symbol of a text and its end: the symbol and the three before, five bits each."""
    kept = F.regexp_replace(F.regexp_replace(ascii_lower(text), "[0-9]", "0"), "[^a-z0/.-]", "~")
    symbols = F.transform(F.split(kept, ""), lambda c: F.instr(F.lit(_SYMBOLS), c))
    symbols = F.when(kept == "", F.array().cast("array<int>")).otherwise(symbols)
    return F.array_append(symbols, F.lit(0))


def _times(n: int):
    return lambda x: x * n


def _positions(pages: DataFrame) -> DataFrame:
    """One row a symbol: ``code`` instead of ``text``."""
    keep = [c for c in pages.columns if c != "text"]
    zeros = [F.array_repeat(F.lit(0), k) for k in range(ORDER + 1)]
    symbols, codes = _codes(F.col("text")), None
    # shifted copies added up, not looked up in a lambda: the optimizer may move the array's making into a lambda
    for k in range(ORDER + 1):
        moved = F.concat(zeros[k], symbols, zeros[ORDER - k])
        part = F.transform(moved, _times(_WIDTH ** k))
        codes = part if codes is None else F.zip_with(codes, part, lambda x, y: x + y)
    s = pages.withColumn("codes", F.slice(codes, F.lit(1), F.size(codes) - ORDER))
    return s.select(*keep, F.explode("codes").alias("code"))


def _compiled(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((code, ratio) of the longest contexts that have evidence; (code, ratio) of all
    codes of one symbol less). ``grams``: code, a, b."""
    spark = grams.sparkSession
    levels, prior = [], None
    symbol = F.explode(F.sequence(F.lit(0), F.lit(_WIDTH - 1))).alias("c")
    for k in range(ORDER + 1):
        own = grams.groupBy(F.col("code").bitwiseAND(F.lit(_WIDTH ** (k + 1) - 1)).alias("code")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        seen = own.groupBy(F.shiftright("code", _BITS).alias("context")).agg(
            F.sum("a").alias("na"), F.sum("b").alias("nb"), F.count_if(F.col("a") > 0).alias("ta"), F.count_if(F.col("b") > 0).alias("tb"))
        seen = seen.where((F.col("na") + F.col("nb") >= MIN_EVIDENCE) | (F.lit(k) == 0))
        full = seen.select("*", symbol).withColumn("code", F.col("context") * _WIDTH + F.col("c")).join(own, "code", "left").na.fill(0, ["a", "b"])
        if prior is None:
            full = full.withColumn("qa", F.lit(1.0 / _WIDTH)).withColumn("qb", F.lit(1.0 / _WIDTH))
        else:         # a context that has evidence has a shorter one that has
            short = prior.select(F.col("code").alias("short"), F.col("pa").alias("qa"), F.col("pb").alias("qb"))
            full = full.join(short, F.col("code").bitwiseAND(F.lit(_WIDTH ** k - 1)) == F.col("short"))
        p = [F.when(F.col(f"n{x}") + F.col(f"t{x}") > 0, (F.col(x) + F.col(f"t{x}") * F.col(f"q{x}")) / (F.col(f"n{x}") + F.col(f"t{x}")))
             .otherwise(F.col(f"q{x}")).alias(f"p{x}") for x in "ab"]
        prior = written(full.select("code", *p), f"url-model-{k}")       # at most 32 ** (k + 1) rows
        levels.append(prior)
    dense = spark.range(_WIDTH ** ORDER).select(F.col("id").cast("int").alias("code"))
    names = []
    for k in reversed(range(ORDER)):
        level = levels[k].select(F.col("code").alias(f"at{k}"), F.struct("pa", "pb").alias(f"p{k}"))
        dense = dense.join(level, F.col("code").bitwiseAND(F.lit(_WIDTH ** (k + 1) - 1)) == F.col(f"at{k}"), "left")
        names.append(f"p{k}")
    dense = dense.select("code", F.coalesce(*names).alias("p")).select("code", "p.pa", "p.pb")
    ratio = F.round(F.log(F.col("pa") / F.col("pb")) * MICRO).cast("long").alias("ratio")
    return levels[-1].select("code", ratio), written(dense.select("code", ratio), "url-ratios")


def _threshold(scored: DataFrame) -> int:
    """The cut between blocked and allowed scores, in thousandths of a nat."""
    cut = F.floor(F.col("score") * 1000).cast("long")
    bins = scored.where("label IS NOT NULL AND held").groupBy(cut.alias("cut")).agg(
        F.count_if(F.col("label") == "allow").alias("a"), F.count_if(F.col("label") == "block").alias("b"))
    rows = sorted(bins.collect())           # at most 2 * MAX_NATS * 1000 bins
    a, b = sum(r.a for r in rows), sum(r.b for r in rows)
    if not a or not b:
        return 0
    # cutting at x allows scores of x and more; between two bins that hold URLs all cuts are alike
    cuts, right_a, right_b, best, among = [r.cut for r in rows], a, 0, -1, []
    for i, r in enumerate([*rows, None]):
        low = cuts[i - 1] + 1 if i else cuts[0]
        high = cuts[i] if r else cuts[-1] + 1
        now = right_a * b + right_b * a
        if now > best:
            best, among = now, []
        if now == best:
            among += [low, high]
        if r:
            right_a, right_b = right_a - r.a, right_b + r.b
    return (min(among) + max(among)) // 2


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row; ``pages``: page_id, url."""
    host, path = split_url(F.col("url"))
    p = pages.select("page_id", F.col("url").cast("string").alias("url")).withColumn("host", host).withColumn("path", path)
    rule, label = rule_of(rules, F.col("host"), F.col("path"))
    p = p.withColumn("rule", rule)
    held = F.crc32(F.encode(F.concat("host", "path"), "UTF-8")) % HELD_OUT == 0
    p = p.drop("url").withColumn("label", label).withColumn("held", held)
    p = written(p.withColumn("row", F.monotonically_increasing_id()), "url-rows")
    text = F.concat("host", "path").alias("text")
    train = _positions(p.where("label IS NOT NULL AND NOT held").select("label", text))
    grams = train.groupBy("code").agg(F.count_if(F.col("label") == "allow").alias("a"), F.count_if(F.col("label") == "block").alias("b"))
    grams = written(grams, "url-grams")       # at most 32 ** 4 rows
    kinds = grams.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    if not kinds.a or not kinds.b:
        scored = p.withColumn("score", F.lit(0.0))
    else:
        deep, short = _compiled(grams)
        at = _positions(p.select("row", text))
        at = at.join(F.broadcast(deep.withColumnRenamed("ratio", "deep")), "code", "left")
        short = short.select(F.col("code").alias("short"), F.col("ratio").alias("shallow"))
        at = at.join(F.broadcast(short), F.col("code").bitwiseAND(F.lit(_WIDTH ** ORDER - 1)) == F.col("short"))
        total = at.groupBy("row").agg(F.sum(F.coalesce("deep", "shallow")).alias("sum"), F.count("*").alias("n"))
        score = F.col("sum") / F.col("n") / MICRO
        score = F.greatest(F.lit(-float(MAX_NATS)), F.least(F.lit(float(MAX_NATS)), score))
        scored = written(p.join(total, "row").withColumn("score", score), "url-scores")
    cut = _threshold(scored)
    verdict = F.coalesce("label", F.when(F.floor(F.col("score") * 1000) >= cut, "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).drop("score")
