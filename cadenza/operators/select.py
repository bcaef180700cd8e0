"""Feature selection: correlation with the target, binned mutual information.

The reference estimator for mutual information is a k-nearest-neighbour one,
which needs all rows on one machine. Here MI is estimated from a joint
histogram: fixed-width bins (edges from one min/max aggregate), one
``groupBy(feature, bin_x, bin_y).count()`` over the stacked columns (combined
map-side: at most features x bins x bins rows leave each task), then
``sum p_xy * ln(p_xy / (p_x * p_y))`` on that small table. Values and ranks
differ from the k-NN estimator; both are in nats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.numeric import pearson, round_to

from cadenza.operators.explore import CORR_BLOCK, literal_bin
from cadenza.schema import SELECTION_CANDIDATES, SELECTION_TOP_K

MI_BINS = 10
MI_BLOCK = 3            # columns whose joint counts are made together
BOUNDARY = 10_000       # rows of a bracket that are put in order


def candidates(df: DataFrame, names: list[str] = SELECTION_CANDIDATES) -> list[str]:
    """Candidate names that exist as columns (driver-side, no job)."""
    have = set(df.columns)
    return [c for c in names if c in have]


def column_profile(df: DataFrame, cols: list[str]) -> dict:
    """One pass: row count and, per column, non-missing count, min and max
    (a few numbers per column reach the driver)."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"k{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    row = df.agg(*aggs).first()
    return {"n": row["_n"],
            "cols": {c: {"count": row[f"k{i}"], "lo": row[f"lo{i}"], "hi": row[f"hi{i}"]}
                     for i, c in enumerate(cols)}}


def corr_with_target(df: DataFrame, cols: list[str], target: str = "popularity",
                     digits: int = 6, profile: dict | None = None) -> DataFrame:
    """Pearson correlation of each column with the target, ``CORR_BLOCK``
    columns a pass over just those columns.

    A profile pass picks the cheapest exact form per column: NULL for a
    constant column, the native ``corr`` when both sides are complete, the
    pairwise-complete ``pearson`` otherwise."""
    prof = profile or column_profile(df, cols + [target])
    n, t = prof["n"], prof["cols"][target]
    exprs = []
    for c in cols:
        p = prof["cols"][c]
        x, y = F.col(c).cast("double"), F.col(target).cast("double")
        if p["lo"] is None or p["lo"] == p["hi"] or t["lo"] is None or t["lo"] == t["hi"]:
            e = F.lit(None).cast("double")
        elif p["count"] == n and t["count"] == n:
            e = F.corr(x, y)
        else:
            e = pearson(x, y)
        exprs.append(e.alias(c))
    long = None
    for at in range(0, len(exprs), CORR_BLOCK):   # branches of one job, each compiled to machine code
        part = df.agg(*exprs[at:at + CORR_BLOCK]).unpivot([], cols[at:at + CORR_BLOCK], "feature", "corr")
        long = part if long is None else long.unionAll(part)
    return long.select("feature", round_to("corr", digits).alias("corr"))


def top_k_abs(scores: DataFrame, value: str, k: int = SELECTION_TOP_K) -> DataFrame:
    """The ``k`` features with the largest absolute score (missing last,
    name breaks ties)."""
    return (scores.orderBy(F.abs(F.col(value)).desc_nulls_last(), F.asc("feature"))
                  .limit(k))


def mutual_info_binned(df: DataFrame, cols: list[str], target: str = "popularity",
                       bins: int = MI_BINS, digits: int = 6, profile: dict | None = None) -> DataFrame:
    """E4 (re-aimed): binned mutual information of each column with the
    target, over complete rows only. Bin edges are literals from one profile
    pass over the complete rows; each row emits (feature, bin_x) pairs for
    one ``groupBy(feature, bin_x, bin_y).count()``."""
    complete = df.select(*cols, target).na.drop()
    # a profile of all rows serves when no column has a missing value
    full = profile is not None and all(v["count"] == profile["n"] for v in profile["cols"].values())
    prof = (profile if full else column_profile(complete, cols + [target]))["cols"]

    def lit_bin(c):
        return literal_bin(F.col(c).cast("double"), prof[c]["lo"], prof[c]["hi"], bins)

    joint = _joint_counts(complete, cols, [lit_bin(c) for c in cols], lit_bin(target), bins)
    return mi_from_counts(joint, digits)


def _joint_counts(df: DataFrame, cols: list[str], bx: list, by, bins: int) -> DataFrame:
    """(feature, bx, by, nxy) for every column against the target bin.

    Each row emits one integer per column, ``index * bins^2 + (bx-1) * bins +
    (by-1)`` -- no strings in the hot path -- and ``groupBy(code).count()``
    (combined map-side: at most columns x bins^2 rows leave each task) does
    the counting; names and bins are decoded on that small result. The columns
    are counted ``MI_BLOCK`` at a time, in branches of one job: the code made for
    the bins of all of them is too large to be compiled to machine code."""
    sq = bins * bins
    codes = [F.lit(i * sq) + (b - 1) * bins + (by - 1) for i, b in enumerate(bx)]
    counts = None
    for at in range(0, len(codes), MI_BLOCK):
        part = (df.select(F.explode(F.array(*codes[at:at + MI_BLOCK])).alias("code")).where(F.col("code").isNotNull())
                  .groupBy("code").agg(F.count(F.lit(1)).alias("nxy")))
        counts = part if counts is None else counts.unionAll(part)
    names = F.array(*[F.lit(c) for c in cols])
    return counts.select(F.element_at(names, (F.col("code") / sq).cast("int") + 1).alias("feature"),
                         ((F.col("code") % sq) / bins).cast("int").alias("bx"),
                         (F.col("code") % bins).cast("int").alias("by"), "nxy")


def mi_from_counts(joint: DataFrame, digits: int = 6) -> DataFrame:
    """MI per feature from joint counts (feature, bx, by, nxy); runs on the
    small histogram table only."""
    wf = Window.partitionBy("feature")
    wx = Window.partitionBy("feature", "bx")
    wy = Window.partitionBy("feature", "by")
    j = joint.select("*", F.sum("nxy").over(wf).alias("n"),
                     F.sum("nxy").over(wx).alias("nx"), F.sum("nxy").over(wy).alias("ny"))
    nxy, n = F.col("nxy").cast("double"), F.col("n").cast("double")
    term = (nxy / n) * F.log((nxy * n) / (F.col("nx").cast("double") * F.col("ny")))
    return (j.groupBy("feature").agg(F.sum(term).alias("mi"))
             .select("feature", round_to("mi", digits).alias("mi")))


def select_features(df: DataFrame, target: str = "popularity", k: int = SELECTION_TOP_K,
                    bins: int = MI_BINS) -> DataFrame:
    """E5: union of the top-``k`` by |corr| and by MI, sorted by name."""
    cols = candidates(df)
    prof = column_profile(df, cols + [target])
    by_corr = top_k_abs(corr_with_target(df, cols, target, profile=prof), "corr", k).select("feature")
    by_mi = top_k_abs(mutual_info_binned(df, cols, target, bins, profile=prof), "mi", k).select("feature")
    return by_corr.union(by_mi).distinct().orderBy("feature")


def exact_quantiles(df: DataFrame, cols: list[str], parts: int, accuracy: int = 10_000,
                    boundary: int = BOUNDARY) -> dict[str, list[float]]:
    """The ``parts - 1`` inner quantiles of each complete numeric column: the
    i-th is the value at place ceil(rows * i / parts) in ascending order. Exact
    at any size, without putting a column in order.

    A distributed order statistic: a bounded quantile sketch of the rows inside
    a bracket gives a narrower bracket (its error is known), one pass counts the
    rows below and inside it, and so on until a bracket holds one value or at
    most ``boundary`` rows; only those rows are put in order. A bracket holds
    about 1 / (accuracy / 4) of the rows of the one before. The driver gets the
    ends and counts of ``len(cols) * (parts - 1)`` brackets.
    """
    xs = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    ends = xs.agg(F.count(F.lit(1)).alias("n"), *[f(f"x{i}").alias(f"{name}{i}") for i in range(len(cols))
                                                  for name, f in (("lo", F.min), ("hi", F.max))]).first()
    n = ends["n"]
    if not n:
        return {c: [] for c in cols}
    open_ = [{"col": i, "part": p, "rank": -(-n * p // parts), "lo": ends[f"lo{i}"], "hi": ends[f"hi{i}"],
              "below": 0, "inside": n} for i in range(len(cols)) for p in range(1, parts)]
    found: dict[tuple, float] = {}
    slack = 2.0 / accuracy
    while True:
        for b in open_:
            if b["lo"] == b["hi"]:
                found[b["col"], b["part"]] = b["lo"]
        open_ = [b for b in open_ if (b["col"], b["part"]) not in found]
        wide = [b for b in open_ if b["inside"] > boundary]
        if not wide:
            break
        # brackets with the same ends share a sketch
        shared: dict[tuple, list] = {}
        for b in wide:
            shared.setdefault((b["col"], b["lo"], b["hi"]), []).append(b)
        aggs = []
        for (i, lo, hi), members in shared.items():
            at = [(b["rank"] - b["below"]) / b["inside"] for b in members]
            probs = [min(max(q + d, 0.0), 1.0) for q in at for d in (-slack, slack)]
            aggs.append(F.percentile_approx(F.when(F.col(f"x{i}").between(lo, hi), F.col(f"x{i}")), probs, accuracy))
        sketch = xs.agg(*[a.alias(f"s{k}") for k, a in enumerate(aggs)]).first()
        tries = []
        for k, members in enumerate(shared.values()):
            for m, b in enumerate(members):
                tries.append((b, sketch[f"s{k}"][2 * m], sketch[f"s{k}"][2 * m + 1]))
        counts = xs.agg(*[c for k, (b, lo, hi) in enumerate(tries) for c in (
            F.count(F.when(F.col(f"x{b['col']}") < lo, 1)).alias(f"b{k}"),
            F.count(F.when(F.col(f"x{b['col']}") <= hi, 1)).alias(f"t{k}"))]).first()
        moved = False
        for k, (b, lo, hi) in enumerate(tries):
            below, upto = counts[f"b{k}"], counts[f"t{k}"]
            top = b["below"] + b["inside"]
            old = (b["lo"], b["hi"])
            if below < b["rank"]:                      # else the bracket missed: the old end stays
                b["lo"], start = lo, below
            else:
                start = b["below"]
            if upto >= b["rank"]:
                b["hi"], top = hi, upto
            b["below"], b["inside"] = start, top - start
            moved |= old != (b["lo"], b["hi"])
        if not moved:                                  # no narrower bracket: order what is left
            break
    if open_:
        code = F.array(*[F.when(F.col(f"x{b['col']}").between(b["lo"], b["hi"]),
                                F.struct(F.lit(k).alias("k"), F.col(f"x{b['col']}").alias("x")))
                         for k, b in enumerate(open_)])
        values = (xs.select(F.explode(F.array_compact(code)).alias("v")).groupBy("v.k", "v.x")
                    .agg(F.count(F.lit(1)).alias("n")))
        left = F.element_at(F.array(*[F.lit(b["rank"] - b["below"]) for b in open_]), F.col("k") + 1)
        upto = F.sum("n").over(Window.partitionBy("k").orderBy("x"))
        rows = (values.withColumn("upto", upto).where(F.col("upto") >= left)
                      .groupBy("k").agg(F.min("x").alias("x")).collect())
        for r in rows:
            found[open_[r["k"]]["col"], open_[r["k"]]["part"]] = r["x"]
    return {c: [found[i, p] for p in range(1, parts)] for i, c in enumerate(cols)}


def mutual_info_quantile(df: DataFrame, cols: list[str], target: str = "popularity",
                         bins: int = MI_BINS, digits: int = 6) -> DataFrame:
    """E4, quantile bins: edges are the exact quantiles of each column over
    complete rows, so every bin holds about the same number of rows; a value's
    bin is one more than the number of different edges below it."""
    complete = df.select(*cols, target).na.drop()
    edges = exact_quantiles(complete, cols + [target], bins)

    def q_bin(c):
        x = F.col(c).cast("double")
        out = F.lit(1)
        for e in sorted(set(edges[c])):
            out = out + (x > F.lit(float(e))).cast("int")
        return out

    joint = _joint_counts(complete, cols, [q_bin(c) for c in cols], q_bin(target), bins)
    return mi_from_counts(joint, digits)
