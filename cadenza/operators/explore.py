"""Dashboard aggregates, histograms, correlation matrices, explorer views.

All aggregates are single ``agg`` / ``groupBy`` passes (map-side combined).
Table-wide constants (min/max for bin edges, column means) come from a
one-row aggregate -- either a few numbers read back as literals or the row
joined back with a broadcast hint (one row is a proven size bound) -- so no
operator funnels the table through a ``Window.partitionBy()``; the windows
here run over aggregated rows only (classes, decades, <= 500 explorer rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.schema import SEED

from cadenza.functions.numeric import pearson, round_to

from cadenza.functions.text import search_match
from cadenza.schema import (AUDIO_FEATURES, CATEGORY_ORDER, CORR_COLUMNS,
                            EXPLORER_COLUMNS, EXPLORER_LIMIT, EXPLORER_YEARS,
                            HIST_BINS_EXPLORER, RADAR_FEATURES, STATS_FEATURES)


def _present(df: DataFrame, cols: list[str]) -> list[str]:
    have = set(df.columns)
    return [c for c in cols if c in have]


def _category_rank(col: str = "popularity_category") -> Column:
    out = F.lit(None).cast("int")
    for i, c in enumerate(CATEGORY_ORDER):
        out = F.when(F.col(col) == c, i + 1).otherwise(out)
    return out


# ---------------------------------------------------------------------------
# KPIs and profiles
# ---------------------------------------------------------------------------

def overview_kpis(df: DataFrame, target: str = "popularity", artist: str = "artist_name",
                  approx: bool = False) -> DataFrame:
    """G1: row count, mean target, distinct artists (exact unless ``approx``)."""
    distinct = (F.approx_count_distinct(artist) if approx else F.countDistinct(artist))
    return df.agg(F.count(F.lit(1)).alias("n_tracks"),
                  round_to(F.avg(target), 6).alias("avg_popularity"),
                  distinct.alias("n_artists"))


def dataset_profile(df: DataFrame) -> DataFrame:
    """Mean duration, explicit rate x100, distinct primary genres."""
    return df.agg(round_to(F.avg("duration_min"), 6).alias("avg_duration_min"),
                  round_to(F.avg("explicit") * 100, 6).alias("explicit_pct"),
                  F.countDistinct("primary_genre").alias("n_genres"))


def year_bounds(df: DataFrame, year: str = "release_year") -> DataFrame:
    """Slider bounds."""
    return df.agg(F.min(year).alias("min_year"), F.max(year).alias("max_year"))


def view_kpis(df: DataFrame) -> DataFrame:
    """KPI strip of a (filtered) view."""
    return df.agg(F.count(F.lit(1)).alias("n_tracks"),
                  round_to(F.avg("popularity"), 6).alias("avg_popularity"),
                  round_to(F.avg("energy"), 6).alias("avg_energy"),
                  round_to(F.avg("danceability"), 6).alias("avg_danceability"))


def analytics_kpis(df: DataFrame) -> DataFrame:
    """Six averages in one pass."""
    return df.agg(round_to(F.avg("popularity"), 6).alias("avg_popularity"),
                  round_to(F.avg("danceability"), 6).alias("avg_danceability"),
                  round_to(F.avg("energy"), 6).alias("avg_energy"),
                  round_to(F.avg("valence"), 6).alias("avg_valence"),
                  round_to(F.avg("explicit") * 100, 6).alias("explicit_pct"),
                  round_to(F.avg("tempo"), 6).alias("avg_tempo"))


# ---------------------------------------------------------------------------
# group profiles
# ---------------------------------------------------------------------------

def category_counts(df: DataFrame, col: str = "popularity_category") -> DataFrame:
    """Count per class in the fixed order, absent classes skipped, share
    of the total. The share window runs over the <= 4 aggregated rows."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return (counts.select(col, "n", _category_rank(col).alias("ord"),
                          round_to(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))
                  .orderBy("ord"))


def peak_year(df: DataFrame, year: str = "release_year") -> DataFrame:
    """The year with the most rows; the earlier year wins a tie."""
    counts = df.where(F.col(year).isNotNull()).groupBy(year).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc(year)).limit(1).select(
        F.col(year).alias("peak_year"), "n")


def popularity_by_decade(df: DataFrame, target: str = "popularity",
                         decade_col: str = "decade") -> DataFrame:
    """Mean target per decade, the year-0 decade removed, sorted."""
    return (df.where(F.col(decade_col).isNotNull() & (F.col(decade_col) != "0s"))
              .groupBy(decade_col)
              .agg(round_to(F.avg(target), 6).alias("avg_popularity"))
              .orderBy(decade_col))


def count_by_decade(df: DataFrame, decade_col: str = "decade") -> DataFrame:
    """Rows per decade, the year-0 decade removed, sorted."""
    return (df.where(F.col(decade_col).isNotNull() & (F.col(decade_col) != "0s"))
              .groupBy(decade_col).agg(F.count(F.lit(1)).alias("n"))
              .orderBy(decade_col))


def popularity_by_category(df: DataFrame, target: str = "popularity",
                           col: str = "popularity_category") -> DataFrame:
    """Mean target for each of the four classes; an absent class gives
    NULL. The class list is a 4-element literal array, exploded, so the
    left join is against a 4-row side."""
    means = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.avg(target).alias("_m"))
    classes = (df.sparkSession.range(1)
                 .select(F.posexplode(F.array(*[F.lit(c) for c in CATEGORY_ORDER])).alias("ord0", col)))
    return (classes.join(F.broadcast(means), col, "left")
                   .select(col, (F.col("ord0") + 1).cast("int").alias("ord"),
                           round_to(F.col("_m"), 6).alias("avg_popularity"))
                   .orderBy("ord"))


def audio_profile(df: DataFrame, feats: list[str] = RADAR_FEATURES,
                  col: str = "popularity_category") -> DataFrame:
    """Mean of each feature per class (one group-by, absent classes skipped)."""
    feats = _present(df, feats)
    return (df.where(F.col(col).isin(CATEGORY_ORDER))
              .groupBy(col)
              .agg(*[round_to(F.avg(f), 6).alias(f"avg_{f}") for f in feats])
              .withColumn("ord", _category_rank(col))
              .orderBy("ord"))


def feature_stats(df: DataFrame, feats: list[str] = STATS_FEATURES, digits: int = 3) -> DataFrame:
    """Mean, sample std, min, max per feature (one pass), long form,
    rounded half-to-even."""
    feats = _present(df, feats)
    aggs = []
    for f in feats:
        aggs += [F.avg(f).alias(f"{f}__mean"), F.stddev_samp(f).alias(f"{f}__std"),
                 F.min(f).cast("double").alias(f"{f}__min"), F.max(f).cast("double").alias(f"{f}__max")]
    wide = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(f).alias("feature"),
                              F.bround(F.col(f"{f}__mean"), digits).alias("mean"),
                              F.bround(F.col(f"{f}__std"), digits).alias("std"),
                              F.bround(F.col(f"{f}__min"), digits).alias("min"),
                              F.bround(F.col(f"{f}__max"), digits).alias("max")) for f in feats])
    return wide.select(F.inline(rows))


# ---------------------------------------------------------------------------
# histograms
# ---------------------------------------------------------------------------

def bin_index(x: Column, lo: Column, hi: Column, n: int) -> Column:
    """Equal-width bin 1..n; the maximum lands in bin n; lo == hi -> bin 1."""
    raw = F.floor(F.lit(n) * (x - lo) / (hi - lo)) + 1
    return (F.when(x.isNull(), None)
              .when(hi == lo, F.lit(1))
              .otherwise(F.least(F.greatest(raw, F.lit(1)), F.lit(n)))).cast("int")


def literal_bin(x: Column, lo: float | None, hi: float | None, n: int) -> Column:
    """:func:`bin_index` with edges known on the driver: the same arithmetic
    (``floor(n * (x - lo) / (hi - lo)) + 1``, clamped), with a constant
    column decided here, so the per-row expression stays small."""
    if lo is None:
        return F.lit(None).cast("int")
    if hi == lo:
        return F.when(x.isNotNull(), F.lit(1))
    raw = F.floor(F.lit(n) * (x - F.lit(float(lo))) / F.lit(float(hi) - float(lo))) + 1
    # greatest/least skip NULL, so a missing value is kept missing explicitly
    return F.when(x.isNotNull(), F.least(F.greatest(raw, F.lit(1)), F.lit(n))).cast("int")


def histogram(df: DataFrame, cols: list[str], bins: int) -> DataFrame:
    """Counts per equal-width bin for each of ``cols`` in one pass.

    Plan: one min/max aggregate (two numbers per column reach the driver),
    then every row emits one integer ``column_index * bins + bin - 1`` per
    column and a single ``groupBy(code).count()`` counts them (combined
    map-side: at most ``len(cols) * bins`` rows leave each task). The bin
    grid is ``range(len(cols) * bins)``, left-joined to the counts, so empty
    bins show as 0. Missing values are not counted.
    """
    cols = _present(df, cols)
    row = df.agg(*[F.struct(F.min(c).cast("double").alias("lo"),
                            F.max(c).cast("double").alias("hi")).alias(c) for c in cols]).first()
    stats = [(c, row[c]["lo"], row[c]["hi"]) for c in cols if row[c]["lo"] is not None]
    spark = df.sparkSession
    if not stats:
        return spark.createDataFrame([], "feature string, bin int, bin_lo double, bin_hi double, n bigint")
    codes = F.array(*[F.lit(i * bins) + literal_bin(F.col(c).cast("double"), lo, hi, bins) - 1
                      for i, (c, lo, hi) in enumerate(stats)])
    counts = (df.select(F.explode(codes).alias("code")).where(F.col("code").isNotNull())
                .groupBy("code").agg(F.count(F.lit(1)).alias("n")))
    names = F.array(*[F.lit(c) for c, _, _ in stats])
    los = F.array(*[F.lit(float(lo)) for _, lo, _ in stats])
    widths = F.array(*[F.lit((float(hi) - float(lo)) / bins) for _, lo, hi in stats])
    idx = (F.col("code") / bins).cast("int") + 1
    b = (F.col("code") % bins).cast("int") + 1
    lo_c, w_c = F.element_at(los, idx), F.element_at(widths, idx)
    grid = spark.range(len(stats) * bins).select(F.col("id").cast("int").alias("code"))
    return (grid.join(counts, "code", "left")
                .select(F.element_at(names, idx).alias("feature"), b.alias("bin"),
                        round_to(lo_c + (b - 1) * w_c, 6).alias("bin_lo"),
                        round_to(lo_c + b * w_c, 6).alias("bin_hi"),
                        F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"))
                .orderBy("feature", "bin"))


# ---------------------------------------------------------------------------
# correlation
# ---------------------------------------------------------------------------

CORR_BLOCK = 4


def corr_matrix(df: DataFrame, cols: list[str] = CORR_COLUMNS, digits: int = 4) -> DataFrame:
    """Full Pearson matrix, pairwise-complete, as long form
    (row_feature, col_feature, corr, label); ``label`` is rounded to 2,
    half-to-even (G18). A zero-variance column, and a pair without a common
    row, give NULL.

    One pass, whether or not columns are complete: each row emits, for each
    column, blocks of ``CORR_BLOCK`` of the columns after it, and
    ``groupBy(block)`` keeps mergeable centred co-moments of the column with the
    others over their common rows (combined map-side, a few rows leave a task).
    A block is small enough that its generated code is compiled to machine code,
    and large enough that few rows are emitted. The cells are formed on that
    small result.
    """
    cols = _present(df, cols)
    k = len(cols)
    blocks = [(i, j) for i in range(k) for j in range(i, k, CORR_BLOCK)]
    x = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    none = F.lit(None).cast("double")
    emitted = F.array(*[F.struct(F.lit(n).alias("block"), F.col(f"x{i}").alias("a"),
                                 *[(F.col(f"x{j + d}") if j + d < k else none).alias(f"b{d}") for d in range(CORR_BLOCK)])
                        for n, (i, j) in enumerate(blocks)])
    aggs = []
    for d in range(CORR_BLOCK):
        aggs += [F.covar_pop("a", f"b{d}").alias(f"cov{d}"),
                 F.var_pop(F.when(F.col(f"b{d}").isNotNull(), F.col("a"))).alias(f"va{d}"),
                 F.var_pop(f"b{d}").alias(f"vb{d}")]
    moments = x.select(F.inline(emitted)).where(F.col("a").isNotNull()).groupBy("block").agg(*aggs)
    moments = moments.select("block", F.inline(F.array(*[
        F.struct(F.lit(d).alias("place"), F.col(f"cov{d}").alias("cov"), F.col(f"va{d}").alias("va"), F.col(f"vb{d}").alias("vb"))
        for d in range(CORR_BLOCK)])))
    varied = (F.col("va") > 0) & (F.col("vb") > 0)
    r = F.when(varied, F.col("cov") / (F.sqrt("va") * F.sqrt("vb")))
    r = F.when(r > 1.0, 1.0).when(r < -1.0, -1.0).otherwise(r)
    pairs = [(n, j - first, i, j) for n, (i, first) in enumerate(blocks) for j in range(first, min(first + CORR_BLOCK, k))]
    cells = [(n, d, cols[i], cols[j]) for n, d, i, j in pairs]
    cells += [(n, d, cols[j], cols[i]) for n, d, i, j in pairs if i != j]
    names = df.sparkSession.createDataFrame(cells, "block int, place int, row_feature string, col_feature string")
    return (names.join(moments.select("block", "place", r.alias("v")), ["block", "place"], "left")
                 .select("row_feature", "col_feature", round_to("v", digits).alias("corr"),
                         F.bround("v", 2).alias("label")))


def corr_target_sorted(matrix: DataFrame, target: str = "popularity") -> DataFrame:
    """The target's column without itself, ascending, with its sign."""
    return (matrix.where((F.col("col_feature") == target) & (F.col("row_feature") != target))
                  .select(F.col("row_feature").alias("feature"), "corr",
                          F.when(F.col("corr") < 0, "negative").otherwise("positive").alias("sign"))
                  .orderBy("corr", "feature"))


# ---------------------------------------------------------------------------
# explorer (X1-X6, X10)
# ---------------------------------------------------------------------------

def search(df: DataFrame, text: str | None, cols: tuple = ("name", "artist_name"),
           literal: bool = False) -> DataFrame:
    """Rows whose name or artist matches ``text`` (regex, ignoring case)."""
    return df.where(search_match(list(cols), text, literal))


def explorer_filter(df: DataFrame, text: str | None = None,
                    classes: list[str] | tuple = tuple(CATEGORY_ORDER),
                    years: tuple[int, int] = EXPLORER_YEARS, literal: bool = False) -> DataFrame:
    """Search, class membership (empty choice -> no rows), year range.
    The class and year predicates reach the parquet scan of a snapshot."""
    out = search(df, text, literal=literal)
    out = out.where(F.col("popularity_category").isin(list(classes)) if classes else F.lit(False))
    return out.where(F.col("release_year").between(years[0], years[1]))


def explorer_view(df: DataFrame, text: str | None = None,
                  classes: list[str] | tuple = tuple(CATEGORY_ORDER),
                  years: tuple[int, int] = EXPLORER_YEARS, sort_col: str = "popularity",
                  limit: int = EXPLORER_LIMIT, cols: list[str] = EXPLORER_COLUMNS,
                  literal: bool = False) -> DataFrame:
    """Filter, sort descending (missing last), project, first ``limit``.

    Ties are broken by the projected columns, so the shown rows are fixed.
    Planned as ``TakeOrderedAndProject``: each task keeps its own top
    ``limit`` rows; only those are merged.
    """
    out = explorer_filter(df, text, classes, years, literal)
    shown = _present(out, cols)
    order = [F.col(sort_col).desc_nulls_last()] + [F.col(c).asc_nulls_last() for c in shown]
    return out.orderBy(*order).limit(limit).select(*shown)


def explorer_page(view: DataFrame, page: int, size: int, sort_col: str = "popularity") -> DataFrame:
    """One page of the (already limited, hence bounded) explorer view,
    after a total order."""
    order = [F.col(sort_col).desc_nulls_last()] + [F.col(c).asc_nulls_last() for c in view.columns]
    ranked = view.withColumn("row", F.row_number().over(Window.orderBy(*order)))
    lo = page * size
    return ranked.where((F.col("row") > lo) & (F.col("row") <= lo + size))


def histogram_view(view: DataFrame, cols: tuple = ("popularity", "energy", "danceability"),
                   bins: int = HIST_BINS_EXPLORER) -> DataFrame:
    """Histograms over the filtered view, all columns in one pass."""
    return histogram(view, list(cols), bins)


def histogram_audio(df: DataFrame, bins: int = 35) -> DataFrame:
    """Histograms of the nine audio features (missing values left out)."""
    return histogram(df, AUDIO_FEATURES, bins)


def scatter(df: DataFrame, x: str, y: str, colour: str | None = None, n: int = 5000, key: str = "id",
            seed: int = SEED) -> DataFrame:
    """An exact sample of ``n`` points with two axes and the column they are
    coloured by. Rows without a value on an axis make no point."""
    from cadenza.operators.sampling import sample_exact
    points = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        key, F.col(x).alias("x"), F.col(y).alias("y"), *([F.col(colour).alias("colour")] if colour else []))
    return sample_exact(points, n, key, seed).drop(key)
