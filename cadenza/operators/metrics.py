"""Model metrics from a predictions table, and small-table rankings.

Predictions are long: (key, model, ordinal, actual, predicted). Every metric is
one ``groupBy(model)`` pass (or a pass over the confusion counts, which are
bounded by models x classes x classes), so scoring millions of predictions
for many models costs one shuffle of a few rows per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.numeric import pearson, round_to

from cadenza.functions.numeric import popularity_category

REG_METRICS = ["MAE", "MSE", "RMSE", "R2"]
CLF_METRICS = ["Accuracy", "Precision", "Recall", "F1"]


def _long(wide: DataFrame, task: str, names: list[str], digits: int) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), round_to(F.col(m), digits).alias("value"))
                      for m in names])
    return wide.select(F.lit(task).alias("task"), "model", "ordinal", F.inline(cells))


def regression_metrics(preds: DataFrame, digits: int = 4) -> DataFrame:
    """MAE, MSE, RMSE, R2 per model, rounded; long form."""
    err = F.col("actual") - F.col("predicted")
    wide = (preds.groupBy("model", "ordinal")
                 .agg(F.avg(F.abs(err)).alias("MAE"),
                      F.avg(err * err).alias("MSE"),
                      F.sum(err * err).alias("_sse"),
                      (F.var_pop("actual") * F.count(F.lit(1))).alias("_sst"))
                 .withColumn("RMSE", F.sqrt("MSE"))
                 .withColumn("R2", 1 - F.try_divide(F.col("_sse"), F.col("_sst"))))
    return _long(wide, "regression", REG_METRICS, digits)


def with_classes(preds: DataFrame) -> DataFrame:
    """Category rule on both sides of a numeric predictions table."""
    return preds.select("key", "model", "ordinal",
                        popularity_category("actual").alias("actual"),
                        popularity_category("predicted").alias("predicted"))


def confusion_counts(cls_preds: DataFrame) -> DataFrame:
    """(model, ordinal, actual, predicted, n) -- combined map-side."""
    return cls_preds.groupBy("model", "ordinal", "actual", "predicted").agg(
        F.count(F.lit(1)).alias("n"))


def classification_metrics(cls_preds: DataFrame, digits: int = 4) -> DataFrame:
    """Accuracy and support-weighted precision, recall, F1 (0 where a
    class is never predicted), rounded; long form."""
    cm = confusion_counts(cls_preds)
    tp = cm.where(F.col("actual") == F.col("predicted")).groupBy("model", "ordinal", F.col("actual").alias("cls")) \
           .agg(F.sum("n").alias("tp"))
    support = cm.groupBy("model", "ordinal", F.col("actual").alias("cls")).agg(F.sum("n").alias("support"))
    predicted = cm.groupBy("model", "ordinal", F.col("predicted").alias("cls")).agg(F.sum("n").alias("pred"))
    per = (support.join(predicted, ["model", "ordinal", "cls"], "full")
                  .join(tp, ["model", "ordinal", "cls"], "left")
                  .na.fill(0, ["support", "pred", "tp"]))
    prec = F.when(F.col("pred") > 0, F.col("tp") / F.col("pred")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    per = per.select("*", prec.alias("p"), rec.alias("r"))
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    w = F.col("support")
    wide = (per.groupBy("model", "ordinal")
               .agg((F.sum("tp") / F.sum(w)).alias("Accuracy"),
                    (F.sum(F.col("p") * w) / F.sum(w)).alias("Precision"),
                    (F.sum(F.col("r") * w) / F.sum(w)).alias("Recall"),
                    (F.sum(f1 * w) / F.sum(w)).alias("F1")))
    return _long(wide, "classification", CLF_METRICS, digits)


def confusion_matrix(cls_preds: DataFrame) -> DataFrame:
    """(model, actual, predicted, n) over the full class grid (zeros
    included), classes in alphabetical order. The grid of each model is its
    observed class list (actual and predicted, bounded by the number of
    classes) exploded twice -- no cross join."""
    cm = confusion_counts(cls_preds)
    classes = cm.groupBy("model", "ordinal").agg(
        F.array_sort(F.array_union(F.collect_set("actual"), F.collect_set("predicted"))).alias("classes"))
    grid = (classes.select("model", "ordinal", F.explode("classes").alias("actual"), "classes")
                   .select("model", "ordinal", "actual", F.explode("classes").alias("predicted")))
    return (grid.join(cm, ["model", "ordinal", "actual", "predicted"], "left")
                .select("model", "ordinal", "actual", "predicted",
                        F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def confusion_normalised(cm: DataFrame) -> DataFrame:
    """Each row (actual class) divided by its total."""
    w = Window.partitionBy("model", "actual")
    return cm.select("*", round_to(F.try_divide(F.col("n"), F.sum("n").over(w)), 6).alias("share"))


# ---------------------------------------------------------------------------
# rankings over a (small) metric table: T1-T4, T6, T7
# ---------------------------------------------------------------------------

def leaderboard(metrics: DataFrame, by: dict | None = None) -> DataFrame:
    """Models ranked per task by their key metric (R2 / F1), best first;
    table order (``ordinal``) breaks ties."""
    by = by or {"regression": "R2", "classification": "F1"}
    key = F.lit(False)
    for task, metric in by.items():
        key = key | ((F.col("task") == task) & (F.col("metric") == metric))
    w = Window.partitionBy("task").orderBy(F.desc("value"), F.asc("ordinal"))
    return metrics.where(key).select("task", "model", "ordinal", "metric", "value",
                                     F.row_number().over(w).alias("rank"))


def best_model(metrics: DataFrame, by: dict | None = None) -> DataFrame:
    """Best value and model per task (ties -> first in table order)."""
    board = leaderboard(metrics, by)
    return board.where(F.col("rank") == 1).select("task", F.col("model").alias("best_model"),
                                                  F.col("value").alias("best_value"))


def metrics_pivot(metrics: DataFrame, task: str) -> DataFrame:
    """T4: wide table, one row per model, one column per metric (listed, so
    no extra job discovers the pivot values)."""
    names = REG_METRICS if task == "regression" else CLF_METRICS
    return (metrics.where(F.col("task") == task)
                   .groupBy("model", "ordinal").pivot("metric", names).agg(F.first("value")))


def top_k_wide(metrics: DataFrame, task: str, k: int = 3) -> DataFrame:
    """The top ``k`` models of a task with all their metrics."""
    board = leaderboard(metrics).where((F.col("task") == task) & (F.col("rank") <= k))
    wide = metrics_pivot(metrics, task)
    return board.select("model", "rank").join(wide, "model").orderBy("rank")


def importance_pct(imp: DataFrame, top: int | None = None, digits: int = 2) -> DataFrame:
    """Rank (descending importance, then name) and percent of the
    total, rounded; with ``top`` the percent is within the first ``top``.
    The input is one row per feature (bounded by the feature count)."""
    w = Window.orderBy(F.desc("importance"), F.asc("feature"))
    ranked = imp.select("feature", "importance", F.row_number().over(w).alias("rank"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    total = Window.partitionBy()
    return ranked.select("feature", "importance", "rank",
                         round_to(F.col("importance") / F.sum("importance").over(total) * 100, digits).alias("pct"))
