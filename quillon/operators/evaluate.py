"""Exact evaluation: ranks, curves, losses and link ranking.

Curves need a total order of scores.  Rows first collapse to one row per
distinct score and group, so the ordered window runs over distinct scores, not
rows; without a group the order is cut into ranges and shifted by range
totals, so no task sees all of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import vectors as V
from quillon.sources.tables import cut

_BEFORE = (Window.unboundedPreceding, -1)


def _score_steps(df: DataFrame, score: str, label: str, group: list[str]) -> DataFrame:
    """Distinct scores with positives p, negatives n, and positives P and negatives N of higher scores."""
    steps = df.groupBy(*group, score).agg(F.sum((F.col(label) == 1).cast("long")).alias("p"), F.sum((F.col(label) != 1).cast("long")).alias("n"))
    if group:
        w = Window.partitionBy(*group).orderBy(F.desc(score)).rowsBetween(*_BEFORE)
        return steps.select("*", *(F.coalesce(F.sum(c).over(w), F.lit(0)).alias(c.upper() + "_") for c in ("p", "n")))
    parted = cut(steps.repartitionByRange(F.desc(score)).withColumn("_part", F.spark_partition_id()))
    totals = parted.groupBy("_part").agg(F.sum("p").alias("tp"), F.sum("n").alias("tn"))
    w = Window.orderBy("_part").rowsBetween(*_BEFORE)
    before = totals.select("_part", F.coalesce(F.sum("tp").over(w), F.lit(0)).alias("bp"), F.coalesce(F.sum("tn").over(w), F.lit(0)).alias("bn"))
    inner = Window.partitionBy("_part").orderBy(F.desc(score)).rowsBetween(*_BEFORE)
    made = parted.join(F.broadcast(before), "_part")  # one row a range
    return made.select(score, "p", "n", (F.coalesce(F.sum("p").over(inner), F.lit(0)) + F.col("bp")).alias("P_"), (F.coalesce(F.sum("n").over(inner), F.lit(0)) + F.col("bn")).alias("N_"))


def roc_auc(df: DataFrame, score: str, label: str, group: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve, ties counted half; null without both classes."""
    group = group or []
    steps = _score_steps(df, score, label, group)
    won = F.sum((F.col("P_") + F.col("p") / 2) * F.col("n"))
    return steps.groupBy(*group).agg(F.try_divide(won, (F.sum("p") * F.sum("n")).cast("double")).alias("auc"))


def pr_auc(df: DataFrame, score: str, label: str, group: list[str] | None = None) -> DataFrame:
    """Area under the precision-recall curve by trapezoids, from precision 1 at recall 0."""
    group = group or []
    steps = _score_steps(df, score, label, group)
    total = steps.groupBy(*group).agg(F.sum("p").alias("_all"))
    made = steps.crossJoin(F.broadcast(total)) if not group else steps.join(total, group)
    here = (F.col("P_") + F.col("p")) / (F.col("P_") + F.col("p") + F.col("N_") + F.col("n"))
    before = F.when(F.col("P_") + F.col("N_") == 0, F.lit(1.0)).otherwise(F.try_divide(F.col("P_").cast("double"), F.col("P_") + F.col("N_")))
    return made.groupBy(*group).agg(F.sum(F.try_divide(F.col("p").cast("double"), F.col("_all")) * (here + before) / 2).alias("pr_auc"))


def f1_at_positives(df: DataFrame, score: str, label: str, group: list[str] | None = None) -> DataFrame:
    """F1 where the threshold is the score of the n-th best row, n the number of positives; ties are predicted too."""
    group = group or []
    steps = _score_steps(df, score, label, group)
    total = steps.groupBy(*group).agg(F.sum("p").alias("_all"))
    made = steps.crossJoin(F.broadcast(total)) if not group else steps.join(total, group)
    chosen = made.filter(F.col("P_") + F.col("N_") < F.col("_all"))
    tp, predicted = F.sum("p"), F.sum(F.col("p") + F.col("n"))
    return chosen.groupBy(*group, "_all").agg(F.try_divide(2.0 * tp, predicted + F.col("_all")).alias("f1")).drop("_all")


def accuracy(df: DataFrame, scores: str, label: str) -> DataFrame:
    """Share of rows whose largest score stands at the label; also micro-F1 of one label a row."""
    return df.filter(F.col(label) >= 0).agg(F.avg((V.argmax(F.col(scores)) == F.col(label)).cast("double")).alias("accuracy"))


def multilabel(df: DataFrame, predicted: str, truth: str, eps: float = 1e-7) -> DataFrame:
    """Sums over 0/1 arrays: f1 = 2tp / (2tp + fp + fn) and jaccard = tp / (tp + fp + fn)."""
    pairs = F.arrays_zip(F.col(predicted).alias("p"), F.col(truth).alias("t"))
    count = lambda p, t: F.sum(F.size(F.filter(pairs, lambda x: (x["p"] == p) & (x["t"] == t))))
    s = df.agg(count(1, 1).alias("tp"), count(1, 0).alias("fp"), count(0, 1).alias("fn"))
    return s.select("tp", "fp", "fn", (2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn") + eps)).alias("f1"), F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp") + F.col("fn")).alias("jaccard"))


def regression_errors(df: DataFrame, predicted: str, truth: str, group: list[str] | None = None) -> DataFrame:
    """MAE, MAPE (rows with truth 0 left out) and RMSE."""
    d = F.col(predicted) - F.col(truth)
    return df.groupBy(*(group or [])).agg(F.avg(F.abs(d)).alias("mae"), F.avg(F.try_divide(F.abs(d), F.abs(F.col(truth)))).alias("mape"), F.sqrt(F.avg(d * d)).alias("rmse"))


def cross_entropy(df: DataFrame, scores: str, label: str) -> DataFrame:
    return df.agg(F.avg(-V.log_softmax_at(F.col(scores), F.col(label))).alias("cross_entropy"))


def binary_cross_entropy(df: DataFrame, score: str, label: str) -> DataFrame:
    """From raw scores: softplus(s) - s * y, in its stable form."""
    s = F.col(score)
    return df.agg(F.avg(F.greatest(s, F.lit(0.0)) - s * F.col(label) + F.log1p(F.exp(-F.abs(s)))).alias("bce"))


def target_ranks(candidates: DataFrame, query: list[str], score: str, is_target: str) -> DataFrame:
    """(query, rank): 1 + candidates with a score above the target's; ties favour the target."""
    target = candidates.filter(is_target).groupBy(*query).agg(F.max(score).alias("_t"))
    above = F.sum((F.col(score) > F.col("_t")).cast("long"))
    return candidates.join(target, query).groupBy(*query).agg((above + 1).alias("rank"))


def ranking_metrics(ranks: DataFrame, hits: tuple = (1, 3, 10)) -> DataFrame:
    r = F.col("rank")
    return ranks.agg(F.avg(1 / r).alias("mrr"), F.avg(r).alias("mr"), *(F.avg((r <= k).cast("double")).alias(f"hits_{k}") for k in hits))


def adversarial_loss(df: DataFrame, query: list[str], score: str, temperature: float = 1.0) -> DataFrame:
    """(query, loss): negatives' log-sigmoid losses weighted by their softmax."""
    w = Window.partitionBy(*query)
    e = F.exp(temperature * F.col(score) - F.max(temperature * F.col(score)).over(w))
    made = df.withColumn("_e", e).withColumn("_p", F.col("_e") / F.sum("_e").over(w))
    return made.groupBy(*query).agg((-F.sum(F.col("_p") * F.log(V.sigmoid(-F.col(score))))).alias("loss"))


def contrastive_loss(pairs: DataFrame, anchor: str, similarity: Column, positive: str, temperature: float = 0.5) -> DataFrame:
    """(anchor, loss): -log of the positive's share among exp(similarity / temperature) of all pairs of an anchor."""
    e = pairs.withColumn("_e", F.exp(similarity / temperature))
    return e.groupBy(anchor).agg((-F.log(F.sum(F.when(F.col(positive), F.col("_e"))) / F.sum("_e"))).alias("loss"))


def mean_and_deviation(df: DataFrame, group: list[str], metric: str) -> DataFrame:
    """(group, text): mean and population deviation, four decimals."""
    return df.groupBy(*group).agg(F.format_string("%.4f±%.4f", F.avg(metric), F.stddev_pop(metric)).alias("summary"))


#: Evaluators by name; unknown names raise.
EVALUATORS = {
    "auc": roc_auc,
    "pr_auc": pr_auc,
    "f1_at_positives": f1_at_positives,
    "accuracy": accuracy,
    "multilabel": multilabel,
    "errors": regression_errors,
    "cross_entropy": cross_entropy,
    "bce": binary_cross_entropy,
}


def evaluator(name: str):
    if name not in EVALUATORS:
        raise KeyError(f"no evaluator {name!r}; there are {', '.join(sorted(EVALUATORS))}")
    return EVALUATORS[name]
