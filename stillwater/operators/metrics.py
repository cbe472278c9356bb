"""Metrics by group, clean against degraded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stillwater.functions import scalars as S
from stillwater.operators.thresholds import curve

#: The conditions in their order, and the groups in theirs.
CONDITIONS = ("CLN", "RSZ", "BLR", "H40", "PLT")
METHODS = ("M1", "M2", "M3", "M4")


def order_of(c: str, values: tuple[str, ...]) -> Column:
    """A number to sort categories by."""
    out = F.lit(len(values))
    for k, v in reversed(list(enumerate(values))):
        out = F.when(F.col(c) == v, k).otherwise(out)
    return out


def auc(rows: DataFrame, keys: list[str], score: str = "score", label: str = "label", weight: str | None = None) -> DataFrame:
    """Tie-aware area under the curve: pairs ranked right, ties half, of all pairs.  Null without both classes."""
    w = F.col(weight) if weight else F.lit(1)
    hist = rows.where(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("s")).agg(F.sum(F.when(F.col(label) == 1, w).otherwise(0)).cast("long").alias("p"), F.sum(F.when(F.col(label) == 0, w).otherwise(0)).cast("long").alias("q"))
    below = Window.partitionBy(*keys).orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumn("mid", F.sum("q").over(below) - F.col("q") / F.lit(2.0))
    out = hist.groupBy(*keys).agg(F.sum(F.col("p") * F.col("mid")).alias("u"), F.sum("p").alias("n_manipulated"), F.sum("q").alias("n_real"))
    pairs = F.col("n_manipulated") * F.col("n_real")
    return out.select(*keys, F.when(pairs > 0, F.col("u") / pairs).alias("auc"), "n_real", "n_manipulated")


def rates(rows: DataFrame, keys: list[str], label: str = "label", decision: str = "decision", weight: str | None = None) -> DataFrame:
    """Confusion counts, FPR, FNR and HTER; null where a class is empty."""
    w = F.col(weight) if weight else F.lit(1)

    def count(a: int, b: int) -> Column:
        return F.sum(F.when((F.col(label) == a) & (F.col(decision) == b), w).otherwise(0)).cast("long")

    out = rows.where(F.col(decision).isNotNull()).groupBy(*keys).agg(count(1, 1).alias("tp"), count(0, 1).alias("fp"), count(0, 0).alias("tn"), count(1, 0).alias("fn"))
    fpr = F.when(F.col("fp") + F.col("tn") > 0, F.col("fp") / (F.col("fp") + F.col("tn")))
    fnr = F.when(F.col("fn") + F.col("tp") > 0, F.col("fn") / (F.col("fn") + F.col("tp")))
    return out.withColumns({"fpr": fpr, "fnr": fnr, "hter": (fpr + fnr) / 2})


def bundle(rows: DataFrame, keys: list[str], score: str = "video_score", label: str = "study_label", weight: str | None = None) -> DataFrame:
    """AUC and the rates at the threshold, of eligible rows: both from one histogram of the scores."""
    w = F.col(weight) if weight else F.lit(1)

    def count(a: int, b: int | None = None) -> Column:
        of = F.col(label) == a
        return F.sum(F.when(of if b is None else of & (F.col("decision") == b), w).otherwise(0)).cast("long")

    cells = {"p": count(1), "q": count(0), "tp": count(1, 1), "fp": count(0, 1), "tn": count(0, 0), "fn": count(1, 0)}
    usable = rows.where(F.col(score).isNotNull() & F.col("decision").isin(0, 1))
    hist = usable.groupBy(*keys, F.col(score).alias("s")).agg(*(c.alias(n) for n, c in cells.items()))
    below = Window.partitionBy(*keys).orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumn("mid", F.sum("q").over(below) - F.col("q") / F.lit(2.0))
    out = hist.groupBy(*keys).agg(F.sum(F.col("p") * F.col("mid")).alias("u"), F.sum("p").alias("n_manipulated"), F.sum("q").alias("n_real"), *(F.sum(n).alias(n) for n in ("tp", "fp", "tn", "fn")))
    pairs = F.col("n_manipulated") * F.col("n_real")
    fpr = F.when(F.col("fp") + F.col("tn") > 0, F.col("fp") / (F.col("fp") + F.col("tn")))
    fnr = F.when(F.col("fn") + F.col("tp") > 0, F.col("fn") / (F.col("fn") + F.col("tp")))
    return out.select(*keys, F.when(pairs > 0, F.col("u") / pairs).alias("auc"), "n_real", "n_manipulated", "tp", "fp", "tn", "fn", fpr.alias("fpr"), fnr.alias("fnr"), ((fpr + fnr) / 2).alias("hter"))


def legacy_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy, precision, recall, F1 and the rest; an empty denominator gives NaN."""
    out = rates(rows, keys).select(*keys, "tp", "fp", "tn", "fn")
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    out = out.withColumns({"accuracy": S.ratio(tp + tn, tp + tn + fp + fn), "precision": S.ratio(tp, tp + fp), "recall_tpr": S.ratio(tp, tp + fn), "fpr": S.ratio(fp, fp + tn), "tnr": S.ratio(tn, tn + fp), "fnr": S.ratio(fn, fn + tp)})
    f1 = F.when(F.isnan("precision") | F.isnan("recall_tpr") | (F.col("precision") + F.col("recall_tpr") == 0), F.lit(float("nan"))).otherwise(2 * F.col("precision") * F.col("recall_tpr") / (F.col("precision") + F.col("recall_tpr")))
    return out.withColumns({"f1": f1, "balanced_accuracy": (F.col("recall_tpr") + F.col("tnr")) / 2, "hter": (F.col("fpr") + F.col("fnr")) / 2})


def roc_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """EER at the curve point with the smallest |FNR - FPR|, average precision, accuracy at 0.5 (columns score, label)."""
    points = curve(rows, keys).withColumns({"tpr": F.col("tp") / F.col("P"), "fpr": F.col("fp") / F.col("N"), "prec": F.col("tp") / (F.col("tp") + F.col("fp"))})
    ordered = Window.partitionBy(*keys).orderBy(F.desc("score"))
    points = points.withColumn("step", F.col("tpr") - F.coalesce(F.lag("tpr").over(ordered), F.lit(0.0)))
    gap = F.abs(1 - F.col("tpr") - F.col("fpr"))
    out = points.groupBy(*keys).agg(F.min_by("fpr", F.struct(gap, -F.col("score"))).alias("eer"), F.sum(F.col("step") * F.col("prec")).alias("ap"))
    acc = rows.groupBy(*keys).agg(F.avg(((F.col("score") > 0.5).cast("int") == F.col("label")).cast("double")).alias("acc"))
    return out.join(acc, keys)


def groups_of() -> Column:
    """The metric groups of a row: real videos of the first dataset belong to all five, manipulated ones to their method's and
    the pooled one; the second dataset has the pooled group alone.
    """
    methods = F.array(*(F.lit(m) for m in METHODS), F.lit("pooled"))
    return F.when(F.col("dataset") == "second", F.array(F.lit("pooled"))).when(F.col("study_label") == 0, methods).otherwise(F.array("manipulation", F.lit("pooled")))


def evaluated() -> Column:
    """False for validation rows, which take no part in any metric."""
    return ~((F.col("dataset") == "first") & (F.col("role") == "validation"))


def fan_out(rows: DataFrame) -> DataFrame:
    """Each row once a metric group."""
    return rows.where(evaluated()).withColumn("metric_group", F.explode(groups_of()))


GROUP_KEYS = ["detector", "dataset", "role", "condition", "metric_group"]


def absolute(decisions: DataFrame) -> DataFrame:
    """AUC, FPR, FNR and HTER of every metric group; groups without a nominal class are left out."""
    rows = fan_out(decisions)
    nominal = rows.groupBy(*GROUP_KEYS).agg(F.count_if(F.col("study_label") == 0).alias("nominal_real"), F.count_if(F.col("study_label") == 1).alias("nominal_manipulated"), F.count_if(F.col("decision").isNotNull()).alias("n_valid"))
    return nominal.where("nominal_real > 0 and nominal_manipulated > 0").join(bundle(rows, GROUP_KEYS), GROUP_KEYS)


def pairs(decisions: DataFrame) -> DataFrame:
    """Clean and degraded rows of videos that are valid in both."""
    valid = decisions.where(F.col("decision").isNotNull() & F.col("video_score").isNotNull())
    keys = ["detector", "dataset", "role", "video"]
    clean = valid.where("condition = 'CLN'").select(*keys, F.col("video_score").alias("clean_score"), F.col("decision").alias("clean_decision"), F.col("threshold_value").alias("clean_threshold"))
    return valid.where("condition <> 'CLN'").join(clean, keys)


def paired_deltas(decisions: DataFrame) -> DataFrame:
    """Degraded minus clean, over the same videos, of AUC, FPR, FNR and HTER."""
    rows = fan_out(pairs(decisions))
    bad = bundle(rows, GROUP_KEYS)
    clean = bundle(rows.withColumns({"video_score": F.col("clean_score"), "decision": F.col("clean_decision")}), GROUP_KEYS)
    names = ("auc", "fpr", "fnr", "hter")
    joined = bad.select(*GROUP_KEYS, "n_real", "n_manipulated", *names).join(clean.select(*GROUP_KEYS, *(F.col(m).alias(f"clean_{m}") for m in names)), GROUP_KEYS)
    return joined.select(*GROUP_KEYS, "n_real", "n_manipulated", *((F.col(m) - F.col(f"clean_{m}")).alias(f"delta_{m}") for m in names))


def tpr_on_grid(rows: DataFrame, keys: list[str], points: int = 100) -> DataFrame:
    """keys, step (0 to points - 1), tpr: the curve's TPR, linear between its points, at the FPRs step / (points - 1).

    Where the curve rises at one FPR, the upper end counts there, and the lower end for what lies before; at FPR 0 the TPR is 0.
    Curves are cut to the first and last point of each cell of the grid, found by a combined aggregation in whole numbers, so
    the window sees at most ``points`` rows a key.  Keys without both classes have no rows (columns score, label).
    """
    cells = points - 1
    curve_points = curve(rows.where(F.col("score").isNotNull()), keys).where("P > 0 and N > 0").select(*keys, "P", "N", F.col("fp").cast("long").alias("fp"), F.col("tp").cast("long").alias("tp"))
    place = F.struct("fp", "tp")
    ends = curve_points.withColumn("step", F.expr(f"({cells} * fp + N - 1) div N")).groupBy(*keys, "step").agg(F.min(place).alias("low"), F.max(place).alias("high"))
    totals = curve_points.groupBy(*keys).agg(F.max("P").alias("P"), F.max("N").alias("N"))
    grid = totals.select(*keys, "P", "N", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells).cast("long"))).alias("step")).join(ends, [*keys, "step"], "left")
    by = Window.partitionBy(*keys).orderBy("step")
    start = F.struct(F.lit(0).cast("long").alias("fp"), F.lit(0).cast("long").alias("tp"))  # the curve begins at no positives
    last = F.coalesce(F.max("high").over(by.rowsBetween(Window.unboundedPreceding, 0)), start)
    after = F.min("low").over(by.rowsBetween(1, Window.unboundedFollowing))
    both = grid.withColumns({"a": last, "b": after})
    share = (F.col("step") * F.col("N") - cells * F.col("a.fp")) / (cells * (F.col("b.fp") - F.col("a.fp")))
    hits = F.when(F.col("step") == 0, F.lit(0.0)).when(F.col("b").isNull(), F.col("a.tp").cast("double")).otherwise(F.col("a.tp") + share * (F.col("b.tp") - F.col("a.tp")))
    return both.select(*keys, "step", (hits / F.col("P")).alias("tpr"))


def with_row_mean(rows: DataFrame, columns: list[str], name: str = "mean") -> DataFrame:
    """The mean over those of the columns that aren't null; null where all are."""
    held = F.array_compact(F.array(*columns))
    total = F.aggregate(held, F.lit(0.0), lambda a, x: a + x)
    return rows.withColumn(name, F.when(F.size(held) > 0, total / F.size(held)))
