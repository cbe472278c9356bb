"""F1 to F5 and the aggregations of the study chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from stillwater.functions import scalars as S
from stillwater.operators import metrics, replicates as blocks, resampling, thresholds, videos
from stillwater.plans import fixtures as X
from stillwater.plans.fixtures import query, r9, read

#: The study's number of replicates.
REPLICATES = 2000


@query("f1_video_scores", f"WITH {X.VIDEOS} SELECT detector, dataset, role, video, condition, n AS clean_valid_frame_count, n_ok AS successful_frame_count, round(video_score, 9) AS video_score, CASE WHEN video_score IS NULL THEN 'invalid_condition' ELSE 'ok' END AS inference_status, CASE WHEN video_score IS NULL THEN 'failed frame' END AS failure_reason FROM videos")
def f1_video_scores(spark, sf):
    out = X.video_scores(spark, sf).select("detector", "dataset", "role", "video", "condition", "clean_valid_frame_count", "successful_frame_count", "video_score", "inference_status", "failure_reason")
    return r9(out)


@query("f2_operating_point", f"WITH {X.CUT} SELECT detector, round(threshold_value, 9) AS threshold_value, n_real, false_positives, max_allowed AS max_allowed_false_positives, round(false_positives / n_real, 9) AS realized_fpr, candidates AS candidate_count FROM cut")
def f2_operating_point(spark, sf):
    return r9(X.frozen(X.video_scores(spark, sf)))


@query("f3_absolute_metrics", f"WITH {X.FAN}, u AS (SELECT * FROM fan WHERE video_score IS NOT NULL), nominal AS (SELECT {X.GROUP}, count(*) FILTER (study_label = 0) AS nominal_real, count(*) FILTER (study_label = 1) AS nominal_manipulated, count(*) FILTER (decision IS NOT NULL) AS n_valid FROM fan GROUP BY ALL), {X.auc_sql('u', X.GROUP, 'video_score', 'study_label', 'a')}, {X.rates_sql('u', X.GROUP, 'study_label', 'decision', 'e')} SELECT {X.GROUP}, nominal_real, nominal_manipulated, n_valid, round(auc, 9) AS auc, n_real, n_manipulated, tp, fp, tn, fn, round(fpr, 9) AS fpr, round(fnr, 9) AS fnr, round(hter, 9) AS hter FROM nominal JOIN a USING ({X.GROUP}) JOIN e USING ({X.GROUP}) WHERE nominal_real > 0 AND nominal_manipulated > 0")
def f3_absolute_metrics(spark, sf):
    return r9(metrics.absolute(X.decisions(spark, sf)))


_F4 = f"WITH {X.PAIRS}, {X.auc_sql('pfan', X.GROUP, 'video_score', 'study_label', 'a')}, {X.rates_sql('pfan', X.GROUP, 'study_label', 'decision', 'e')}, {X.auc_sql('pfan', X.GROUP, 'clean_score', 'study_label', 'ca')}, {X.rates_sql('pfan', X.GROUP, 'study_label', 'clean_decision', 'ce')} SELECT {X.GROUP}, a.n_real, a.n_manipulated, round(a.auc - ca.auc, 9) AS delta_auc, round(e.fpr - ce.fpr, 9) AS delta_fpr, round(e.fnr - ce.fnr, 9) AS delta_fnr, round(e.hter - ce.hter, 9) AS delta_hter FROM a JOIN e USING ({X.GROUP}) JOIN ca USING ({X.GROUP}) JOIN ce USING ({X.GROUP})"


@query("f4_paired_deltas", _F4)
def f4_paired_deltas(spark, sf):
    return r9(metrics.paired_deltas(X.decisions(spark, sf)))


#: Units of draws in SQL: the video, or the source that twelve videos in a row share.
_VIDEO = "CAST(video AS VARCHAR)"
_CLUSTER = "CASE WHEN dataset = 'first' THEN 'source::' || (video // 12) ELSE 'base::' || video END"


def _resampled_sql(source: str, context: str, stream: str, name: str, unit: str = _VIDEO) -> str:
    """Rows of source with replicate and weight, by the portable draw."""
    return f"""{name}_s AS MATERIALIZED (SELECT *, {unit} AS unit, CASE WHEN study_label = 0 THEN 'real' WHEN manipulation <> '' THEN manipulation ELSE 'manipulated' END AS stratum FROM {source}),
{name}_u AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {context}, stratum ORDER BY unit) - 1 AS k, count(*) OVER (PARTITION BY {context}, stratum) AS n FROM (SELECT DISTINCT {context}, stratum, unit FROM {name}_s)),
{name}_d AS MATERIALIZED (SELECT {context}, stratum, replicate, CAST(('0x' || substr(md5('1024::{stream}::' || replicate || '::' || stratum || '::' || i), 1, 8)) AS BIGINT) % n AS k
  FROM (SELECT *, unnest(range(0, n)) AS i FROM (SELECT {context}, stratum, n, unnest(range(0, {REPLICATES})) AS replicate FROM (SELECT {context}, stratum, max(n) AS n FROM {name}_u GROUP BY ALL)))),
{name}_w AS MATERIALIZED (SELECT {context}, stratum, replicate, k, count(*) AS w FROM {name}_d GROUP BY ALL),
{name} AS MATERIALIZED (SELECT s.*, w.replicate, w.w FROM {name}_s s JOIN {name}_u u USING ({context}, stratum, unit) JOIN {name}_w w USING ({context}, stratum, k))"""


def _weighted_cut(source: str, keys: str = "detector, replicate", score: str = "video_score", name: str = "rcut") -> str:
    return f"""{name}_h AS (SELECT {keys}, {score} AS score, sum(w) AS n FROM {source} GROUP BY ALL),
{name}_c AS (SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY score DESC) AS c, sum(n) OVER (PARTITION BY {keys}) AS t FROM {name}_h),
{name} AS (SELECT {keys}, coalesce(min(CASE WHEN c <= (5 * t) // 100 THEN score END), nextafter(max(score), 'infinity'::DOUBLE)) AS rt FROM {name}_c GROUP BY ALL)"""


_CONTEXT = "detector, dataset, role, condition"
_FANNED = "unnest(CASE WHEN dataset = 'second' THEN ['pooled'] WHEN study_label = 0 THEN ['M1', 'M2', 'M3', 'M4', 'pooled'] ELSE [manipulation, 'pooled'] END) AS metric_group"
_RGROUP = f"{X.GROUP}, replicate"
_RATED = f"""(SELECT * FROM rcut) AS at_cut USING (detector, replicate) WHERE NOT (dataset = 'first' AND role = 'validation')"""


def _absolute_sql(unit: str = _VIDEO) -> str:
    """After DECISIONS: a and e, the AUC and the rates of each group and replicate."""
    return f"""{_resampled_sql("calib", "detector", "primary_clean_validation", "cs", unit)}, {_weighted_cut("cs")},
scored AS (SELECT * FROM decisions WHERE video_score IS NOT NULL), {_resampled_sql("scored", _CONTEXT, "absolute", "rs", unit)},
rf AS (SELECT rs.* EXCLUDE (decision), CAST(video_score >= rt AS INTEGER) AS decision, {_FANNED} FROM rs JOIN {_RATED}),
{X.auc_sql("rf", _RGROUP, "video_score", "study_label", "a", "w")}, {X.rates_sql("rf", _RGROUP, "study_label", "decision", "e", "w")}"""


def _paired_sql(unit: str = _VIDEO) -> str:
    """After PAIRS: pa, pe, ca and ce, the AUC and the rates of the degraded and the clean side."""
    return f"""{_resampled_sql("calib", "detector", "primary_clean_validation", "pcs", unit)}, {_weighted_cut("pcs", name="pcut")}, {_resampled_sql("pairs", _CONTEXT, "paired", "ps", unit)},
pf AS (SELECT ps.* EXCLUDE (decision, clean_decision), CAST(video_score >= rt AS INTEGER) AS decision, CAST(clean_score >= rt AS INTEGER) AS clean_decision, {_FANNED} FROM ps JOIN {_RATED.replace("rcut", "pcut")}),
{X.auc_sql("pf", _RGROUP, "video_score", "study_label", "pa", "w")}, {X.rates_sql("pf", _RGROUP, "study_label", "decision", "pe", "w")},
{X.auc_sql("pf", _RGROUP, "clean_score", "study_label", "ca", "w")}, {X.rates_sql("pf", _RGROUP, "study_label", "clean_decision", "ce", "w")}"""


_DISPLACED = f"""diag AS (SELECT b.detector, b.condition, b.video, b.study_label, b.manipulation, b.video_score, c.video_score AS clean_score FROM videos b JOIN calib c USING (detector, video)
  WHERE b.dataset = 'first' AND b.role = 'validation' AND b.study_label = 0 AND b.condition <> 'CLN' AND b.video_score IS NOT NULL),
{_resampled_sql("diag", "detector, condition", "diagnostic", "ds")}, {_weighted_cut("ds", "detector, condition, replicate", "video_score", "own")}, {_weighted_cut("ds", "detector, condition, replicate", "clean_score", "ref")},
moved AS (SELECT detector, condition, replicate, own.rt - ref.rt AS displacement FROM own JOIN ref USING (detector, condition, replicate))"""

_ABS = f"{X.DECISIONS}, {_absolute_sql()}"
_PAIRED = f"{X.PAIRS}, {_paired_sql()}"


def _interval_sql(names: list[str], source: str, keys: str = X.GROUP) -> str:
    return f"SELECT {keys}, count(*) AS n_replicates, " + ", ".join(f"round(quantile_cont({m}, {p}), 9) AS {m}_{side}" for m in names for p, side in ((0.025, "lower"), (0.975, "upper"))) + f" FROM ({source}) GROUP BY ALL"


_ABS_VALUES = f"SELECT {_RGROUP}, auc, fpr, fnr, hter FROM a JOIN e USING ({_RGROUP})"
_PAIR_VALUES = f"SELECT {_RGROUP}, pa.auc - ca.auc AS delta_auc, pe.fpr - ce.fpr AS delta_fpr, pe.fnr - ce.fnr AS delta_fnr, pe.hter - ce.hter AS delta_hter FROM pa JOIN pe USING ({_RGROUP}) JOIN ca USING ({_RGROUP}) JOIN ce USING ({_RGROUP})"
_ABS_NAMES, _PAIR_NAMES = ["auc", "fpr", "fnr", "hter"], ["delta_auc", "delta_fpr", "delta_fnr", "delta_hter"]


def _calibrated(spark, sf):
    scores = X.stored(X.video_scores(spark, sf), "scores")
    return X.stored(thresholds.decide(scores, X.frozen(scores), ["detector"]), "decisions"), X.calibration(scores)


@query("f5_bootstrap", f"WITH {_ABS} {_interval_sql(['auc', 'fpr', 'fnr', 'hter'], _ABS_VALUES)}")
def f5_bootstrap(spark, sf):
    decided, calib = _calibrated(spark, sf)
    return r9(resampling.intervals(resampling.absolute(decided, calib, REPLICATES), metrics.GROUP_KEYS, ["auc", "fpr", "fnr", "hter"]))


@query("bst_07", f"WITH {_ABS} SELECT {_RGROUP}, round(auc, 9) AS auc, round(fpr, 9) AS fpr, round(fnr, 9) AS fnr, round(hter, 9) AS hter FROM a JOIN e USING ({_RGROUP})")
def bst_07(spark, sf):
    decided, calib = _calibrated(spark, sf)
    return r9(resampling.absolute(decided, calib, REPLICATES).select(*metrics.GROUP_KEYS, F.col("replicate").cast("long").alias("replicate"), "auc", "fpr", "fnr", "hter"))


@query("bst_08", f"WITH {_PAIRED} {_interval_sql(['delta_auc', 'delta_fpr', 'delta_fnr', 'delta_hter'], _PAIR_VALUES)}")
def bst_08(spark, sf):
    decided, calib = _calibrated(spark, sf)
    return r9(resampling.intervals(resampling.paired(decided, calib, REPLICATES), metrics.GROUP_KEYS, ["delta_auc", "delta_fpr", "delta_fnr", "delta_hter"]))


@query("bst_10", f"WITH {X.CUT}, {_resampled_sql('calib', 'detector', 'primary_clean_validation', 'cs')}, {_weighted_cut('cs')} SELECT detector, replicate, round(rt, 9) AS threshold_value FROM rcut")
def bst_10(spark, sf):
    return r9(resampling.replicate_thresholds(X.calibration(X.video_scores(spark, sf)), REPLICATES, 1024).select("detector", F.col("replicate").cast("long").alias("replicate"), "threshold_value"))


@query("bst_03", f"WITH {X.CUT}, {_resampled_sql('calib', 'detector', 'x', 'cs')} SELECT detector, stratum, CAST(unit AS BIGINT) AS video, k, n FROM cs_u")
def bst_03(spark, sf):
    return resampling.units(X.calibration(X.video_scores(spark, sf)).withColumn("stratum", resampling.stratum()), ["detector"]).select("detector", "stratum", "video", F.col("k").cast("long").alias("k"), "n")


for _alias, _target in (("f5_bootstrap_whole", "f5_bootstrap"), ("bst_14_whole", "f5_bootstrap"), ("bst_08_whole", "bst_08"), ("bst_12_whole", "bst_08")):
    query(_alias, X.ORACLE[_target])(X.QUERIES[_target])


def _clustered(decided):
    """Twelve videos in a row share a source, so a source is in several strata and has several videos in one."""
    return decided.withColumn("source", F.expr("video div 12")).withColumn("cluster", resampling.cluster())


@query("bst_11", f"WITH {X.DECISIONS}, {_absolute_sql(_CLUSTER)} {_interval_sql(_ABS_NAMES, _ABS_VALUES)}")
def bst_11(spark, sf):
    """Method groups and the pooled one over one draw of source units, each of which serves several videos."""
    decided, calib = map(_clustered, _calibrated(spark, sf))
    return r9(resampling.intervals(resampling.absolute(decided, calib, REPLICATES, unit="cluster"), metrics.GROUP_KEYS, _ABS_NAMES))


@query("bst_12", f"WITH {X.PAIRS}, {_paired_sql(_CLUSTER)} {_interval_sql(_PAIR_NAMES, _PAIR_VALUES)}")
def bst_12(spark, sf):
    """The paired form: one draw of source units for the clean and the degraded side of all groups."""
    decided, calib = map(_clustered, _calibrated(spark, sf))
    return r9(resampling.intervals(resampling.paired(decided, calib, REPLICATES, unit="cluster"), metrics.GROUP_KEYS, _PAIR_NAMES))


def _moved(spark, sf, scores):
    clean = X.calibration(scores).select("detector", "video", F.col("video_score").alias("clean_score"))
    return scores.where("dataset = 'first' and role = 'validation' and study_label = 0 and condition <> 'CLN' and video_score is not null").select("detector", "condition", "video", "video_score").join(clean, ["detector", "video"])


@query("bst_09", f"WITH {X.CUT}, {_DISPLACED} {_interval_sql(['displacement'], 'SELECT * FROM moved', 'detector, condition')}")
def bst_09(spark, sf):
    """Interval of the displacement of each condition's own operating point, one draw a replicate for both sides."""
    moved = resampling.displaced(_moved(spark, sf, X.stored(X.video_scores(spark, sf), "scores")), REPLICATES)
    return r9(resampling.intervals(moved, ["detector", "condition"], ["displacement"]))


def _long_sql(kind: str, names: list[str], keys: str) -> str:
    """One row a metric of an interval table and its point estimates."""
    return " UNION ALL ".join(f"SELECT '{kind}' AS kind, {keys}, '{m}' AS metric, n_replicates, round({m}, 9) AS estimate, {m}_lower AS lower, {m}_upper AS upper FROM {kind}_i JOIN {kind}_e USING ({keys})" for m in names)


_POINTS = f"""{X.auc_sql('ufan', X.GROUP, 'video_score', 'study_label', 'fa')}, {X.rates_sql('ufan', X.GROUP, 'study_label', 'decision', 'fe')},
{X.auc_sql('pfan', X.GROUP, 'video_score', 'study_label', 'ga')}, {X.rates_sql('pfan', X.GROUP, 'study_label', 'decision', 'ge')}, {X.auc_sql('pfan', X.GROUP, 'clean_score', 'study_label', 'ha')}, {X.rates_sql('pfan', X.GROUP, 'study_label', 'clean_decision', 'he')},
absolute_e AS (SELECT {X.GROUP}, auc, fpr, fnr, hter FROM fa JOIN fe USING ({X.GROUP})),
paired_e AS (SELECT {X.GROUP}, ga.auc - ha.auc AS delta_auc, ge.fpr - he.fpr AS delta_fpr, ge.fnr - he.fnr AS delta_fnr, ge.hter - he.hter AS delta_hter FROM ga JOIN ge USING ({X.GROUP}) JOIN ha USING ({X.GROUP}) JOIN he USING ({X.GROUP})),
{X.threshold_sql('diag', 'detector, condition', 'video_score', 'down')}, {X.threshold_sql('diag', 'detector, condition', 'clean_score', 'dref')},
diagnostic_e AS (SELECT detector, condition, down.threshold_value - dref.threshold_value AS displacement FROM down JOIN dref USING (detector, condition))"""
_ARTIFACT = f"""WITH {X.PAIRS}, {_absolute_sql()}, {_paired_sql()}, {_DISPLACED}, ufan AS (SELECT *, {_FANNED} FROM scored WHERE NOT (dataset = 'first' AND role = 'validation')), {_POINTS},
absolute_i AS ({_interval_sql(_ABS_NAMES, _ABS_VALUES)}), paired_i AS ({_interval_sql(_PAIR_NAMES, _PAIR_VALUES)}), diagnostic_i AS ({_interval_sql(['displacement'], 'SELECT * FROM moved', 'detector, condition')})
{_long_sql('absolute', _ABS_NAMES, X.GROUP)} UNION ALL {_long_sql('paired', _PAIR_NAMES, X.GROUP)}
UNION ALL SELECT 'diagnostic' AS kind, detector, NULL AS dataset, NULL AS role, condition, NULL AS metric_group, 'displacement' AS metric, n_replicates, round(displacement, 9) AS estimate, displacement_lower AS lower, displacement_upper AS upper FROM diagnostic_i JOIN diagnostic_e USING (detector, condition)"""


@query("bst_14", _ARTIFACT)
def bst_14(spark, sf):
    """The whole artifact: estimates and intervals of the absolute, paired and diagnostic parts, a row a metric."""
    decided, calib = _calibrated(spark, sf)
    moved = X.stored(_moved(spark, sf, decided), "moved")
    own, clean = (thresholds.low_fpr(moved.withColumn("score", F.col(c)), ["detector", "condition"]).select("detector", "condition", F.col("threshold_value").alias(c)) for c in ("video_score", "clean_score"))
    rows = metrics.fan_out(decided.where(F.col("video_score").isNotNull()))
    parts = {
        "absolute": (resampling.absolute(decided, calib, REPLICATES), metrics.bundle(rows, metrics.GROUP_KEYS), metrics.GROUP_KEYS, _ABS_NAMES),
        "paired": (resampling.paired(decided, calib, REPLICATES), metrics.paired_deltas(decided), metrics.GROUP_KEYS, _PAIR_NAMES),
        "diagnostic": (resampling.displaced(moved, REPLICATES), own.join(clean, ["detector", "condition"]).withColumn("displacement", F.col("video_score") - F.col("clean_score")), ["detector", "condition"], ["displacement"]),
    }
    out = None
    for kind, (values, points, keys, names) in parts.items():
        joined = resampling.intervals(values, keys, names).join(points.select(*keys, *names), keys)
        cells = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("estimate"), F.col(f"{m}_lower").alias("lower"), F.col(f"{m}_upper").alias("upper")) for m in names))
        known = [F.col(k) if k in keys else F.lit(None).cast("string").alias(k) for k in metrics.GROUP_KEYS]
        part = joined.select(F.lit(kind).alias("kind"), *known, "n_replicates", F.inline(cells))
        out = part if out is None else out.unionByName(part)
    return r9(out)


@query("bst_05_twister", f"WITH {X.CUT}, u AS (SELECT detector, dataset, {_CLUSTER} AS unit FROM calib), n AS (SELECT detector, count(DISTINCT unit) AS n FROM u GROUP BY ALL) SELECT detector, 'real' AS stratum, CAST(replicate AS INTEGER) AS replicate, CAST(n AS BIGINT) AS drawn FROM (SELECT detector, n, unnest(range(0, {REPLICATES})) AS replicate FROM n)")
def bst_05_twister(spark, sf):
    """How many units each replicate drew by the Mersenne Twister: as many as the stratum has.  Which ones it drew is compared
    with Python's generator in the tests; SQL has no such generator.
    """
    calib = _clustered(X.calibration(X.video_scores(spark, sf))).withColumn("stratum", resampling.stratum()).withColumn("unit", F.col("cluster"))
    drawn = blocks.draw_counts(calib, ["detector"], REPLICATES, 1024, "primary_clean_validation")
    return drawn.groupBy("detector", "stratum", "replicate").agg(F.sum("w").alias("drawn"))


@query("bst_04", f"WITH {X.CUT}, {_resampled_sql('calib', 'detector', 'x', 'cs')} SELECT detector, stratum, replicate, k, w FROM cs_w")
def bst_04(spark, sf):
    numbered = resampling.units(X.calibration(X.video_scores(spark, sf)).withColumn("stratum", resampling.stratum()), ["detector"])
    return resampling.draws(numbered, ["detector"], REPLICATES, 1024, "x").select("detector", "stratum", F.col("replicate").cast("long").alias("replicate"), F.col("k").cast("long").alias("k"), "w")


@query("bst_01", f"WITH {X.BASE} SELECT DISTINCT video, CASE WHEN study_label = 0 THEN 'real' WHEN manipulation <> '' THEN manipulation ELSE 'manipulated' END AS stratum FROM base")
def bst_01(spark, sf):
    return X.base(spark, sf).select("video", resampling.stratum().alias("stratum")).distinct()


@query("bst_05", "SELECT user_id AS video, ('0x' || substr(sha256('1024::' || user_id), 1, 15))::BIGINT AS head FROM (SELECT DISTINCT user_id FROM events)")
def bst_05(spark, sf):
    ids = read(spark, sf, "events").select(F.col("user_id").alias("video")).distinct()
    seed = S.stream_seed(1024, F.col("video").cast("string"))
    return ids.select("video", F.floor(seed / F.lit(16).cast("decimal(20,0)")).cast("long").alias("head"))


@query("agg_43", "SELECT l_returnflag, round(quantile_cont(l_quantity, 0.025), 9) AS lower, round(quantile_cont(l_quantity, 0.975), 9) AS upper FROM lineitem GROUP BY ALL")
def agg_43(spark, sf):
    out = resampling.intervals(read(spark, sf, "lineitem"), ["l_returnflag"], ["l_quantity"])
    return r9(out.select("l_returnflag", F.col("l_quantity_lower").alias("lower"), F.col("l_quantity_upper").alias("upper")))


# legacy chain: frames of the raw detector under the older names
_LEGACY = f"WITH {X.BASE}, f AS (SELECT *, CASE WHEN inference_status = 'ok' THEN s END AS score FROM base), v AS (SELECT role, condition, video, CAST(round_even(avg(study_label), 0) AS INTEGER) AS label, avg(score) AS score, count(score) AS n FROM f GROUP BY ALL)"


def legacy_frames(spark, sf):
    return X.base(spark, sf).withColumns({"score": F.when(F.col("inference_status") == "ok", F.col("s")), "label": F.col("study_label")})


def legacy_videos(spark, sf):
    return videos.mean_scores(legacy_frames(spark, sf), ["role", "condition", "video"], 8)


@query("agg_01", f"{_LEGACY} SELECT role, condition, video, label, round(score, 9) AS score, n AS n_frames_scored, 8 AS n_frames_expected, greatest(8 - n, 0) AS n_frames_missing, n / 8 AS frame_score_coverage, n > 0 AND n < 8 AS partial_score, n > 0 AS score_available, n > 0 AS face_found, CASE WHEN n < 8 THEN 'video_aggregation' ELSE '' END AS failure_stage, CASE WHEN n = 0 THEN 'no_scored_frames_for_video' WHEN n < 8 THEN 'partial_frame_coverage' ELSE '' END AS failure_reason FROM v")
def agg_01(spark, sf):
    return r9(legacy_videos(spark, sf))


@query("agg_11", f"{_LEGACY} SELECT condition, count(*) AS n_total_videos, count(*) FILTER (n > 0) AS n_scored_videos, count(*) FILTER (n = 0) AS n_no_score_videos, count(*) FILTER (n > 0) AS n_face_found_videos, count(*) FILTER (n > 0 AND n < 8) AS n_partial_videos, round(count(*) FILTER (n > 0) / count(*), 9) AS score_available_rate, round(count(*) FILTER (n > 0) / count(*), 9) AS face_found_rate FROM v GROUP BY ALL")
def agg_11(spark, sf):
    return r9(videos.coverage(legacy_videos(spark, sf), ["condition"]))


@query("agg_42", f"{_LEGACY} SELECT video, condition, 'video_aggregation' AS stage, CASE WHEN n = 0 THEN 'no_scored_frames_for_video' ELSE 'partial_frame_coverage' END AS reason_code, CASE WHEN n = 0 THEN 'No scored frames after aggregation' ELSE 'Scored ' || n || ' of 8 expected frames' END AS details FROM v WHERE n < 8")
def agg_42(spark, sf):
    return videos.exclusions(legacy_videos(spark, sf), ["video", "condition"])


@query("agg_03", f"WITH {X.BASE} SELECT condition || '/' || video AS video, round(avg(s), 9) AS score, max(study_label) AS label, count(DISTINCT study_label) AS n_labels, count(*) AS n FROM base GROUP BY condition, base.video")
def agg_03(spark, sf):
    return r9(videos.scores_by_parent(_paths(spark, sf)))


@query("agg_04", f"WITH {X.BASE} SELECT CAST(video AS VARCHAR) AS video, round(avg(s), 12) AS score, CAST(floor(avg(study_label)) AS INTEGER) AS label, count(*) AS n FROM base GROUP BY base.video")
def agg_04(spark, sf):
    return r9(videos.scores_by_folder_name(_paths(spark, sf)), 12)


def _paths(spark, sf):
    return X.base(spark, sf).select(F.concat_ws("/", "condition", F.col("video").cast("string"), F.format_string("%06d.png", "temporal_position")).alias("path"), F.col("s").alias("score"), F.col("study_label").alias("label"))


_TIED = "WITH t AS (SELECT l_returnflag AS detector, l_discount * 10 AS score, CAST(l_linenumber > 3 AS INTEGER) AS label FROM lineitem)"


def tied(spark, sf):
    return read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("detector"), (F.col("l_discount") * 10).alias("score"), (F.col("l_linenumber") > 3).cast("int").alias("label"))


@query("agg_08", f"{_TIED}, {X.auc_sql('t', 'detector', 'score', 'label', 'a')} SELECT detector, round(auc, 9) AS auc, n_real, n_manipulated FROM a")
def agg_08(spark, sf):
    return r9(metrics.auc(tied(spark, sf), ["detector"]))


@query("agg_05", f"{_TIED}, d AS (SELECT *, CAST(score >= 0.5 AS INTEGER) AS decision FROM t), {X.rates_sql('d', 'detector', 'label', 'decision', 'e')} SELECT detector, tp, fp, tn, fn, round(fpr, 9) AS fpr, round(fnr, 9) AS fnr, round(hter, 9) AS hter FROM e")
def agg_05(spark, sf):
    return r9(metrics.rates(tied(spark, sf).withColumn("decision", (F.col("score") >= 0.5).cast("int")), ["detector"]))


for _alias in ("agg_06", "agg_07", "agg_09"):
    query(_alias, X.ORACLE["agg_05"])(agg_05)


@query("agg_10", f"{_TIED}, d AS (SELECT *, CAST(score >= 0.5 AS INTEGER) AS decision FROM t), {X.rates_sql('d', 'detector', 'label', 'decision', 'e')} SELECT detector, tp, fp, tn, fn, round(fpr, 9) AS fpr, round(fnr, 9) AS fnr, round(hter, 9) AS hter, round((tp + tn) / (tp + fp + tn + fn), 9) AS accuracy, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall_tpr, round(tn / (tn + fp), 9) AS tnr, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 9) AS f1, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 9) AS balanced_accuracy FROM e")
def agg_10(spark, sf):
    return r9(metrics.legacy_summary(tied(spark, sf).withColumn("decision", (F.col("score") >= 0.5).cast("int")), ["detector"]))


@query("agg_19", f"{_TIED}, z AS (SELECT * FROM t WHERE label = 0), {X.threshold_sql('z', 'detector', 'score', 'cut', 20)} SELECT detector, round(threshold_value, 9) AS threshold_value, n_real, false_positives, max_allowed AS max_allowed_false_positives, round(false_positives / n_real, 9) AS realized_fpr, candidates AS candidate_count FROM cut")
def agg_19(spark, sf):
    return r9(thresholds.low_fpr(tied(spark, sf).where("label = 0"), ["detector"], 20, 100))


for _alias, _target in (("agg_13", "f3_absolute_metrics"), ("agg_14", "f3_absolute_metrics"), ("agg_15", "f3_absolute_metrics"), ("agg_16", "f4_paired_deltas"), ("agg_02", "f1_video_scores"), ("agg_20", "f2_operating_point")):
    query(_alias, X.ORACLE[_target])(X.QUERIES[_target])


@query("agg_18", "SELECT n_nationkey AS n, (5 * n_nationkey) // 100 AS budget FROM nation")
def agg_18(spark, sf):
    return read(spark, sf, "nation").select(F.col("n_nationkey").alias("n"), thresholds.budget("n_nationkey").alias("budget"))


_DIAG = f"WITH {X.CUT}, dv AS (SELECT * FROM videos WHERE dataset = 'first' AND role = 'validation' AND study_label = 0 AND condition <> 'CLN' AND video_score IS NOT NULL), {X.threshold_sql('dv', 'detector, condition', 'video_score', 'own')}"


@query("agg_21", f"{_DIAG} SELECT own.detector, condition, round(own.threshold_value, 9) AS diagnostic_threshold, round(own.threshold_value - cut.threshold_value, 9) AS displacement, own.n_real FROM own JOIN cut USING (detector)")
def agg_21(spark, sf):
    scores = X.video_scores(spark, sf)
    rows = scores.where("dataset = 'first' and role = 'validation' and study_label = 0 and condition <> 'CLN' and video_score is not null")
    own = thresholds.low_fpr(rows.withColumn("score", F.col("video_score")), ["detector", "condition"]).withColumnRenamed("threshold_value", "diagnostic_threshold")
    joined = own.join(X.frozen(scores).select("detector", "threshold_value"), "detector")
    return r9(joined.select("detector", "condition", "diagnostic_threshold", (F.col("diagnostic_threshold") - F.col("threshold_value")).alias("displacement"), "n_real"))


_CURVE = f"{_TIED}, h AS (SELECT detector, score, sum(label) AS p, sum(1 - label) AS q FROM t GROUP BY ALL), c AS (SELECT *, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER a AS pp, sum(q) OVER a AS nn FROM h WINDOW w AS (PARTITION BY detector ORDER BY score DESC), a AS (PARTITION BY detector)), k AS (SELECT detector, score, tp, fp, pp, nn FROM c UNION ALL SELECT detector, max(score) + greatest(1e-12, abs(max(score)) * 1e-12), 0, 0, max(pp), max(nn) FROM c GROUP BY detector)"


@query("agg_22", f"{_TIED}, z AS (SELECT detector, score, count(*) AS n FROM t WHERE label = 0 GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY detector ORDER BY score DESC) AS c, sum(n) OVER (PARTITION BY detector) AS t FROM z) SELECT detector, round(coalesce(min(CASE WHEN CAST(c AS DOUBLE) / CAST(t AS DOUBLE) <= CAST(0.2 AS DOUBLE) THEN score END), max(score) + greatest(1e-12, abs(max(score)) * 1e-12)), 9) AS threshold_value, CAST(max(t) AS BIGINT) AS n_real FROM c GROUP BY detector")
def agg_22(spark, sf):
    return r9(thresholds.low_fpr_legacy(tied(spark, sf).where("label = 0"), ["detector"], 0.2))


@query("agg_23", f"{_CURVE} SELECT detector, round(score, 9) AS threshold_value, round(fp / nn, 9) AS fpr, round((pp - tp) / pp, 9) AS fnr FROM k QUALIFY row_number() OVER (PARTITION BY detector ORDER BY abs(fp / nn - (pp - tp) / pp), score) = 1")
def agg_23(spark, sf):
    return r9(thresholds.eer_like(tied(spark, sf), ["detector"]))


@query("agg_24", f"{_CURVE}, s AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS pr, CASE WHEN pp = 0 THEN 0 ELSE tp / pp END AS re FROM k), g AS (SELECT *, CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END AS f1 FROM s) SELECT detector, round(score, 9) AS threshold_value, round(f1, 9) AS f1, round(pr, 9) AS precision, round(re, 9) AS recall FROM g QUALIFY row_number() OVER (PARTITION BY detector ORDER BY f1 DESC, score) = 1")
def agg_24(spark, sf):
    return r9(thresholds.best_f1(tied(spark, sf), ["detector"]))


@query("agg_25", f"{_TIED} SELECT detector, round(avg(CASE WHEN label = 0 THEN CAST(score >= 0.3 AS INTEGER) END), 9) AS fpr, round(avg(CASE WHEN label = 1 THEN CAST(score < 0.3 AS INTEGER) END), 9) AS fnr, round(avg(CAST((score >= 0.3) = (label = 1) AS INTEGER)), 9) AS accuracy FROM t GROUP BY ALL")
def agg_25(spark, sf):
    above = (F.col("score") >= 0.3).cast("int")
    return r9(tied(spark, sf).groupBy("detector").agg(F.avg(F.when(F.col("label") == 0, above)).alias("fpr"), F.avg(F.when(F.col("label") == 1, 1 - above)).alias("fnr"), F.avg((above == F.col("label")).cast("int")).alias("accuracy")))


@query("agg_26", f"{_CURVE}, s AS (SELECT *, tp / pp AS tpr, fp / nn AS fpr, tp / (tp + fp) AS pr FROM c), l AS (SELECT *, tpr - coalesce(lag(tpr) OVER (PARTITION BY detector ORDER BY score DESC), 0) AS step FROM s), g AS (SELECT detector, round(arg_min(fpr, row(abs(1 - tpr - fpr), -score)), 9) AS eer, round(sum(step * pr), 9) AS ap FROM l GROUP BY detector), a AS (SELECT detector, round(avg(CAST((score > 0.5) = (label = 1) AS INTEGER)), 9) AS acc FROM t GROUP BY detector) SELECT detector, eer, ap, acc FROM g JOIN a USING (detector)")
def agg_26(spark, sf):
    return r9(metrics.roc_summary(tied(spark, sf), ["detector"]))


@query("agg_29", f"WITH {X.BASE}, v AS (SELECT condition, video, study_label, avg(s) AS s, count(*) AS n FROM base GROUP BY ALL), {X.auc_sql('base', 'condition', 's', 'study_label', 'fa')}, {X.auc_sql('v', 'condition', 's', 'study_label', 'va')} SELECT condition, round(fa.auc, 9) AS frame_auc, round(va.auc, 9) AS video_auc, fa.n_real + fa.n_manipulated AS n_frames, va.n_real + va.n_manipulated AS n_videos, min(n) AS least, max(n) AS most FROM fa JOIN va USING (condition) JOIN v USING (condition) GROUP BY ALL")
def agg_29(spark, sf):
    rows = X.base(spark, sf)
    vids = rows.groupBy("condition", "video", "study_label").agg(F.avg("s").alias("s"), F.count("*").alias("n"))
    fa = metrics.auc(rows, ["condition"], "s", "study_label").select("condition", F.col("auc").alias("frame_auc"), (F.col("n_real") + F.col("n_manipulated")).alias("n_frames"))
    va = metrics.auc(vids, ["condition"], "s", "study_label").select("condition", F.col("auc").alias("video_auc"), (F.col("n_real") + F.col("n_manipulated")).alias("n_videos"))
    return r9(fa.join(va, "condition").join(vids.groupBy("condition").agg(F.min("n").alias("least"), F.max("n").alias("most")), "condition"))
