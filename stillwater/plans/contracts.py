"""Audits and record contracts.  The fixture views plant faults (by remainders of ids), so each check has rows to return."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from stillwater.functions import scalars as S
from stillwater.operators import metrics, reconcile, records, resampling
from stillwater.plans import fixtures as X
from stillwater.plans.fixtures import query, r9, read, scratch
from stillwater.sources import readers, writers


def check_sql(view: str, keys: str, rules: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT {keys}, '{name}' AS rule FROM {view} WHERE NOT coalesce({rule}, FALSE)" for name, rule in rules.items())


# records of inference: one a video and condition
_SCORE = "CASE WHEN video % 11 = 3 THEN 1.25 WHEN video % 13 = 4 THEN NULL ELSE m END"
_STATUS = "CASE WHEN good = 0 OR video % 5 = 1 THEN 'invalid_condition' ELSE 'ok' END"
REC = f"""WITH {X.BASE}, raw AS (SELECT video, condition, dataset, role, study_label, manipulation, CAST(count(*) AS BIGINT) AS declared, count(*) FILTER (inference_status = 'ok') AS good,
  coalesce(list(temporal_position ORDER BY temporal_position) FILTER (inference_status = 'ok'), []) AS p, avg(s) AS m FROM base GROUP BY ALL),
rec AS (SELECT *, CAST({_SCORE} AS DOUBLE) AS score, {_STATUS} AS status, good + CASE WHEN video % 7 = 2 THEN 1 ELSE 0 END AS n_positions, CASE WHEN video % 17 = 5 THEN list_reverse(p) ELSE p END AS positions FROM raw),
dec AS (SELECT *, CASE WHEN video % 23 = 7 THEN NULL WHEN score IS NOT NULL THEN CAST(score >= 0.5 AS INTEGER) END AS decision, CASE WHEN video % 29 = 8 THEN 'other' ELSE 'fpr05' END AS threshold_id FROM rec)"""


def inference_records(spark, sf):
    ok = F.col("inference_status") == "ok"
    raw = X.base(spark, sf).groupBy("video", "condition", "dataset", "role", "study_label", "manipulation").agg(F.count("*").alias("declared"), F.count_if(ok).alias("good"), F.sort_array(F.collect_list(F.when(ok, F.col("temporal_position")))).alias("p"), F.avg("s").alias("m"))
    rec = raw.withColumns({"score": F.expr(_SCORE).cast("double"), "status": F.expr(_STATUS), "n_positions": F.expr("good + CASE WHEN video % 7 = 2 THEN 1 ELSE 0 END"), "positions": F.when(F.expr("video % 17 = 5"), F.reverse("p")).otherwise(F.col("p"))})
    return rec.withColumns({"decision": F.expr("CASE WHEN video % 23 = 7 THEN NULL WHEN score IS NOT NULL THEN CAST(score >= 0.5 AS INT) END"), "threshold_id": F.expr("CASE WHEN video % 29 = 8 THEN 'other' ELSE 'fpr05' END")})


_VC = ["video", "condition"]
_INFERENCE = {"score_range": "score IS NULL OR score BETWEEN 0 AND 1", "status_score": "(status = 'ok') = (score IS NOT NULL)", "budget": "n_positions <= declared"}


@query("sup_34", f"{REC} {check_sql('rec', 'video, condition', _INFERENCE | {'declared_length': 'len(positions) = n_positions', 'sorted_unique': 'positions = list_sort(list_distinct(positions))'})}")
def sup_34(spark, sf):
    rules = _INFERENCE | {"declared_length": "size(positions) = n_positions", "sorted_unique": "positions = sort_array(array_distinct(positions))"}
    return records.violations(inference_records(spark, sf), rules, _VC)


_DECISION = {"score_decision": "(score IS NULL) = (decision IS NULL)", "decision_value": "decision IS NULL OR decision = CAST(score >= 0.5 AS INTEGER)", "threshold": "threshold_id = 'fpr05'", "invalid_has_no_score": "status = 'ok' OR score IS NULL", "label": "study_label IN (0, 1)"}


@query("sup_35", f"{REC} {check_sql('dec', 'video, condition', _DECISION)}")
def sup_35(spark, sf):
    return records.violations(inference_records(spark, sf), _DECISION, _VC)


# manifest records: one a video
MAN = f"WITH {X.BASE}, man AS (SELECT DISTINCT video, dataset, CASE WHEN video % 10 = 9 THEN 'test' ELSE role END AS role, CASE role WHEN 'validation' THEN 'val' ELSE 'test' END AS split, study_label, CASE WHEN video % 31 = 3 THEN 'M9' ELSE manipulation END AS manipulation FROM base)"


def manifest(spark, sf):
    role = F.when(F.col("video") % 10 == 9, "test").otherwise(F.col("role"))
    split = F.when(F.col("role") == "validation", "val").otherwise("test")
    method = F.when(F.col("video") % 31 == 3, "M9").otherwise(F.col("manipulation"))
    return X.base(spark, sf).select("video", "dataset", role.alias("role"), split.alias("split"), "study_label", method.alias("manipulation")).distinct()


_MANIFEST = {"triple": "(dataset = 'first' AND split = 'val' AND role = 'validation') OR (dataset = 'first' AND split = 'test' AND role = 'test') OR (dataset = 'second' AND split = 'test' AND role = 'external_evaluation')", "method": "manipulation IN ('', 'M1', 'M2', 'M3', 'M4')", "label_method": "(study_label = 0 AND manipulation = '') OR (study_label = 1 AND (manipulation <> '' OR dataset = 'second'))"}


@query("sup_36", f"{MAN} {check_sql('man', 'video', _MANIFEST)}")
def sup_36(spark, sf):
    return records.violations(manifest(spark, sf), _MANIFEST, ["video"])


_BAD_CUT = "CASE detector WHEN 'raw' THEN 'fpr05' WHEN 'draw' THEN 'drift' ELSE 'fpr05' END"
_ARTIFACT = {"type": "kind = 'fpr05'", "budget": "false_positives <= max_allowed", "target": "max_allowed = (5 * n_real) / 100", "value": "threshold_value BETWEEN 0 AND 1", "candidates": "candidate_count > 1"}


@query("sup_38", f"WITH {X.CUT}, art AS (SELECT detector, {_BAD_CUT} AS kind, threshold_value, n_real, false_positives + CASE WHEN detector = 'mean' THEN 1000 ELSE 0 END AS false_positives, max_allowed, candidates AS candidate_count FROM cut) {check_sql('art', 'detector', _ARTIFACT | {'target': 'max_allowed = (5 * n_real) // 100'})}")
def sup_38(spark, sf):
    cut = X.frozen(X.video_scores(spark, sf))
    art = cut.select("detector", F.expr(_BAD_CUT).alias("kind"), "threshold_value", "n_real", F.expr("false_positives + CASE WHEN detector = 'mean' THEN 1000 ELSE 0 END").alias("false_positives"), F.col("max_allowed_false_positives").alias("max_allowed"), "candidate_count")
    return records.violations(art, _ARTIFACT | {"target": "max_allowed = (5 * n_real) div 100"}, ["detector"])


@query("sup_30", f"WITH {X.BASE}, v AS (SELECT video, count(DISTINCT condition) AS n_conditions, count(*) AS n, 'v' || CASE WHEN video % 37 = 4 THEN 0 ELSE video END AS stem FROM base GROUP BY video) {check_sql('v', 'video', {'conditions': 'n_conditions = 5', 'frames': 'n >= 12', 'stem': chr(39).join(['stem = ', 'v', ' || video'])})}")
def sup_30(spark, sf):
    v = X.base(spark, sf).groupBy("video").agg(F.countDistinct("condition").alias("n_conditions"), F.count("*").alias("n")).withColumn("stem", F.expr("'v' || CASE WHEN video % 37 = 4 THEN 0 ELSE video END"))
    return records.violations(v, {"conditions": "n_conditions = 5", "frames": "n >= 12", "stem": "stem = 'v' || video"}, ["video"])


# composition and leakage of split groups of twelve videos
_COMPOSITION = {"reals": "n_real = 6", "fakes": "n_fake = 6", "methods": "n_methods = 2", "both_directions": "one_way = 0"}


@query("qc_03", f"WITH {X.BASE}, v AS (SELECT DISTINCT video, video // 12 AS g, study_label, manipulation FROM base), w AS (SELECT v.*, p.video IS NULL AS alone FROM v LEFT JOIN v p ON p.video = xor(v.video, 1)), c AS (SELECT g, count(*) FILTER (study_label = 0) AS n_real, count(*) FILTER (study_label = 1) AS n_fake, count(DISTINCT nullif(manipulation, '')) AS n_methods, count(*) FILTER (alone) AS one_way FROM w GROUP BY g) {check_sql('c', 'g', _COMPOSITION)}")
def qc_03(spark, sf):
    v = X.base(spark, sf).select("video", F.expr("video div 12").alias("g"), "study_label", "manipulation").distinct()
    w = v.withColumn("p", F.col("video").bitwiseXOR(F.lit(1))).join(v.select(F.col("video").alias("p"), F.lit(True).alias("there")), "p", "left")
    return records.group_violations(w, ["g"], _COMPOSITION, n_real=F.count_if(F.col("study_label") == 0), n_fake=F.count_if(F.col("study_label") == 1), n_methods=F.countDistinct(F.nullif("manipulation", F.lit(""))), one_way=F.count_if(F.col("there").isNull()))


@query("qc_04", "WITH i AS (SELECT unnest([o_custkey, o_orderkey % 2000]) AS id, o_orderpriority AS g, o_orderstatus AS split FROM orders) SELECT id, count(DISTINCT g) AS groups, count(DISTINCT split) AS splits FROM i GROUP BY id HAVING count(DISTINCT g) > 1 OR count(DISTINCT split) > 1")
def qc_04(spark, sf):
    """Ids, counted as source and as target, in more than one group or split."""
    ids = read(spark, sf, "orders").select(F.explode(F.array("o_custkey", F.col("o_orderkey") % 2000)).alias("id"), "o_orderpriority", "o_orderstatus")
    return ids.groupBy("id").agg(F.countDistinct("o_orderpriority").alias("groups"), F.countDistinct("o_orderstatus").alias("splits")).where("groups > 1 or splits > 1")


_NINE = ["dataset", "role", "study_label", "manipulation", "threshold_value", "checkpoint", "source_video", "base_video", "status"]
_NINE_SQL = {"dataset": "dataset", "role": "role", "study_label": "CASE WHEN condition = 'RSZ' AND video % 9 = 0 THEN 1 - study_label ELSE study_label END", "manipulation": "manipulation", "threshold_value": "CASE WHEN condition = 'BLR' THEN threshold_value + 0.5 ELSE threshold_value END", "checkpoint": "CASE WHEN condition = 'H40' AND video % 7 = 1 THEN 'b' ELSE 'a' END", "source_video": "video // 10", "base_video": "CASE WHEN condition = 'PLT' AND video % 8 = 5 THEN video + 1 ELSE video END", "status": "CASE WHEN decision IS NULL THEN 'no' ELSE 'ok' END"}


_NINE_PAIRS = f"WITH {X.DECISIONS}, f AS (SELECT detector, video, condition, {', '.join(f'{e} AS {n}' for n, e in _NINE_SQL.items())} FROM decisions), j AS (SELECT b.detector, b.video, b.condition, {', '.join(f'b.{n} IS NOT DISTINCT FROM c.{n} AS {n}' for n in _NINE)} FROM f b JOIN f c USING (detector, video) WHERE b.condition <> 'CLN' AND c.condition = 'CLN')"


def nine_pairs(spark, sf):
    """Degraded records with the fields of their clean one."""
    f = X.decisions(spark, sf).select("detector", "video", "condition", *(F.expr(e.replace("//", "div")).alias(n) for n, e in _NINE_SQL.items()))
    clean = f.where("condition = 'CLN'").select("detector", "video", *(F.col(n).alias(f"c_{n}") for n in _NINE))
    return f.where("condition <> 'CLN'").join(clean, ["detector", "video"])


@query("join_05", f"{_NINE_PAIRS} SELECT detector, video, condition, {' AND '.join(_NINE)} AS compatible FROM j")
def join_05(spark, sf):
    """Clean and degraded records of a video, and whether the pair agrees in nine fields."""
    agree = F.lit(True)
    for n in _NINE:
        agree = agree & F.col(n).eqNullSafe(F.col(f"c_{n}"))
    return nine_pairs(spark, sf).select("detector", "video", "condition", agree.alias("compatible"))


@query("qc_06", f"{_NINE_PAIRS} {check_sql('j', 'detector, video, condition', {n: n for n in _NINE})}")
def qc_06(spark, sf):
    """Pairs of clean and degraded records that differ in any of nine fields."""
    return records.violations(nine_pairs(spark, sf), {n: F.col(n).eqNullSafe(F.col(f"c_{n}")) for n in _NINE}, ["detector", "video", "condition"])


# two training views of the same videos; the second has lost some and holds some of the test set
_VIEWS = f"WITH {X.BASE}, v AS (SELECT DISTINCT video, role FROM base), a AS (SELECT video, role FROM v WHERE role = 'validation'), b AS (SELECT video, role FROM v WHERE (role = 'validation' AND video % 15 <> 0) OR video % 20 = 1)"


def views(spark, sf):
    v = X.base(spark, sf).select("video", "role").distinct()
    return v.where("role = 'validation'"), v.where("(role = 'validation' and video % 15 <> 0) or video % 20 = 1")


@query("qc_09", f"{_VIEWS} SELECT video, 'held_out' AS side FROM b WHERE role <> 'validation' UNION ALL SELECT video, 'left' FROM (SELECT video FROM a EXCEPT ALL SELECT video FROM b) UNION ALL SELECT video, 'right' FROM (SELECT video FROM b EXCEPT ALL SELECT video FROM a)")
def qc_09(spark, sf):
    a, b = views(spark, sf)
    return b.where("role <> 'validation'").select("video", F.lit("held_out").alias("side")).unionByName(records.two_sided(a, b, ["video"]))


@query("set_04", f"{_VIEWS} SELECT video, 'left' AS side FROM (SELECT video FROM a EXCEPT ALL SELECT video FROM b) UNION ALL SELECT video, 'right' FROM (SELECT video FROM b EXCEPT ALL SELECT video FROM a)")
def set_04(spark, sf):
    return records.two_sided(*views(spark, sf), ["video"])


@query("set_05", f"{_VIEWS} SELECT NOT EXISTS (SELECT video FROM a EXCEPT SELECT video FROM b) AND NOT EXISTS (SELECT video FROM b EXCEPT SELECT video FROM a) AS equal, (SELECT count(*) FROM (SELECT video FROM a EXCEPT SELECT video FROM b)) AS missing, (SELECT count(*) FROM (SELECT video FROM b EXCEPT SELECT video FROM a)) AS extra")
def set_05(spark, sf):
    a, b = (v.select("video").distinct().withColumn(n, F.lit(1)) for v, n in zip(views(spark, sf), "ab", strict=True))
    both = a.join(b, "video", "full").agg(F.count_if(F.col("b").isNull()).alias("missing"), F.count_if(F.col("a").isNull()).alias("extra"))
    return both.select((F.col("missing") + F.col("extra") == 0).alias("equal"), "missing", "extra")


@query("set_06", f"{REC} SELECT video, condition, [x for x in range(0, declared) if NOT list_contains(p, CAST(x AS INTEGER))] AS missing, list_sort([CASE WHEN video % 19 = 6 THEN declared ELSE 0 END + x for x in p if x + CASE WHEN video % 19 = 6 THEN declared ELSE 0 END >= declared]) AS extra FROM rec")
def set_06(spark, sf):
    planned = F.expr("transform(sequence(0L, declared - 1), x -> cast(x as bigint))")
    found = F.expr("transform(p, x -> cast(x as bigint))")
    moved = F.expr("transform(p, x -> cast(x as bigint) + CASE WHEN video % 19 = 6 THEN declared ELSE 0 END)")
    return inference_records(spark, sf).select(*_VC, F.sort_array(F.array_except(planned, found)).alias("missing"), F.sort_array(F.array_except(moved, planned)).alias("extra"))


# files
@query("qc_10", "SELECT 'part-' || n_nationkey || '.txt' AS name FROM nation WHERE n_nationkey % 4 = 3")
def qc_10(spark, sf):
    """Files of the manifest that aren't there."""
    path = scratch(spark, "missing")
    wanted = read(spark, sf, "nation").select("n_nationkey", F.concat(F.lit("part-"), F.col("n_nationkey").cast("string"), F.lit(".txt")).alias("name"))
    wanted.where("n_nationkey % 4 <> 3").select(F.col("n_nationkey").cast("string").alias("value"), F.col("name").alias("file")).write.partitionBy("file").text(path)
    there = readers.files(spark, path).select(F.regexp_extract("path", "file=([^/]+)/", 1).alias("name")).distinct()
    return wanted.select("name").join(there, "name", "left_anti")


@query("qc_13", "SELECT n_nationkey, sha256(n_name || chr(10)) AS sha256, CAST(strlen(n_name) + 1 AS BIGINT) AS bytes, n_nationkey % 6 <> 5 AS hash_ok, n_nationkey % 8 <> 7 AS size_ok FROM nation")
def qc_13(spark, sf):
    """Files' hashes and sizes against those that the manifest states."""
    path = scratch(spark, "chain")
    n = read(spark, sf, "nation")
    n.select(F.col("n_name").alias("value"), "n_nationkey").repartition(F.col("n_nationkey")).write.partitionBy("n_nationkey").text(path)
    found = readers.files(spark, path).select(F.regexp_extract("path", "n_nationkey=([0-9]+)/", 1).cast("int").alias("n_nationkey"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))
    text = F.concat("n_name", F.lit("\n"))
    stated = n.select(F.col("n_nationkey").cast("int").alias("n_nationkey"), F.when(F.col("n_nationkey") % 6 == 5, "bad").otherwise(F.sha2(text, 256)).alias("h"), (F.length(text) + F.when(F.col("n_nationkey") % 8 == 7, 1).otherwise(0)).alias("b"))
    return found.join(stated, "n_nationkey").select("n_nationkey", "sha256", "bytes", (F.col("sha256") == F.col("h")).alias("hash_ok"), (F.col("bytes") == F.col("b")).alias("size_ok"))


@query("src_03", "SELECT n_nationkey, n_name FROM nation")
def src_03(spark, sf):
    """One JSON document over many lines."""
    document = read(spark, sf, "nation").select(F.regexp_replace(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name"))), ",", ",\n").alias("value"))
    document.coalesce(1).write.text(path := scratch(spark, "document"))
    return readers.json_document(spark, path, "n_nationkey int, n_name string")


@query("src_09", "SELECT CAST(o_custkey AS VARCHAR) AS o_custkey, count(*) AS count FROM orders GROUP BY ALL HAVING count(*) > 1")
def src_09(spark, sf):
    """A manifest read under its exact header: the keys that repeat."""
    columns = ["o_custkey", "o_orderstatus"]
    writers.csv(read(spark, sf, "orders"), path := scratch(spark, "strict"), columns)
    return readers.csv_strict(spark, path, columns, ["o_custkey"])[1]


@query("snk_04", """SELECT r_regionkey, '{"members":' || count(*) || ',"name":"' || r_name || '","region":' || r_regionkey || '}' AS line FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name""")
def snk_04(spark, sf):
    """Documents with sorted keys, each file ending in a newline; Spark's commit makes the write all or nothing."""
    joined = read(spark, sf, "region").join(read(spark, sf, "nation"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey", "r_name").agg(F.count("*").alias("n"))
    line = F.to_json(F.struct(F.col("n").alias("members"), F.col("r_name").alias("name"), F.col("r_regionkey").alias("region")))
    joined.select("r_regionkey", line.alias("value")).write.partitionBy("r_regionkey").text(path := scratch(spark, "sorted"))
    return spark.read.text(path).select(F.col("r_regionkey").cast("int").alias("r_regionkey"), F.col("value").alias("line"))


# histories, modes, logs
_HISTORY = "SELECT run, epoch, steps, best FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch) - 1 AS place, max(value) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM h) WHERE epoch <> place OR steps <> (epoch + 1) * 4608 OR best <> coalesce(value > before, TRUE)"


@query("qc_12", f"WITH h AS (SELECT l_orderkey AS run, l_linenumber - 1 AS epoch, max(l_extendedprice) AS value, CAST(l_linenumber AS BIGINT) * 4608 + CASE WHEN l_orderkey % 50 = 3 THEN 1 ELSE 0 END AS steps, l_linenumber = 1 AS best FROM lineitem GROUP BY ALL) {_HISTORY}")
def qc_12(spark, sf):
    """Epochs of a history that aren't contiguous, whose steps are wrong, or that are wrongly said (not) to be the best so far."""
    e = F.col("l_linenumber")
    h = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("run"), (e - 1).alias("epoch"), (e.cast("long") * 4608 + F.when(F.col("l_orderkey") % 50 == 3, 1).otherwise(0)).alias("steps"), (e == 1).alias("best")).agg(F.max("l_extendedprice").alias("value"))
    by = Window.partitionBy("run").orderBy("epoch")
    h = h.withColumns({"place": F.row_number().over(by) - 1, "before": F.max("value").over(by.rowsBetween(Window.unboundedPreceding, -1))})
    wrong = (F.col("epoch") != F.col("place")) | (F.col("steps") != (F.col("epoch") + 1) * 4608) | (F.col("best") != F.coalesce(F.col("value") > F.col("before"), F.lit(True)))
    return h.where(wrong).select("run", "epoch", "steps", "best")


@query("qc_14", f"WITH {X.BASE}, n AS (SELECT role, count(DISTINCT video) * 5 * 3 AS expected, count(DISTINCT video || condition) * 3 AS found FROM base GROUP BY role) SELECT role, expected, found, CASE WHEN found = expected THEN 'production' WHEN found < expected THEN 'smoke' ELSE 'invalid' END AS mode FROM n")
def qc_14(spark, sf):
    """Rows that each mode's contract asks for (videos x conditions x detectors), and the mode that the rows found allow."""
    n = X.base(spark, sf).groupBy("role").agg((F.countDistinct("video") * 15).alias("expected"), (F.countDistinct(F.concat(F.col("video").cast("string"), F.col("condition"))) * 3).alias("found"))
    return n.withColumn("mode", F.when(F.col("found") == F.col("expected"), "production").when(F.col("found") < F.col("expected"), "smoke").otherwise("invalid"))


_LOG = f"WITH {X.BASE}, log AS (SELECT condition, CASE WHEN event_id % 501 = 7 THEN 'odd' ELSE inference_status END AS status FROM base), summary AS (SELECT condition, status, count(*) + CASE WHEN condition = 'BLR' THEN 2 ELSE 0 END AS n FROM log WHERE status <> 'odd' GROUP BY condition, status)"


@query("qc_16", f"{_LOG}, found AS (SELECT condition, status, count(*) AS n FROM log GROUP BY ALL) SELECT condition, status, coalesce(f.n, 0) AS n, coalesce(s.n, 0) AS expected, status IN ('ok', 'failed') AS accepted FROM found f FULL JOIN summary s USING (condition, status) WHERE coalesce(f.n, 0) <> coalesce(s.n, 0) OR status NOT IN ('ok', 'failed')")
def qc_16(spark, sf):
    """Statuses whose number in the log isn't the summary's, or that no contract knows."""
    log = X.base(spark, sf).select("condition", F.when(F.col("event_id") % 501 == 7, "odd").otherwise(F.col("inference_status")).alias("status"))
    found = log.groupBy("condition", "status").agg(F.count("*").alias("n"))
    summary = found.where("status <> 'odd'").withColumn("n", F.col("n") + F.when(F.col("condition") == "BLR", 2).otherwise(0))
    return records.unmatched_counts(found, summary, ["condition", "status"]).withColumn("accepted", F.col("status").isin("ok", "failed"))


@query("sup_28", f"WITH {X.BASE}, v AS (SELECT video, condition, count(*) AS reported, count(*) FILTER (inference_status = 'ok') AS decoded FROM base GROUP BY ALL) SELECT condition, count(*) AS videos, count(*) FILTER (reported <> decoded) AS mismatches, count(*) FILTER (decoded = 0) AS failures, count(*) FILTER (decoded < 5) AS insufficient FROM v GROUP BY condition")
def sup_28(spark, sf):
    """Reported against decoded frames: mismatches, failures, and videos with fewer frames than asked for."""
    v = X.base(spark, sf).groupBy("video", "condition").agg(F.count("*").alias("reported"), F.count_if(F.col("inference_status") == "ok").alias("decoded"))
    return v.groupBy("condition").agg(F.count("*").alias("videos"), F.count_if(F.expr("reported <> decoded")).alias("mismatches"), F.count_if(F.expr("decoded = 0")).alias("failures"), F.count_if(F.expr("decoded < 5")).alias("insufficient"))


# calibration pool and groups
_POOL = f"WITH {X.VIDEOS}, pool AS (SELECT *, CASE WHEN detector = 'draw' AND video % 12 = 0 THEN 'b' ELSE 'a' END AS checkpoint FROM videos WHERE role = 'validation' AND study_label = 0 AND dataset = 'first')"


def _pool(spark, sf):
    rows = X.video_scores(spark, sf).where("role = 'validation' and study_label = 0 and dataset = 'first'")
    return rows.withColumn("checkpoint", F.when((F.col("detector") == "draw") & (F.col("video") % 12 == 0), "b").otherwise("a"))


@query("sup_08", f"{_POOL}, c AS (SELECT * FROM pool WHERE condition = 'CLN' AND video_score IS NOT NULL) SELECT detector, count(*) AS n, count(DISTINCT video) AS units, count(DISTINCT checkpoint) AS checkpoints, string_agg(CAST(video AS VARCHAR), ',' ORDER BY video) AS ordered FROM c GROUP BY detector")
def sup_08(spark, sf):
    """The clean pool of each detector: how many rows, units and checkpoints, and its units in order."""
    c = _pool(spark, sf).where("condition = 'CLN' and video_score is not null")
    ordered = F.concat_ws(",", F.transform(F.sort_array(F.collect_list("video")), lambda x: x.cast("string")))
    return c.groupBy("detector").agg(F.count("*").alias("n"), F.countDistinct("video").alias("units"), F.countDistinct("checkpoint").alias("checkpoints"), ordered.alias("ordered"))


_CALIBRATION = {"dataset": "dataset = 'first'", "role": "role = 'validation'", "condition": "condition = 'CLN'", "label": "study_label = 0"}


@query("sup_09", f"WITH {X.VIDEOS}, r AS (SELECT * FROM videos WHERE video_score IS NOT NULL AND video % 4 <> 3) {check_sql('r', 'detector, video, condition', _CALIBRATION)}")
def sup_09(spark, sf):
    """Rows that may not calibrate, and why; invalid rows are skipped."""
    rows = X.video_scores(spark, sf).where("video_score is not null and video % 4 <> 3")
    return records.violations(rows, _CALIBRATION, ["detector", "video", "condition"])


@query("sup_11", f"WITH {X.VIDEOS} SELECT detector, condition, video, count(*) AS n, count(*) = 1 AS unique_unit FROM videos WHERE role = 'validation' AND video_score IS NOT NULL GROUP BY ALL")
def sup_11(spark, sf):
    rows = X.video_scores(spark, sf).where("role = 'validation' and video_score is not null")
    return rows.groupBy("detector", "condition", "video").agg(F.count("*").alias("n")).withColumn("unique_unit", F.col("n") == 1)


@query("sup_12", f"{_POOL} SELECT detector, condition, count(DISTINCT row(detector, checkpoint, dataset, role)) AS contexts FROM pool GROUP BY ALL HAVING count(DISTINCT row(detector, checkpoint, dataset, role)) > 1")
def sup_12(spark, sf):
    """Groups that mix contexts (detector, checkpoint, dataset, role)."""
    return _pool(spark, sf).groupBy("detector", "condition").agg(F.countDistinct(F.struct("detector", "checkpoint", "dataset", "role")).alias("contexts")).where("contexts > 1")


@query("sup_37", f"{_POOL} SELECT detector, count(DISTINCT checkpoint) AS checkpoints, count(*) FILTER (checkpoint <> 'a') AS unlike_file FROM pool GROUP BY detector")
def sup_37(spark, sf):
    """Checkpoints of each detector, and records whose checkpoint isn't the file's."""
    return _pool(spark, sf).groupBy("detector").agg(F.countDistinct("checkpoint").alias("checkpoints"), F.count_if(F.col("checkpoint") != "a").alias("unlike_file"))


@query("sup_10", f"WITH {X.PAIRS} SELECT coalesce(a.detector, b.detector) AS detector, coalesce(a.condition, b.condition) AS condition, coalesce(a.video, b.video) AS video, a.video IS NULL AS only_degraded FROM (SELECT DISTINCT detector, d.condition, video FROM ok, (VALUES ('RSZ'), ('BLR'), ('H40'), ('PLT')) d(condition) WHERE ok.condition = 'CLN') a FULL JOIN (SELECT DISTINCT detector, condition, video FROM ok WHERE condition <> 'CLN') b ON a.detector = b.detector AND a.condition = b.condition AND a.video = b.video WHERE a.video IS NULL OR b.video IS NULL")
def sup_10(spark, sf):
    """Sampling keys that only one side of a paired population has."""
    ok = X.decisions(spark, sf).where("decision is not null and video_score is not null").select("detector", "condition", "video")
    clean = ok.where("condition = 'CLN'").select("detector", F.explode(F.array(*map(F.lit, metrics.CONDITIONS[1:]))).alias("condition"), "video", F.lit(1).alias("a")).distinct()
    bad = ok.where("condition <> 'CLN'").distinct().withColumn("b", F.lit(1))
    return clean.join(bad, ["detector", "condition", "video"], "full").where("a is null or b is null").select("detector", "condition", "video", F.col("a").isNull().alias("only_degraded"))


@query("sup_13", f"WITH {X.PAIRS}, u AS (SELECT detector, condition, video, video_score, clean_score, row_number() OVER (PARTITION BY detector, condition ORDER BY CAST(video AS VARCHAR)) - 1 AS k, count(*) OVER (PARTITION BY detector, condition) AS n FROM pairs WHERE role = 'test' AND study_label = 0), d AS (SELECT detector, condition, i, CAST(('0x' || substr(md5('1024::pair::0::real::' || i), 1, 8)) AS BIGINT) % n AS k FROM (SELECT *, unnest(range(0, n)) AS i FROM (SELECT DISTINCT detector, condition, n FROM u))) SELECT detector, condition, i, video, round(video_score, 9) AS video_score, round(clean_score, 9) AS clean_score FROM d JOIN u USING (detector, condition, k)")
def sup_13(spark, sf):
    """Both sides of a class, materialised from one draw."""
    rows = metrics.pairs(X.decisions(spark, sf)).where("role = 'test' and study_label = 0").select("detector", "condition", "video", "video_score", "clean_score").withColumn("stratum", F.lit("real"))
    numbered = resampling.units(rows, ["detector", "condition"])
    each = numbered.groupBy("detector", "condition", "stratum").agg(F.max("n").alias("n")).withColumn("i", F.explode(F.expr("sequence(0L, n - 1)")))
    drawn = each.withColumn("k", S.draw("n", F.lit(1024), F.lit("pair"), F.lit(0), "stratum", "i").cast("int"))
    return r9(drawn.join(numbered.drop("n"), ["detector", "condition", "stratum", "k"]).join(rows, ["detector", "condition", "stratum", "video"]).select("detector", "condition", "i", "video", "video_score", "clean_score"))


_KEYS = {"absolute": "detector || '|' || dataset || '|' || role || '|' || condition || '|' || g", "paired": "detector || '|' || dataset || '|' || role || '|' || coalesce(degraded, condition) || '|' || g", "base": "detector || '|' || dataset || '|' || role || '|' || condition", "diagnostic": "detector || '|' || coalesce(degraded, condition)"}


@query("sup_15", f"WITH {X.FRAMES}, k AS (SELECT DISTINCT detector, dataset, role, condition, CASE WHEN condition = 'BLR' THEN NULL ELSE lower(condition) END AS degraded, CASE WHEN manipulation = '' THEN 'pooled' ELSE manipulation END AS g FROM frames) SELECT DISTINCT {', '.join(f'{e} AS {n}_key' for n, e in _KEYS.items())} FROM k")
def sup_15(spark, sf):
    """Export keys of five, five, four and two parts; the degraded condition falls back to the condition."""
    k = X.frames(spark, sf).select("detector", "dataset", "role", "condition", F.expr("CASE WHEN condition = 'BLR' THEN NULL ELSE lower(condition) END").alias("degraded"), F.expr("CASE WHEN manipulation = '' THEN 'pooled' ELSE manipulation END").alias("g"))
    return k.select(*(F.expr(e).alias(f"{n}_key") for n, e in _KEYS.items())).distinct()


# manifests and memberships
_PAIR_ROWS = "SELECT DISTINCT o_custkey % 60 AS a, o_orderkey % 59 AS b FROM orders WHERE o_orderstatus = 'P'"


def pair_rows(spark, sf):
    return read(spark, sf, "orders").where("o_orderstatus = 'P'").selectExpr("o_custkey % 60 as a", "o_orderkey % 59 as b").distinct()


@query("sup_19", f"WITH p AS ({_PAIR_ROWS}) SELECT CAST(a AS VARCHAR) AS item, 'self_pair' AS rule FROM p WHERE a = b UNION ALL SELECT least(a, b) || '_' || greatest(a, b), 'reversed_duplicate' FROM p WHERE a <> b GROUP BY 1 HAVING count(DISTINCT a < b) > 1 UNION ALL SELECT CAST(i AS VARCHAR), 'repeated_id' FROM (SELECT unnest([a, b]) AS i FROM p) GROUP BY i HAVING count(*) > 1")
def sup_19(spark, sf):
    return records.self_reversed_repeated(pair_rows(spark, sf))


@query("sup_20", f"WITH p AS ({_PAIR_ROWS}), r AS (SELECT DISTINCT unnest([a, b]) AS id FROM p), m AS (VALUES ('M1'), ('M2'), ('M3'), ('M4')) SELECT printf('%03d', id) AS name, 0 AS study_label, '' AS manipulation FROM r UNION ALL SELECT printf('%03d_%03d', x, y), 1, col0 FROM (SELECT a AS x, b AS y FROM p UNION SELECT b, a FROM p), m")
def sup_20(spark, sf):
    """The manifest of a pair list: one real record an id, and each direction of a pair under every method."""
    p = pair_rows(spark, sf)
    real = p.select(F.explode(F.array("a", "b")).alias("id")).distinct().select(F.format_string("%03d", "id").alias("name"), F.lit(0).alias("study_label"), F.lit("").alias("manipulation"))
    both = p.unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    fake = both.select(F.format_string("%03d_%03d", "a", "b").alias("name"), F.lit(1).alias("study_label"), F.explode(F.array(*map(F.lit, metrics.METHODS))).alias("manipulation"))
    return real.unionByName(fake)


_MEMBERS = f"WITH {X.BASE}, v AS (SELECT DISTINCT video, role, study_label, manipulation FROM base WHERE dataset = 'first'), m AS (SELECT video, role, study_label, unnest(CASE WHEN study_label = 0 THEN ['aggregate', 'M' || (row_number() OVER (PARTITION BY role, study_label ORDER BY video) - 1) % 4 + 1] ELSE ['aggregate', manipulation] END) AS view FROM v)"


def members(spark, sf):
    v = X.base(spark, sf).where("dataset = 'first'").select("video", "role", "study_label", "manipulation").distinct()
    turn = (F.row_number().over(Window.partitionBy("role", "study_label").orderBy("video")) - 1) % 4 + 1
    own = F.when(F.col("study_label") == 0, F.concat(F.lit("M"), turn.cast("string"))).otherwise(F.col("manipulation"))
    return v.withColumn("own", own).select("video", "role", "study_label", F.explode(F.array(F.lit("aggregate"), F.col("own"))).alias("view"))


@query("sup_17", f"{_MEMBERS} SELECT * FROM m")
def sup_17(spark, sf):
    """Five views: all videos in the aggregate one; fakes in their method's, reals dealt in turn to the methods."""
    return members(spark, sf)


@query("sup_18", f"{_MEMBERS} SELECT view, role, study_label, count(*) AS n, CASE WHEN view = 'aggregate' THEN 25 ELSE 6 END AS expected FROM m GROUP BY ALL HAVING count(*) <> CASE WHEN view = 'aggregate' THEN 25 ELSE 6 END")
def sup_18(spark, sf):
    found = members(spark, sf).groupBy("view", "role", "study_label").agg(F.count("*").alias("n"))
    return found.withColumn("expected", F.when(F.col("view") == "aggregate", 25).otherwise(6)).where("n <> expected")


@query("sup_21", f"{MAN} SELECT study_label, count(*) AS n, CASE study_label WHEN 0 THEN 178 ELSE 340 END AS expected FROM man WHERE dataset = 'second' GROUP BY study_label")
def sup_21(spark, sf):
    """Composition of the second dataset beside the expected one."""
    return manifest(spark, sf).where("dataset = 'second'").groupBy("study_label").agg(F.count("*").alias("n")).withColumn("expected", F.when(F.col("study_label") == 0, 178).otherwise(340))


_FRAMES = """k AS (SELECT video, condition, temporal_position AS position, event_id, inference_status = 'ok' AS good FROM base),
done AS (SELECT video, condition, position FROM k WHERE good),
one AS (SELECT video, condition, position FROM k WHERE good AND event_id % 53 <> 4 UNION ALL SELECT video, condition, position FROM k WHERE good AND event_id % 59 = 5),
two AS (SELECT video, condition, position FROM k WHERE good OR event_id % 194 = 0)"""


@query("sup_23", f"WITH {X.BASE}, {_FRAMES}, c AS (SELECT video, condition, position, count(*) FILTER (t = 0) AS n_done, count(*) FILTER (t = 1) AS n_one, count(*) FILTER (t = 2) AS n_two FROM (SELECT *, 0 AS t FROM done UNION ALL SELECT *, 1 FROM one UNION ALL SELECT *, 2 FROM two) GROUP BY ALL) SELECT video, condition, position, list_filter([CASE WHEN n_done = 0 THEN 'done' END, CASE WHEN n_one = 0 THEN 'one' END, CASE WHEN n_two = 0 THEN 'two' END], lambda x: x IS NOT NULL) AS missing, list_filter([CASE WHEN n_done > 1 THEN 'done' END, CASE WHEN n_one > 1 THEN 'one' END, CASE WHEN n_two > 1 THEN 'two' END], lambda x: x IS NOT NULL) AS repeated FROM c WHERE NOT (n_done = 1 AND n_one = 1 AND n_two = 1)")
def sup_23(spark, sf):
    """Frames that the two views of the training documents and the set of materialised frames don't hold once each."""
    k = X.base(spark, sf).select("video", "condition", F.col("temporal_position").alias("position"), "event_id", (F.col("inference_status") == "ok").alias("good"))
    one = k.where("good").select("*", F.explode(F.expr("CASE WHEN event_id % 53 = 4 THEN IF(event_id % 59 = 5, array(1), array()) WHEN event_id % 59 = 5 THEN array(1, 1) ELSE array(1) END")).alias("_"))
    sets = {"done": k.where("good"), "one": one, "two": k.where("good or event_id % 194 = 0")}
    return reconcile.reconciled(sets, ["video", "condition", "position"], []).drop("differing")


_PLAN_RULES = {"positions": "n_frames = n_distinct", "contiguous": "n_frames = last + 1", "frames": "n_frames >= 4", "role": "n_roles = 1"}


@query("sup_26", f"WITH {X.BASE}, p AS (SELECT video, condition, role, CASE WHEN event_id % 211 = 5 THEN temporal_position + 1 ELSE temporal_position END AS position FROM base), c AS (SELECT video, condition, count(*) AS n_frames, count(DISTINCT position) AS n_distinct, max(position) AS last, count(DISTINCT role) AS n_roles FROM p GROUP BY ALL) {check_sql('c', 'video, condition', _PLAN_RULES)}")
def sup_26(spark, sf):
    position = F.when(F.col("event_id") % 211 == 5, F.col("temporal_position") + 1).otherwise(F.col("temporal_position"))
    rows = X.base(spark, sf).withColumn("position", position)
    return records.group_violations(rows, _VC, _PLAN_RULES, n_frames=F.count("*"), n_distinct=F.countDistinct("position"), last=F.max("position"), n_roles=F.countDistinct("role"))


_TARGETS = 12
_PLAN_AUDIT = {
    "preflight": "decoded IS NOT NULL",
    "role": "role = stated_role",
    "budget": f"budget = {_TARGETS}",
    "status": f"status = CASE WHEN coalesce(decoded, 0) >= {_TARGETS} THEN 'ok' ELSE 'invalid' END",
    "invalid_is_empty": "status = 'ok' OR n_indices = 0",
    "complete": f"status <> 'ok' OR n_indices = {_TARGETS}",
    "midpoints": "n_indices = 0 OR n_midpoints = n_indices",
    "inside": "n_indices = 0 OR (least >= 0 AND most < counted)",
    "distinct": "n_distinct = n_indices",
}
_SUMMARY_AUDIT = {"base_video_count": "stated_n = n", "ok_count": "stated_ok = n_ok", "minimum_decoded": "stated_min = min_decoded", "maximum_decoded": "stated_max = max_decoded"}
_STATED_PLAN = f"""video, role, CASE WHEN video % 13 = 5 THEN 'test' ELSE role END AS stated_role, counted, CASE WHEN video % 10 = 8 THEN NULL ELSE counted END AS decoded, CASE WHEN video % 9 = 6 THEN 11 ELSE {_TARGETS} END AS budget, CASE WHEN (counted >= {_TARGETS}) <> (video % 11 = 4) THEN 'ok' ELSE 'invalid' END AS status"""
_INDEX = f"(2 * k + 1) * counted {{div}} {2 * _TARGETS}"


def _plan_sql(div: str) -> str:
    return f"{_INDEX.format(div=div)} + CASE WHEN video % 7 = 3 AND k = 3 THEN 1 WHEN video % 14 = 12 AND k = {_TARGETS - 1} THEN 99999 ELSE 0 END"


@query(
    "sup_31",
    f"""WITH {X.BASE}, v AS (SELECT video, role, count(*) AS counted FROM base WHERE condition = 'CLN' GROUP BY ALL), s AS (SELECT {_STATED_PLAN} FROM v),
i AS (SELECT video, k, counted, {_plan_sql("//")} AS idx FROM s, range(0, {_TARGETS}) r(k) WHERE (status = 'ok' OR video % 4 = 0) AND NOT (video % 15 = 14 AND k = {_TARGETS - 1})),
a AS (SELECT video, count(*) AS n_indices, count(*) FILTER (idx = {_INDEX.format(div="//")}) AS n_midpoints, min(idx) AS least, max(idx) AS most, count(DISTINCT idx) AS n_distinct FROM i GROUP BY ALL),
p AS (SELECT 'video::' || video AS subject, s.* EXCLUDE (video), coalesce(n_indices, 0) AS n_indices, coalesce(n_midpoints, 0) AS n_midpoints, least, most, coalesce(n_distinct, 0) AS n_distinct FROM s LEFT JOIN a USING (video)),
t AS (SELECT 'summary' AS subject, count(*) AS n, count(*) FILTER (status = 'ok') AS n_ok, min(decoded) AS min_decoded, max(decoded) AS max_decoded, count(*) AS stated_n, count(*) FILTER (counted >= {_TARGETS}) AS stated_ok, min(counted) AS stated_min, max(decoded) + 1 AS stated_max FROM s)
{check_sql("p", "subject", _PLAN_AUDIT)} UNION ALL {check_sql("t", "subject", _SUMMARY_AUDIT)}""",
)
def sup_31(spark, sf):
    """The temporal plan's rows, each against the manifest, the preflight and the midpoint rule, and the summary against the
    rows: all from one table of one row a video; an index list is judged where it stands.
    """
    v = X.base(spark, sf).where("condition = 'CLN'").groupBy("video", "role").agg(F.count("*").alias("counted"))
    s = v.selectExpr(*X.split_columns(_STATED_PLAN))
    steps = f"sequence(0L, {_TARGETS - 1}L)"
    s = s.withColumn("indices", F.expr(f"IF(status = 'ok' OR video % 4 = 0, transform(filter({steps}, k -> NOT (video % 15 = 14 AND k = {_TARGETS - 1})), k -> {_plan_sql('div')}), array())")).withColumn("midpoints", F.expr(f"transform({steps}, k -> {_INDEX.format(div='div')})"))
    rows = X.stored(s, "plan")
    p = rows.selectExpr("concat('video::', video) AS subject", "*", "CAST(size(indices) AS BIGINT) AS n_indices", "CAST(size(filter(zip_with(indices, midpoints, (a, b) -> a = b), x -> x)) AS BIGINT) AS n_midpoints", "array_min(indices) AS least", "array_max(indices) AS most", "CAST(size(array_distinct(indices)) AS BIGINT) AS n_distinct")
    t = rows.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "ok").alias("n_ok"), F.min("decoded").alias("min_decoded"), F.max("decoded").alias("max_decoded"), F.count("*").alias("stated_n"), F.count_if(F.col("counted") >= _TARGETS).alias("stated_ok"), F.min("counted").alias("stated_min"), (F.max("decoded") + 1).alias("stated_max")).withColumn("subject", F.lit("summary"))
    return records.violations(p, _PLAN_AUDIT, ["subject"]).unionByName(records.violations(t, _SUMMARY_AUDIT, ["subject"]))


_GEOMETRY = {"index": "idx = planned", "reason": "valid = (reason IS NULL)", "crop": "valid OR crop IS NULL", "inside": "crop IS NULL OR crop BETWEEN 0 AND 400"}
_GEO_SQL = "video, temporal_position, temporal_position AS planned, temporal_position + CASE WHEN event_id % 307 = 9 THEN 1 ELSE 0 END AS idx, inference_status = 'ok' AS valid, CASE WHEN inference_status <> 'ok' AND event_id % 2 = 0 THEN 'no face' END AS reason, CASE WHEN inference_status = 'ok' OR event_id % 5 = 0 THEN event_id % 407 END AS crop"


_VIDEO_GEOMETRY = {"complete": "n = n_positions", "last": "last_position = n - 1"}
_GEO_FAULTS = "video, condition, event_id, temporal_position + CASE WHEN event_id % 211 = 6 THEN 1 ELSE 0 END AS position, inference_status = 'ok' AND event_id % 151 <> 7 AS valid, inference_status = 'ok' AS stated_valid"


@query(
    "sup_32",
    f"""WITH {X.BASE}, g AS (SELECT 'record::' || event_id AS subject, {_GEO_SQL} FROM base), f AS (SELECT {_GEO_FAULTS} FROM base),
v AS (SELECT 'video::' || video || '::' || condition AS subject, count(*) AS n, count(DISTINCT position) AS n_positions, max(position) AS last_position, count(*) FILTER (valid) AS n_valid, count(*) FILTER (stated_valid) AS stated FROM f GROUP BY video, condition),
d AS (SELECT k, sum(found) AS found, sum(stated) AS stated FROM (SELECT n_valid AS k, 1 AS found, 0 AS stated FROM v UNION ALL SELECT stated, 0, 1 FROM v) GROUP BY k)
{check_sql("g", "subject", _GEOMETRY)} UNION ALL {check_sql("v", "subject", _VIDEO_GEOMETRY)} UNION ALL SELECT 'valid::' || k, 'distribution' FROM d WHERE found <> stated""",
)
def sup_32(spark, sf):
    """The geometry audit: records whose index isn't the planned one, invalid ones without a reason or with crop facts, crops
    outside; videos without all their positions; numbers of valid frames that as many videos don't have as the summary says.
    """
    base = X.base(spark, sf)
    each = records.violations(base.selectExpr("concat('record::', event_id) AS subject", *X.split_columns(_GEO_SQL)), _GEOMETRY, ["subject"])
    facts = base.selectExpr(*X.split_columns(_GEO_FAULTS)).groupBy("video", "condition").agg(F.count("*").alias("n"), F.countDistinct("position").alias("n_positions"), F.max("position").alias("last_position"), F.count_if("valid").alias("n_valid"), F.count_if("stated_valid").alias("stated"))
    v = X.stored(facts.withColumn("subject", F.concat_ws("::", F.lit("video"), F.col("video").cast("string"), "condition")), "facts")
    sides = v.select(F.explode(F.array(F.struct(F.col("n_valid").alias("k"), F.lit(1).alias("side")), F.struct(F.col("stated").alias("k"), F.lit(-1).alias("side")))).alias("s"))
    d = sides.groupBy("s.k").agg(F.sum("s.side").alias("gap")).where("gap <> 0").select(F.concat(F.lit("valid::"), F.col("k").cast("string")).alias("subject"), F.lit("distribution").alias("rule"))
    return each.unionByName(records.violations(v, _VIDEO_GEOMETRY, ["subject"])).unionByName(d)


@query("sup_29", "WITH l AS (SELECT c_nationkey AS label, CASE WHEN c_custkey % 25 = 4 THEN 'same.mp4' ELSE c_name || '.mp4' END AS path, c_custkey % 9 = 2 AS gone FROM customer) SELECT label, count(*) AS listed, count(*) - count(DISTINCT path) AS repeated, count(*) FILTER (gone) AS missing FROM l GROUP BY label")
def sup_29(spark, sf):
    """A listed set by label: entries, repeated paths, and entries without a file."""
    c = read(spark, sf, "customer")
    listed = c.select("c_custkey", F.col("c_nationkey").alias("label"), F.when(F.col("c_custkey") % 25 == 4, "same.mp4").otherwise(F.concat("c_name", F.lit(".mp4"))).alias("path"))
    there = c.where("c_custkey % 9 <> 2").select("c_custkey", F.lit(1).alias("there"))
    return listed.join(there, "c_custkey", "left").groupBy("label").agg(F.count("*").alias("listed"), (F.count("*") - F.countDistinct("path")).alias("repeated"), F.count_if(F.col("there").isNull()).alias("missing"))


# training
@query("sup_43", "SELECT lang, least(greatest(CAST(round_even(count(*) * 0.3, 0) AS BIGINT), 200), count(*)) AS held, count(*) - least(greatest(CAST(round_even(count(*) * 0.3, 0) AS BIGINT), 200), count(*)) AS train FROM documents GROUP BY lang")
def sup_43(spark, sf):
    """The hold-out that may leave nothing to train on."""
    n = read(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    held = F.least(F.greatest(F.bround(F.col("n") * 0.3, 0).cast("long"), F.lit(200)), F.col("n"))
    return n.select("lang", held.alias("held"), (F.col("n") - held).alias("train"))


@query("sup_45", f"WITH e AS (SELECT source, CAST(doc_id AS VARCHAR) AS item, count(*) OVER (PARTITION BY source) AS n FROM documents), s AS (SELECT source, max(n) AS source_count FROM e GROUP BY source) SELECT source, source_count, 64 AS target, CAST(64 // source_count AS BIGINT) AS full_passes, CAST(64 % source_count AS BIGINT) AS extra FROM s")
def sup_45(spark, sf):
    """What a loader's exposures come to: items, target, whole passes and the items seen once more."""
    s = read(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("source_count"))
    return s.select("source", "source_count", F.lit(64).alias("target"), F.expr("64 div source_count").alias("full_passes"), F.expr("64 % source_count").alias("extra"))


@query("sup_46", "SELECT coalesce(f.source, e.source) AS source, coalesce(f.n, 0) AS n, coalesce(e.n, 0) AS expected FROM (SELECT source, count(*) AS n FROM documents GROUP BY source) f FULL JOIN (SELECT source, count(*) AS n FROM documents WHERE doc_id % 90 <> 1 GROUP BY source UNION ALL SELECT 'lost', 3) e ON f.source = e.source WHERE coalesce(f.n, 0) <> coalesce(e.n, 0)")
def sup_46(spark, sf):
    """Sources whose counts aren't the frozen ones, on either side."""
    d = read(spark, sf, "documents")
    frozen = d.where("doc_id % 90 <> 1").groupBy("source").agg(F.count("*").alias("n")).unionByName(d.sparkSession.range(1).select(F.lit("lost").alias("source"), F.lit(3).cast("long").alias("n")))
    return records.unmatched_counts(d.groupBy("source").agg(F.count("*").alias("n")), frozen, ["source"])


@query("sup_48", "SELECT n_nationkey, CAST(unnest(range(n_nationkey % 12, 10)) AS INTEGER) AS epoch FROM nation")
def sup_48(spark, sf):
    """Epochs that a run of ten still has before it."""
    n = read(spark, sf, "nation").withColumn("done", (F.col("n_nationkey") % 12).cast("int"))
    return n.where("done < 10").select("n_nationkey", F.explode(F.sequence("done", F.lit(9))).alias("epoch"))


@query("sup_49", "WITH c AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) AS r, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_name) AS low, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_name) AS high FROM customer) SELECT c_nationkey, 'first' AS rule, c_custkey FROM c WHERE r = 1 UNION ALL SELECT c_nationkey, 'least', c_custkey FROM c WHERE low = 1 UNION ALL SELECT c_nationkey, 'most', c_custkey FROM c WHERE high = 1")
def sup_49(spark, sf):
    """The first row by path of each selector, and those with the least and the most."""
    c = read(spark, sf, "customer").groupBy("c_nationkey").agg(F.min_by("c_custkey", "c_name").alias("first"), F.min_by("c_custkey", F.struct("c_acctbal", "c_name")).alias("least"), F.min_by("c_custkey", F.struct(-F.col("c_acctbal"), "c_name")).alias("most"))
    return c.unpivot("c_nationkey", ["first", "least", "most"], "rule", "c_custkey")


@query("smp_06", "WITH p AS (SELECT doc_id, row_number() OVER (PARTITION BY quality ORDER BY md5('7::' || doc_id), doc_id) - 1 AS k, quality FROM labels), n AS (SELECT count(*) FILTER (quality = 1) AS n FROM labels), f AS (SELECT doc_id, k // 8 AS batch, quality, k FROM p WHERE quality = 0) SELECT batch, doc_id, 0 AS quality FROM f UNION ALL SELECT f.batch, r.doc_id, 1 FROM f, n JOIN p r ON r.quality = 1 AND r.k = CAST(('0x' || substr(md5('7::half::' || f.k), 1, 8)) AS BIGINT) % n.n")
def smp_06(spark, sf):
    """Batches of sixteen: eight of one class in a shuffled order, each seen once, and eight of the other drawn with replacement."""
    labels = read(spark, sf, "labels").where("quality is not null")
    order = F.md5(F.concat_ws("::", F.lit("7"), F.col("doc_id").cast("string")))
    ranked = labels.withColumn("k", (F.row_number().over(Window.partitionBy("quality").orderBy(order, "doc_id")) - 1).cast("long"))
    once = ranked.where("quality = 0").select(F.expr("k div 8").alias("batch"), "doc_id", "k")
    n = labels.where("quality = 1").agg(F.count("*").alias("n"))
    drawn = once.join(F.broadcast(n), F.lit(True)).select("batch", S.draw("n", F.lit(7), F.lit("half"), "k").cast("long").alias("k"))
    again = drawn.join(ranked.where("quality = 1").select("k", "doc_id"), "k").select("batch", "doc_id", F.lit(1).alias("quality"))
    return once.select("batch", "doc_id", F.lit(0).alias("quality")).unionByName(again)


# sorts, unions, texts
@query("srt_02", f"WITH {X.FAN} SELECT metric_group, row_number() OVER (ORDER BY CASE metric_group WHEN 'M1' THEN 0 WHEN 'M2' THEN 1 WHEN 'M3' THEN 2 WHEN 'M4' THEN 3 ELSE 4 END) AS place FROM (SELECT DISTINCT metric_group FROM fan)")
def srt_02(spark, sf):
    """The metric groups, four methods and then the pooled one; at most five rows reach the window."""
    groups = metrics.fan_out(X.decisions(spark, sf)).select("metric_group").distinct()
    return groups.select("metric_group", F.row_number().over(Window.orderBy(metrics.order_of("metric_group", (*metrics.METHODS, "pooled")))).cast("long").alias("place"))


@query("set_02", f"WITH {X.BASE}, f AS (SELECT condition AS part, video, dataset, CASE WHEN condition = 'PLT' THEN 'v2' ELSE 'v1' END AS version FROM base) SELECT part, count(*) AS n, count(DISTINCT row(dataset, version)) AS metadata, (SELECT count(DISTINCT version) FROM f) AS versions FROM f GROUP BY part")
def set_02(spark, sf):
    """The union of five files, with how many kinds of metadata each and all of them have."""
    whole = None
    for c in metrics.CONDITIONS:
        part = X.base(spark, sf).where(F.col("condition") == c).select(F.lit(c).alias("part"), "video", "dataset", F.lit("v2" if c == "PLT" else "v1").alias("version"))
        whole = part if whole is None else whole.unionByName(part)
    versions = whole.agg(F.countDistinct("version").alias("versions"))
    return whole.groupBy("part").agg(F.count("*").alias("n"), F.countDistinct(F.struct("dataset", "version")).alias("metadata")).join(F.broadcast(versions), F.lit(True))


@query("set_09", f"WITH {X.BASE} SELECT video, condition, event_id, study_label FROM base WHERE study_label = 1 UNION ALL SELECT video, '', event_id, study_label FROM (SELECT video, event_id, study_label FROM base WHERE study_label = 0 QUALIFY row_number() OVER (PARTITION BY video ORDER BY event_id) = 1)")
def set_09(spark, sf):
    """Fake rows as they are, and real rows once a video."""
    b = X.base(spark, sf)
    real = b.where("study_label = 0").groupBy("video", "study_label").agg(F.min("event_id").alias("event_id")).withColumn("condition", F.lit(""))
    return b.where("study_label = 1").select("video", "condition", "event_id", "study_label").unionByName(real)


@query("str_10", "SELECT n_nationkey, regexp_full_match(h, '[0-9a-f]{64}') AS hex, regexp_full_match(id, '[0-9]{3}') AS three FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN upper(sha256(n_name)) WHEN n_nationkey % 3 = 1 THEN substr(sha256(n_name), 2) ELSE sha256(n_name) END AS h, CASE WHEN n_nationkey % 2 = 0 THEN printf('%03d', n_nationkey) ELSE 'x' || n_nationkey END AS id FROM nation)")
def str_10(spark, sf):
    h = F.sha2("n_name", 256)
    k = F.col("n_nationkey")
    n = read(spark, sf, "nation").select("n_nationkey", F.when(k % 3 == 0, F.upper(h)).when(k % 3 == 1, F.substring(h, 2, 64)).otherwise(h).alias("h"), F.when(k % 2 == 0, F.format_string("%03d", k)).otherwise(F.concat(F.lit("x"), k.cast("string"))).alias("id"))
    return n.select("n_nationkey", S.is_sha256("h").alias("hex"), F.col("id").rlike("^[0-9]{3}$").alias("three"))


@query("agg_12", f"WITH {X.BASE}, k AS (SELECT *, video // 50 AS b, CAST(study_label AS VARCHAR) AS l, CAST(temporal_position % 2 AS VARCHAR) AS p, 'fpr05' AS t, 'a' AS c, CAST(event_id % 3 AS VARCHAR) AS e, '' AS x FROM base) SELECT dataset, role, condition, inference_status, manipulation, CAST(b AS VARCHAR) AS b, l, p, t, c, e, x, count(*) AS n, min(event_id) AS first_event, arg_min(video, event_id) AS first_video, round(avg(s), 9) AS mean FROM k GROUP BY dataset, role, condition, inference_status, manipulation, b, l, p, t, c, e, x")
def agg_12(spark, sf):
    """Groups by a text key of twelve parts; columns outside the key come from the group's first row."""
    k = X.base(spark, sf).withColumns({"b": F.expr("cast(video div 50 as string)"), "l": F.col("study_label").cast("string"), "p": (F.col("temporal_position") % 2).cast("string"), "t": F.lit("fpr05"), "c": F.lit("a"), "e": (F.col("event_id") % 3).cast("string"), "x": F.lit("")})
    keys = ["dataset", "role", "condition", "inference_status", "manipulation", "b", "l", "p", "t", "c", "e", "x"]
    return r9(k.groupBy(*keys).agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.min_by("video", "event_id").alias("first_video"), F.avg("s").alias("mean")))
