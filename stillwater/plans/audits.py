"""Audits of whole chains: reconciliation of tables, rules counted while artifacts are written, hash chains, numbered lines.

Views plant faults by remainders of ids, so every check has something to find.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillwater.operators import audit, metrics, reconcile
from stillwater.plans import fixtures as X
from stillwater.plans.fixtures import query, r9, read, scratch
from stillwater.sources import readers

# manifest, inference and analysis records of a video and condition; each lacks some, and some differ
_RECORDS = ["dataset", "role", "study_label", "manipulation"]
_LOST = {
    "manifest": "(video % 17 = 3 AND condition = 'BLR') OR (video % 7 = 6 AND condition = 'RSZ') OR (video % 11 = 1 AND condition = 'H40')",
    "inference": "(video % 19 = 5 AND condition = 'PLT') OR (video % 11 = 1 AND condition = 'H40') OR (video % 10 = 9 AND condition = 'CLN')",
    "analysis": "(video % 19 = 5 AND condition = 'PLT') OR (video % 7 = 6 AND condition = 'RSZ') OR (video % 8 = 2 AND condition = 'PLT')",
}
_CHANGED = {
    "manifest": {},
    "inference": {"role": "CASE WHEN video % 13 = 2 AND condition = 'H40' THEN 'other' ELSE role END"},
    "analysis": {"study_label": "CASE WHEN video % 9 = 8 THEN 1 - study_label ELSE study_label END", "manipulation": "CASE WHEN video % 14 = 5 THEN NULL ELSE manipulation END"},
}
_TWICE = "video % 16 = 7 AND condition = 'CLN'"


def _side_sql(name: str) -> str:
    fields = ", ".join(f"{_CHANGED[name].get(f, f)} AS {f}" for f in _RECORDS)
    return f"{name} AS (SELECT video, condition, {fields}, CASE WHEN {_TWICE} AND '{name}' = 'analysis' THEN 2 ELSE 1 END AS n FROM v WHERE NOT ({_LOST[name]}))"


def _faults_sql(names: list[str], keys: list[str], fields: list[str]) -> str:
    """The faults by full joins of all sides."""
    on = names[0]
    for k, n in enumerate(names[1:], 1):
        known = {c: f"coalesce({', '.join(f'{m}.{c}' for m in names[:k])})" for c in keys}
        on += f" FULL JOIN {n} ON " + " AND ".join(f"{known[c]} = {n}.{c}" for c in keys)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    told = lambda cells: f"list_sort(list_filter([{', '.join(cells)}], lambda x: x IS NOT NULL))"
    missing = told([f"CASE WHEN {n}.n IS NULL THEN '{n}' END" for n in names])
    repeated = told([f"CASE WHEN {n}.n > 1 THEN '{n}' END" for n in names])
    differing = told(["CASE WHEN " + " OR ".join(f"({a}.n IS NOT NULL AND {b}.n IS NOT NULL AND {a}.{f} IS DISTINCT FROM {b}.{f})" for a, b in pairs) + f" THEN '{f}' END" for f in fields])
    columns = ", ".join(f"coalesce({', '.join(f'{n}.{c}' for n in names)}) AS {c}" for c in keys)
    return f"SELECT * FROM (SELECT {columns}, {missing} AS missing, {repeated} AS repeated, {differing} AS differing FROM {on}) WHERE len(missing) + len(repeated) + len(differing) > 0"


_V = "v AS (SELECT DISTINCT video, condition, dataset, role, study_label, manipulation FROM base)"


@query("join_21", f"WITH {X.BASE}, {_V}, {', '.join(map(_side_sql, _LOST))} {_faults_sql(list(_LOST), ['video', 'condition'], _RECORDS)}")
def join_21(spark, sf):
    """Manifest, inference and analysis: records that a side lacks or repeats, and fields that sides state differently."""
    v = X.base(spark, sf).select("video", "condition", *_RECORDS).distinct()
    sides = {n: v.where(f"NOT ({lost})").select("video", "condition", *(F.expr(_CHANGED[n].get(f, f)).alias(f) for f in _RECORDS)) for n, lost in _LOST.items()}
    sides["analysis"] = sides["analysis"].unionByName(sides["analysis"].where(_TWICE))
    return reconcile.reconciled(sides, ["video", "condition"], _RECORDS)


_SELECTED = "dataset = 'second' OR role = 'test' OR (role = 'validation' AND study_label = 0)"
_STORED = f"(({_SELECTED}) AND video % 9 <> 4) OR (role = 'validation' AND study_label = 1 AND video % 12 = 3)"
_STORED_ROLE = "CASE WHEN video % 10 = 7 THEN 'train' ELSE role END"


@query("sup_22", f"WITH {X.BASE}, p AS (SELECT DISTINCT video, dataset, role, study_label FROM base), selected AS (SELECT *, 1 AS n FROM p WHERE {_SELECTED}), stored AS (SELECT video, dataset, {_STORED_ROLE} AS role, study_label, 1 AS n FROM p WHERE {_STORED}) {_faults_sql(['selected', 'stored'], ['video'], ['dataset', 'role', 'study_label'])}")
def sup_22(spark, sf):
    """What is degraded, selected again (real validation videos, all test videos, all of the second dataset), against the
    stored population both ways.
    """
    p = X.base(spark, sf).select("video", "dataset", "role", "study_label").distinct()
    stored = p.where(_STORED).withColumn("role", F.expr(_STORED_ROLE))
    return reconcile.reconciled({"selected": p.where(_SELECTED), "stored": stored}, ["video"], ["dataset", "role", "study_label"])


# the audit: frames, video scores and decisions with planted faults
_FRAME = {
    "score": "CASE WHEN event_id % 211 = 5 THEN 1.5 WHEN event_id % 223 = 7 THEN NULL ELSE s END",
    "failure_reason": "CASE WHEN inference_status = 'failed' AND event_id % 2 = 0 THEN 'decode' WHEN event_id % 307 = 11 THEN 'odd' END",
    "condition": "CASE WHEN event_id % 401 = 13 THEN 'XXX' ELSE condition END",
    "study_label": "CASE WHEN event_id % 503 = 17 THEN 1 - study_label ELSE study_label END",
    "temporal_position": "CASE WHEN event_id % 601 = 19 THEN temporal_position + 1 ELSE temporal_position END",
    "role": "CASE WHEN event_id % 701 = 23 THEN 'train' ELSE role END",
}
_FRAME_COLUMNS = ["event_id", "video", "condition", "role", "dataset", "study_label", "manipulation", "temporal_position", "score", "inference_status", "failure_reason"]
_FRAME_RULES = {
    "frame_condition_known": "condition IN ('CLN', 'RSZ', 'BLR', 'H40', 'PLT')",
    "frame_role_known": "role IN ('validation', 'test', 'external_evaluation')",
    "frame_label_binary": "study_label IN (0, 1)",
    "frame_method_of_label": "(study_label = 1 AND dataset = 'first') = (manipulation <> '')",
    "frame_dataset_of_role": "(dataset = 'second') = (role = 'external_evaluation')",
    "frame_position_not_negative": "temporal_position >= 0",
    "frame_score_in_range": "score IS NULL OR (score >= 0 AND score <= 1)",
    "frame_score_of_success": "inference_status <> 'ok' OR score IS NOT NULL",
    "frame_failure_has_reason": "inference_status <> 'failed' OR failure_reason IS NOT NULL",
    "frame_success_has_no_reason": "inference_status <> 'ok' OR failure_reason IS NULL",
}
_CLIP = ("count(*) AS n, count(DISTINCT temporal_position) AS n_positions, min(temporal_position) AS low, max(temporal_position) AS high", {"clip_positions_unique": "n = n_positions", "clip_positions_contiguous": "low = 0 AND high = n - 1"})
_VIDEO = ("count(DISTINCT role) AS roles, count(DISTINCT study_label) AS labels, count(DISTINCT condition) AS conditions, count(DISTINCT manipulation) AS methods", {"video_one_role": "roles = 1", "video_one_label": "labels = 1", "video_one_method": "methods = 1", "video_all_conditions": "conditions = 5"})
_SCORES = "SELECT video, condition, count(*) AS n, count(*) FILTER (WHERE inference_status = 'ok' AND score IS NOT NULL) AS n_ok, CASE WHEN video % 27 = 4 OR count(*) = count(*) FILTER (WHERE inference_status = 'ok' AND score IS NOT NULL) THEN avg(score) END AS video_score FROM frames GROUP BY video, condition"
_SCORE_RULES = {"score_only_if_all_frames": "(video_score IS NULL) = (n_ok < n)", "score_in_range": "video_score IS NULL OR video_score BETWEEN 0 AND 1", "score_counts": "n_ok <= n AND n > 0"}
_DECISIONS = "SELECT video, condition, video_score, CASE WHEN video % 41 = 8 THEN 0.31 ELSE 0.3 END AS threshold_value, CASE WHEN video % 25 = 9 THEN 1 ELSE CASE WHEN video_score >= 0.3 THEN 1 WHEN video_score < 0.3 THEN 0 END END AS decision FROM scores WHERE NOT (video % 33 = 10 AND condition = 'RSZ')"
_DECISION_RULES = {"decision_at_threshold": "video_score IS NULL OR decision = CASE WHEN video_score >= threshold_value THEN 1 ELSE 0 END", "decision_only_of_scores": "(decision IS NULL) = (video_score IS NULL)", "decision_threshold_frozen": "threshold_value = 0.3"}
_SAME = ("count(DISTINCT side) AS sides, count(*) AS n", {"decision_for_each_score": "sides = 2", "decision_once_a_score": "n <= 2"})


def _count_sql(source: str, rules: dict[str, str]) -> list[str]:
    return [f"SELECT '{n}' AS check, count(*) AS looked_at, count(*) FILTER (WHERE NOT coalesce({r}, FALSE)) AS violations FROM {source}" for n, r in rules.items()]


_FRAME_SQL = ", ".join(f"{_FRAME.get(c, c)} AS {c}" for c in _FRAME_COLUMNS)
_CHECKS_SQL = [
    *_count_sql("frames", _FRAME_RULES),
    *_count_sql(f"(SELECT {_CLIP[0]} FROM frames GROUP BY video, condition)", _CLIP[1]),
    *_count_sql(f"(SELECT {_VIDEO[0]} FROM frames GROUP BY video)", _VIDEO[1]),
    *_count_sql("scores", _SCORE_RULES),
    *_count_sql("decisions", _DECISION_RULES),
    *_count_sql(f"(SELECT {_SAME[0]} FROM (SELECT video, condition, 'score' AS side FROM scores UNION ALL SELECT video, condition, 'decision' FROM decisions) GROUP BY video, condition)", _SAME[1]),
]


@query("qc_15", f"WITH {X.BASE}, frames AS (SELECT {_FRAME_SQL} FROM base), scores AS ({_SCORES}), decisions AS ({_DECISIONS}) SELECT *, violations = 0 AS passed FROM ({' UNION ALL '.join(_CHECKS_SQL)})")
def qc_15(spark, sf):
    """24 checks of a chain of three artifacts in six scans: three writes that count row rules, three aggregations by key."""
    found = audit.Audit(spark)
    framed = X.base(spark, sf).select(*(F.expr(_FRAME.get(c, c)).alias(c) for c in _FRAME_COLUMNS))
    frames = found.written(framed, scratch(spark, "audit-frames"), _FRAME_RULES)
    for keys, (aggregates, rules) in ((["video", "condition"], _CLIP), (["video"], _VIDEO)):
        found.keyed(frames, keys, _columns(aggregates), rules)
    scores = found.written(spark.sql(_SCORES.replace("FROM frames", "FROM {frames}"), frames=frames), scratch(spark, "audit-scores"), _SCORE_RULES)
    decisions = found.written(spark.sql(_DECISIONS.replace("FROM scores", "FROM {scores}"), scores=scores), scratch(spark, "audit-decisions"), _DECISION_RULES)
    both = reduce(DataFrame.unionByName, [d.select("video", "condition", F.lit(n).alias("side")) for n, d in (("score", scores), ("decision", decisions))])
    found.keyed(both, ["video", "condition"], _columns(_SAME[0]), _SAME[1])
    return found.table()


def _columns(aggregates: str) -> dict[str, F.Column]:
    return {a.rsplit(" AS ", 1)[1]: F.expr(a.rsplit(" AS ", 1)[0]) for a in aggregates.split(", ")}


# a chain of artifacts, each of which states the digest of the one before
_LINKS = {"frames": ("SELECT event_id, video, condition, temporal_position FROM base", ["event_id", "video", "condition", "temporal_position"]), "clips": ("SELECT video, condition, count(*) AS n FROM base GROUP BY ALL", ["video", "condition", "n"]), "conditions": ("SELECT condition, count(*) AS n FROM (SELECT DISTINCT video, condition FROM base) GROUP BY ALL", ["condition", "n"]), "summary": ("SELECT count(DISTINCT video) AS n FROM base", ["n"])}
_LAST = "summary"
_DIGESTS = ", ".join(f"{n} AS (SELECT count(*) AS n, coalesce(sum(('0x' || substr(md5(concat_ws('|', {', '.join(f'CAST({c} AS VARCHAR)' for c in columns)})), 1, 8))::BIGINT), 0) AS s FROM ({sql}))" for n, (sql, columns) in _LINKS.items())
_CHAIN = " UNION ALL ".join(f"SELECT '{n}' AS name, {n}.n AS rows, CAST({n}.s AS BIGINT) AS digest, {repr(b) if b else 'NULL'} AS source, {f'CAST({b}.s + {int(n == _LAST)} AS BIGINT)' if b else 'NULL'} AS stated FROM {n}{f', {b}' if b else ''}" for n, b in zip(_LINKS, [None, *_LINKS], strict=False))


@query("qc_13_chain", f"WITH {X.BASE}, {_DIGESTS}, links AS ({_CHAIN}) SELECT name, rows, digest, source, stated, name <> 'summary' AS link_ok FROM links")
def qc_13_chain(spark, sf):
    """Four artifacts and whether each states the digest that its source has; the last one's record is off by one."""
    base, links = X.stored(X.base(spark, sf), "base"), []
    for name, (sql, columns) in _LINKS.items():
        rows, own = audit.digest(spark.sql(sql.replace("FROM base", "FROM {base}"), base=base), columns)
        before = links[-1] if links else None
        links.append({"name": name, "rows": rows, "digest": own, "source": before["name"] if before else None, "stated": before["digest"] + (name == "summary") if before else None})
    return audit.chain(links, spark)


@query(
    "agg_27",
    f"""WITH {X.BASE}, r AS (SELECT condition, event_id % 6 AS batch, s AS score, study_label FROM base),
h AS (SELECT condition, batch, score, sum(study_label) AS p, sum(1 - study_label) AS q FROM r GROUP BY ALL),
c AS (SELECT condition, batch, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER t AS pp, sum(q) OVER t AS nn FROM h WINDOW w AS (PARTITION BY condition, batch ORDER BY score DESC), t AS (PARTITION BY condition, batch)),
k AS (SELECT condition, batch, tp, fp, pp, nn FROM c WHERE pp > 0 AND nn > 0 UNION ALL SELECT DISTINCT condition, batch, 0, 0, pp, nn FROM c WHERE pp > 0 AND nn > 0),
e AS (SELECT condition, batch, pp, nn, 99 * fp AS x, fp, min(tp) AS low, max(tp) AS high FROM k GROUP BY ALL),
g AS (SELECT DISTINCT condition, batch, pp, nn, step, step * nn AS x FROM e, range(0, 100) t(step)),
a AS (SELECT g.*, e.fp AS fp0, e.high AS tp0 FROM g ASOF JOIN e ON g.condition = e.condition AND g.batch = e.batch AND g.x >= e.x),
b AS (SELECT a.*, e.fp AS fp1, e.low AS tp1 FROM a ASOF LEFT JOIN e ON a.condition = e.condition AND a.batch = e.batch AND a.x < e.x),
i AS (SELECT condition, batch, step, CASE WHEN step = 0 THEN 0 WHEN fp1 IS NULL THEN tp0 ELSE tp0 + (x - 99 * fp0) / (99 * (fp1 - fp0)) * (tp1 - tp0) END / pp AS tpr FROM b)
SELECT condition, CAST(step AS BIGINT) AS step, count(*) AS batches, round(avg(tpr), 9) AS tpr FROM i GROUP BY condition, step""",
)
def agg_27(spark, sf):
    """The TPR of each batch at 100 FPRs, linear between the points of its curve, and the mean over batches."""
    rows = X.base(spark, sf).select("condition", (F.col("event_id") % 6).alias("batch"), F.col("s").alias("score"), F.col("study_label").alias("label"))
    grid = metrics.tpr_on_grid(rows, ["condition", "batch"])
    return r9(grid.groupBy("condition", "step").agg(F.count("*").alias("batches"), F.avg("tpr").alias("tpr")))


# text files whose faults are told by file and line
_PART = "c_custkey % 3"
_JSON_LINE = "CASE WHEN c_custkey % 50 = 7 THEN '{{\"c_custkey\": ' WHEN c_custkey % 50 = 8 THEN '' WHEN c_custkey % 50 = 9 THEN '{{\"c_custkey\": \"x\"}}' ELSE '{{\"c_custkey\": ' || c_custkey || '}}' END".replace("{{", "{").replace("}}", "}")
_LIST_LINE = "CASE WHEN c_custkey % 40 = 3 THEN '' WHEN c_custkey % 40 = 4 THEN 'x  a' || c_custkey || '.mp4' WHEN c_custkey % 40 = 5 THEN '7' WHEN c_custkey % 40 = 6 THEN ' 1 a' || (c_custkey - 1 - c_custkey % 2) || ' b.mp4' ELSE c_nationkey || '  a' || c_custkey || ' b.mp4' END"


def _lines_sql(line: str) -> str:
    return f"t AS (SELECT c_custkey, {_PART} AS part, {line} AS value FROM customer), l AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY c_custkey) AS line, value FROM t)"


def _written_lines(spark, sf, line: str) -> str:
    rows = read(spark, sf, "customer").select("c_custkey", F.expr(_PART).alias("part"), F.expr(line).alias("value"))
    rows.repartition(3, "part").sortWithinPartitions("part", "c_custkey").select("part", "value").write.partitionBy("part").text(path := scratch(spark, "lines"))
    return path


def _part_of_file() -> F.Column:
    return F.regexp_extract("file", "part=([0-9]+)/", 1).cast("long").alias("part")


@query("src_02_lines", f"WITH {_lines_sql(_JSON_LINE)} SELECT part, line, value FROM l WHERE value <> '' AND NOT regexp_full_match(value, '\\{{\"c_custkey\": [0-9]+\\}}')")
def src_02_lines(spark, sf):
    """Malformed lines of JSON files, by file and line."""
    return readers.bad_json_lines(spark, _written_lines(spark, sf, _JSON_LINE), "c_custkey long").select(_part_of_file(), F.col("line").cast("long").alias("line"), "value")


@query("src_06_lines", f"WITH {_lines_sql(_LIST_LINE)}, s AS (SELECT part, line, value, TRY_CAST(regexp_extract(trim(value), '^\\S+') AS INTEGER) AS label, nullif(regexp_extract(trim(value), '^\\S+\\s+(.*)$', 1), '') AS path FROM l WHERE trim(value) <> ''), f AS (SELECT *, CASE WHEN label IS NULL THEN 'no_label' WHEN path IS NULL THEN 'no_path' WHEN row_number() OVER (PARTITION BY path ORDER BY part, line) > 1 THEN 'repeated' END AS fault FROM s) SELECT part, line, value, fault FROM f WHERE fault IS NOT NULL")
def src_06_lines(spark, sf):
    """Lines of a list of labels and paths that lack one of both or repeat a path."""
    return readers.label_list_faults(spark, _written_lines(spark, sf, _LIST_LINE)).select(_part_of_file(), F.col("line").cast("long").alias("line"), "value", "fault")
