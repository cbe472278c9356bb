"""Joins, set operations, windows, sorts, projections and filters on the fixture views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stillwater.functions import scalars as S
from stillwater.operators import checks, metrics, selection, thresholds, videos
from stillwater.plans import fixtures as X
from stillwater.plans.fixtures import query, r9, read
from stillwater.plans.flagships import tied

_WIDE = """w AS (SELECT video, max(study_label) AS label, max(manipulation) AS manipulation, max(role) AS role, avg(s) FILTER (condition = 'CLN') AS cln, avg(s) FILTER (condition = 'RSZ') AS rsz, avg(s) FILTER (condition = 'BLR') AS blr, avg(s) FILTER (condition = 'H40') AS h40, avg(s) FILTER (condition = 'PLT') AS plt FROM base GROUP BY video HAVING count(DISTINCT condition) = 5)"""
CUTOFF, MARGIN = 0.1, 0.02


def wide(spark, sf, order=None):
    """One row a video with a mean score of each condition, summed along ``order``, without it from the least to the largest; videos
    lacking a condition are left out.
    """
    rows = X.base(spark, sf).groupBy("video").pivot("condition", list(metrics.CONDITIONS)).agg(S.steady_mean("s", order))
    facts = X.base(spark, sf).groupBy("video").agg(F.max("study_label").alias("label"), F.max("manipulation").alias("manipulation"), F.max("role").alias("role"), F.countDistinct("condition").alias("n"))
    joined = rows.join(facts.where("n = 5").drop("n"), "video")
    return joined.select("video", "label", "manipulation", "role", *(F.col(c).alias(c.lower()) for c in metrics.CONDITIONS))


def derived(df):
    near = F.least(*(F.abs(F.col(c) - CUTOFF) for c in ("cln", "rsz", "blr", "h40", "plt")))
    return df.withColumns({"near": near, "drop_h40": F.col("cln") - F.col("h40"), "drop_plt": F.col("cln") - F.col("plt"), "jump_blr": F.col("blr") - F.col("cln"), "jump_plt": F.col("plt") - F.col("cln"), "drop_mean": F.col("cln") - (F.col("h40") + F.col("plt")) / 2})


_DERIVED = f"WITH {X.BASE}, {_WIDE}, g AS (SELECT *, least(abs(cln - {CUTOFF}), abs(rsz - {CUTOFF}), abs(blr - {CUTOFF}), abs(h40 - {CUTOFF}), abs(plt - {CUTOFF})) AS near, cln - h40 AS drop_h40, cln - plt AS drop_plt, blr - cln AS jump_blr, plt - cln AS jump_plt, cln - (h40 + plt) / 2 AS drop_mean FROM w)"


def case_classes():
    """The eight classes: name, predicate, metric, ascending."""

    def yes(*names):
        return [F.col(n) >= CUTOFF for n in names]

    def no(*names):
        return [F.col(n) < CUTOFF for n in names]

    def every(*parts):
        out = F.lit(True)
        for p in parts:
            out = out & p
        return out

    real, fake = F.col("label") == 0, F.col("label") == 1
    return [
        ("A", every(real, *yes("cln", "rsz", "blr", "h40", "plt")), "jump_plt", False),
        ("B", every(real, *no("cln", "rsz"), *yes("blr")), "jump_blr", False),
        ("C", every(real, *no("cln", "rsz"), *yes("plt")), "jump_plt", False),
        ("D", every(fake, *yes("cln", "rsz", "blr", "plt"), *no("h40")), "drop_h40", False),
        ("E", every(fake, *yes("cln", "rsz", "blr", "h40"), *no("plt")), "drop_plt", False),
        ("F", every(fake, *yes("cln", "rsz", "blr"), *no("h40", "plt")), "drop_mean", False),
        ("G", every(real, F.col("near") <= MARGIN), "near", True),
        ("H", every(fake, F.col("near") <= MARGIN), "near", True),
    ]


_Y = {n: f"{n} >= {CUTOFF}" for n in ("cln", "rsz", "blr", "h40", "plt")}
_N = {n: f"{n} < {CUTOFF}" for n in _Y}
_CLASS_SQL = {
    "A": ("label = 0 AND " + " AND ".join(_Y.values()), "jump_plt", "DESC"),
    "B": (f"label = 0 AND {_N['cln']} AND {_N['rsz']} AND {_Y['blr']}", "jump_blr", "DESC"),
    "C": (f"label = 0 AND {_N['cln']} AND {_N['rsz']} AND {_Y['plt']}", "jump_plt", "DESC"),
    "D": (f"label = 1 AND {_Y['cln']} AND {_Y['rsz']} AND {_Y['blr']} AND {_N['h40']} AND {_Y['plt']}", "drop_h40", "DESC"),
    "E": (f"label = 1 AND {_Y['cln']} AND {_Y['rsz']} AND {_Y['blr']} AND {_Y['h40']} AND {_N['plt']}", "drop_plt", "DESC"),
    "F": (f"label = 1 AND {_Y['cln']} AND {_Y['rsz']} AND {_Y['blr']} AND {_N['h40']} AND {_N['plt']}", "drop_mean", "DESC"),
    "G": (f"label = 0 AND near <= {MARGIN}", "near", "ASC"),
    "H": (f"label = 1 AND near <= {MARGIN}", "near", "ASC"),
}


@query("prj_06", f"{_DERIVED} SELECT video, round(near, 12) AS near, round(drop_h40, 12) AS drop_h40, round(drop_plt, 12) AS drop_plt, round(jump_blr, 12) AS jump_blr, round(jump_plt, 12) AS jump_plt, round(drop_mean, 12) AS drop_mean FROM g")
def prj_06(spark, sf):
    return r9(derived(wide(spark, sf, "event_id")).select("video", "near", "drop_h40", "drop_plt", "jump_blr", "jump_plt", "drop_mean"), 12)


@query("join_06", f"WITH {X.BASE}, {_WIDE} SELECT video, label, manipulation, role, round(cln, 12) AS cln, round(rsz, 12) AS rsz, round(blr, 12) AS blr, round(h40, 12) AS h40, round(plt, 12) AS plt FROM w")
def join_06(spark, sf):
    return r9(wide(spark, sf, "event_id"), 12)


@query("flt_09", f"{_DERIVED} SELECT video, c AS case_class FROM g, unnest(list_filter([" + ", ".join(f"CASE WHEN {p} THEN '{k}' END" for k, (p, _, _) in _CLASS_SQL.items()) + "], lambda x: x IS NOT NULL)) t(c)")
def flt_09(spark, sf):
    found = F.filter(F.array(*(F.when(p, name) for name, p, _, _ in case_classes())), lambda x: x.isNotNull())
    return derived(wide(spark, sf, "event_id")).select("video", F.explode(found).alias("case_class"))


query("flt_10", X.ORACLE["flt_09"])(flt_09)

_STEPS = []
for _k, (_p, _m, _d) in _CLASS_SQL.items():
    _before = " AND ".join(f"video NOT IN (SELECT video FROM s{j})" for j in "ABCDEFGH"[: len(_STEPS)]) or "TRUE"
    _STEPS.append(f"s{_k} AS (SELECT video, '{_k}' AS case_class, row_number() OVER (ORDER BY {_m} {_d}, video {_d}) AS place FROM g WHERE ({_p}) AND {_before} QUALIFY place <= 3)")


@query("win_07", f"{_DERIVED}, {', '.join(_STEPS)} " + " UNION ALL ".join(f"SELECT * FROM s{k}" for k in _CLASS_SQL))
def win_07(spark, sf):
    return selection.greedy_cases(derived(wide(spark, sf, "event_id")), case_classes(), "video", 3).select("video", "case_class", "place")


# a class takes an identity once, whatever video it comes with: reals by source, fakes by subset and id
_OWN = "CASE WHEN label = 0 THEN 'real::' || (video // 4) ELSE 'fake::' || manipulation || '::' || video END AS identity"
_OWN_STEPS = []
for _k, (_p, _m, _d) in _CLASS_SQL.items():
    _before = " AND ".join(f"identity NOT IN (SELECT identity FROM s{j})" for j in "ABCDEFGH"[: len(_OWN_STEPS)]) or "TRUE"
    _first = f"(SELECT * FROM w2 WHERE ({_p}) AND {_before} QUALIFY row_number() OVER (PARTITION BY identity ORDER BY {_m} {_d}, video {_d}) = 1)"
    _OWN_STEPS.append(f"s{_k} AS (SELECT identity, video, '{_k}' AS case_class, row_number() OVER (ORDER BY {_m} {_d}, video {_d}) AS place FROM {_first} QUALIFY place <= 3)")


@query("sup_42", f"{_DERIVED}, w2 AS (SELECT *, {_OWN} FROM g), {', '.join(_OWN_STEPS)} " + " UNION ALL ".join(f"SELECT * FROM s{k}" for k in _CLASS_SQL))
def sup_42(spark, sf):
    rows = derived(wide(spark, sf, "event_id")).withColumn("source", F.expr("video div 4"))
    return selection.greedy_cases(rows.withColumn("case_id", selection.case_identity(subset="manipulation")), case_classes(), "case_id", 3).select("identity", "video", "case_class", "place")


@query("join_01", "SELECT o_orderkey, c_name, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey")
def join_01(spark, sf):
    return read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "c_nationkey")


@query("join_02", f"WITH {X.DECISIONS} SELECT detector, video, condition, decision FROM decisions")
def join_02(spark, sf):
    return X.decisions(spark, sf).select("detector", "video", "condition", "decision")


query("sup_04", X.ORACLE["join_02"])(join_02)


@query("join_03", "SELECT c_custkey, o_custkey IS NULL AS missing FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) ON c_custkey = o_custkey")
def join_03(spark, sf):
    o = read(spark, sf, "orders").select("o_custkey").distinct()
    return read(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.col("o_custkey").isNull().alias("missing"))


@query("join_04", f"WITH {X.PAIRS} SELECT detector, video, condition, round(video_score, 9) AS video_score, round(clean_score, 9) AS clean_score FROM pairs")
def join_04(spark, sf):
    return r9(metrics.pairs(X.decisions(spark, sf)).select("detector", "video", "condition", "video_score", "clean_score"))




@query("join_07", "SELECT d.doc_id, d.source, l.quality, l.doc_id IS NULL AS unscored FROM documents d LEFT JOIN labels l USING (doc_id)")
def join_07(spark, sf):
    scored = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id").select("doc_id", "source", "quality")
    return videos.with_unscored(scored, read(spark, sf, "documents").select("doc_id", "source"), ["doc_id"]).withColumn("unscored", F.col("quality").isNull())


@query("join_08", "WITH a AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 5 <> 0 AND (user_id + length(event_type)) % 7 <> 0), b AS (SELECT DISTINCT user_id, event_type FROM events WHERE (user_id + length(event_type)) % 8 <> 1) SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, CASE WHEN a.user_id IS NULL THEN 'right' ELSE 'left' END AS side FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type WHERE a.user_id IS NULL OR b.user_id IS NULL")
def join_08(spark, sf):
    """Videos and conditions that only one of two artifacts has; each lacks some of the events' pairs."""
    e = read(spark, sf, "events")
    code = F.col("user_id") + F.length("event_type")
    return checks.unmatched(e.where((F.col("event_id") % 5 != 0) & (code % 7 != 0)), e.where(code % 8 != 1), ["user_id", "event_type"])


@query("join_09", "SELECT c_custkey, list_sort(list(o_orderkey)) AS orders FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL")
def join_09(spark, sf):
    lists = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("orders"))
    return read(spark, sf, "customer").select("c_custkey").join(lists, "c_custkey")


@query("join_10", "SELECT count(*) AS n, count(*) FILTER (p_partkey IS NULL) AS missed FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def join_10(spark, sf):
    return read(spark, sf, "lineitem").join(read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"), "left").agg(F.count("*").alias("n"), F.count_if(F.col("p_partkey").isNull()).alias("missed"))


@query("join_11", f"WITH {X.CUT}, v AS (SELECT detector, count(*) AS n FROM videos GROUP BY ALL) SELECT detector, round(threshold_value, 9) AS threshold_value, n FROM cut JOIN v USING (detector)")
def join_11(spark, sf):
    scores = X.video_scores(spark, sf)
    return r9(X.frozen(scores).select("detector", "threshold_value").join(scores.groupBy("detector").agg(F.count("*").alias("n")), "detector"))


@query("join_12", "SELECT c_custkey, CAST(sum(w * o_totalprice) AS DECIMAL(30, 2)) AS total FROM (SELECT o_custkey AS c_custkey, o_totalprice, (o_orderkey % 3) AS w FROM orders) WHERE w > 0 GROUP BY ALL")
def join_12(spark, sf):
    drawn = read(spark, sf, "orders").select("o_orderkey", F.explode(F.expr("sequence(1, cast(o_orderkey % 3 as int))")).alias("i")).where("i <= o_orderkey % 3 and o_orderkey % 3 > 0")
    return drawn.join(read(spark, sf, "orders"), "o_orderkey").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").cast("decimal(30,2)").alias("total"))


@query("join_13", "SELECT c_custkey FROM customer ANTI JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON c_custkey = o_custkey")
def join_13(spark, sf):
    """Customers without an order in progress."""
    pending = read(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf, "customer").join(pending, "c_custkey", "left_anti").select("c_custkey")


@query("join_14", "WITH s AS (SELECT l_returnflag AS k, l_discount AS t, count(*) AS n FROM lineitem GROUP BY ALL) SELECT a.k, a.t, CAST(sum(b.n) AS BIGINT) AS at_least FROM s a JOIN s b ON a.k = b.k AND b.t >= a.t GROUP BY ALL")
def join_14(spark, sf):
    """Counts of score >= t for every t: a running sum from above, not a join."""
    hist = read(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("k"), F.col("l_discount").alias("t")).agg(F.count("*").alias("n"))
    down = Window.partitionBy("k").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    return hist.select("k", "t", F.sum("n").over(down).alias("at_least"))


@query("join_15", f"WITH {X.PLAN} SELECT p.video, i.pos AS pos, count(DISTINCT b.condition) AS n FROM (SELECT video, unnest(range(0, n)) AS pos FROM plan) i JOIN plan p USING (video) JOIN base b ON b.video = p.video AND b.temporal_position = i.pos GROUP BY ALL")
def join_15(spark, sf):
    planned = X.plan(spark, sf).select("video", F.posexplode("positions").alias("pos", "position"))
    rows = X.base(spark, sf).select("video", "condition", F.col("temporal_position").alias("position"))
    return planned.join(rows, ["video", "position"]).groupBy("video", F.col("pos").cast("long").alias("pos")).agg(F.countDistinct("condition").alias("n"))


@query("join_16", "SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'evaluation' ELSE 'calibration' END AS part FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0) ON o_custkey = c_custkey")
def join_16(spark, sf):
    chosen = read(spark, sf, "customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("o_custkey"))
    o = read(spark, sf, "orders")
    a = o.join(chosen, "o_custkey", "left_semi").select("o_orderkey", F.lit("calibration").alias("part"))
    return a.unionByName(o.join(chosen, "o_custkey", "left_anti").select("o_orderkey", F.lit("evaluation").alias("part")))


_SEVEN = [f"d{k}" for k in range(2, 9)]
_SEVEN_SQL = ", ".join(f"{{0}} % {k} = 0 AS d{k}" for k in range(2, 9))


@query("join_17", f"""WITH s AS (SELECT CAST(s_suppkey AS BIGINT) AS seq, s_suppkey % 64 AS id, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey END AS run, {_SEVEN_SQL.format("s_nationkey")} FROM supplier),
    c AS (SELECT c_custkey, c_nationkey AS run, {_SEVEN_SQL.format("c_nationkey")} FROM customer),
    m AS (SELECT c_custkey, seq, 1 AS rank FROM c JOIN s ON c_custkey = id UNION ALL SELECT c_custkey, seq, 2 FROM c JOIN s USING (run) UNION ALL SELECT c_custkey, seq, 3 FROM c JOIN s USING ({", ".join(_SEVEN)})),
    r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY rank, seq DESC) AS n FROM m)
    SELECT c_custkey, seq AS chosen, rank FROM c LEFT JOIN (SELECT * FROM r WHERE n = 1) USING (c_custkey)""")
def join_17(spark, sf):
    """The registry's last row with the same id, else the last of the same run, else the last that agrees in seven columns.

    The registry is reduced to one row a key for each of the three, so no join multiplies rows.
    """
    seven = lambda key: [(F.col(key) % k == 0).alias(f"d{k}") for k in range(2, 9)]
    run = F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey")).alias("run")
    registry = read(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("seq"), (F.col("s_suppkey") % 64).alias("id"), run, *seven("s_nationkey"))
    found = read(spark, sf, "customer").select("c_custkey", F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("run"), *seven("c_nationkey"))
    for name, keys in (("exact", ["id"]), ("same_run", ["run"]), ("alike", _SEVEN)):
        found = found.join(registry.dropna(subset=keys).groupBy(*keys).agg(F.max("seq").alias(name)), keys, "left")
    rank = F.when(F.col("exact").isNotNull(), 1).when(F.col("same_run").isNotNull(), 2).when(F.col("alike").isNotNull(), 3)
    return found.select("c_custkey", F.coalesce("exact", "same_run", "alike").alias("chosen"), rank.alias("rank"))


@query("join_18", "SELECT CAST(l_suppkey AS BIGINT) AS id, count(DISTINCT l_returnflag) AS n_splits FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_returnflag) > 1")
def join_18(spark, sf):
    return checks.leaking(read(spark, sf, "lineitem"), ["l_suppkey"], "l_returnflag")


@query("join_19", "SELECT n_name, r_name, d FROM nation, region, (VALUES ('raw'), ('draw'), ('mean')) t(d)")
def join_19(spark, sf):
    d = spark.createDataFrame([(x,) for x in X.DETECTORS], "d string")
    return read(spark, sf, "nation").select("n_name").crossJoin(read(spark, sf, "region").select("r_name")).crossJoin(d)


@query("join_20", "SELECT n_nationkey, unnest(['r1', 'r2', 'M1a', 'M1b', 'M2a', 'M2b', 'M3a', 'M3b', 'M4a', 'M4b']) AS video FROM nation")
def join_20(spark, sf):
    kinds = F.array(*map(F.lit, ["r1", "r2", *(f"{m}{d}" for m in metrics.METHODS for d in "ab")]))
    return read(spark, sf, "nation").select("n_nationkey", F.explode(kinds).alias("video"))


# set operations
@query("set_01", "SELECT s_nationkey AS k FROM supplier UNION ALL SELECT c_nationkey FROM customer")
def set_01(spark, sf):
    return read(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")).unionByName(read(spark, sf, "customer").select(F.col("c_nationkey").alias("k")))


@query("set_03", "SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer")
def set_03(spark, sf):
    return read(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")).intersect(read(spark, sf, "customer").select(F.col("c_nationkey").alias("k")))


@query("set_08", "SELECT count(*) = 0 AS equal FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders)")
def set_08(spark, sf):
    left = read(spark, sf, "lineitem").select("l_orderkey").distinct().join(read(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")
    return left.agg((F.count("*") == 0).alias("equal"))


@query("set_07", "SELECT DISTINCT l_discount AS score FROM lineitem")
def set_07(spark, sf):
    return read(spark, sf, "lineitem").select(F.col("l_discount").alias("score")).distinct()


# windows
@query("win_01", "SELECT l_returnflag, l_discount, (min(r) + max(r)) / 2 AS mid_rank FROM (SELECT l_returnflag, l_discount, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_discount) AS r FROM lineitem) GROUP BY ALL")
def win_01(spark, sf):
    hist = read(spark, sf, "lineitem").groupBy("l_returnflag", "l_discount").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("l_returnflag").orderBy("l_discount").rowsBetween(Window.unboundedPreceding, 0))
    return hist.select("l_returnflag", "l_discount", (upto - (F.col("n") - 1) / F.lit(2.0)).alias("mid_rank"))


@query("win_02", "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity DESC, l_extendedprice DESC, l_partkey, l_suppkey) = 1")
def win_02(spark, sf):
    rows = selection.first_by(read(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], [F.desc("l_quantity"), F.desc("l_extendedprice"), F.col("l_partkey"), F.col("l_suppkey")])
    return rows.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


@query("win_03", "SELECT user_id, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id")
def win_03(spark, sf):
    return selection.latest(read(spark, sf, "events").select("user_id", "event_id", F.col("event_type").alias("status")), ["user_id"], "event_id").select("user_id", "status")


@query("win_04", "SELECT user_id, event_id, coalesce(value > max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS improved FROM events")
def win_04(spark, sf):
    return selection.running_best(read(spark, sf, "events"), ["user_id"], "event_id", "value").select("user_id", "event_id", "improved")


@query("win_05", f"WITH {X.BASE} SELECT event_id, temporal_position FROM base")
def win_05(spark, sf):
    return X.base(spark, sf).select("event_id", "temporal_position")


@query("win_06", "SELECT DISTINCT r_name, n_name, (dense_rank() OVER (PARTITION BY r_name ORDER BY n_name) - 1) % 4 AS view FROM nation JOIN region ON n_regionkey = r_regionkey")
def win_06(spark, sf):
    rows = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return selection.round_robin(rows, "r_name", "n_name").select("r_name", "n_name", F.col("view").cast("long").alias("view")).distinct()


@query("win_08", "SELECT c_nationkey, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) <= 3")
def win_08(spark, sf):
    return selection.top_k(read(spark, sf, "customer"), ["c_nationkey"], [F.col("c_custkey")], 3).select("c_nationkey", "c_custkey")


@query("win_09", "SELECT n_name, lpad(CAST(row_number() OVER (ORDER BY n_name) AS VARCHAR), 3, '0') AS case_id FROM nation")
def win_09(spark, sf):
    return read(spark, sf, "nation").select("n_name", F.lpad(F.row_number().over(Window.orderBy("n_name")).cast("string"), 3, "0").alias("case_id"))


@query("win_10", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE i % greatest(n // 4, 1) = 0 AND i // greatest(n // 4, 1) < 4")
def win_10(spark, sf):
    return selection.strided(read(spark, sf, "events"), ["user_id"], "event_id", 4).select("user_id", "event_id")


@query("win_11", "WITH f AS (SELECT user_id, list(event_id ORDER BY event_id) AS frames FROM events GROUP BY user_id) SELECT user_id, i AS clip, frames[i * 8 + 1:i * 8 + 8] AS frames FROM (SELECT *, unnest(range(0, len(frames) // 8)) AS i FROM f)")
def win_11(spark, sf):
    lists = read(spark, sf, "events").groupBy("user_id").agg(F.sort_array(F.collect_list("event_id")).alias("frames")).where(F.size("frames") >= 8)
    clips = lists.select("user_id", "frames", F.explode(F.expr("sequence(0, size(frames) div 8 - 1)")).alias("clip"))
    return clips.select("user_id", F.col("clip").cast("long").alias("clip"), F.slice("frames", F.col("clip").cast("int") * 8 + 1, 8).alias("frames"))


@query("win_12", "SELECT p_brand, count(*) FILTER (r <= 3) AS top3 FROM (SELECT p_brand, rank() OVER (PARTITION BY p_type ORDER BY m DESC) AS r FROM (SELECT p_brand, p_type, round(avg(p_retailprice), 6) AS m FROM part GROUP BY ALL)) GROUP BY ALL")
def win_12(spark, sf):
    means = read(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.round(F.avg("p_retailprice"), 6).alias("m"))
    ranked = means.withColumn("r", F.rank().over(Window.partitionBy("p_type").orderBy(F.desc("m"))))
    return ranked.groupBy("p_brand").agg(F.count_if(F.col("r") <= 3).alias("top3"))


# sorts with their places, so that order is part of the result
@query("srt_01", f"WITH {X.BASE} SELECT video, condition, row_number() OVER (ORDER BY video, CASE condition WHEN 'CLN' THEN 0 WHEN 'RSZ' THEN 1 WHEN 'BLR' THEN 2 WHEN 'H40' THEN 3 ELSE 4 END) AS place FROM (SELECT DISTINCT video, condition FROM base)")
def srt_01(spark, sf):
    rows = X.base(spark, sf).select("video", "condition").distinct()
    return X.numbered(rows, [F.col("video"), metrics.order_of("condition", metrics.CONDITIONS)])


for _n in ("srt_01_whole", "srt_02_whole"):
    query(_n, X.ORACLE["srt_01"])(srt_01)


@query("srt_03", f"WITH {X.BASE} SELECT video, row_number() OVER (ORDER BY coalesce(manipulation, ''), video) AS place FROM (SELECT DISTINCT video, nullif(manipulation, '') AS manipulation FROM base)")
def srt_03(spark, sf):
    rows = X.base(spark, sf).select("video", F.nullif("manipulation", F.lit("")).alias("manipulation")).distinct()
    return X.numbered(rows, [F.coalesce("manipulation", F.lit("")), F.col("video")]).select("video", "place")


@query("srt_04", "SELECT c_name, row_number() OVER (ORDER BY CAST(regexp_extract(c_name, '([0-9]+)', 1) AS INTEGER)) AS place FROM customer")
def srt_04(spark, sf):
    return X.numbered(read(spark, sf, "customer").select("c_name"), [F.regexp_extract("c_name", "([0-9]+)", 1).cast("int")])


@query("srt_05", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 10")
def srt_05(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), F.desc("o_orderkey")).limit(10)


@query("srt_06", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25")
def srt_06(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey").orderBy("o_orderkey").limit(25)


@query("srt_07", "SELECT c_nationkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 3")
def srt_07(spark, sf):
    return selection.top_k(read(spark, sf, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 3).select("c_nationkey", "c_acctbal")


@query("srt_08", "SELECT c_nationkey, arg_min(c_custkey, row(c_acctbal, c_custkey)) AS poorest, arg_max(c_custkey, row(c_acctbal, c_custkey)) AS richest FROM customer GROUP BY ALL")
def srt_08(spark, sf):
    by = F.struct("c_acctbal", "c_custkey")
    return read(spark, sf, "customer").groupBy("c_nationkey").agg(F.min_by("c_custkey", by).alias("poorest"), F.max_by("c_custkey", by).alias("richest"))




@query("srt_09", "SELECT p_brand, p_partkey, p_size FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) = 1")
def srt_09(spark, sf):
    """The largest of each set, the first of those that tie."""
    return selection.largest(read(spark, sf, "part").select("p_brand", "p_partkey", "p_size"), ["p_brand"], "p_size", "p_partkey")


@query("srt_10", "SELECT doc_id, row_number() OVER (ORDER BY lang, source, -n_chars, doc_id) AS place FROM documents")
def srt_10(spark, sf):
    """Places over the whole table: ranks inside a lang and source, plus the rows of all groups before."""
    d = read(spark, sf, "documents").withColumn("r", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("n_chars"), "doc_id")))
    sizes = d.groupBy("lang", "source").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("lang", "source").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return d.join(before.drop("n"), ["lang", "source"]).select("doc_id", (F.col("r") + F.col("before")).alias("place"))


# projections and filters
@query("prj_01", "SELECT user_id || '::' || event_type AS video_uid, event_id AS source_id, CAST(value AS FLOAT) IS NOT NULL AS has_score FROM events")
def prj_01(spark, sf):
    return read(spark, sf, "events").select(F.concat_ws("::", F.col("user_id").cast("string"), "event_type").alias("video_uid"), F.col("event_id").alias("source_id"), F.col("value").isNotNull().alias("has_score"))


@query("prj_02", "SELECT DISTINCT user_id, event_type FROM events")
def prj_02(spark, sf):
    return read(spark, sf, "events").select("user_id", "event_type").distinct()


@query("prj_03", f"WITH {X.CUT} SELECT detector, 'clean_real_validation' AS population, 0.05::DOUBLE AS target_fpr, n_real FROM cut")
def prj_03(spark, sf):
    return X.frozen(X.video_scores(spark, sf)).select("detector", F.lit("clean_real_validation").alias("population"), F.lit(0.05).alias("target_fpr"), "n_real")


@query("prj_04", "SELECT event_id, 'pooled' AS run_id, event_type AS original_run_id FROM events")
def prj_04(spark, sf):
    return read(spark, sf, "events").withColumnRenamed("event_type", "original_run_id").withColumn("run_id", F.lit("pooled")).select("event_id", "run_id", "original_run_id")


@query("prj_05", "SELECT n_nationkey AS diagnostic_n_nationkey, n_name AS diagnostic_n_name FROM nation")
def prj_05(spark, sf):
    return read(spark, sf, "nation").select(*(F.col(c).alias(f"diagnostic_{c}") for c in ("n_nationkey", "n_name")))


@query("prj_07", "SELECT page_id, replace(url, 'example', 'sample') AS url FROM pages")
def prj_07(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.replace("url", F.lit("example"), F.lit("sample")).alias("url"))


@query("flt_01", f"WITH {X.CUT} SELECT detector, video, round(video_score, 9) AS video_score FROM calib")
def flt_01(spark, sf):
    return r9(X.calibration(X.video_scores(spark, sf)).select("detector", "video", "video_score"))


@query("flt_02", f"WITH {X.VIDEOS} SELECT detector, video, condition FROM videos WHERE dataset = 'first' AND role = 'validation' AND study_label = 0 AND condition <> 'CLN' AND video_score IS NOT NULL")
def flt_02(spark, sf):
    return X.video_scores(spark, sf).where("dataset = 'first' and role = 'validation' and study_label = 0 and condition <> 'CLN' and video_score is not null").select("detector", "video", "condition")


@query("flt_03", f"WITH {X.DECISIONS} SELECT detector, video, condition FROM decisions WHERE video_score IS NOT NULL AND decision IN (0, 1)")
def flt_03(spark, sf):
    return X.decisions(spark, sf).where("video_score is not null and decision_status = 'decided' and decision in (0, 1)").select("detector", "video", "condition")




@query("flt_04", "WITH e AS (SELECT event_id, CASE WHEN event_id % 7 = 3 THEN '' WHEN event_id % 11 = 5 THEN ' null ' ELSE ' ' || value || ' ' END AS score, CASE WHEN event_id % 13 = 4 THEN ' No ' WHEN event_id % 17 = 6 THEN NULL WHEN event_id % 2 = 0 THEN 'yes' ELSE 'TRUE' END AS score_available FROM events) SELECT event_id, round(CAST(trim(score) AS DOUBLE), 6) AS score FROM e WHERE lower(trim(score_available)) IN ('1', 'true', 'yes', 'y') AND lower(trim(score)) NOT IN ('', 'null')")
def flt_04(spark, sf):
    """The scored subset of records in text form."""
    value = F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" "))
    score = F.when(F.expr("event_id % 7 = 3"), "").when(F.expr("event_id % 11 = 5"), " null ").otherwise(value)
    there = F.when(F.expr("event_id % 13 = 4"), " No ").when(F.expr("event_id % 17 = 6"), None).when(F.expr("event_id % 2 = 0"), "yes").otherwise("TRUE")
    rows = read(spark, sf, "events").select("event_id", score.alias("score"), there.alias("score_available"))
    return r9(selection.scored(rows).select("event_id", "score"), 6)


@query("flt_05", f"WITH {X.BASE} SELECT DISTINCT video FROM base WHERE dataset = 'first' AND role IN ('validation', 'test')")
def flt_05(spark, sf):
    return X.base(spark, sf).where((F.col("dataset") == "first") & F.col("role").isin("validation", "test")).select("video").distinct()


@query("flt_06", "SELECT doc_id FROM documents WHERE lang = 'de'")
def flt_06(spark, sf):
    """Filters that are null don't filter."""
    rows = read(spark, sf, "documents")
    for column, value in (("lang", "de"), ("source", None)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows.select("doc_id")


@query("flt_07", f"WITH {X.BASE} SELECT event_id FROM base WHERE inference_status = 'ok'")
def flt_07(spark, sf):
    return X.base(spark, sf).where("inference_status = 'ok'").select("event_id")


@query("flt_08", f"WITH {X.DECISIONS} SELECT detector, video, condition FROM decisions WHERE NOT (dataset = 'first' AND role = 'validation')")
def flt_08(spark, sf):
    return X.decisions(spark, sf).where("not (dataset = 'first' and role = 'validation')").select("detector", "video", "condition")


# further aggregations
@query("agg_17", f"WITH {X.DECISIONS} SELECT detector, count(DISTINCT threshold_value) AS n_thresholds, bool_and(decision = CAST(video_score >= threshold_value AS INTEGER)) AS agrees FROM decisions GROUP BY ALL")
def agg_17(spark, sf):
    d = X.decisions(spark, sf)
    return d.groupBy("detector").agg(F.countDistinct("threshold_value").alias("n_thresholds"), F.bool_and(F.col("decision") == (F.col("video_score") >= F.col("threshold_value")).cast("int")).alias("agrees"))




@query("qc_11", f"WITH {X.DECISIONS}, s AS (SELECT detector, video, condition, CASE WHEN video % 23 = 7 THEN 1 - decision WHEN video % 29 = 3 THEN NULL ELSE decision END AS stated, CASE WHEN video_score IS NOT NULL AND threshold_value IS NOT NULL THEN decision END AS computed FROM decisions) SELECT detector, video, condition, stated, computed FROM s WHERE stated IS DISTINCT FROM computed")
def qc_11(spark, sf):
    """Decisions that the scores and thresholds don't give when computed again."""
    stated = F.when(F.expr("video % 23 = 7"), 1 - F.col("decision")).when(F.expr("video % 29 = 3"), None).otherwise(F.col("decision"))
    return checks.wrong_decisions(X.decisions(spark, sf).withColumn("decision", stated), ["detector", "video", "condition"])


@query("agg_28", "SELECT c_nationkey, round(sum(c_acctbal * c_custkey) / sum(c_custkey), 6) AS mean FROM customer GROUP BY ALL")
def agg_28(spark, sf):
    return read(spark, sf, "customer").groupBy("c_nationkey").agg(F.round(F.sum(F.col("c_acctbal") * F.col("c_custkey")) / F.sum("c_custkey"), 6).alias("mean"))


@query("agg_30", "SELECT lang, source, count(*) AS n, CAST(grouping(lang) * 2 + grouping(source) AS INTEGER) AS grain FROM documents GROUP BY GROUPING SETS ((lang, source), (lang), ())")
def agg_30(spark, sf):
    return read(spark, sf, "documents").groupingSets([["lang", "source"], ["lang"], []], "lang", "source").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("grain"))


@query("agg_31", "SELECT r_name, n_name, c_mktsegment, CAST(sum(CAST(trunc(c_acctbal * CAST(1.25 AS DOUBLE)) AS BIGINT)) AS BIGINT) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name, c_mktsegment)")
def agg_31(spark, sf):
    rows = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.withColumn("part", (F.col("c_acctbal") * F.lit(1.25)).cast("long")).rollup("r_name", "n_name", "c_mktsegment").agg(F.sum("part").alias("total"))


@query("agg_32", "SELECT lang, count(DISTINCT source) AS sources, count(DISTINCT text) AS texts FROM documents GROUP BY ALL")
def agg_32(spark, sf):
    return read(spark, sf, "documents").groupBy("lang").agg(F.countDistinct("source").alias("sources"), F.countDistinct("text").alias("texts"))


@query("agg_33", "SELECT n, count(*) AS customers FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL) GROUP BY n")
def agg_33(spark, sf):
    o = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return read(spark, sf, "customer").join(o, "c_custkey", "left").select(F.coalesce("n", F.lit(0)).cast("long").alias("n")).groupBy("n").agg(F.count("*").alias("customers"))


@query("agg_34", "SELECT event_type, count(*) AS n, min(value) FILTER (event_id % 97 <> 0) AS least, max(value) FILTER (event_id % 97 <> 0) AS most FROM events GROUP BY ALL")
def agg_34(spark, sf):
    ok = F.when(F.col("event_id") % 97 != 0, F.col("value"))
    return read(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min(ok).alias("least"), F.max(ok).alias("most"))


@query("agg_35", "SELECT conv_id, list(role ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def agg_35(spark, sf):
    lists = read(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("l"))
    return lists.select("conv_id", F.col("l.role").alias("roles"))


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query("agg_36", f"WITH t AS (SELECT c_nationkey, c_mktsegment, avg(c_acctbal) AS m FROM (SELECT * FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal DESC, c_custkey) <= 3) GROUP BY ALL) SELECT c_nationkey, {', '.join(f"round(max(m) FILTER (c_mktsegment = '{x}'), 6) AS {x.lower()}" for x in _SEGMENTS)}, round(avg(m), 6) AS mean FROM t GROUP BY ALL")
def agg_36(spark, sf):
    """The mean of each segment's three richest as columns, and the mean over the columns that are there."""
    best = selection.top_k(read(spark, sf, "customer"), ["c_nationkey", "c_mktsegment"], [F.desc("c_acctbal"), F.col("c_custkey")], 3)
    table = best.groupBy("c_nationkey").pivot("c_mktsegment", list(_SEGMENTS)).agg(F.avg("c_acctbal"))
    return r9(metrics.with_row_mean(table.select("c_nationkey", *(F.col(x).alias(x.lower()) for x in _SEGMENTS)), [x.lower() for x in _SEGMENTS]), 6)


@query("agg_36_whole", "WITH t AS (SELECT p_brand, p_size, avg(p_retailprice) AS m FROM (SELECT * FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_retailprice DESC, p_partkey) <= 3) GROUP BY ALL) SELECT p_brand, p_size, round(m, 6) AS m, round(avg(m) OVER (PARTITION BY p_brand), 6) AS mean FROM t")
def agg_36_whole(spark, sf):
    """The mean of each size's three dearest, a row each, with the brand's mean over the sizes that it has."""
    best = selection.top_k(read(spark, sf, "part"), ["p_brand", "p_size"], [F.desc("p_retailprice"), F.col("p_partkey")], 3).groupBy("p_brand", "p_size").agg(F.avg("p_retailprice").alias("m"))
    return r9(best.join(best.groupBy("p_brand").agg(F.avg("m").alias("mean")), "p_brand"), 6)


@query("agg_37", f"WITH {X.BASE}, m AS (SELECT condition, avg(s) AS s FROM base GROUP BY ALL) SELECT m.condition, round(m.s - b.s, 6) AS delta FROM m JOIN m b ON b.condition = 'CLN'")
def agg_37(spark, sf):
    m = X.base(spark, sf).groupBy("condition").agg(F.avg("s").alias("s"))
    clean = m.where("condition = 'CLN'").select(F.col("s").alias("c"))
    return m.join(F.broadcast(clean), F.lit(True)).select("condition", F.round(F.col("s") - F.col("c"), 6).alias("delta"))


@query("agg_38", "SELECT CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) AS k, round(avg(p_retailprice), 6) AS mean FROM part GROUP BY ALL")
def agg_38(spark, sf):
    return read(spark, sf, "part").groupBy(F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int").alias("k")).agg(F.round(F.avg("p_retailprice"), 6).alias("mean"))


@query("agg_41", "SELECT l_returnflag AS detector, count(*) FILTER ((l_discount * 10 >= 0.5) = (l_linenumber > 3)) AS right_, count(*) AS n FROM lineitem GROUP BY ALL")
def agg_41(spark, sf):
    return tied(spark, sf).groupBy("detector").agg(F.count_if((F.col("score") >= 0.5).cast("int") == F.col("label")).alias("right_"), F.count("*").alias("n"))


@query("sup_03", f"WITH {X.CUT} SELECT detector, rule FROM cut, (VALUES ('primary_target_fpr'), ('eer_like'), ('best_f1')) t(rule)")
def sup_03(spark, sf):
    """One registry row a rule, the three rules' results unioned."""
    scores = X.video_scores(spark, sf).where("video_score is not null and role = 'validation' and condition = 'CLN'")
    rows = scores.select("detector", F.col("video_score").alias("score"), F.col("study_label").alias("label"))
    rules = {"primary_target_fpr": thresholds.low_fpr(rows.where("label = 0"), ["detector"]), "eer_like": thresholds.eer_like(rows, ["detector"]), "best_f1": thresholds.best_f1(rows, ["detector"])}
    out = None
    for rule, df in rules.items():
        part = df.where("threshold_value is not null").select("detector", F.lit(rule).alias("rule"))
        out = part if out is None else out.unionByName(part)
    return out


@query("sup_05", f"WITH {X.DECISIONS} SELECT detector, condition, count(*) FILTER (video_score >= threshold_value) AS fp, count(*) AS n_real, round(count(*) FILTER (video_score >= threshold_value) / count(*), 9) AS fpr FROM decisions WHERE study_label = 0 AND video_score IS NOT NULL GROUP BY ALL")
def sup_05(spark, sf):
    """False positives and their rate among the real videos that have a score, at the frozen threshold."""
    real = X.decisions(spark, sf).where("study_label = 0 and video_score is not null")
    return r9(thresholds.false_positives(real, ["detector", "condition"], "video_score", "threshold_value"))


@query("sup_24", "SELECT list_value(lang, source) AS key, count(*) AS n FROM documents GROUP BY lang, source")
def sup_24(spark, sf):
    return read(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n")).select(F.array("lang", "source").alias("key"), "n")


@query("sup_27", f"WITH {X.PLAN} SELECT p.video, p.pos AS pos, b.event_id IS NULL AS failed FROM (SELECT video, unnest(range(0, n + 2)) AS pos FROM plan) p LEFT JOIN (SELECT * FROM base WHERE condition = 'CLN') b ON b.video = p.video AND b.temporal_position = p.pos")
def sup_27(spark, sf):
    planned = X.plan(spark, sf).select("video", F.explode(F.sequence(F.lit(0), F.size("positions") + 1)).alias("pos"))
    rows = X.base(spark, sf).where("condition = 'CLN'").select("video", F.col("temporal_position").alias("pos"), "event_id")
    return planned.join(rows, ["video", "pos"], "left").select("video", F.col("pos").cast("long").alias("pos"), F.col("event_id").isNull().alias("failed"))


_IDENTITY = ("dataset", "role", "subgroup", "study_label", "source_label", "base_video_id", "relative_source_path")
_FACTS = """video, condition, dataset, role, CASE WHEN event_id % 101 = 3 THEN 'other' ELSE manipulation END AS subgroup, study_label, CASE WHEN event_id % 103 = 5 THEN NULL WHEN study_label = 0 THEN 'real' ELSE 'fake' END AS source_label,
  CASE WHEN event_id % 107 = 6 THEN -1 ELSE video % 12 END AS base_video_id, CASE WHEN event_id % 109 = 7 THEN 'odd' ELSE 'clip' END AS relative_source_path, CASE WHEN event_id % 113 = 8 THEN 0 ELSE temporal_position END AS position"""


@query("sup_33", f"WITH {X.BASE}, f AS (SELECT {_FACTS} FROM base), g AS (SELECT video, condition, {', '.join(f"count(DISTINCT coalesce(CAST({x} AS VARCHAR), '')) AS {x}" for x in _IDENTITY)}, count(*) - count(DISTINCT position) AS again FROM f GROUP BY ALL) {' UNION ALL '.join(f"SELECT video, condition, '{x}' AS rule FROM g WHERE {x} > 1" for x in _IDENTITY)} UNION ALL SELECT video, condition, 'position' FROM g WHERE again > 0")
def sup_33(spark, sf):
    """Videos whose frames disagree on one of seven fields, or share a position."""
    return checks.identities(X.base(spark, sf).selectExpr(*X.split_columns(_FACTS)), ["video", "condition"], list(_IDENTITY), "position")


@query("sup_44", "SELECT l_returnflag, l_linestatus, count(*) AS videos, CAST(sum(l_linenumber) AS BIGINT) AS frames FROM lineitem GROUP BY ALL")
def sup_44(spark, sf):
    return read(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("videos"), F.sum("l_linenumber").cast("long").alias("frames"))


