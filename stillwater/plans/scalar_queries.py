"""Scalar functions, sources and sinks, sampling and checks on the fixture views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stillwater.functions import scalars as S
from stillwater.operators import checks, resampling, selection
from stillwater.plans import fixtures as X
from stillwater.plans.fixtures import query, r9, read, scratch
from stillwater.sources import committed, readers, writers


# text
@query("str_01", "SELECT event_id, user_id || '::' || event_type AS k FROM events")
def str_01(spark, sf):
    return read(spark, sf, "events").select("event_id", F.concat_ws("::", F.col("user_id").cast("string"), "event_type").alias("k"))


@query("str_02", "SELECT lang || '|' || source AS k, count(*) AS n FROM documents GROUP BY ALL")
def str_02(spark, sf):
    return read(spark, sf, "documents").groupBy(F.concat_ws("|", "lang", "source").alias("k")).agg(F.count("*").alias("n"))


@query("str_03", "SELECT DISTINCT least(a, b) || '_' || greatest(a, b) AS k FROM (SELECT CAST(l_suppkey AS VARCHAR) AS a, CAST(l_linenumber AS VARCHAR) AS b FROM lineitem)")
def str_03(spark, sf):
    return read(spark, sf, "lineitem").select(S.pair_key(F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string")).alias("k")).distinct()


_U = r"regexp_replace(url, '[?#].*$', '')"


@query("str_04", rf"SELECT page_id, regexp_extract({_U}, '([^/]+?)(\.[^./]*)?$', 1) AS stem, regexp_extract({_U}, '^(.*)/[^/]+$', 1) AS parent, split_part({_U}, '/', 1) AS first FROM pages")
def str_04(spark, sf):
    u = F.regexp_replace("url", "[?#].*$", "")
    return read(spark, sf, "pages").select("page_id", S.stem(u).alias("stem"), S.parent_path(u).alias("parent"), S.first_part(u).alias("first"))


@query("str_05", r"SELECT page_id, regexp_replace(replace('.\' || replace(url, '/', '\'), '\', '/'), '^\./', '') AS path FROM pages")
def str_05(spark, sf):
    back = F.concat(F.lit(".\\"), F.replace("url", F.lit("/"), F.lit("\\")))
    return read(spark, sf, "pages").select("page_id", S.forward_slashes(back).alias("path"))


@query("str_06", r"SELECT page_id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g'), '^_+|_+$', '', 'g') AS name FROM pages")
def str_06(spark, sf):
    return read(spark, sf, "pages").select("page_id", S.safe_name("url").alias("name"))


@query("str_07", "SELECT o_orderkey, CASE WHEN starts_with(o_orderpriority, '1') THEN 'first' WHEN starts_with(o_orderpriority, '2') THEN 'second' ELSE o_orderpriority END AS name FROM orders")
def str_07(spark, sf):
    p = F.col("o_orderpriority")
    return read(spark, sf, "orders").select("o_orderkey", F.when(p.startswith("1"), "first").when(p.startswith("2"), "second").otherwise(p).alias("name"))


@query("str_08", "SELECT n_nationkey, 'fpr05_' || n_name || '_' || substr(sha256(n_name), 1, 12) AS id FROM nation")
def str_08(spark, sf):
    return read(spark, sf, "nation").select("n_nationkey", F.format_string("fpr05_%s_%s", "n_name", F.substring(F.sha2("n_name", 256), 1, 12)).alias("id"))


@query("str_09", "SELECT n_nationkey, [n_name, 'x'] AS parts FROM nation")
def str_09(spark, sf):
    return read(spark, sf, "nation").select("n_nationkey", S.clean_list(F.concat(F.lit(" "), F.col("n_name"), F.lit(" ;; x ;"))).alias("parts"))


@query("str_11", "SELECT event_id, printf('%06d.png', event_id) AS name FROM events")
def str_11(spark, sf):
    return read(spark, sf, "events").select("event_id", F.format_string("%06d.png", "event_id").alias("name"))


@query("str_12", "SELECT conv_id, string_agg(role, ' || ' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def str_12(spark, sf):
    l = read(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("l"))
    return l.select("conv_id", F.array_join("l.role", " || ").alias("roles"))


@query("str_13", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 WHEN 'P' THEN 2 END AS code FROM orders")
def str_13(spark, sf):
    codes = F.create_map(*(F.lit(x) for x in ("F", 1, "O", 0, "P", 2)))
    return read(spark, sf, "orders").select("o_orderkey", codes[F.col("o_orderstatus")].alias("code"))


@query("str_14", "SELECT doc_id, right(text, 40) AS tail FROM documents")
def str_14(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.right("text", F.lit(40)).alias("tail"))


# numbers
@query("mth_01", "SELECT p_partkey, list_transform(range(0, 32), lambda p: CAST((2 * p + 1) * p_size // 64 AS INTEGER)) AS positions FROM part")
def mth_01(spark, sf):
    return read(spark, sf, "part").select("p_partkey", S.midpoints("p_size", 32).alias("positions"))


@query("mth_02", "SELECT p_partkey, list_transform(range(0, 8), lambda p: CAST(trunc(p * (p_size - 1) / 7) AS INTEGER)) AS positions FROM part")
def mth_02(spark, sf):
    return read(spark, sf, "part").select("p_partkey", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda p: (p * (F.col("p_size") - 1) / 7).cast("int")).alias("positions"))


@query("mth_03", "SELECT p_partkey, CAST(greatest(1, floor(p_size * CAST(0.75 AS DOUBLE) + 0.5)) AS INTEGER) AS w FROM part")
def mth_03(spark, sf):
    return read(spark, sf, "part").select("p_partkey", S.half_up(F.col("p_size") * 0.75).alias("w"))


@query("mth_04", "SELECT p_partkey, p_size * 1001 = 30000 * 2 AS same FROM part")
def mth_04(spark, sf):
    """a / b = c / d by cross-multiplication of integers."""
    return read(spark, sf, "part").select("p_partkey", (F.col("p_size") * 1001 == F.lit(30000) * 2).alias("same"))


@query("mth_05", "SELECT doc_id, round(n_chars / pow(1024, 3), 9) AS gib FROM documents")
def mth_05(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.round(F.col("n_chars") / F.pow(F.lit(1024.0), F.lit(3.0)), 9).alias("gib"))


@query("mth_06", "SELECT c_custkey, nextafter(c_acctbal, 'infinity'::DOUBLE) AS up FROM customer")
def mth_06(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", S.next_up("c_acctbal").alias("up"))


@query("mth_07", "SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(l_discount - l_tax)), 9) AS p FROM lineitem")
def mth_07(spark, sf):
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.class_probability("l_discount", "l_tax"), 9).alias("p"))


@query("mth_09", "SELECT l_orderkey, l_linenumber, abs(l_discount - l_tax) <= 1e-15 AS close FROM lineitem")
def mth_09(spark, sf):
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.abs(F.col("l_discount") - F.col("l_tax")) <= 1e-15).alias("close"))


@query("mth_10", "SELECT n_nationkey, (n_nationkey + 1) * 4608 AS steps FROM nation")
def mth_10(spark, sf):
    return read(spark, sf, "nation").select("n_nationkey", ((F.col("n_nationkey") + 1) * 4608).alias("steps"))


# arrays, JSON, hashes
@query("arr_01", "SELECT conv_id, list_sort(list_distinct(t)) = t AS ascending, len(t) = 8 AS complete FROM (SELECT conv_id, list(turn ORDER BY turn) AS t FROM conversations GROUP BY conv_id)")
def arr_01(spark, sf):
    t = read(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("t"))
    return t.select("conv_id", S.sorted_distinct("t").alias("ascending"), (F.size("t") == 8).alias("complete"))


@query("arr_02", "SELECT conv_id, list_sort(list_distinct(list(turn))) AS positions FROM conversations GROUP BY conv_id")
def arr_02(spark, sf):
    return read(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_set("turn")).alias("positions"))


@query("arr_03", "SELECT vec_id, len(embedding) = 64 AS shape, list_bool_and(list_transform(embedding, lambda x: isfinite(x))) AS finite FROM embeddings")
def arr_03(spark, sf):
    return read(spark, sf, "embeddings").select("vec_id", (F.size("embedding") == 64).alias("shape"), F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))).alias("finite"))


@query("jsn_01", """SELECT event_id, '{"v":' || user_id || ',"t":"' || event_type || '"}' AS cell FROM events""")
def jsn_01(spark, sf):
    return read(spark, sf, "events").select("event_id", F.to_json(F.struct(F.col("user_id").alias("v"), F.col("event_type").alias("t"))).alias("cell"))


@query("jsn_02", "SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events")
def jsn_02(spark, sf):
    return read(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


_METRICS = ["l_quantity", "l_extendedprice", "l_discount"]


@query("map_01", " UNION ALL ".join(f"SELECT l_returnflag, '{m}' AS metric, CAST(min({m}) AS DOUBLE) AS lower, CAST(max({m}) AS DOUBLE) AS upper FROM lineitem GROUP BY l_returnflag" for m in _METRICS))
def map_01(spark, sf):
    """A map from each metric to its interval, one a group, and its entries as rows."""
    interval = lambda m: F.struct(F.min(m).cast("double").alias("lower"), F.max(m).cast("double").alias("upper"))
    intervals = F.map_from_arrays(F.array(*(F.lit(m) for m in _METRICS)), F.array(*(interval(m) for m in _METRICS)))
    groups = read(spark, sf, "lineitem").groupBy("l_returnflag").agg(intervals.alias("intervals"))
    return groups.select("l_returnflag", F.explode("intervals").alias("metric", "at")).select("l_returnflag", "metric", "at.lower", "at.upper")


@query("hsh_01", "SELECT doc_id, sha256(text) AS digest FROM documents")
def hsh_01(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("dat_01", "SELECT user_id, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS last FROM events GROUP BY user_id")
def dat_01(spark, sf):
    return read(spark, sf, "events").groupBy("user_id").agg(F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss").alias("last"))


# sources and sinks by round trips
@query("src_01", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer")
def src_01(spark, sf):
    columns = ["c_custkey", "c_name", "c_nationkey"]
    writers.csv(read(spark, sf, "customer"), path := scratch(spark, "csv"), columns)
    return readers.csv_text(spark, path, columns)


query("snk_01", X.ORACLE["src_01"])(src_01)


@query("src_02", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def src_02(spark, sf):
    writers.json_lines(read(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), path := scratch(spark, "jsonl"))
    return readers.json_lines(spark, path, "c_custkey long, c_name string, c_acctbal double")


query("snk_05", X.ORACLE["src_02"])(src_02)


@query("src_05", "SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS a, CAST(c_nationkey AS VARCHAR) AS b FROM customer")
def src_05(spark, sf):
    c = read(spark, sf, "customer").select(F.array(F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")).alias("p"), (F.col("c_custkey") % 50).alias("k"))
    return readers.pair_list(c.groupBy("k").agg(F.to_json(F.collect_list("p")).alias("value"))).distinct()


@query("src_06", "SELECT c_nationkey AS label, c_name || ' x.mp4' AS path FROM customer")
def src_06(spark, sf):
    lines = read(spark, sf, "customer").select(F.concat(F.col("c_nationkey").cast("string"), F.lit("  "), F.col("c_name"), F.lit(" x.mp4")).alias("value"))
    lines.write.mode("overwrite").text(path := scratch(spark, "list"))
    return readers.label_list(spark, path)


@query("src_07", "SELECT 'd' AS dataset, role AS label, 'train' AS split, CAST(conv_id AS VARCHAR) AS video, CAST(row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS INTEGER) AS position, text AS frame FROM conversations")
def src_07(spark, sf):
    return _nested(read(spark, sf, "conversations"))


query("src_07_whole", X.ORACLE["src_07"])(src_07)


def _nested(turns):
    rows = turns.groupBy("role", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("l"))
    video = F.create_map(F.col("conv_id").cast("string"), F.struct(F.col("l.text").alias("frames")))
    doc = F.to_json(F.create_map(F.lit("d"), F.create_map("role", F.create_map(F.lit("train"), video))))
    return readers.nested_frames(rows.select(doc.alias("value")))


@query("src_08", "SELECT DISTINCT video, nullif(manipulation, '') AS manipulation FROM (WITH " + X.BASE + " SELECT * FROM base)")
def src_08(spark, sf):
    return readers.empty_as_null(X.base(spark, sf).select("video", "manipulation").distinct())


@query("src_10", "SELECT event_id AS id, value AS score FROM events")
def src_10(spark, sf):
    return readers.aliased(read(spark, sf, "events"), {"id": ["record", "event_id"], "score": ["score", "value"]})


@query("src_11", "SELECT c_mktsegment AS subgroup, CAST(sum(strlen(c_name) + 1) AS BIGINT) AS bytes FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY ALL")
def src_11(spark, sf):
    """Files below two of the five folders that are there, found at any depth; their sizes come without their contents."""
    names = read(spark, sf, "customer").select("c_name", "c_mktsegment", (F.col("c_custkey") % 3).alias("deep"))
    names.write.partitionBy("c_mktsegment", "deep").text(path := scratch(spark, "files"))
    found = readers.discovered(spark, path, "*.txt", [f"c_mktsegment={x}" for x in ("BUILDING", "MACHINERY")])
    return found.groupBy(F.substring_index("subgroup", "=", -1).alias("subgroup")).agg(F.sum("length").alias("bytes"))


@query("src_15", "SELECT c_custkey, 'cust' AS kind FROM customer")
def src_15(spark, sf):
    read(spark, sf, "customer").select("c_custkey").write.parquet(path := f"{scratch(spark, 'dims')}/cust")
    return readers.with_folder_dimensions(spark.read.parquet(path), ["kind"])


@query("snk_02", "SELECT o_orderkey FROM orders")
def snk_02(spark, sf):
    """Two batches appended, one of them twice: it is there once."""
    path, rows = scratch(spark, "append"), read(spark, sf, "orders").select("o_orderkey")
    committed.write(rows.where("o_orderkey % 2 = 0"), path, "even")
    for _ in range(2):
        committed.write(rows.where("o_orderkey % 2 <> 0"), path, "odd")
    return committed.read(spark, path, rows.schema)


@query("snk_10", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 2 = 0")
def snk_10(spark, sf):
    """A file set replaced by one move: rows of an old batch are seen until the new ones are."""
    path, rows = scratch(spark, "replace"), read(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    committed.write(rows, path, "first")
    committed.write(rows.where("o_orderkey % 2 = 0"), path, "second", overwrite=True)
    return committed.read(spark, path, rows.schema)


@query("snk_03", "SELECT n_nationkey AS id, n_name AS name, CAST(NULL AS VARCHAR) AS region FROM nation UNION ALL SELECT r_regionkey, NULL, r_name FROM region")
def snk_03(spark, sf):
    n = read(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return writers.union_of_columns([n, read(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("region"))])


@query("snk_06", "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0")
def snk_06(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey")
    return writers.resume(o, o.where("o_orderkey % 3 = 0"), ["o_orderkey"])


@query("snk_07", """SELECT r_regionkey AS n_regionkey, '[' || string_agg('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}', ',' ORDER BY n_nationkey) || ']' AS document FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL""")
def snk_07(spark, sf):
    return writers.as_document(read(spark, sf, "nation").select("n_regionkey", "n_nationkey", "n_name"), ["n_regionkey"])


# bootstrap pieces and sampling
@query("bst_02", f"WITH {X.BASE} SELECT stratum, unit, count(*) AS n_videos FROM (SELECT DISTINCT video, CASE WHEN study_label = 0 THEN 'real' WHEN manipulation <> '' THEN manipulation ELSE 'manipulated' END AS stratum, CASE WHEN dataset = 'first' THEN 'source::' || (video // 12) ELSE 'base::' || video END AS unit FROM base) GROUP BY ALL")
def bst_02(spark, sf):
    """Sampling keys (stratum, unit): a source has several videos, in several strata."""
    rows = X.base(spark, sf).withColumn("source", F.expr("video div 12"))
    return rows.select("video", resampling.stratum().alias("stratum"), resampling.cluster().alias("unit")).distinct().groupBy("stratum", "unit").agg(F.count("*").alias("n_videos"))


@query("smp_01", "SELECT c_custkey, row_number() OVER (ORDER BY md5('7::' || c_custkey), c_custkey) <= 288 AS fit FROM customer")
def smp_01(spark, sf):
    rows = read(spark, sf, "customer").select("c_custkey")
    chosen = rows.orderBy(F.md5(F.concat_ws("::", F.lit("7"), F.col("c_custkey").cast("string"))), "c_custkey").limit(288)
    return rows.join(chosen.withColumn("fit", F.lit(True)), "c_custkey", "left").select("c_custkey", F.coalesce("fit", F.lit(False)).alias("fit"))


@query("smp_02", "SELECT lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('7::' || doc_id), doc_id) <= 5")
def smp_02(spark, sf):
    return selection.hash_sample(read(spark, sf, "documents"), ["lang"], "doc_id", 7, F.lit(5)).select("lang", "doc_id")


@query("smp_03", "SELECT lang, least(greatest(CAST(round_even(count(*) * 0.3, 0) AS BIGINT), 2), count(*) - 1) AS k FROM documents GROUP BY lang")
def smp_03(spark, sf):
    return read(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n")).select("lang", selection.hold_out_size(F.col("n"), 0.3, 2).alias("k"))


@query("smp_04", "SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_custkey < 20)")
def smp_04(spark, sf):
    c = read(spark, sf, "customer").where("c_custkey < 20").select(F.col("c_nationkey").alias("s_nationkey"))
    return read(spark, sf, "supplier").join(c, "s_nationkey", "left_anti").select("s_suppkey")


@query("smp_05", "WITH p AS (SELECT c_nationkey, c_custkey, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer), t AS (SELECT max(n) + 7 AS target FROM p), e AS (SELECT *, unnest(range(0, CAST(ceil(target / n) AS BIGINT) + 1)) AS pass FROM p, t), o AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY pass, md5('7::' || pass || '::' || c_custkey), c_custkey) AS place FROM e) SELECT c_nationkey, c_custkey, pass, place, row_number() OVER (ORDER BY md5('7::all::' || c_nationkey || '::' || place), c_nationkey, place) AS slot FROM o WHERE place <= target")
def smp_05(spark, sf):
    """Every group filled up to one target, no item dropped, then all exposures shuffled into one order."""
    rows = read(spark, sf, "customer").select("c_nationkey", "c_custkey")
    target = rows.groupBy("c_nationkey").count().agg(F.max("count")).first()[0] or 0
    shown = selection.exposures(rows, ["c_nationkey"], "c_custkey", 7, target + 7)
    shown = shown.select("c_nationkey", "c_custkey", F.col("pass").cast("long").alias("pass"), F.col("place").cast("long").alias("place"))
    order = F.md5(F.concat_ws("::", F.lit("7::all"), F.col("c_nationkey").cast("string"), F.col("place").cast("string")))
    return X.numbered(shown, [order, F.col("c_nationkey"), F.col("place")], "slot")


@query("smp_07", "WITH r AS (SELECT c_nationkey, min(c_custkey) AS partner FROM customer GROUP BY ALL), p AS (SELECT r_name, n_name, partner, count(*) OVER (PARTITION BY r_name) AS n FROM nation JOIN region ON n_regionkey = r_regionkey JOIN r ON c_nationkey = n_nationkey), e AS (SELECT *, unnest(range(0, CAST(ceil(32 / n) AS BIGINT) + 1)) AS pass FROM p), o AS (SELECT *, row_number() OVER (PARTITION BY r_name ORDER BY pass, md5('7::' || pass || '::' || n_name), n_name) AS place FROM e) SELECT r_name, place, item, label FROM (SELECT r_name, place, n_name AS item, 1 AS label FROM o WHERE place <= 32 UNION ALL SELECT r_name, place, CAST(partner AS VARCHAR), 0 FROM o WHERE place <= 32)")
def smp_07(spark, sf):
    """Per method as many exposures of pairs: a manipulated item and its real partner share a place; items without a
    partner are never exposed.
    """
    real = read(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.min("c_custkey").alias("partner"))
    pairs = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).join(real, "n_nationkey")
    shown = selection.exposures(pairs, ["r_name"], "n_name", 7, 32)
    members = F.array(F.struct(F.col("n_name").alias("item"), F.lit(1).alias("label")), F.struct(F.col("partner").cast("string").alias("item"), F.lit(0).alias("label")))
    return shown.select("r_name", F.col("place").cast("long").alias("place"), F.explode(members).alias("m")).select("r_name", "place", "m.item", "m.label")


@query("smp_08", "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k, count(*) OVER () AS n FROM labels WHERE quality = 1), f AS (SELECT doc_id, CAST(('0x' || substr(md5('7::' || doc_id), 1, 8)) AS BIGINT) % (SELECT max(n) FROM r) AS k FROM labels WHERE quality = 0) SELECT f.doc_id, r.doc_id AS partner FROM f JOIN r USING (k)")
def smp_08(spark, sf):
    labels = read(spark, sf, "labels")
    real = X.numbered(labels.where("quality = 1").select("doc_id"), [F.col("doc_id")]).select(F.col("doc_id").alias("partner"), (F.col("place") - 1).alias("k"))
    n = labels.where("quality = 1").agg(F.count("*").alias("n"))
    fake = labels.where("quality = 0").join(F.broadcast(n), F.lit(True)).select("doc_id", S.draw("n", F.lit(7), "doc_id").alias("k"))
    return fake.join(real, "k").select("doc_id", "partner")


# checks
@query("qc_01", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def qc_01(spark, sf):
    return checks.repeated_keys(read(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("qc_02", "SELECT n_regionkey, count(*) AS found FROM nation GROUP BY ALL HAVING count(*) <> 4")
def qc_02(spark, sf):
    expected = read(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.lit(4).cast("long").alias("n"))
    return checks.wrong_counts(read(spark, sf, "nation"), expected, ["n_regionkey"]).select("n_regionkey", "found")


_STATED = "CASE WHEN event_id % 211 = 5 THEN 'M9' WHEN event_id % 199 = 4 THEN '' ELSE manipulation END"


@query("qc_05", f"WITH {X.BASE} SELECT DISTINCT video FROM (SELECT *, {_STATED} AS stated FROM base) WHERE NOT ((study_label = 0 AND stated = '') OR (study_label = 1 AND (stated <> '' OR dataset = 'second')))")
def qc_05(spark, sf):
    """Videos whose label and manipulation contradict each other."""
    stated = F.expr(_STATED)
    rule = ((F.col("study_label") == 0) & (stated == "")) | ((F.col("study_label") == 1) & ((stated != "") | (F.col("dataset") == "second")))
    return checks.broken(X.base(spark, sf), rule, ["video"]).distinct()


@query("qc_07", f"WITH {X.DECISIONS} SELECT count(*) AS violations FROM decisions WHERE (video_score IS NULL) <> (decision IS NULL)")
def qc_07(spark, sf):
    rule = F.col("video_score").isNull() == F.col("decision").isNull()
    return checks.broken(X.decisions(spark, sf), rule, ["video"]).agg(F.count("*").alias("violations"))


@query("qc_08", f"WITH {X.BASE} SELECT video, count(DISTINCT n) AS n_values FROM (SELECT video, condition, count(*) AS n FROM base GROUP BY ALL) GROUP BY video HAVING count(DISTINCT n) > 1")
def qc_08(spark, sf):
    return checks.not_constant(X.base(spark, sf).groupBy("video", "condition").agg(F.count("*").alias("n")), ["video"], "n")
