"""Readers.  Files come through Spark, so any store that Spark reads will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def csv_text(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """CSV with a header, every column text; a given schema saves the pass that reads names."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return reader.csv(path)


def csv_strict(spark: SparkSession, path: str, columns: list[str], keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows under exactly these columns, and the keys that repeat."""
    rows = spark.read.option("header", True).option("enforceSchema", False).option("multiLine", True).option("escape", '"').schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).csv(path)
    return rows, rows.groupBy(*keys).count().where("count > 1")


def empty_as_null(rows: DataFrame) -> DataFrame:
    """Empty texts to null."""
    return rows.select(*(F.nullif(f.name, F.lit("")).alias(f.name) if isinstance(f.dataType, T.StringType) else f.name for f in rows.schema))


def aliased(rows: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """Each wanted column from the first candidate that exists; a column without any raises."""
    chosen = {}
    for wanted, candidates in names.items():
        present = [c for c in candidates if c in rows.columns]
        if not present:
            raise ValueError(f"no column for {wanted} among {candidates}")
        chosen[wanted] = present[0]
    return rows.select(*(F.col(c).alias(w) for w, c in chosen.items()))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; a malformed line raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def pair_list(texts: DataFrame, column: str = "value") -> DataFrame:
    """Pairs from JSON texts [["a", "b"], ...]; ids stay text."""
    pairs = texts.select(F.explode(F.from_json(column, "array<array<string>>")).alias("p"))
    return pairs.select(F.col("p")[0].alias("a"), F.col("p")[1].alias("b"))


def label_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``label path``: split once, blank lines skipped."""
    parts = F.split(F.trim("value"), r"\s+", 2)
    return spark.read.text(path).where(F.trim("value") != "").select(parts[0].cast("int").alias("label"), parts[1].alias("path"))


def nested_frames(documents: DataFrame, column: str = "value") -> DataFrame:
    """dataset, label, split, video, position, frame of a document nested in that order."""
    schema = "map<string,map<string,map<string,map<string,struct<frames:array<string>>>>>>"
    out = documents.select(F.explode(F.from_json(column, schema)).alias("dataset", "a"))
    out = out.select("dataset", F.explode("a").alias("label", "b")).select("dataset", "label", F.explode("b").alias("split", "c"))
    return out.select("dataset", "label", "split", F.explode("c").alias("video", "d")).select("dataset", "label", "split", "video", F.posexplode("d.frames").alias("position", "frame"))


def files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Path, length and content of files below a folder."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def with_folder_dimensions(rows: DataFrame, names: list[str]) -> DataFrame:
    """The last folders of each row's file as columns."""
    parts = F.split(F.input_file_name(), "/")
    return rows.select("*", *(F.element_at(parts, k - len(names) - 1).alias(n) for k, n in enumerate(names)))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1 on), value: the lines of text files with their numbers, blank ones counted.

    A file may be read in several splits: lines are ranked inside their split, and the lines of all splits before it in the file
    come from a table of one row a split.  No task sees more than a split.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value", F.monotonically_increasing_id().alias("at"))
    sizes = rows.groupBy("file", "start").agg(F.count("*").alias("n"))
    before = sizes.select("file", "start", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = rows.withColumn("own", F.row_number().over(Window.partitionBy("file", "start").orderBy("at")))
    return ranked.join(before, ["file", "start"]).select("file", (F.col("before") + F.col("own")).alias("line"), "value")


def bad_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """file, line, value of lines that aren't blank and give no object of the schema."""
    parsed = F.from_json("value", f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    return lines.withColumn("r", parsed).where("r is null or r._broken is not null").select("file", "line", "value")


def strict_json_lines(spark: SparkSession, path: str, schema: str, told: int = 5) -> DataFrame:
    """The rows of JSON lines; an error names the file and line of the first malformed ones."""
    bad = bad_json_lines(spark, path, schema).orderBy("file", "line").limit(told).collect()
    if bad:
        raise ValueError("; ".join(f"{r['file']}:{r['line']}: no object of {schema}: {r['value'][:80]}" for r in bad))
    return json_lines(spark, path, schema)


def label_list_faults(spark: SparkSession, path: str) -> DataFrame:
    """file, line, value, fault of the lines of a list ``label path``: no_label, no_path, or repeated (a path that an earlier
    line of any file has, in order of file and line).  Blank lines are none.
    """
    parts = F.split(F.trim("value"), r"\s+", 2)
    rows = numbered_lines(spark, path).where(F.trim("value") != "").withColumns({"label": F.expr("try_cast(split(trim(value), '\\\\s+', 2)[0] as int)"), "path": F.when(F.size(parts) > 1, parts[1])})
    several = rows.where("path is not null").groupBy("path").agg(F.count("*").alias("n"), F.min(F.struct("file", "line")).alias("first")).where("n > 1").drop("n")
    joined = rows.join(several, "path", "left")
    fault = F.when(F.col("label").isNull(), "no_label").when(F.col("path").isNull(), "no_path").when(F.col("first") != F.struct("file", "line"), "repeated")
    return joined.withColumn("fault", fault).where("fault is not null").select("file", "line", "value", "fault")


def discovered(spark: SparkSession, root: str, pattern: str, folders: list[str] | None = None) -> DataFrame:
    """subgroup, path, length of the files below a root whose name fits, at any depth, without reading their contents.

    With ``folders`` only those below the root are searched, each a subgroup, and one that isn't there is an error; without
    them all files are of subgroup ".".  Files of no bytes are left out: Spark plans no reads of them.
    """
    root = root.rstrip("/")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    found = reader.load([f"{root}/{f}" for f in folders] if folders else root)
    if not folders:
        return found.select(F.lit(".").alias("subgroup"), "path", "length")
    group = F.coalesce(*(F.when(F.contains("path", F.lit(f"{root}/{f}/")), F.lit(f)) for f in sorted(folders, key=len, reverse=True)))
    return found.select(group.alias("subgroup"), "path", "length")
