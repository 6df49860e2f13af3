"""Readers and writers of record files: JSON, JSON lines, CSV and TSV, with their gates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share (spark.checkpoint.dir; a new one where
    it is unset and all run on one machine, as in tests)."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rollbook-"))
        top = spark.sparkContext.getCheckpointDir()
    return f"{top}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read from there: computed once, without the lineage before it.
    What is written grows with the input while its file may be small (copies, short runs), so that its joins are merge joins
    and none of it is sent to the driver to be broadcast."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).hint("merge")


def load_layer(rows: DataFrame, key: str) -> DataFrame:
    """rows if every key is there once; else an error when it runs. The check is a window-free count by key."""
    bad = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(f"n > 1 OR {key} IS NULL").agg(F.count(F.lit(1)).alias("bad"))
    broken = bad.first()["bad"]
    if broken:
        raise ValueError(f"layer: {broken} keys are missing or repeated")
    return rows


def json_lines(lines: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """lines with value (a struct; null for a line that isn't JSON of that shape) and valid."""
    corrupt = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    parsed = lines.withColumn("__v", F.from_json(column, corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    ok = F.col("__v").isNotNull() & F.col("__v._corrupt").isNull()
    return parsed.withColumns({"value": F.when(ok, F.struct(*(F.col(f"__v.{f.name}").alias(f.name) for f in schema.fields))), "valid": ok}).drop("__v")


def read_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> DataFrame:
    """A file with a header that must have the schema's columns."""
    return spark.read.csv(path, schema=schema, header=True, sep=sep, enforceSchema=False, multiLine=False, mode="FAILFAST")


def bindings(rows: DataFrame, column: str, names: list[str]) -> DataFrame:
    """rows with a column for each name: the trimmed value of that binding ({name: {"value": ...}}) in a JSON column, blank
    where it isn't there."""
    shape = T.StructType([T.StructField(n, T.StructType([T.StructField("value", T.StringType())])) for n in names])
    out = rows.withColumn("__b", F.from_json(column, shape))
    return out.withColumns({n: F.trim(F.coalesce(F.col(f"__b.{n}.value"), F.lit(""))) for n in names}).drop("__b")


def read_submissions(spark: SparkSession, path: str, prefixes: dict[str, str], apart: str = "／") -> DataFrame:
    """(name, reading, urls) of a TSV file without a header. Names and readings of a line that are as many, and set apart,
    belong together by place and share its URLs, which are set apart by blanks; a URL may begin with a shorthand."""
    lines = spark.read.csv(path, schema="name string, reading string, urls string", sep="\t", quote="", mode="FAILFAST")
    kinds = F.create_map(*(F.lit(x) for kv in prefixes.items() for x in kv))
    short = lambda u: F.substring(u, 1, 2)
    full = lambda u: F.coalesce(F.concat(F.try_element_at(kinds, short(u)), F.substring(u, 3, 1 << 30)), u)
    urls = F.transform(F.filter(F.split("urls", r"\s+"), lambda u: u != ""), full)
    names, readings = F.split("name", apart), F.split("reading", apart)
    paired = F.when(F.size(names) == F.size(readings), F.arrays_zip(names.alias("name"), readings.alias("reading"))).otherwise(F.array(F.struct("name", "reading")))
    return lines.select(F.explode(paired).alias("x"), urls.alias("urls")).select("x.*", "urls")


def read_json_directory(spark: SparkSession, path: str, schema: T.StructType, glob: str = "*.json", most_bytes: int = 1 << 30, most_total: int = 1 << 40) -> DataFrame:
    """Records of the files that fit the glob, with each file's time. Files over most_bytes are an error, as is a sum over
    most_total; sizes come from file metadata."""
    rows = spark.read.schema(schema).json(path, pathGlobFilter=glob).select("*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_size").alias("__size"), F.col("_metadata.file_modification_time").alias("snapshot_at"))
    sizes = rows.groupBy("__path").agg(F.max("__size").alias("size")).agg(F.max("size").alias("largest"), F.sum("size").alias("total")).first()
    if (sizes["largest"] or 0) > most_bytes or (sizes["total"] or 0) > most_total:
        raise ValueError("a file, or all together, are over the bound")
    return rows.drop("__path", "__size")


def paged_feed(rows: DataFrame, feed: str, page: str, cursor: str, most_pages: int = 100, most_rows: int = 1000) -> DataFrame:
    """(feed, monotonic, n_pages, within): whether each feed's cursor strictly grows in the order of its pages, and whether
    it keeps to the bounds of pages, and of rows on a page."""
    pages = rows.groupBy(feed, page).agg(F.max(cursor).alias("cursor"), F.count(F.lit(1)).alias("n"))
    grown = F.col("cursor") > F.lag("cursor").over(Window.partitionBy(feed).orderBy(page))  # a row a page
    checked = pages.withColumn("grown", F.coalesce(grown, F.lit(True))).groupBy(feed)
    return checked.agg(F.bool_and("grown").alias("monotonic"), F.count(F.lit(1)).alias("n_pages"), ((F.count(F.lit(1)) <= most_pages) & (F.max("n") <= most_rows)).alias("within"))


def spreadsheet_safe(c: Column) -> Column:
    """Text that spreadsheets won't run as a formula."""
    return F.regexp_replace(c, r"^([=+@-])", "'$1")


def export_csv(rows: DataFrame, path: str) -> None:
    """All fields quoted, no formulas. Each line ends in a line feed: the writer takes one character."""
    safe = rows.select(*(spreadsheet_safe(F.col(f.name).cast("string")).alias(f.name) for f in rows.schema))
    safe.write.csv(path, header=True, quoteAll=True, escape='"', emptyValue="")


def content_version(rows: DataFrame, columns: list[str]) -> DataFrame:
    """16 hex digits that change with any row: a sum of 64-bit row hashes and the count, whatever the order."""
    total = F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))
    return rows.agg(F.substring(F.sha2(F.concat_ws(":", F.coalesce(total.cast("string"), F.lit("0")), F.count(F.lit(1)).cast("string")).cast("binary"), 256), 1, 16).alias("version"), F.count(F.lit(1)).alias("n"))


def overwrite_if_changed(rows: DataFrame, path: str) -> bool:
    """Writes rows to a staging path beside it, puts it in place of the table at `path` and says so, unless that has the
    same content already. After a crash between the two moves the old table is beside it, under a name with `.old-`."""
    spark = rows.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.exists(target):
        old = spark.read.schema(rows.schema).parquet(path)
        if content_version(old, old.columns).first() == content_version(rows, rows.columns).first():
            return False
    staging = hadoop.Path(f"{path}.staging-{uuid.uuid4().hex}")
    rows.write.parquet(staging.toString())
    # the old table is moved aside first: at no time is there neither
    aside = hadoop.Path(f"{path}.old-{uuid.uuid4().hex}")
    had = system.exists(target) and system.rename(target, aside)
    if not system.rename(staging, target):
        if had:
            system.rename(aside, target)
        raise OSError(f"{path}: the new table could not be moved into place")
    if had:
        system.delete(aside, True)
    return True
