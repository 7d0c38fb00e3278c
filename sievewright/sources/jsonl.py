"""JSON lines and JSON arrays as tables: tolerant, strict, or absent; and their sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievewright.session import materialize, release

CORRUPT = "_corrupt_record"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, on whatever file system it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (1-based within each file) and value of every line, in the files' order.

    Lines are numbered within their block of a file, which one task reads, and the counts of the blocks before are added.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    local = raw.withColumn("n", F.row_number().over(W.partitionBy("file", "block").orderBy("id")))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sizes = raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("size")).withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    return local.join(sizes.select("file", "block", "before"), ["file", "block"]).select("file", (F.col("n") + F.col("before")).alias("line_no"), "value")


def tolerant(spark: SparkSession, path: str, schema: T.StructType | str, objects_only: bool = True, missing_ok: bool = False) -> DataFrame:
    """Rows of a JSON-lines file; blank and unparsable lines, `null` lines and lines that are no object are skipped.

    A missing file is an error, or an empty table with `missing_ok`.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return parsed(spark.read.text(path), schema, objects_only).filter(~F.col("bad")).select("row.*")


def parsed(lines: DataFrame, schema: T.StructType | str, objects_only: bool = True) -> DataFrame:
    """row and bad of every line that isn't blank or `null`: bad lines can't be parsed or are no object."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    v = F.trim("value")
    rows = lines.filter((v != "") & (v != "null")).withColumn("__row", F.from_json(v, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))
    bad = F.col("__row").isNull() | F.col(f"__row.{CORRUPT}").isNotNull()
    if objects_only:
        bad = bad | ~F.startswith(v, F.lit("{"))
    return rows.select(*[c for c in lines.columns if c != "value"], F.struct(*[F.col(f"__row.{f.name}").alias(f.name) for f in schema.fields]).alias("row"), bad.alias("bad"))


def with_rejects(spark: SparkSession, path: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """The good rows, and one row that counts good and bad lines; `null` lines are neither."""
    p = parsed(spark.read.text(path), schema)
    return p.filter("NOT bad").select("row.*"), p.agg(F.count_if(~F.col("bad")).alias("ok"), F.count_if("bad").alias("bad"))


def strict(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of a JSON-lines file; the first bad line fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def array_file(spark: SparkSession, path: str, schema: T.StructType | str, key: str | None = None, missing_ok: bool = False) -> DataFrame:
    """Rows of a JSON-array file; with a key, one row for each, the last in the file."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.option("wholetext", "true").text(path).select(F.posexplode(F.from_json("value", T.ArrayType(schema))).alias("__pos", "__row"))
    if key is None:
        return rows.select("__row.*")
    return rows.filter(F.col(f"__row.{key}").isNotNull()).groupBy(F.col(f"__row.{key}").alias("__k")).agg(F.max_by("__row", "__pos").alias("__row")).select("__row.*")


def sniffed(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A file that is a JSON array or JSON lines, whichever its first character says; only objects count, bad lines are skipped."""
    first = spark.read.text(path).filter(F.trim("value") != "").select(F.substring(F.ltrim("value"), 1, 1)).first()
    return array_file(spark, path, schema) if first and first[0] == "[" else tolerant(spark, path, schema)


# sinks ---------------------------------------------------------------------------------------------------------------------------
def write_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines with nulls kept."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_ordered(df: DataFrame, path: str, order: str, present: Column | None = None) -> None:
    """JSON lines in the order of a column over the files; rows that aren't present become a `null` line."""
    data = F.to_json(F.struct(*[c for c in df.columns if c != order]), {"ignoreNullFields": "false"})
    value = data if present is None else F.when(present, data).otherwise(F.lit("null"))
    df.select(order, value.alias("value")).orderBy(order).select("value").write.mode("overwrite").text(path)


def write_with_side_file(df: DataFrame, path: str, side_path: str, key: str, side: list[str]) -> None:
    """The rows without some bulky columns, and these with the key in a file of their own. The plan runs once."""
    rows = materialize(df, "rows")
    write_lines(rows.drop(*side), path)
    write_lines(rows.select(key, *side), side_path)
    release(rows)


def write_log(df: DataFrame, path: str, template: str, *columns: str) -> None:
    """One line of text for each row."""
    df.select(F.format_string(template, *columns).alias("value")).write.mode("overwrite").text(path)


def preview(df: DataFrame, n: int = 5, clip: int = 200, order: list[str] | None = None) -> DataFrame:
    """The first rows by `order` (any rows without one) with their texts clipped, for people to look at."""
    some = (df.orderBy(*order) if order else df).limit(n)
    return some.select(*[F.substring(f.name, 1, clip).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema.fields])


def resume(items: DataFrame, done_path: str, key: str, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run only the items whose key isn't in an output yet, append their results there, and give the whole output."""
    spark = items.sparkSession
    todo = items
    if exists(spark, done_path):
        todo = items.join(spark.read.parquet(done_path).select(key).distinct(), key, "left_anti")
    run(todo).write.mode("append").parquet(done_path)
    return spark.read.parquet(done_path)
