"""Sharded CSV exports: write them, and read all shards of a glob as one frame."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom import vocab
from cohortloom.functions.dates import AsOf
from cohortloom.functions.text import na_to_null
from cohortloom.session import scratch_path

# Doubled quotes, as in RFC 4180; without this Spark escapes with backslashes.
_DIALECT = {"header": "true", "quote": '"', "escape": '"'}


def export_path(base: str, name: str, on: AsOf | None = None) -> str:
    """``base/yyyymmdd/name``, or ``base/name`` without a date.

    A rerun on the same date replaces that date's copy; other dates keep theirs.
    """
    parts = [base.rstrip("/"), *([str(on).replace("-", "")] if on is not None else []), name]
    return "/".join(parts)


def _is_there(spark: SparkSession, path: str) -> bool:
    """Whether a path has files: one listing, no job."""
    try:
        return bool(spark.read.format("binaryFile").load(path).schema)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def export_csv(df: DataFrame, path: str, rows_per_shard: int = 2_000_000) -> str:
    """Write one shard or more per partition, replacing what is there; returns the shard glob.

    Spark empties a folder before it starts to write there. So where an older export lies, the rows
    are first computed into a new folder of the shared scratch space, and only finished rows replace
    it: a job that fails on the way leaves the old export as it was.
    """
    spark = df.sparkSession
    staged = scratch_path(spark, "staged") if _is_there(spark, path) else None
    if staged:
        df.write.parquet(staged)
        df = spark.read.schema(df.schema).parquet(staged)
    (df.write.mode("overwrite").options(**_DIALECT)
       .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
       .option("maxRecordsPerFile", rows_per_shard)
       .csv(path))
    if staged:
        spark.range(0).write.mode("overwrite").parquet(staged)  # the space is free again
    return f"{path}/*.csv"


def by_line_breaks(spark: SparkSession, glob: str) -> tuple[str | list[str], list[str]]:
    """The shards without a quoted line break (the glob itself, if that is all of them) and those with one.

    A record that is broken inside a field has an odd number of quotes on its first line. The
    lines are counted where they lie; only names of shards come to the driver.
    """
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    shards = (spark.read.text(glob).groupBy("_metadata.file_path")
              .agg(F.max(quotes % 2).alias("broken")).orderBy("file_path").collect())
    broken = [unquote(name) for name, odd in shards if odd]
    return ([unquote(name) for name, odd in shards if not odd] if broken else glob), broken


def read_csv_shards(spark: SparkSession, glob: str,
                    schema: str | T.StructType | None = None,
                    overrides: Mapping[str, str] | None = None,
                    all_text: Sequence[str] | bool = False,
                    na_tokens: Sequence[str] = tuple(vocab.NA_TOKENS),
                    multiline: bool | None = None) -> DataFrame:
    """Read every shard as one distributed scan.

    ``schema``      full schema; the right choice for large data, as nothing is scanned twice.
    ``overrides``   types for some columns, the rest inferred over the whole glob (one extra
                    pass); names that no shard has only warn.
    ``all_text``    every column as text; pass the column names to avoid reading a header.
    Empty fields and NA tokens become NULL. A quoted line break keeps its record whole: shards that
    have any are found by a pass over the lines and read by one task each, all others are split
    however large they are. ``multiline`` skips that pass: False where no field has a line break,
    True to read every shard by one task.
    """
    reader = (spark.read.options(**_DIALECT)
              .option("ignoreLeadingWhiteSpace", "true").option("ignoreTrailingWhiteSpace", "true"))
    if multiline is None:
        split, whole = by_line_breaks(spark, glob)
    else:
        split, whole = ([], glob) if multiline else (glob, [])
    glob = split or whole
    reader = reader.option("multiLine", str(not split).lower())
    if schema is not None:
        wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    elif all_text is not False:
        names = all_text if all_text is not True else reader.csv(glob).columns
        wanted = T.StructType([T.StructField(c, T.StringType()) for c in names])
    else:
        guessed = reader.option("inferSchema", "true").option("nullValue", "NA").csv(glob).schema
        given = {c: T._parse_datatype_string(t) for c, t in (overrides or {}).items()}
        for name in sorted(set(given) - set(guessed.names)):
            warnings.warn(f"no column named {name!r} in {glob}", stacklevel=2)
        wanted = T.StructType([T.StructField(f.name, given.get(f.name, f.dataType)) for f in guessed])

    # Typed columns go through text, so that an NA token is NULL and not a parse failure.
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in wanted])
    reader = reader.option("inferSchema", "false").schema(text)
    raw = reader.csv(glob)
    if split and whole:
        raw = raw.unionByName(reader.option("multiLine", "true").csv(whole))
    return raw.select(*[
        na_to_null(F.col(_quoted(f.name)), na_tokens).try_cast(f.dataType).alias(f.name) for f in wanted])


def write_report(df: DataFrame, path: str, order_column: str = "row_number") -> str:
    """One CSV file in report order, led by the row number in a column without a name.

    For finished reports only: their rows are table categories, so one writer task is enough.
    """
    rest = [_quoted(c) for c in df.columns if c != order_column]
    (df.orderBy(order_column).coalesce(1)
       .select(F.col(order_column).alias(""), *rest)
       .write.mode("overwrite").options(**_DIALECT).csv(path))
    return f"{path}/*.csv"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
