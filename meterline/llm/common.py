"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from meterline.session import checkpoint_dir

# Word separators of the "plain" word rule [^\x20\x09-\x0D]+ as a Java class.
SPACE = r"[\x20\x09-\x0D]"
# Separators of the "alphanumeric" word rule, before A-Z are lower-cased.
NON_ALNUM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a parquet table in the shared checkpoint folder and
    return a reader of it: the lineage is cut, a lost executor re-reads files
    instead of recomputing, and the planner knows the real size.  The folder is
    deleted when the application ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`stored` that no later plan
    reads (the previous round of an iteration)."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names starting with ``names`` that clash with none of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def lower_ascii(col: Column) -> Column:
    """A-Z lower-cased, every other character unchanged."""
    return F.translate(col, UPPER, UPPER.lower())


def plain_words(col: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` in order; none for null."""
    return F.array_remove(F.split(F.coalesce(col, F.lit("")), SPACE + "+"), "")


def text_key(col: Column) -> Column:
    """128-bit key of a text; null counts as its own value."""
    return F.coalesce(F.md5(col), F.lit("null"))


def numbered(rows: DataFrame, name: str = "row", chunk: int = 4096) -> DataFrame:
    """``rows`` with ``name``, the number of a row among rows equal to it (from 0):
    the same whatever files or partitions the rows came from.  Equal rows are one
    row with a count while they move, and a long run of them is written out by
    many tasks."""
    same = rows.groupBy(*rows.columns).agg(F.count("*").alias("_n"))

    def out(start, end):
        return [*rows.columns, F.explode(F.sequence(start, end)).alias(name)]

    few = same.where(F.col("_n") <= chunk).select(*out(F.lit(0).cast("long"), F.col("_n") - 1))
    many = same.where(F.col("_n") > chunk).withColumn(
        "_c", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {chunk}")))).repartition("_c")
    return few.unionByName(many.select(*out(F.col("_c") * chunk, F.least((F.col("_c") + 1) * chunk, F.col("_n")) - 1)))
