"""Incremental batch refresh of in-place logs (O8.1, O8.2, O7.3).

The state kept between refreshes is the narrow parsed-lines table (before
dedup) and the file manifest.  A refresh lists the files again (metadata
only), diffs the manifests, drops the rows of changed and deleted files and
re-reads only new and changed files (a changed file is re-read whole).
Dedup, names and prices are then recomputed on the union, so a refresh
always equals a full load of the current files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.sources.jsonl import (file_manifest, finish_usage, materialize, parse_narrow, resolve_root,
                                     scan_logs)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """File manifest ``(path, modification_time, length)`` (O8.1), listed
    afresh (the session's cached listing of ``root`` is dropped first) and
    checkpointed, so it stays the listing of this moment."""
    base = resolve_root(spark, root)
    spark.catalog.refreshByPath(base)
    return materialize(file_manifest(spark, base))


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per path: 'new', 'changed', 'deleted' or 'unchanged' (O8.2)."""
    o = old.select("path", F.col("modification_time").alias("old_mtime"), F.col("length").alias("old_length"))
    n = new.select("path", F.col("modification_time").alias("new_mtime"), F.col("length").alias("new_length"))
    j = o.join(n, "path", "full_outer")
    status = (F.when(F.col("old_mtime").isNull(), F.lit("new"))
              .when(F.col("new_mtime").isNull(), F.lit("deleted"))
              .when((F.col("old_mtime") != F.col("new_mtime")) | (F.col("old_length") != F.col("new_length")),
                    F.lit("changed"))
              .otherwise(F.lit("unchanged")))
    return j.select("path", F.regexp_extract("path", r"/projects/([^/]+)/", 1).alias("project"),
                    status.alias("status"), "old_mtime", "new_mtime", "old_length", "new_length")


def removed_projects(old: DataFrame, new: DataFrame) -> DataFrame:
    """Projects that had files before and have none now (O7.3)."""
    def proj(m):
        return m.select(F.regexp_extract("path", r"/projects/([^/]+)/", 1).alias("project")).distinct()
    return proj(old).join(proj(new), "project", "left_anti")


def refresh_parsed(spark: SparkSession, root: str, parsed_old: DataFrame, diff: DataFrame) -> DataFrame:
    """Replace the rows of changed and deleted files; add new files."""
    stale = diff.where(F.col("status").isin("changed", "deleted")).select(F.col("path").alias("source_file"))
    keep = parsed_old.join(stale, "source_file", "left_anti")
    # only the new and changed files are read; their list stays in tasks
    fresh = parse_narrow(scan_logs(spark, root, files=files_to_read(diff)))
    return keep.unionByName(fresh.select(*keep.columns))


def files_to_read(diff: DataFrame) -> DataFrame:
    """The manifest lines of new and changed files."""
    return diff.where(F.col("status").isin("new", "changed")).select(
        "path", F.col("new_mtime").alias("modification_time"), F.col("new_length").alias("length"))


def refresh(spark: SparkSession, root: str, state: dict, prices: DataFrame | None = None,
            tz: str = "UTC") -> dict:
    """One refresh step.  ``state`` holds ``parsed`` and ``manifest`` from the
    previous load (``load_state``) or refresh; with no change the previous
    result is returned as is."""
    new_manifest = manifest(spark, root)
    diff = materialize(manifest_diff(state["manifest"], new_manifest))
    changed = diff.where(F.col("status") != "unchanged").limit(1).count() > 0
    if not changed and "entries" in state:
        return {**state, "manifest": new_manifest, "diff": diff}
    parsed = materialize(refresh_parsed(spark, root, state["parsed"], diff))
    out = finish_usage(parsed, prices, tz)
    return {**out, "parsed": parsed, "manifest": new_manifest, "diff": diff}


def load_state(spark: SparkSession, root: str, prices: DataFrame | None = None, tz: str = "UTC") -> dict:
    """Initial full load plus the manifest it was made from."""
    m = manifest(spark, root)
    lines = scan_logs(spark, root, files=m)
    parsed = materialize(parse_narrow(lines))
    out = finish_usage(parsed, prices, tz)
    return {**out, "parsed": parsed, "manifest": m}
