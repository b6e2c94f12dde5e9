"""JSONL usage-log source (O1.1-O1.13, O3.2 input).

The scan reads every ``*.jsonl`` (case-insensitive) below the root, prefering
``<root>/projects``; files are listed and read in tasks (``sources/files.py``).
Every line keeps its lineage: ``source_file``, the split's first byte
``file_block_start``, and ``line_seq``, the line's first byte (where Spark's text
source reads, ``monotonically_increasing_id`` taken right after the scan, which
grows with the read order inside a split).  The load order of the reference, files by the earliest
RFC3339 timestamp in them and then lines, is therefore a
sort key that never needs a global sort.

Parsing is ``try_parse_json`` into VARIANT and strict extraction: a JSON
string is never taken for a number or the other way round.  Lines that are
not usage entries go to a rejects frame with a reason, never dropped
silently; blank lines are ignored.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.operators.common import blank_to_null
from meterline.sources.files import in_tasks, list_files, read_files, tasks_for

JSONL_GLOB = "*.[jJ][sS][oO][nN][lL]"
RFC3339_RE = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
_NUMBER_TYPES = ("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT")


# ---- path helpers ------------------------------------------------------------

def _hadoop_fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def resolve_root(spark: SparkSession, root: str) -> str:
    """``<root>/projects`` when it exists, else ``root`` (O1.1)."""
    projects = root.rstrip("/") + "/projects"
    p, fs = _hadoop_fs(spark, projects)
    return projects if fs.exists(p) else root


def plain_path(c: Column) -> Column:
    """Local file URIs shown as plain paths (``file:/a`` -> ``/a``)."""
    return F.regexp_replace(F.url_decode(c), r"^file:(//)?", "")


def project_from_file(path: Column) -> Column:
    """Project path from a log path (O1.10): up to ``projects/<name>``, else
    the directory without a trailing YYYY/MM/DD, else the directory."""
    d = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    parts = F.split(d, "/")
    n = F.size(parts)
    idx = F.array_position(parts, "projects")
    date_tail = ((n >= 3) & F.element_at(parts, -3).rlike(r"^\d{4}$")
                 & F.element_at(parts, -2).rlike(r"^\d{1,2}$") & F.element_at(parts, -1).rlike(r"^\d{1,2}$"))
    return (F.when((idx > 0) & (idx < n), F.array_join(F.slice(parts, 1, (idx + 1).cast("int")), "/"))
            .when(date_tail, F.array_join(F.slice(parts, 1, (n - 3).cast("int")), "/"))
            .otherwise(d))


# ---- scan ------------------------------------------------------------------------

def scan_logs(spark: SparkSession, root: str, modified_within: timedelta | None = None,
              as_of: datetime | None = None, max_files: int | None = None,
              paths: list[str] | None = None, skip_unreadable: bool = False,
              files: DataFrame | None = None) -> DataFrame:
    """Raw lines ``(line, source_file, file_block_start, file_mtime, line_seq)``.

    ``modified_within`` prunes files at listing time (``modifiedAfter``);
    ``max_files`` keeps the newest N files by modification time (O1.3, O1.4);
    ``files`` (rows of ``file_manifest``) are the files to read instead of all.
    A read error ends the job unless ``skip_unreadable`` lets Spark leave out
    the rest of such a file.  Lines end at a newline only, as in the logs'
    definition; a carriage return is white space.
    """
    uri = in_tasks(spark, resolve_root(spark, root)) if paths is None else None
    if uri:
        from meterline.session import materialize_checkpoint
        listed = files if files is not None else file_manifest(spark, uri, modified_within, as_of)
        if max_files:
            listed = listed.orderBy(F.desc("modification_time"), "path").limit(max_files)
        listed = materialize_checkpoint(listed.select("path", "modification_time", "length"))
        n, size = listed.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
        return read_files(listed, uri, tasks_for(spark, n, size), skip_unreadable)
    reader = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", JSONL_GLOB)
              .option("lineSep", "\n").option("ignoreMissingFiles", str(skip_unreadable).lower())
              .option("ignoreCorruptFiles", str(skip_unreadable).lower()))
    if modified_within is not None:
        cutoff = (as_of or datetime.utcnow()) - modified_within
        reader = reader.option("modifiedAfter", cutoff.strftime("%Y-%m-%dT%H:%M:%S"))
    if paths is None:
        base = resolve_root(spark, root)
        if max_files:
            newest = (file_manifest(spark, base, modified_within, as_of)
                      .orderBy(F.desc("modification_time"), "path").limit(max_files))
            # the parameter bounds this list, not the data
            paths = [r.path for r in newest.select("path").collect()]
            if not paths:
                return _empty_lines(spark)
        else:
            paths = [base]
    # line order inside a split is the read order: the id grows with it and
    # never needs a shuffle; (source_file, file_block_start, line_seq) sorts lines
    lines = reader.text(paths).select(
        F.col("value").alias("line"),
        plain_path(F.col("_metadata.file_path")).alias("source_file"),
        F.col("_metadata.file_block_start").alias("file_block_start"),
        F.col("_metadata.file_modification_time").alias("file_mtime"),
        F.monotonically_increasing_id().alias("line_seq"))
    return lines if files is None else lines.join(files.select(F.col("path").alias("source_file")), "source_file", "left_semi")


def _empty_lines(spark):
    return spark.createDataFrame([], "line string, source_file string, file_block_start bigint, "
                                     "file_mtime timestamp, line_seq bigint")


def file_manifest(spark: SparkSession, root: str, modified_within: timedelta | None = None,
                  as_of: datetime | None = None) -> DataFrame:
    """``(path, modification_time, length)`` of every log file, without reading
    any content (O8.1)."""
    uri = in_tasks(spark, root)
    if uri:
        found = list_files(spark, uri)
        if modified_within is not None:
            cutoff = ((as_of or datetime.utcnow()) - modified_within).strftime("%Y-%m-%d %H:%M:%S")
            found = found.where(F.col("modification_time") > F.lit(cutoff).cast("timestamp"))
        return found
    reader = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
              .option("pathGlobFilter", JSONL_GLOB))
    if modified_within is not None:
        cutoff = (as_of or datetime.utcnow()) - modified_within
        reader = reader.option("modifiedAfter", cutoff.strftime("%Y-%m-%dT%H:%M:%S"))
    return reader.load(root).select(plain_path(F.col("path")).alias("path"),
                                    F.col("modificationTime").alias("modification_time"),
                                    F.col("length").alias("length"))


# ---- strict JSON access --------------------------------------------------------------
# Every field is pulled out of the VARIANT once, as a struct of small
# VARIANT values; a non-object record (array, scalar) does not cast and
# gives NULL.  Type checks then look at each small value's schema, so a JSON
# string is never taken for a number or the other way round.

TOP = ("struct<id:variant,timestamp:variant,type:variant,sessionId:variant,session_id:variant,"
       "requestId:variant,model:variant,project_path:variant,block_type:variant,cost:variant,costUSD:variant,"
       "customTitle:variant,agentName:variant,usage_limit_reset_time:variant,"
       "cache_creation_input_tokens:variant,cache_read_input_tokens:variant,message:variant>")
MESSAGE = "struct<id:variant,model:variant,usage:variant>"
USAGE = ("struct<input_tokens:variant,output_tokens:variant,cache_creation_input_tokens:variant,"
         "cache_read_input_tokens:variant>")


def _struct_of(c: Column, ddl: str) -> Column:
    return F.try_variant_get(c, "$", ddl)


def _kind(c: Column) -> Column:
    return F.schema_of_variant(c)


def _str(c: Column) -> Column:
    """The value when it is a JSON string, else NULL."""
    return F.when(_kind(c) == "STRING", F.try_variant_get(c, "$", "string"))


def _num(c: Column) -> Column:
    """The value when it is a JSON number, as double, else NULL."""
    k = _kind(c)
    return F.when(k.isin(*_NUMBER_TYPES) | k.startswith("DECIMAL"), F.try_variant_get(c, "$", "double"))


def _int(c: Column) -> Column:
    """JSON number truncated toward zero, like an int conversion."""
    return c.try_cast("bigint")


def parse_time(ts_value: Column) -> Column:
    """RFC3339 string, or Unix seconds as a number (truncated) (O1.8)."""
    s = _str(ts_value)
    n = _num(ts_value)
    return F.coalesce(F.when(s.rlike(RFC3339_RE), s.try_cast("timestamp")),
                      F.when(n.isNotNull(), F.timestamp_seconds(_int(n))))


# ---- parse ------------------------------------------------------------------------------

def parse_narrow(lines: DataFrame) -> DataFrame:
    """One narrow row per line: ``kind`` is 'entry', 'name', 'reject' or
    'blank'; entry fields, name fields, reject reason (with the raw line for
    rejects only) and the line's file-order timestamp candidate.  Nothing
    wide (the raw JSON, the VARIANT) leaves this projection; blank lines keep
    only their position, which the file order needs."""
    v = F.try_parse_json(F.col("line"))
    # one pass over the text: blank lines stay (their position counts for the
    # file order) but are never parsed
    is_blank = ~F.col("line").rlike(r"\S")
    x = lines.select("line", "source_file", "file_block_start", "line_seq", is_blank.alias("_blank"),
                     F.when(~is_blank, _struct_of(v, TOP)).alias("r"))
    r = F.col("r")
    m = _struct_of(r["message"], MESSAGE)
    x = x.select("*", m.alias("m"))
    x = x.select("*", _struct_of(F.col("m")["usage"], USAGE).alias("u"))
    m, u = F.col("m"), F.col("u")
    x = x.select(
        "*",
        _str(r["type"]).alias("_type"),
        _num(u["input_tokens"]).alias("_in"),
        _num(u["output_tokens"]).alias("_out"),
        parse_time(r["timestamp"]).alias("_ts"),
        F.coalesce(_str(m["model"]), _str(r["model"])).alias("_model"),
        _str(r["timestamp"]).alias("_ts_str"))
    is_title = F.coalesce(F.col("_type") == "custom-title", F.lit(False))
    is_agent = F.coalesce(F.col("_type") == "agent-name", F.lit(False))
    reason = (F.when(F.col("_blank"), F.lit(None).cast("string"))
              .when(r.isNull(), F.lit("malformed_json"))
              .when(is_title | is_agent, F.lit(None).cast("string"))
              .when(F.col("_in").isNotNull() & F.col("_out").isNotNull(),
                    F.when(F.col("_ts").isNull() | (F.year("_ts") < 2020), F.lit("invalid_time"))
                    .when(F.col("_model") == "<synthetic>", F.lit("synthetic")))
              .when(m.isNull(), F.lit("missing_message"))
              .when(u.isNull(), F.lit("missing_usage"))
              .when(u["input_tokens"].isNull(), F.lit("missing_input_tokens"))
              .when(F.col("_in").isNull(), F.lit("input_tokens_not_number"))
              .when(u["output_tokens"].isNull(), F.lit("missing_output_tokens"))
              .otherwise(F.lit("output_tokens_not_number")))
    x = x.select("*", reason.alias("reject_reason"))
    kind = (F.when(F.col("_blank"), F.lit("blank"))
            .when(F.col("reject_reason").isNotNull(), F.lit("reject"))
            .when(is_title | is_agent, F.lit("name")).otherwise(F.lit("entry")))
    x = x.select("*", kind.alias("kind"))
    entry = F.col("kind") == "entry"

    def ef(c):
        return F.when(entry, c)

    cc_n = _num(u["cache_creation_input_tokens"])
    cr_n = _num(u["cache_read_input_tokens"])
    cc = F.coalesce(_int(cc_n), _int(_num(r["cache_creation_input_tokens"])))
    cr = F.coalesce(_int(cr_n), _int(_num(r["cache_read_input_tokens"])))
    in_i, out_i = _int(F.col("_in")), _int(F.col("_out"))
    # total counts nested cache tokens only; flat ones are kept in the cache columns
    total = in_i + out_i + F.coalesce(_int(cc_n), F.lit(0)) + F.coalesce(_int(cr_n), F.lit(0))
    logged = F.coalesce(_num(r["cost"]), _num(r["costUSD"]))
    counted = ~F.coalesce(((F.col("reject_reason") == "missing_usage") & F.col("_type").isin("user", "summary"))
                          | ((F.col("reject_reason") == "missing_message") & (F.col("_type") == "summary"))
                          | F.col("reject_reason").isin("invalid_time", "synthetic"), F.lit(False))
    return x.select(
        "kind", "source_file", "file_block_start", "line_seq",
        F.when(F.col("_ts_str").rlike(RFC3339_RE),
               F.col("_ts_str").try_cast("timestamp")).alias("_first_ts_candidate"),
        ef(_str(r["id"])).alias("entry_id"),
        ef(F.col("_ts")).alias("ts"),
        ef(F.coalesce(blank_to_null(_str(r["project_path"])), project_from_file(F.col("source_file"))))
        .alias("project_path"),
        ef(F.col("_model")).alias("model"),
        ef(in_i).alias("input_tokens"), ef(out_i).alias("output_tokens"),
        ef(cc).alias("cache_create_tokens"), ef(cr).alias("cache_read_tokens"),
        ef(total).alias("total_tokens"),
        ef(F.coalesce(logged, F.lit(0.0)).cast("decimal(38,12)")).alias("logged_cost"),
        F.when(entry, F.coalesce(_str(r["session_id"]), _str(r["sessionId"])))
        .when(F.col("kind") == "name", _str(r["sessionId"])).alias("session_id"),
        ef(_str(r["block_type"])).alias("block_type"),
        ef(_str(m["id"])).alias("message_id"),
        ef(_str(r["requestId"])).alias("request_id"),
        ef(_str(r["usage_limit_reset_time"])).alias("usage_limit_reset_time"),
        F.when(is_title, F.lit("title")).when(is_agent, F.lit("agent")).alias("name_kind"),
        F.when(is_title, _str(r["customTitle"])).when(is_agent, _str(r["agentName"])).alias("name"),
        "reject_reason",
        F.when(F.col("kind") == "reject", counted).alias("counted"),
        F.when(F.col("kind") == "reject", F.col("line")).alias("line"))


ENTRY_COLS = ["entry_id", "ts", "project_path", "model", "input_tokens", "output_tokens", "cache_create_tokens",
              "cache_read_tokens", "total_tokens", "logged_cost", "session_id", "block_type", "message_id",
              "request_id", "usage_limit_reset_time", "source_file", "file_first_ts", "file_block_start", "line_seq"]


def split_parsed(parsed: DataFrame) -> dict[str, DataFrame]:
    """``entries`` / ``names`` / ``rejects`` from the narrow parsed lines.

    File order (O1.12): the earliest RFC3339 time of the whole file, one small
    per-file aggregate joined back; the planner chooses the join by its size.
    """
    order = (parsed.where(F.col("_first_ts_candidate").isNotNull())
             .groupBy("source_file").agg(F.min("_first_ts_candidate").alias("file_first_ts")))
    rows = parsed.where(F.col("kind").isin("entry", "name")).join(order, "source_file", "left")
    entries = rows.where(F.col("kind") == "entry").select(*ENTRY_COLS)
    names = rows.where((F.col("kind") == "name") & F.col("session_id").isNotNull() & F.col("name").isNotNull()) \
        .select("session_id", F.col("name_kind").alias("kind"), "name", "source_file", "file_first_ts",
                "file_block_start", "line_seq")
    rejects = parsed.where(F.col("kind") == "reject").select(
        "source_file", "file_block_start", "line_seq", "reject_reason", "counted", "line")
    return {"entries": entries, "names": names, "rejects": rejects}


def parse_lines(lines: DataFrame, materialize_as: str | None = None) -> dict[str, DataFrame]:
    """Split raw lines into ``entries`` (USAGE_ENTRY rows before dedup),
    ``names`` (session-name lines) and ``rejects`` (O1.5-O1.12).

    ``rejects.counted`` tells whether the reference would count the line as a
    parse error (blank lines are not kept at all).  ``entries`` and ``names``
    use the parsed lines twice; ``materialize_as`` (see ``materialize``) parses
    them once.
    """
    return split_parsed(materialize(parse_narrow(lines), materialize_as))


def reject_summary(rejects: DataFrame) -> DataFrame:
    """Per file and reason: count and the first offending line (O1.5)."""
    return (rejects.groupBy("source_file", "reject_reason", "counted")
            .agg(F.count(F.lit(1)).alias("lines"),
                 F.min(F.struct("file_block_start", "line_seq")).alias("first_line"))
            .orderBy("source_file", "reject_reason"))


def finish_usage(parsed: DataFrame, prices: DataFrame | None = None,
                 tz: str = "UTC") -> dict[str, DataFrame]:
    """Narrow parsed lines -> deduplicated, named, priced entries."""
    from meterline.functions.timefns import date_key
    from meterline.operators.dedup import dedup_usage
    from meterline.operators.names import session_names, with_session_name
    from meterline.operators.pricing import with_cost
    parts = split_parsed(parsed)
    names = session_names(parts["names"])
    entries = with_cost(with_session_name(dedup_usage(parts["entries"]), names), prices)
    return {"entries": entries.withColumn("date_key", date_key("ts", tz)), "names": names,
            "rejects": parts["rejects"]}


def materialize(parsed: DataFrame, how: str | None = "checkpoint") -> DataFrame:
    """``checkpoint``: written to the shared ``spark.checkpoint.dir`` (cuts the
    lineage: a lost executor never re-parses text); ``cache``: kept by the
    block manager; None: left lazy."""
    from meterline.session import materialize_checkpoint, session_conf
    if how == "checkpoint":
        # the parser's fused stage is too large for one generated method: the
        # compile would fail and fall back each time, so this one job runs
        # without whole-stage fusion (expressions keep their generated code)
        with session_conf(parsed.sparkSession, spark__sql__codegen__wholeStage="false"):
            return materialize_checkpoint(parsed)
    if how == "cache":
        return parsed.persist()
    return parsed


def load_usage(spark: SparkSession, root: str, prices: DataFrame | None = None, tz: str = "UTC",
               materialize_as: str | None = "checkpoint", **scan_args) -> dict[str, DataFrame]:
    """Scan, parse, deduplicate, name and price logs: the batch entry point.

    The narrow parsed lines are materialized once, so the text is read and
    parsed exactly once for entries, names, rejects and the file order.
    Returns ``entries`` (priced USAGE_ENTRY + cost + session_name +
    date_key), ``names``, ``rejects`` and ``parsed`` (the narrow lines, the
    state an incremental refresh starts from).
    """
    lines = scan_logs(spark, root, **scan_args)
    parsed = materialize(parse_narrow(lines), materialize_as)
    out = finish_usage(parsed, prices, tz)
    out["parsed"] = parsed
    return out
