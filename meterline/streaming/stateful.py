"""Exact live operators over keyed state (O8.4, O8.6, O8.7, O8.9).

Streaming queries in a row, each with a checkpoint of its own:

1. ``land_entries`` parses what has landed and appends the priced entries with
   their load order.
2. ``keep_first`` holds, per (message id, request id), the copy that is first in
   load order.  A copy that arrives late but was loaded earlier takes its
   place: the old copy is retracted (``sign`` -1) and the new one added (+1).
   Entries without either id pass through.  The copy is held by a built-in
   aggregate; a trigger in which a copy is replaced also reads the signed rows
   of the triggers before, for the rows to retract.
3. ``LiveBlocks`` holds, per key, signed sums by time and model, folds the hour
   marks of the keys a trigger touches by the block rule and sends the blocks that
   changed (``entry_count`` 0 for a block that is no more).
4. The signed rows of a trigger, added up per day, session and model, are a run of
   day partials (``runs.py``); daily, monthly and total reports add up the runs.
5. ``live_activity`` holds, per key, how often each time stands there and sends
   the activity sessions that changed.

Blocks and activity sessions are ``keyed.KeyedView``s: their state is a log of runs
laid out by key, of which a trigger reads the folders its keys fall in.

Deltas commute, so any order of arrival and any split into triggers gives the
batch result, and a trigger costs its new lines and the keys they touch, not
the history.  With ``retention`` (seconds) a key forgets the blocks that ended
before its newest entry less the retention; entries older than that come out as
rows of kind ``late``, one per entry, and are never dropped without a trace.
A dedup key keeps its one copy for good, in RocksDB: forgetting it would count
a copy that comes later a second time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterline.operators.blocks import block_assignment
from meterline.operators.common import nonempty
from meterline.operators.partials import (SCHEMA, daily_from_partials, day_partials, merge_partials, monthly_from_partials,
                                          totals_from_partials)
from meterline.operators.pricing import with_cost
from meterline.session import checkpoint_dir, materialize_checkpoint, session_conf
from meterline.sources.growing import grown_lines
from meterline.sources.jsonl import materialize, parse_narrow, split_parsed
from meterline.streaming.keyed import KeyedView
from meterline.streaming.live import landed_lines, with_line_seq
from meterline.streaming.runs import KeyedLog, RunLog

TOKENS = ["input_tokens", "output_tokens", "cache_create_tokens", "cache_read_tokens"]
COSTS = ["cost", "api_cost", "cache_create_cost", "cache_read_cost"]
ORDER = ["file_first_us", "source_file", "file_block_start", "line_seq"]
_ENTRY = ("message_id string, request_id string, file_first_us long, source_file string, file_block_start long, line_seq long, "
          "entry_id string, session_id string, model string, total_tokens long, ts_us long, " +
          ", ".join(f"{c} long" for c in TOKENS) + ", " + ", ".join(f"{c} string" for c in COSTS))
HOUR = 3600 * 10 ** 6
_MARK = "key string, ts_us long, model string, n long, " + ", ".join(f"{c} long" for c in TOKENS) + ", " + \
    ", ".join(f"{c} decimal(38,12)" for c in COSTS)
_SEEN = "key string, newest long, floor long"
_BLOCK = "kind string, key string, start_us long, first_us long, last_us long, entry_count long, " + \
    ", ".join(f"{c} long" for c in TOKENS) + ", " + ", ".join(f"{c} string" for c in COSTS) + ", models array<string>"


def _names(ddl: str) -> list[str]:
    return [column.split()[0] for column in ddl.split(", ")]


_DELTA = "sign int, " + _ENTRY
_TIME = "key string, ts_us long, n long"
_WINDOW = "key string, start_us long, last_us long, n long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def entry_deltas(entries: DataFrame) -> DataFrame:
    """Priced entries as the rows that the stateful operators take."""
    costs = [F.coalesce(c, F.lit(0)).cast("decimal(38,12)").cast("string").alias(c) for c in COSTS]
    return entries.where(F.col("ts").isNotNull()).select(
        "message_id", "request_id", F.unix_micros("file_first_ts").alias("file_first_us"), "source_file", "file_block_start",
        "line_seq", "entry_id", "session_id", "model", F.coalesce("total_tokens", F.lit(0)).cast("long").alias("total_tokens"),
        F.unix_micros("ts").alias("ts_us"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in TOKENS], *costs)


def keep_first(stream: DataFrame) -> DataFrame:
    """Of a stream of :func:`entry_deltas` with the trigger ``epoch`` they landed in:
    per call of a trigger the copy that is first in load order by now, the trigger
    ``landed`` of that copy and the trigger ``since`` of the call's first copy.

    A built-in streaming minimum: the state holds one copy a call and no row of it
    leaves the executors' own state store.  Entries without either id pass through."""
    keyed = F.coalesce(nonempty("message_id") & nonempty("request_id"), F.lit(False))
    place = [F.col("file_first_us").isNull().alias("last"), *ORDER, F.col("epoch").alias("landed")]
    rest = [c for c in _names(_ENTRY) if c not in ("message_id", "request_id", *ORDER)]
    state = stream.where(keyed).groupBy("message_id", "request_id").agg(
        F.min(F.struct(*place, *rest)).alias("first"), F.min("epoch").alias("since"))
    return state.select("message_id", "request_id", "first.*", "since").select(*_names(_ENTRY), "landed", "since").unionByName(
        stream.where(~keyed).select(*_names(_ENTRY), F.col("epoch").alias("landed"), F.col("epoch").alias("since")))


def _own(key: str | None) -> Column:
    """The key of a row's view; None is one key for all."""
    return (F.col(key) if key else F.lit(None)).cast("string").alias("key")


def _summed() -> list[Column]:
    """Sums over signed rows: their number and measures."""
    return [F.sum(c).cast("long").alias(c) for c in ("n", *TOKENS)] + [F.sum(c).cast("decimal(38,12)").alias(c) for c in COSTS]


def merge_marks(rows: DataFrame) -> DataFrame:
    """Signed rows added up per key, time and model.  A sum of no rows may still hold
    the difference of two calls, so it stays unless it is 0 in every measure."""
    return rows.groupBy("key", "ts_us", "model").agg(*_summed()).where(" or ".join(f"{c} != 0" for c in ("n", *TOKENS, *COSTS)))


def marks_of(deltas: DataFrame, key: str | None = "session_id") -> DataFrame:
    """Signed rows as rows of :func:`merge_marks`."""
    def signed(c: Column) -> Column:  # a product of decimals would lose places
        return F.when(F.col("sign") < 0, -c).otherwise(c)

    return deltas.select(
        _own(key), "ts_us", "model", F.col("sign").cast("long").alias("n"), *[signed(F.col(c)).alias(c) for c in TOKENS],
        *[signed(F.col(c).cast("decimal(38,12)")).cast("decimal(38,12)").alias(c) for c in COSTS])


def folded_blocks(marks: DataFrame, hours: int = 5) -> DataFrame:
    """The blocks of all rows of some keys: the batch's fold over two marks an hour."""
    hour, there = F.col("ts_us") - F.expr(f"pmod(ts_us, {HOUR})"), F.col("n") > 0
    hourly = marks.withColumns({"_hs": F.expr("div(ts_us - pmod(ts_us, %d), 1000000)" % HOUR), "_strict": F.col("ts_us") > hour}) \
        .groupBy("key", "_hs", "_strict").agg(
            *_summed(), F.min(F.when(there, F.col("ts_us"))).alias("first_us"), F.max(F.when(there, F.col("ts_us"))).alias("last_us"),
            F.collect_set(F.when(there & (F.col("model") != ""), F.col("model"))).alias("models")).where("n > 0")
    parts = block_assignment(None, hours, "key", hourly=materialize_checkpoint(hourly))
    return parts.groupBy("key", "_block_hs").agg(
        *_summed(), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("models")))).alias("models")).select(
        F.lit("block").alias("kind"), "key", (F.col("_block_hs") * 10 ** 6).alias("start_us"), "first_us", "last_us",
        F.col("n").alias("entry_count"), *TOKENS, *[F.col(c).cast("string").alias(c) for c in COSTS], "models")


class LiveBlocks:
    """Billing blocks kept per key below ``path``: changed blocks (kind ``block``) and
    late entries (kind ``late``) of triggers of signed rows; ``key`` None is the one
    global timeline."""

    def __init__(self, spark: SparkSession, path: str, hours: int = 5, key: str | None = "session_id", retention: float | None = None):
        self.spark, self.key, self.span, self.keep = spark, key, hours * HOUR, None if retention is None else int(retention * 10 ** 6)
        # per key its newest time, and up to which time what it held is forgotten
        self.seen = KeyedLog(spark, f"{path}/seen", _SEEN, lambda rows: rows.groupBy("key").agg(
            F.max("newest").alias("newest"), F.max("floor").alias("floor")))
        log = KeyedLog(spark, f"{path}/marks", _MARK, merge_marks, self._remembered)
        gone = {"kind": F.lit("block"), "first_us": F.lit(None).cast("long"), "last_us": F.lit(None).cast("long"), "entry_count": F.lit(0).cast("long"),
                **{c: F.lit(0).cast("long") for c in TOKENS}, **{c: F.lit("0") for c in COSTS}, "models": F.array().cast("array<string>")}
        self.view = KeyedView(spark, f"{path}/sent", log, _BLOCK, lambda rows: folded_blocks(rows, hours), gone, "entry_count", "kind = 'block'")

    def sent(self) -> DataFrame:
        return self.view.sent().drop("bucket")

    def _with_seen(self, rows: DataFrame, epoch: int, seen: DataFrame | None = None) -> DataFrame:
        """``rows`` with what was known of their key before trigger ``epoch``."""
        seen = (self.seen.read(before=epoch) if seen is None else seen).withColumnRenamed("key", "_key")
        return rows.join(seen, F.col("key").eqNullSafe(F.col("_key")), "left").drop("_key")

    def _remembered(self, rows: DataFrame, epoch: int) -> DataFrame:
        if self.keep is None:
            return rows
        return self._with_seen(rows, epoch).where("floor is null or ts_us > floor").drop("newest", "floor")

    def add(self, deltas: DataFrame, epoch: int) -> None:
        """The signed rows of trigger ``epoch``."""
        if self.keep is None:
            return self.view.add(marks_of(deltas, self.key), epoch)
        rows = materialize_checkpoint(self._with_seen(deltas.withColumn("key", _own(self.key)), epoch).withColumn(
            "_late", F.coalesce(F.col("ts_us") < F.col("newest") - self.keep, F.lit(False))))
        late = rows.where("_late").select(
            F.lit("late").alias("kind"), "key", F.col("ts_us").alias("start_us"), F.col("ts_us").alias("first_us"),
            F.col("ts_us").alias("last_us"), F.col("sign").cast("long").alias("entry_count"), *TOKENS, *COSTS, F.array("model").alias("models"))
        times = rows.where("not _late").groupBy("key").agg(F.max("ts_us").alias("_newest"))
        seen = materialize_checkpoint(self._with_seen(times, epoch).select("key", F.greatest("newest", "_newest").alias("newest"), "floor"))
        done = F.col("newest") - self.keep > F.col("start_us") + self.span  # no entry can reach it
        self.view.add(marks_of(rows.where("not _late"), "key"), epoch, late, lambda changed: self._with_seen(changed, epoch, seen).where(
            ~(F.col("_gone") & F.coalesce(done, F.lit(False)))).drop("newest", "floor"))
        ended = self._with_seen(self.view.now(epoch), epoch, seen).where(done).groupBy("key").agg(
            F.max(F.col("start_us") + self.span).alias("_end"))
        self.seen.add(seen.join(ended.withColumnRenamed("key", "_key"), F.col("key").eqNullSafe(F.col("_key")), "left").select(
            "key", "newest", F.greatest("floor", "_end").alias("floor")), epoch)


def block_view(emitted: DataFrame, hours: int = 5, key: str = "session_id") -> DataFrame:
    """The blocks as of the last trigger, from all emitted rows with ``epoch``."""
    last = emitted.where("kind = 'block'").groupBy("key", "start_us").agg(F.max_by(F.struct("*"), "epoch").alias("b")).select("b.*")
    start = F.timestamp_micros("start_us")
    names = {"input_tokens": "input_tokens", "output_tokens": "output_tokens", "cache_create_tokens": "cache_creation_input_tokens",
             "cache_read_tokens": "cache_read_input_tokens", "cost": "cost_usd", "api_cost": "api_cost_usd",
             "cache_create_cost": "cache_create_cost_usd", "cache_read_cost": "cache_read_cost_usd"}
    return last.where("entry_count > 0").select(
        F.col("key").alias(key), F.date_format(start, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("block_id"), start.alias("start_time"),
        F.timestamp_micros(F.col("start_us") + hours * HOUR).alias("end_time"), F.timestamp_micros("last_us").alias("actual_end_time"),
        F.timestamp_micros("first_us").alias("first_ts"), F.lit(False).alias("is_gap"), "entry_count",
        *[F.col(a).cast("long" if a in TOKENS else "decimal(38,12)").alias(b) for a, b in names.items()],
        sum((F.col(c) for c in TOKENS), F.lit(0)).cast("long").alias("total_tokens"), "models")


def merge_times(rows: DataFrame) -> DataFrame:
    """Signed rows (key, ts_us, n) added up per key and time."""
    return rows.groupBy("key", "ts_us").agg(F.sum("n").cast("long").alias("n")).where("n != 0")


def activity_windows(times: DataFrame, gap: int) -> DataFrame:
    """Activity sessions of all times of some keys: entries at most ``gap``
    microseconds apart.

    Two entries of one bucket of that length always belong together, so the rule
    walks one (first, last, n) per bucket."""
    edges = times.where("n > 0").groupBy("key", F.expr(f"ts_us - pmod(ts_us, {gap})").alias("_bucket")).agg(
        F.min("ts_us").alias("first"), F.max("ts_us").alias("last"), F.sum("n").alias("n"))
    w = Window.partitionBy("key").orderBy("_bucket")
    begins = F.coalesce(F.col("first") - F.lag("last").over(w) > gap, F.lit(True))
    return edges.withColumn("_begins", begins.cast("int")).withColumn("_window", F.sum("_begins").over(w)).groupBy("key", "_window").agg(
        F.min("first").alias("start_us"), F.max("last").alias("last_us"), F.sum("n").cast("long").alias("n")).drop("_window")


def live_activity(spark: SparkSession, path: str, gap_seconds: float = 5 * 3600) -> KeyedView:
    """Activity sessions kept per key below ``path``; it takes rows (key, ts_us, n)."""
    log = KeyedLog(spark, f"{path}/times", _TIME, merge_times)
    gone = {"last_us": F.lit(None).cast("long"), "n": F.lit(0).cast("long")}
    return KeyedView(spark, f"{path}/sent", log, _WINDOW, lambda times: activity_windows(times, int(gap_seconds * 10 ** 6)), gone, "n")


def window_view(emitted: DataFrame, gap_seconds: float = 5 * 3600, key: str = "session_id") -> DataFrame:
    """The activity sessions as of the last trigger, from all emitted rows with ``epoch``."""
    last = emitted.groupBy("key", "start_us").agg(F.max_by(F.struct("*"), "epoch").alias("w")).select("w.*").where("n > 0")
    return last.select(F.col("key").alias(key), F.timestamp_micros("start_us").alias("start_time"),
                       F.timestamp_micros(F.col("last_us") + int(gap_seconds * 10 ** 6)).alias("end_time"), F.col("n").alias("entries"),
                       F.timestamp_micros("start_us").alias("first_ts"), F.timestamp_micros("last_us").alias("last_ts"))


def delta_entries(deltas: DataFrame) -> DataFrame:
    """Signed rows with the columns of entries (time and money)."""
    return deltas.withColumns({"ts": F.timestamp_micros("ts_us"), **{c: F.col(c).cast("decimal(38,12)") for c in COSTS}})


VIEWS = ("blocks", "days", "activity")


class LiveLog:
    """The queries over the logs below ``root``.  ``advance`` runs each over
    everything new and stops; called again it goes on where it stopped, also in
    another session with the same ``name``.

    ``views`` names what is kept up to date beside the entries: ``blocks``;
    ``days``, the day partials that the daily, monthly and total reports add up;
    ``activity``, the activity sessions.  Each view reads the deltas with a
    checkpoint of its own, so one asked for later catches up by itself.

    ``growing``: files may be appended to in place and only the new bytes are read
    (``sources/growing.py``).  The place of a file in load order is its earliest
    time; when an append makes it earlier, the file's keyed entries are sent again
    with their new place, which only ever moves forward."""

    def __init__(self, spark: SparkSession, root: str, name: str | None = None, prices: DataFrame | None = None, hours: int = 5,
                 key: str | None = "session_id", max_files_per_trigger: int | None = None, retention: float | None = None,
                 views: tuple[str, ...] = ("blocks",), tz: str = "UTC", gap_seconds: float = 5 * 3600, growing: bool = False,
                 truncated: str = "fail", max_bytes_per_trigger: int | None = None):
        if set(views) - set(VIEWS):
            raise ValueError(f"views are {VIEWS}")
        self.spark, self.root, self.prices, self.hours, self.key = spark, root, prices, hours, key
        self.growing, self.truncated = growing, truncated
        self.max_bytes = max_bytes_per_trigger
        self.max_files, self.retention, self.views, self.tz, self.gap = max_files_per_trigger, retention, views, tz, gap_seconds
        self.base = f"{checkpoint_dir(spark).rstrip('/')}/meterline-live/{name or uuid.uuid4().hex}"

    def _run(self, stream: DataFrame, name: str, write) -> None:
        with session_conf(self.spark, spark__sql__streaming__stateStore__providerClass=ROCKSDB):
            (stream.writeStream.option("checkpointLocation", f"{self.base}/{name}-checkpoint").outputMode(
                "update" if name == "deltas" else "append").trigger(availableNow=True).foreachBatch(write).start()).awaitTermination()

    def _to(self, name: str, of=lambda rows: rows):
        def write(batch: DataFrame, epoch: int) -> None:
            # a folder per trigger: a retried trigger writes the same files again
            of(batch).write.mode("overwrite").parquet(f"{self.base}/{name}/epoch={epoch}")
        return write

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.base}/{name}")

    def advance(self) -> "LiveLog":
        def landed(batch: DataFrame) -> DataFrame:
            parsed = materialize(parse_narrow(with_line_seq(batch)))
            return entry_deltas(with_cost(split_parsed(parsed)["entries"], self.prices))

        if self.growing:
            lines = grown_lines(self.spark, self.root, f"{self.base}/ranges", f"{self.base}/entries-checkpoint", self.truncated)
            self._run(lines, "entries", self._grown)
        else:
            lines = landed_lines(self.spark, self.root, f"{self.base}/files", f"{self.base}/entries-checkpoint", self.max_files,
                                 self.max_bytes)
            self._run(lines, "entries", self._to("entries", landed))
        landed_in = F.regexp_extract(F.col("_metadata.file_path"), r"/epoch=(\d+)/[^/]*$", 1).cast("long")
        self._run(keep_first(self._read("entries", _ENTRY).withColumn("epoch", landed_in)), "deltas", self._signed)
        deltas = self._read("deltas", _DELTA)
        if "blocks" in self.views:
            self._run(deltas, "blocks-by-key", self._blocks().add)
        if "days" in self.views:
            log = self.day_log()
            self._run(deltas, "days", lambda batch, epoch: log.add(day_partials(delta_entries(batch), self.tz), epoch))
        if "activity" in self.views:
            self._run(deltas, "activity-by-key", lambda batch, epoch: self._activity().add(
                batch.select(_own(self.key), "ts_us", F.col("sign").cast("long").alias("n")), epoch))
        return self

    def _signed(self, batch: DataFrame, epoch: int) -> None:
        """The signed rows of a trigger over :func:`keep_first`."""
        spark, path, upto = batch.sparkSession, f"{self.base}/deltas/epoch={epoch}", f"{self.base}/landed/epoch="
        before = spark.read.schema("landed long").parquet(f"{upto}{epoch - 1}").first().landed if epoch else -1
        batch.where(F.col("landed") > before).withColumn("sign", F.lit(1)).write.mode("overwrite").parquet(path)
        rows = spark.read.schema(_DELTA + ", landed long, since long").parquet(path)
        calls = ["message_id", "request_id"]
        replaced = rows.where(F.col("since") <= before).select(*calls)
        if not replaced.isEmpty():  # a copy that comes late but was loaded earlier: read the rows of triggers before
            held = spark.read.schema(_DELTA + ", epoch long").parquet(f"{self.base}/deltas").where(
                (F.col("epoch") < epoch) & (F.col("sign") > 0)).join(replaced, calls, "left_semi")
            held.groupBy(*calls).agg(F.max_by(F.struct(*[c for c in held.columns if c not in calls]), "epoch").alias("held")) \
                .select(*calls, "held.*").drop("epoch").withColumn("sign", F.lit(-1)).write.mode("append").parquet(path)
        rows.agg(F.coalesce(F.max("landed"), F.lit(before)).cast("long").alias("landed")).write.mode("overwrite").parquet(f"{upto}{epoch}")

    def _grown(self, batch: DataFrame, epoch: int) -> None:
        """The entries of a trigger over growing files."""
        spark, path = batch.sparkSession, f"{self.base}/parsed/epoch={epoch}"
        narrow = parse_narrow(batch)
        narrow.write.mode("overwrite").parquet(path)
        parsed = spark.read.schema(narrow.schema).parquet(path)
        first = parsed.groupBy("source_file").agg(F.min(F.unix_micros("_first_ts_candidate")).alias("first_us"))
        log = RunLog(spark, f"{self.base}/firsts", "source_file string, first_us long",
                     lambda rows: rows.groupBy("source_file").agg(F.min("first_us").alias("first_us")))
        known = log.read(before=epoch).withColumnRenamed("first_us", "known_us")
        log.add(first, epoch)
        entries = split_parsed(parsed)["entries"].drop("file_first_ts").join(log.read(), "source_file", "left") \
            .withColumn("file_first_ts", F.timestamp_micros("first_us")).drop("first_us")
        out = entry_deltas(with_cost(entries, self.prices))
        moved = first.join(known, "source_file").where("first_us < known_us or (known_us is null and first_us is not null)") \
            .select("source_file", "first_us")
        if not moved.isEmpty():  # the rare append with an earlier time: read the entries landed before
            old = spark.read.schema(_ENTRY + ", epoch long").parquet(f"{self.base}/entries").where(F.col("epoch") < epoch)
            again = old.where(nonempty("message_id") & nonempty("request_id")).drop("file_first_us", "epoch") \
                .dropDuplicates(["source_file", "file_block_start", "line_seq"]).join(moved, "source_file") \
                .withColumnRenamed("first_us", "file_first_us")
            out = out.unionByName(again)
        out.write.mode("overwrite").parquet(f"{self.base}/entries/epoch={epoch}")

    def _blocks(self) -> LiveBlocks:
        return LiveBlocks(self.spark, f"{self.base}/blocks-by-key", self.hours, self.key, self.retention)

    def _activity(self) -> KeyedView:
        return live_activity(self.spark, f"{self.base}/activity-by-key", self.gap)

    def day_log(self) -> RunLog:
        return RunLog(self.spark, f"{self.base}/days", SCHEMA, merge_partials)

    def daily(self, with_total: bool = False) -> DataFrame:
        """``reports.daily_report`` of everything landed (view ``days``)."""
        return daily_from_partials(self.day_log().read(), with_total)

    def monthly(self, with_total: bool = False) -> DataFrame:
        """``reports.monthly_report`` of everything landed (view ``days``)."""
        return monthly_from_partials(self.day_log().read(), with_total)

    def totals(self) -> DataFrame:
        """``reports.usage_totals`` of everything landed (view ``days``)."""
        return totals_from_partials(self.day_log().read())

    def activity(self) -> DataFrame:
        """Activity sessions of everything landed (view ``activity``)."""
        return window_view(self._activity().sent().drop("bucket"), self.gap, self.key or "key")

    def kept(self, *cols: str) -> DataFrame:
        """The entries that count now, columns ``cols``: what is left when the
        retractions are taken off."""
        place = ["source_file", "file_block_start", "line_seq"]
        names = list(dict.fromkeys([*cols, *place]))
        return self.deltas().groupBy(*names).agg(F.sum("sign").alias("_n")).where("_n > 0").select(*cols)

    def deltas(self) -> DataFrame:
        return self.spark.read.schema(_DELTA).parquet(f"{self.base}/deltas")

    def emitted(self) -> DataFrame:
        return self._blocks().sent()

    def blocks(self) -> DataFrame:
        return block_view(self.emitted(), self.hours, self.key or "key")

    def late(self) -> DataFrame:
        """Late entries of all triggers: key, time, sign and measures."""
        return self.emitted().where("kind = 'late'")
