"""Usage store refreshed by affected keys (O8.1, O8.2, O7.3).

The store is a folder of append-only tables and one commit file a refresh:

* ``parsed/gen=G/kind=K``: the narrow parsed lines of the files read by refresh G;
* ``files/G``: per live file its manifest line, its earliest time and the refresh
  (``gen``) whose lines count.  Lines of any other ``gen`` of a file are dead;
* ``facts/v=G/day=D``: the deduplicated entries of the UTC day D as refresh G left them;
* ``commits/G``: which ``v`` counts for each day, and from which ``gen`` on lines count.

A refresh parses new and changed files only.  The dedup keys of their lines,
and of the lines they had before, are the affected keys; only these are
deduplicated again, and only days whose entries differ are written anew.  The
result equals a full load.  Nothing is changed in place: a refresh that dies
leaves no commit, its tables are written over by the next one, and readers of
the commit before are not disturbed.  One writer at a time.

The driver holds one entry per calendar day that has entries, never a file list.
Of the files on disk, only new and changed ones are opened (where Spark's text
source reads them: those not older than the oldest of these).  Looking up the affected keys reads the stored lines as columns, without
shuffling them as long as the keys are few.
"""

from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.functions.timefns import date_key
from meterline.operators.common import nonempty
from meterline.operators.dedup import dedup_usage
from meterline.operators.names import session_names, with_session_name
from meterline.operators.pricing import with_cost
from meterline.schema import LOAD_ORDER
from meterline.session import materialize_checkpoint, session_conf
from meterline.sources.jsonl import ENTRY_COLS, parse_narrow, resolve_root, scan_logs
from meterline.streaming.refresh import files_to_read, manifest, manifest_diff

FILES_SCHEMA = "path string, modification_time timestamp, length long, file_first_ts timestamp, gen long"
OWN = "\u0000"


def dedup_key() -> F.Column:
    """One string per dedup key; entries without a key share that of their file."""
    keyed = F.coalesce(nonempty("message_id") & nonempty("request_id"), F.lit(False))
    return F.when(keyed, F.concat_ws(OWN, "message_id", "request_id")).otherwise(F.concat(F.lit(OWN), "source_file"))


class UsageStore:
    """Deduplicated usage facts of a log folder, kept under ``path``.

    ``refresh()`` brings them to the present state of ``root`` and returns what
    it did: ``diff`` (one row per file), ``days`` rewritten and ``changed``.
    Opening the same ``path`` again goes on from its last commit."""

    def __init__(self, spark: SparkSession, root: str, path: str):
        self.spark, self.root, self.path = spark, resolve_root(spark, root), path.rstrip("/")
        self.gen, self.since, self.days, self._parsed_schema = 0, 0, {}, None
        last = self._last_commit()
        if last:
            self.gen, self.since, self.days, self._parsed_schema = last["gen"], last["since"], last["days"], last["parsed"]

    # ---- commits ---------------------------------------------------------------

    def _fs(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _last_commit(self) -> dict | None:
        fs, p = self._fs("commits")
        if not fs.exists(p):
            return None
        gens = [int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit()]
        if not gens:
            return None
        text = self.spark.read.option("wholetext", "true").text(f"{self.path}/commits/{max(gens)}").first()
        return json.loads(text.value)

    def _commit(self, gen: int, days: dict[str, int], since: int) -> None:
        """The commit file appears whole under its name or not at all."""
        fs, new = self._fs(f"commits/.{gen}.writing")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps({"gen": gen, "since": since, "days": days, "parsed": self._parsed_schema}).encode()))
        out.close()
        _, done = self._fs(f"commits/{gen}")
        if not fs.rename(new, done):
            raise RuntimeError(f"refresh {gen} of {self.path} was committed by another writer")
        self.gen, self.since, self.days = gen, since, days

    # ---- tables ----------------------------------------------------------------

    def files(self) -> DataFrame:
        """Live files with their manifest line and earliest time."""
        if not self.gen:
            return self.spark.createDataFrame([], FILES_SCHEMA)
        return self.spark.read.schema(FILES_SCHEMA).parquet(f"{self.path}/files/{self.gen}")

    def _lines(self, kind: str, upto: int) -> DataFrame:
        """Stored lines of a kind, dead ones too, of refreshes up to ``upto``."""
        return self._parsed().where((F.col("kind") == kind) & F.col("gen").between(self.since, upto))

    def _parsed(self) -> DataFrame:
        return self.spark.read.schema(self._parsed_schema).parquet(f"{self.path}/parsed")

    def live_lines(self, kind: str) -> DataFrame:
        """Lines of a kind (entry, name, reject) of the live files, with the
        earliest time of the file."""
        return self._alive(self._lines(kind, self.gen), self.files())

    @staticmethod
    def _alive(lines: DataFrame, files: DataFrame) -> DataFrame:
        return lines.join(files.select(F.col("path").alias("source_file"), "gen", "file_first_ts"), ["source_file", "gen"])

    def facts(self, days: dict[str, int] | None = None) -> DataFrame:
        """Deduplicated entries of the days given (all if none): day folders only."""
        days = self.days if days is None else days
        schema = self._facts_schema()
        if not days:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.path}/facts/v={v}/day={d}" for d, v in sorted(days.items())]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/facts").parquet(*paths) \
            .select(*ENTRY_COLS, "dedup_key", "gen", "day")

    def _facts_schema(self) -> str:
        from meterline.schema import USAGE_ENTRY
        kinds = {f.name: f.dataType.simpleString() for f in USAGE_ENTRY}
        kinds |= {"file_first_ts": "timestamp", "file_block_start": "bigint", "line_seq": "bigint", "source_file": "string"}
        return ", ".join(f"{c} {kinds[c]}" for c in ENTRY_COLS) + ", dedup_key string, gen bigint, day string"

    def entries(self, prices: DataFrame | None = None, tz: str = "UTC") -> DataFrame:
        """Priced, named entries, as ``load_usage`` gives them."""
        named = with_session_name(self.facts().select(*ENTRY_COLS), self.names())
        return with_cost(named, prices).withColumn("date_key", date_key("ts", tz))

    def names(self) -> DataFrame:
        """(session_id, session_name), from the name lines of the live files."""
        if not self.gen:
            return self.spark.createDataFrame([], "session_id string, session_name string")
        rows = self.live_lines("name").where(F.col("session_id").isNotNull() & F.col("name").isNotNull())
        return session_names(rows.drop("kind").withColumnRenamed("name_kind", "kind"))

    # ---- refresh ---------------------------------------------------------------

    def refresh(self) -> dict:
        gen = self.gen + 1
        listing = manifest(self.spark, self.root)
        diff = materialize_checkpoint(manifest_diff(self.files(), listing))
        read = diff.where(F.col("status").isin("new", "changed"))
        n = diff.agg(F.count_if(F.col("status") != "unchanged").alias("changed"),
                     F.min(F.when(F.col("status").isin("new", "changed"), F.unix_micros("new_mtime"))).alias("oldest")).first()
        if not n.changed:
            return {"diff": diff, "days": [], "changed": 0}
        self._append(gen, read, n.oldest)
        files = self._next_files(gen, diff)
        old, new = self._winners(gen, diff, files)
        days = self._rewrite(gen, old, new)
        left = self._written_days(gen) if days else set()
        self._commit(gen, {d: v for d, v in self.days.items() if d not in days} | {d: gen for d in left}, self.since)
        return {"diff": diff, "days": sorted(days), "changed": n.changed}

    def _append(self, gen: int, read: DataFrame, oldest: int | None) -> None:
        """Parse the files to read, the oldest modified at ``oldest`` (micros),
        into ``parsed/gen=G``; with none to read nothing is written."""
        if oldest is None:
            return
        path = f"{self.path}/parsed/gen={gen}"
        at = datetime.fromtimestamp(oldest // 1_000_000 - 2, timezone.utc)
        after = {"modified_within": timedelta(0), "as_of": at} if self.gen else {}
        lines = scan_logs(self.spark, self.root, files=files_to_read(read), **after)
        parsed = parse_narrow(lines)
        # as in materialize(): the parser's fused stage is too large to compile; a task
        # has a file open per kind, so the lines are not sorted by kind first
        with session_conf(self.spark, spark__sql__codegen__wholeStage="false", spark__sql__maxConcurrentOutputFileWriters="8"):
            parsed.write.mode("overwrite").partitionBy("kind").parquet(path)
        self._parsed_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parsed.schema) + ", gen bigint"

    def _next_files(self, gen: int, diff: DataFrame) -> DataFrame:
        first = self._parsed().where((F.col("gen") == gen) & F.col("_first_ts_candidate").isNotNull()) \
            .groupBy("source_file").agg(F.min("_first_ts_candidate").alias("file_first_ts"))
        fresh = diff.where(F.col("status").isin("new", "changed")).select(
            "path", F.col("new_mtime").alias("modification_time"), F.col("new_length").alias("length")) \
            .join(first.withColumnRenamed("source_file", "path"), "path", "left") \
            .withColumn("gen", F.lit(gen).cast("long"))
        same = self.files().join(diff.where("status = 'unchanged'").select("path"), "path", "left_semi")
        out = f"{self.path}/files/{gen}"
        same.unionByName(fresh).write.mode("overwrite").parquet(out)
        return self.spark.read.schema(FILES_SCHEMA).parquet(out)

    def _winners(self, gen: int, diff: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
        """First copies of the affected keys before and after this refresh."""
        key = dedup_key().alias("dedup_key")
        lines = self._lines("entry", gen)
        if not self.gen:  # every key is affected
            won = dedup_usage(self._alive(lines, files).withColumn("dedup_key", key), order=LOAD_ORDER)
            return self.facts({}), self._as_facts(won)
        touched = diff.where("status <> 'unchanged'").select(F.col("path").alias("source_file"))
        keys = materialize_checkpoint(lines.join(touched, "source_file", "left_semi").select(key).distinct())
        hit = lines.withColumn("dedup_key", key).join(keys, "dedup_key", "left_semi")
        new = materialize_checkpoint(self._as_facts(dedup_usage(self._alive(hit, files), order=LOAD_ORDER)))
        old = materialize_checkpoint(self.facts().join(keys, "dedup_key", "left_semi"))
        return old, new

    @staticmethod
    def _as_facts(won: DataFrame) -> DataFrame:
        day = F.coalesce(F.date_format("ts", "yyyy-MM-dd"), F.lit("none"))
        return won.select(*ENTRY_COLS, "dedup_key", F.col("gen").cast("long"), day.alias("day"))

    def _rewrite(self, gen: int, old: DataFrame, new: DataFrame) -> set[str]:
        """Write the days whose entries differ as ``facts/v=G``; returns them."""
        out = f"{self.path}/facts/v={gen}"
        if not self.gen:
            new.hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(out)
            return self._written_days(gen)
        place = ["day", "dedup_key", "source_file", "gen", "file_block_start", "line_seq"]
        signed = old.select(*place, F.lit(-1).alias("s")).unionByName(new.select(*place, F.lit(1).alias("s")))
        # one row per calendar day at most
        days = {r.day for r in signed.groupBy(*place).agg(F.sum("s").alias("s")).where("s <> 0").select("day").distinct().collect()}
        if not days:
            return days
        kept = self.facts({d: v for d, v in self.days.items() if d in days}) \
            .join(old.select("dedup_key").distinct(), "dedup_key", "left_anti")
        rows = kept.unionByName(new.where(F.col("day").isin(*days)).select(*kept.columns))
        rows.hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(out)
        return days

    def _written_days(self, gen: int) -> set[str]:
        fs, p = self._fs(f"facts/v={gen}")
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return {n[len("day="):] for n in names if n.startswith("day=")}

    # ---- upkeep ----------------------------------------------------------------

    def compact(self) -> None:
        """Write the live lines and the facts anew, as one refresh that reads no
        log.  Dead lines are left behind; ``vacuum`` removes them.  Done when dead
        lines outnumber live ones, it costs a constant share of all refreshes."""
        if not self.gen:
            return
        gen = self.gen + 1
        files = self.files()
        mine = files.select(F.col("path").alias("source_file"), "gen")
        self._parsed().where(F.col("gen").between(self.since, self.gen)).join(mine, ["source_file", "gen"], "left_semi") \
            .drop("gen").write.mode("overwrite").partitionBy("kind").parquet(f"{self.path}/parsed/gen={gen}")
        now = F.lit(gen).cast("long")
        files.withColumn("gen", now).write.mode("overwrite").parquet(f"{self.path}/files/{gen}")
        if self.days:
            self.facts().withColumn("gen", now).hint("rebalance", "day") \
                .write.mode("overwrite").partitionBy("day").parquet(f"{self.path}/facts/v={gen}")
        self._commit(gen, {d: gen for d in self.days}, gen)

    def vacuum(self) -> None:
        """Delete tables that the last commit doesn't use.  Data frames of commits
        before can't be read any more."""
        used = {"parsed": lambda g: self.since <= g <= self.gen, "facts": lambda g: g in self.days.values(),
                "files": lambda g: g == self.gen, "commits": lambda g: g == self.gen}
        for table, keep in used.items():
            fs, p = self._fs(table)
            for s in fs.listStatus(p) if fs.exists(p) else ():
                number = s.getPath().getName().rpartition("=")[2]
                if number.isdigit() and not keep(int(number)):
                    fs.delete(s.getPath(), True)
