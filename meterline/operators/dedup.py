"""Keep-first deduplication (O3.1, O3.7).

Rows with both a message id and a request id keep only their first copy in
load order; rows missing either key are never deduplicated.

Plan: ``row_number() = 1`` over the key.  Spark keeps only the first row of a
group on the map side as well (its window group limit), so a hot key, a third
of all rows, is one row per map task before the shuffle.  Un-keyed rows must
all survive: each is a group of its own by a row id, so they spread over all
tasks, and the facts are read once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterline.operators.common import nonempty
from meterline.schema import LOAD_ORDER


def keep_first(df: DataFrame, keys: list[str], order: list[str], keyed=None) -> DataFrame:
    keyed = keyed if keyed is not None else F.lit(True)
    group = [F.when(keyed, F.col(k)) for k in keys]
    own = F.when(~keyed, F.monotonically_increasing_id())
    marked = df.withColumns({**{f"_k{i}": g for i, g in enumerate(group)}, "_own": own})
    first = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))], "_own").orderBy(
        *[F.col(c).asc_nulls_last() for c in order])
    return marked.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").select(*df.columns)


def dedup_usage(df: DataFrame, order: list[str] = LOAD_ORDER) -> DataFrame:
    """First copy of every (message_id, request_id) in ``order``."""
    keyed = F.coalesce(nonempty("message_id") & nonempty("request_id"), F.lit(False))
    return keep_first(df, ["message_id", "request_id"], order, keyed)


def merge_projects(frames: list[DataFrame], order: list[str] = LOAD_ORDER) -> DataFrame:
    """Union of per-project entry sets, keep-first on (entry_id, session_id);
    rows missing either are all kept (O3.7)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    keyed = F.coalesce(nonempty("entry_id") & nonempty("session_id"), F.lit(False))
    return keep_first(out, ["entry_id", "session_id"], order, keyed)
