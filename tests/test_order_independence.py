"""The same input in a different partitioning gives the same results."""

from pyspark.sql import functions as F

from meterline.operators import blocks as B
from meterline.operators import reports as R
from meterline.operators.dedup import dedup_usage
from meterline.operators.pricing import with_cost
from meterline.sources.events_view import VIEW_ORDER, usage_view
from tests.conftest import SF_SMALL


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_dedup_daily_and_blocks_do_not_depend_on_partitioning(spark):
    v = usage_view(spark, SF_SMALL)
    shuffled = v.repartition(7, F.rand(11)).sortWithinPartitions(F.rand(3))
    for frame in (v, shuffled):
        frame.cache()
    a = with_cost(dedup_usage(v, order=VIEW_ORDER))
    b = with_cost(dedup_usage(shuffled, order=VIEW_ORDER))
    assert _rows(a.select("entry_id")) == _rows(b.select("entry_id"))
    assert _rows(R.daily_report(a)) == _rows(R.daily_report(b))
    cols = ["session_id", "block_id", "entry_count", "total_tokens", "cost_usd"]
    assert _rows(B.identify_blocks(a, key="session_id").select(*cols)) == \
        _rows(B.identify_blocks(b, key="session_id").select(*cols))
