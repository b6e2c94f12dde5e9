import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from meterline.operators import blocks as B
from meterline.schema import USAGE_ENTRY
from tests.test_pricing import BASE

T0 = dt.datetime(2024, 3, 1, 0, 0, 0)


def sequential_starts(times, hours):
    """The block rule written as the plain sequential loop."""
    d = dt.timedelta(hours=hours)
    start = last = None
    out = {}
    for t in sorted(times):
        if start is None or t - start > d or t - last > d:
            start = t.replace(minute=0, second=0, microsecond=0)
        last = t
        out[t] = start
    return out


def random_times(rng, n):
    base = T0 + dt.timedelta(days=rng.randint(0, 30))
    out, t = [], base
    for _ in range(n):
        step = rng.choice([0, 1, 59, 3600, 4 * 3600, 5 * 3600, 5 * 3600 + 1, 6 * 3600, rng.randint(0, 40000)])
        t = t + dt.timedelta(seconds=step)
        if rng.random() < 0.2:   # exact hour marks
            t = t.replace(minute=0, second=0, microsecond=0)
        if rng.random() < 0.1:
            t = t + dt.timedelta(microseconds=rng.randint(1, 999))
        out.append(t)
    return sorted(set(out))


def test_fold_equals_sequential_rule(spark):
    rng = random.Random(7)
    rows, expected = [], {}
    for case in range(300):
        hours = rng.choice([1, 2, 5, 7])
        times = random_times(rng, rng.randint(1, 40))
        exp = sequential_starts(times, hours)
        for t in times:
            rows.append((f"c{case}-{hours}", t))
            expected[(f"c{case}-{hours}", t)] = exp[t]
    df = spark.createDataFrame(rows, "case string, ts timestamp")
    df = df.withColumns({"input_tokens": F.lit(1).cast("bigint"), "output_tokens": F.lit(1).cast("bigint"),
                         "cache_create_tokens": F.lit(None).cast("bigint"),
                         "cache_read_tokens": F.lit(None).cast("bigint"), "model": F.lit("m"),
                         "cost": F.lit(0).cast("decimal(38,12)"), "api_cost": F.lit(0).cast("decimal(38,12)"),
                         "cache_create_cost": F.lit(0).cast("decimal(38,12)"),
                         "cache_read_cost": F.lit(0).cast("decimal(38,12)")})
    by_hours = {}
    for (c, t), s in expected.items():
        by_hours.setdefault(int(c.split("-")[1]), []).append((c, t, s))
    for hours, items in by_hours.items():
        cases = {c for c, _, _ in items}
        sub = df.where(F.col("case").isin(*cases))
        got = {(r.case, r.ts): r.block_start for r in B.assign_blocks(sub, hours, "case").collect()}
        for c, t, s in items:
            assert got[(c, t)] == s, (c, t, hours)


def priced(spark, specs):
    rows = []
    for i, (t, cost, api, cc, cr) in enumerate(specs):
        d = {**BASE, "entry_id": f"e{i}", "ts": t, "line_seq": i}
        rows.append(tuple(d[f.name] for f in USAGE_ENTRY.fields))
    df = spark.createDataFrame(rows, USAGE_ENTRY)
    costs = spark.createDataFrame([(f"e{i}", Decimal(str(c)), Decimal(str(a)), Decimal(str(x)), Decimal(str(y)))
                                   for i, (_, c, a, x, y) in enumerate(specs)],
                                  "entry_id string, cost decimal(38,12), api_cost decimal(38,12), "
                                  "cache_create_cost decimal(38,12), cache_read_cost decimal(38,12)")
    return df.join(costs, "entry_id")


def test_block_cost_split(spark):
    # fixed values: two entries 4.0 (2.5/1.0/0.5) and 8.0 (5.0/2.0/1.0) in one block -> 12 / 7.5 / 3 / 1.5
    df = priced(spark, [(T0, 4.0, 2.5, 1.0, 0.5), (T0 + dt.timedelta(minutes=10), 8.0, 5.0, 2.0, 1.0)])
    b = B.identify_blocks(df).collect()
    assert len(b) == 1
    assert (b[0].cost_usd, b[0].api_cost_usd, b[0].cache_create_cost_usd, b[0].cache_read_cost_usd) == (
        Decimal(12), Decimal("7.5"), Decimal(3), Decimal("1.5"))


def test_gap_rows_and_boundaries(spark):
    t1 = T0 + dt.timedelta(minutes=30)
    at_end = T0 + dt.timedelta(hours=5)              # exactly start + 5h: same block
    after = T0 + dt.timedelta(hours=12)              # idle > 5h: new block and a gap
    df = priced(spark, [(t1, 1, 1, 0, 0), (at_end, 1, 1, 0, 0), (after, 1, 1, 0, 0)])
    rows = B.session_blocks(df, 5, None, as_of=None).orderBy("start_time").collect()
    assert [(r.is_gap, r.entry_count) for r in rows] == [(False, 2), (True, 0), (False, 1)]
    gap = rows[1]
    assert gap.start_time == at_end + dt.timedelta(hours=5) and gap.end_time == after
    assert gap.block_id.startswith("gap-")


def test_active_projection_and_limit(spark):
    now = T0 + dt.timedelta(hours=2)
    df = priced(spark, [(T0 + dt.timedelta(minutes=10), 1, 1, 0, 0), (T0 + dt.timedelta(minutes=70), 1, 1, 0, 0)])
    b = B.with_projection(B.with_burn_rate(B.identify_blocks(df, as_of=now)), now)
    r = b.collect()[0]
    assert r.is_active
    assert abs(r.tokens_per_minute - r.total_tokens / 60.0) < 1e-9
    assert r.remaining_minutes == 180.0
    assert r.projected_total_tokens == r.total_tokens + int(r.tokens_per_minute * 180.0)
    s = B.with_limit_status(b, 100).collect()[0]
    assert s.limit_status == ("exceeds" if s.projected_total_tokens > 100 else "ok")
    assert B.max_block_tokens(b).collect()[0].max_tokens == 0   # the only block is active


def test_plan_compresses_before_the_fold(spark):
    df = priced(spark, [(T0, 1, 1, 0, 0)])
    plan = B.identify_blocks(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate" in plan.lower()


def test_block_reset_time_is_last_parseable_value(spark):
    df = priced(spark, [(T0, 1, 1, 0, 0), (T0 + dt.timedelta(minutes=5), 1, 1, 0, 0),
                        (T0 + dt.timedelta(minutes=9), 1, 1, 0, 0)])
    resets = spark.createDataFrame([("e0", "2024-03-01T05:00:00Z"), ("e1", "2024-03-01T06:30:00+01:00"),
                                    ("e2", "not a time")], "entry_id string, usage_limit_reset_time string")
    df = df.drop("usage_limit_reset_time").join(resets, "entry_id")
    b = B.identify_blocks(df).collect()[0]
    assert b.usage_limit_reset_time == dt.datetime(2024, 3, 1, 5, 30)   # e1, in UTC; e2 does not parse
