import datetime as dt
import os
import tempfile

from meterline.operators import blocks as B
from meterline.sinks.reports import (blocks_csv_rows, blocks_json_rows, entries_csv_rows, write_csv, write_json,
                                     write_usage_table)
from meterline.functions.timefns import date_key
from tests.test_blocks import priced

T0 = dt.datetime(2024, 3, 1, 9, 30, 0)


def test_entries_csv_columns_and_format(spark):
    df = priced(spark, [(T0, 1.2345675, 1, 0, 0)])
    rows = entries_csv_rows(df)
    assert rows.columns == ["timestamp", "model", "project_path", "input_tokens", "output_tokens", "total_tokens",
                            "cost", "session_id", "block_type"]
    r = rows.collect()[0]
    assert r.timestamp == "2024-03-01T09:30:00Z" and r.cost == "1.234568"
    out = os.path.join(tempfile.mkdtemp(prefix="meterline-csv-"), "entries")
    write_csv(rows, out, single_file=True)
    text = open([os.path.join(out, f) for f in os.listdir(out) if f.endswith(".csv")][0]).read().splitlines()
    assert text[0].startswith("timestamp,model,project_path") and len(text) == 2


def test_blocks_csv_and_json(spark):
    df = priced(spark, [(T0, 4, 2.5, 1, 0.5), (T0 + dt.timedelta(minutes=10), 8, 5, 2, 1)])
    blocks = B.session_blocks(df, 5, None, as_of=T0 + dt.timedelta(hours=1))
    c = blocks_csv_rows(blocks).collect()[0]
    assert c["Block ID"] == "2024-03-01T09:00:00Z" and c["Cost (USD)"] == "12.00" and c["Is Active"] == "true"
    full = B.with_limit_status(B.with_projection(B.with_burn_rate(blocks), T0 + dt.timedelta(hours=1)), 1000)
    j = blocks_json_rows(full).collect()[0]
    assert j.token_counts.input_tokens == 200 and j.burn_rate is not None and j.projection is not None
    out = os.path.join(tempfile.mkdtemp(prefix="meterline-json-"), "blocks")
    write_json(blocks_json_rows(full), out)
    assert spark.read.json(out).count() == 1


def test_usage_table_partitions_by_day(spark):
    df = priced(spark, [(T0, 1, 1, 0, 0), (T0 + dt.timedelta(days=1), 1, 1, 0, 0)]).withColumn("date_key",
                                                                                               date_key("ts"))
    out = os.path.join(tempfile.mkdtemp(prefix="meterline-table-"), "t")
    write_usage_table(df, out)
    assert sorted(d for d in os.listdir(out) if d.startswith("date_key=")) == ["date_key=2024-03-01",
                                                                              "date_key=2024-03-02"]
    plan = spark.read.parquet(out).where("date_key = '2024-03-01'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan or "date_key" in plan
