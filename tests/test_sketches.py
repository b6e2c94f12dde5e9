from pyspark.sql import functions as F

from meterline.operators import partials as P, reports as R


def facts(spark, sessions):
    """``sessions`` sessions of three entries each over 60 days, some in two months."""
    return spark.range(sessions * 3).select(
        F.expr("timestamp_micros(1704067200000000 + (id % 60) * 86400000000 + id)").alias("ts"),
        F.when(F.col("id") % 50 == 49, F.lit("")).otherwise(F.concat(F.lit("s"), F.col("id") % sessions)).alias("session_id"),
        F.when(F.col("id") % 2 == 0, F.lit("claude-opus-4-20250514")).otherwise(F.lit("claude-sonnet-4-20250514")).alias("model"),
        *[F.lit(i + 1).cast("long").alias(c) for i, c in enumerate(P.TOKENS)],
        *[F.lit("0.25").cast("decimal(38,12)").alias(c) for c in P.COSTS])


def error(approx, exact, key):
    pairs = approx.select(key, F.col("sessions").alias("a")).join(exact.select(key, F.col("sessions").alias("b")), key).collect()
    assert pairs
    return max(abs(r.a - r.b) / r.b for r in pairs)


def rest(df):
    return sorted(map(str, df.drop("sessions").collect()))


def test_estimates_are_within_four_standard_errors(spark):
    x = facts(spark, 60_000).persist()
    for report, key in ((R.daily_report, "date_key"), (R.monthly_report, "month_key")):
        exact, approx = report(x), report(x, approx=True)
        assert 0 < error(approx, exact, key) < 0.052      # estimated, and near
        assert rest(approx) == rest(exact)
    x.unpersist()


def test_reports_from_sketches(spark):
    x = facts(spark, 5_000).persist()
    whole = P.day_sketches(x)
    assert whole.count() == 60  # one model a day here, whatever the sessions
    # sketches of parts of the entries unite to those of all of them
    parts = P.day_sketches(x.where("hash(ts) % 2 = 0")).unionByName(P.day_sketches(x.where("hash(ts) % 2 <> 0")))
    for table in (whole, parts, P.merge_sketches(parts)):
        for build, report in ((P.daily_from_sketches, R.daily_report), (P.monthly_from_sketches, R.monthly_report)):
            got, want = build(table, with_total=True), report(x, with_total=True, approx=True)
            assert rest(got) == rest(want)
            key = "date_key" if report is R.daily_report else "month_key"
            assert error(got.where("not is_total"), report(x), key) < 0.052
    x.unpersist()


def test_no_session_and_no_entry(spark):
    x = facts(spark, 10).withColumn("session_id", F.lit(None).cast("string"))
    assert {r.sessions for r in R.daily_report(x, approx=True).collect()} == {0}
    none = x.where("false")
    assert R.daily_report(none, approx=True).collect() == []
    assert P.monthly_from_sketches(P.day_sketches(none)).collect() == []
