import datetime as dt

import pytest
from pyspark.sql import functions as F

from seriesmill.operators import alignment
from seriesmill.sources import store
from seriesmill.streaming import refresh

D = dt.date


def dates(spark, days, symbol="A"):
    return spark.createDataFrame([(symbol, d, i) for i, d in enumerate(days)], "symbol string, date date, ingest_seq long")


def violations(spark, days):
    return {(r.violation, r.violations, r.examples) for r in alignment.validate_calendar(dates(spark, days)).collect()}


def test_calendar_violations(spark):
    week = [D(2023, 1, 2) + dt.timedelta(days=i) for i in range(5)]
    assert violations(spark, week) == set()
    assert violations(spark, [D(2023, 1, 6), D(2023, 1, 7)]) == {("weekend", 1, "2023-01-07")}
    assert violations(spark, [D(2023, 1, 3), D(2023, 1, 3), D(2023, 1, 4)]) == {("duplicate", 1, "2023-01-03")}
    assert violations(spark, [D(2023, 1, 4), D(2023, 1, 3)]) == {("order", 1, "2023-01-03")}


@pytest.mark.parametrize("piece", [1, 3, 100])
def test_previous_arrival_over_pieces(spark, piece):
    df = spark.createDataFrame([("a", i, i * 10) for i in (0, 1, 5, 6, 12)] + [("b", 3, 7)], "g string, seq long, v long")
    got = {(r.g, r.seq): r.before for r in alignment.previous_arrival(df, "v", "seq", ["g"], "before", piece).collect()}
    assert got == {("a", 0): None, ("a", 1): 0, ("a", 5): 10, ("a", 6): 50, ("a", 12): 60, ("b", 3): None}


def test_align_fills_the_grid(spark):
    days = [D(2023, 1, d) for d in (2, 3, 4, 5)]
    cal = spark.createDataFrame([(d,) for d in days], "date date")
    rows = [("a", D(2023, 1, 3), 1.0), ("a", D(2023, 1, 7), 9.0), ("b", D(2023, 1, 8), 5.0)]
    df = spark.createDataFrame(rows, "symbol string, date date, v double")
    got = {(r.symbol, r.date.day): r.v for r in alignment.calendar_align(df, cal, ["v"]).collect()}
    assert got == {**{("a", d): None for d in (2, 4, 5)}, ("a", 3): 1.0, **{("b", d): None for d in (2, 3, 4, 5)}}


def test_strict_release_on_a_holiday_is_lost(spark):
    cal = spark.createDataFrame([(D(2023, 1, d),) for d in (2, 3, 4)], "date date")
    rel = spark.createDataFrame([(D(2023, 1, 1), 7.0), (D(2023, 1, 3), 8.0)], "date date, value double")
    strict = {r.date.day: r.value for r in alignment.asof_release(cal, rel).collect()}
    known = {r.date.day: r.value for r in alignment.asof_release(cal, rel, strict=False).collect()}
    assert strict == {2: None, 3: 8.0, 4: 8.0} and known == {2: 7.0, 3: 8.0, 4: 8.0}


def test_upsert_rules(spark):
    old = spark.createDataFrame([("a", 1, 10.0, "x"), ("b", 2, 20.0, "y")], "k string, n int, v double, note string")
    new = spark.createDataFrame([("b", 2, None, 1), ("c", 3, 30.0, 2)], "k string, n int, v double, extra int")
    out = {r.k: (r.v, r.note, r.extra) for r in store.upsert_by_key(old, new, ["k", "n"]).collect()}
    assert out == {"a": (10.0, "x", None), "b": (None, "y", 1), "c": (30.0, None, 2)}
    again = store.upsert_by_key(store.upsert_by_key(old, new, ["k", "n"]), new, ["k", "n"])
    assert {r.k: (r.v, r.note, r.extra) for r in again.collect()} == out


def test_first_valid_source_and_report(spark):
    rows = [("s", "p", 1, None), ("s", "q", 1, 5.0), ("t", "p", 1, None), ("t", "q", 1, None)]
    df = spark.createDataFrame(rows, "series string, source string, date int, value double")
    got = {r.series: (r.chosen, r["values"]) for r in store.source_report(df, ["p", "q"]).collect()}
    assert got == {"s": ("q", 1), "t": (None, 0)}
    assert [r.source for r in store.first_valid_source(df, ["p", "q"]).collect()] == ["q"]


def test_enrich_keeps_first_and_renames(spark):
    main = spark.createDataFrame([(1, "m"), (2, "n")], "date int, v string")
    extra = spark.createDataFrame([(1, 5, "late"), (1, 4, "first")], "date int, ingest_seq int, v string")
    out = {r.date: (r.v, r.v_x) for r in store.enrich_left_join(main, {"x": extra}).collect()}
    assert out == {1: ("m", "first"), 2: ("n", None)}


def test_csv_needs_a_schema(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(D(2020, 1, 2), 1.5)], "date date, v double").write.option("header", True).csv(path)
    with pytest.raises(ValueError):
        store.read_feature_table(spark, path, fmt="csv")
    assert store.read_feature_table(spark, path, "date DATE, v DOUBLE", "csv").collect() == [(D(2020, 1, 2), 1.5)]


def _write(spark, path, rows):
    spark.createDataFrame(rows, "symbol string, date date, close double").coalesce(1).write.mode("append").parquet(path)


def test_stream_upsert_is_idempotent(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "store")
    read = lambda: sorted(tuple(r) for r in spark.read.parquet(target).select("symbol", "date", "close").collect())
    stream = lambda n: refresh.stream_upsert(
        spark.readStream.schema("symbol string, date date, close double").parquet(source), target, str(tmp_path / n))
    _write(spark, source, [("a", D(2020, 1, 2), 1.0), ("a", D(2020, 2, 3), 2.0)])
    stream("p1").awaitTermination()
    first = read()
    stream("p2").awaitTermination()  # everything delivered again
    assert read() == first and len(first) == 2
    _write(spark, source, [("a", D(2020, 2, 3), 5.0), ("b", D(2020, 2, 4), 3.0)])
    stream("p1").awaitTermination()
    assert read() == [("a", D(2020, 1, 2), 1.0), ("a", D(2020, 2, 3), 5.0), ("b", D(2020, 2, 4), 3.0)]


def test_stream_refresh_equals_batch(spark, tmp_path):
    def compute(df):
        from seriesmill.functions.columns import Series

        return df.withColumn("m", Series().mean("close", 3)).select(
            "symbol", "date", "m", *[c for c in df.columns if c == "first_date"])

    source = str(tmp_path / "in")
    rows = [("a", D(2020, 1, 1) + dt.timedelta(days=i), float(i * i)) for i in range(60)]
    go = lambda: refresh.stream_feature_refresh(
        spark.readStream.schema("symbol string, date date, close double").parquet(source),
        str(tmp_path / "p"), str(tmp_path / "f"), str(tmp_path / "c"), compute, 3).awaitTermination()
    _write(spark, source, rows[:40])
    go()
    changed = [(s, d, v + 1) for s, d, v in rows[35:]]
    _write(spark, source, changed)
    go()
    want = compute(spark.createDataFrame(rows[:35] + changed, "symbol string, date date, close double"))
    got = spark.read.parquet(str(tmp_path / "f")).select("symbol", "date", "m")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.filter(F.col("m").isNull()).count() == 2
