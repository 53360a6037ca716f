"""The helpers for large groups, with one vessel holding most rows."""

import random
from datetime import timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helmtrace.operators import cleaning as C
from helmtrace.operators import sequences as S
from helmtrace.operators import spread as X
from helmtrace.operators import tracks as K
from helmtrace.operators import layers as L
from tests.helpers import at, ping, table


@pytest.fixture(scope="module")
def busy(spark):
    rng = random.Random(3)
    rows, start = [], at("2024-01-01 00:00:00")
    for mmsi, n in ((1, 900), (2, 40), (3, 1)):
        t = start
        for _ in range(n):
            t += timedelta(seconds=rng.choice([20, 600, 3600, 6 * 3600, 6 * 3600 + 1, 9 * 3600]))
            sog = rng.choice([None, 1.0, 5.0, 7.5])
            rows.append(ping(mmsi, t, lat=rng.uniform(-5, 5), lon=rng.uniform(-5, 5), sog=sog, cog=rng.uniform(0, 360)))
    df = table(spark, rows).persist()
    return df, df.toPandas().sort_values(["MMSI", "BaseDateTime"]).reset_index(drop=True)


def test_previous_and_position(busy):
    df, pdf = busy
    got = X.add_previous(df, ["MMSI"], ["LAT", "SOG"], position="k", counted="SOG")
    got = got.select("MMSI", "BaseDateTime", "k", F.col("prev.LAT").alias("p"), F.col("prev.SOG").alias("s")).toPandas()
    got = got.sort_values(["MMSI", "BaseDateTime"]).reset_index(drop=True)
    by = pdf.groupby("MMSI")
    pd.testing.assert_series_equal(got["p"], by["LAT"].shift(), check_names=False)
    pd.testing.assert_series_equal(got["s"], by["SOG"].shift(), check_names=False)
    want = pdf["SOG"].notna().groupby(pdf["MMSI"]).cumsum() - 1
    assert (got["k"].dropna() == want[pdf["SOG"].notna()]).all() and got["k"].isna().sum() == pdf["SOG"].isna().sum()


def test_segments_partition_the_pings(busy):
    df, pdf = busy
    gap = pdf.groupby("MMSI")["BaseDateTime"].diff() > pd.Timedelta(hours=6)
    pdf = pdf.assign(seg=gap.groupby(pdf["MMSI"]).cumsum())
    size = pdf.groupby(["MMSI", "seg"])["BaseDateTime"].agg(["size", lambda t: (t.max() - t.min()) / pd.Timedelta(hours=1)])
    size.columns = ["n", "h"]
    ok = size[(size.n >= 2) & (size.h >= 1)].reset_index()
    want = pdf.merge(ok[["MMSI", "seg"]], on=["MMSI", "seg"])
    got = K.segment_tracks(df).select("MMSI", "BaseDateTime", "segment_id").toPandas()
    assert len(got) == len(want)
    merged = got.merge(want, on=["MMSI", "BaseDateTime"])
    assert (merged["segment_id"] == merged["seg"]).all()


def test_gap_of_exactly_the_limit_does_not_split(spark):
    rows = table(spark, [ping(1, "2024-01-01 00:00:00"), ping(1, "2024-01-01 06:00:00"), ping(1, "2024-01-01 12:00:01")])
    assert [(r.points, r.segment_id) for r in K.track_segments(rows).collect()] == [(2, 0)]
    assert K.detect_gaps(rows).select("start_index", "end_index").collect() == [(1, 2)]


def test_nearest_ping(spark, busy):
    df, pdf = busy
    rng = random.Random(8)
    asks = [ping(rng.choice([1, 2, 3, 4]), at("2023-12-31") + timedelta(minutes=rng.randint(0, 400000))) for _ in range(200)]
    asks += [ping(1, None, day=at("2024-01-01").date())]
    got = L.nearest_ping(table(spark, asks), df).select("MMSI", "BaseDateTime", F.col("match.ts").alias("ts")).collect()
    assert len(got) == len(asks)
    for r in got:
        own = pdf[pdf["MMSI"] == r.MMSI]["BaseDateTime"]
        if own.empty:
            assert r.ts is None
        elif r.BaseDateTime is None:
            assert r.ts == own.min()
        else:
            assert abs(r.ts - r.BaseDateTime) == (own - r.BaseDateTime).abs().min()


@pytest.mark.parametrize("bins", [4, 256])
def test_exact_percentiles(spark, bins):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"k": rng.choice(["a", "b", "c"], 3000, p=[0.8, 0.19, 0.01]), "v": np.where(rng.random(3000) < 0.4, 7.0, rng.lognormal(3, 3, 3000))})
    frame.loc[len(frame)] = ["d", 5.0]
    qs = {"lo": 0.0, "q1": 0.25, "md": 0.5, "p95": 0.95, "hi": 1.0}
    df = spark.createDataFrame(frame)
    got = X.exact_percentiles(df, ["k"], "v", qs, bins).toPandas().set_index("k")
    for key, part in frame.groupby("k"):
        np.testing.assert_allclose(got.loc[key, list(qs)].astype(float), np.quantile(part["v"], list(qs.values())), rtol=1e-12)
    whole = X.exact_percentiles(df, [], "v", qs, bins).toPandas().iloc[0]
    np.testing.assert_allclose(whole.astype(float), np.quantile(frame["v"], list(qs.values())), rtol=1e-12)


def test_global_rank_and_split(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000003 + 300000000).alias("MMSI"), F.lit(0).alias("segment_id"), "id").withColumnRenamed("id", "window_no")
    ranked = X.global_rank(rows, [], F.floor(F.col("MMSI") / 1000), ["MMSI"]).orderBy("MMSI").collect()
    assert [r["rank"] for r in ranked] == list(range(1, 1001))
    parts = {r.split: r["count"] for r in S.split_sequences(rows).groupBy("split").count().collect()}
    assert parts == {"train": 700, "validation": 150, "test": 150}
    first = S.split_sequences(rows).filter("split = 'train'").select("MMSI")
    again = S.split_sequences(rows.repartition(7)).filter("split = 'train'").select("MMSI")
    assert first.exceptAll(again).count() == 0
    with pytest.raises(ValueError):
        S.split_sequences(rows, 0.5, 0.1, 0.1)


def test_dedup_is_idempotent(spark):
    rows = table(spark, [ping(1, "2024-01-01", lat=x) for x in (3.0, 1.0, 2.0, None)] + [ping(2, "2024-01-01")])
    once = C.dedup_pings(rows)
    assert sorted((r.MMSI, r.LAT) for r in once.filter("MMSI = 2").collect()) == [(2, 10.0)]
    assert once.count() == 2 and C.dedup_pings(once).exceptAll(once).count() == 0


def test_recent_window_needs_two(spark):
    rows = table(spark, [ping(1, "2024-01-01 00:00:00"), ping(1, "2024-01-02 00:00:00"), ping(1, "2024-01-02 00:00:01"), ping(2, "2024-01-01"), ping(3, "2024-01-01"), ping(3, "2024-01-05")])
    got = C.recent_window(rows).orderBy("BaseDateTime").collect()
    assert [(r.MMSI, r.BaseDateTime.day) for r in got] == [(1, 2), (1, 2)]


def test_long_tracks_keep_their_slide_and_all_windows(spark):
    # 800 hourly pings: 130 windows of 24 hours fit at a slide of six.
    rows = table(spark, [ping(1, at("2024-01-01") + timedelta(hours=i)) for i in range(800)])
    starts = S.window_starts(K.segment_tracks(rows)).first()
    assert (starts.slide_hours, starts.windows) == (6, 130)
    short = table(spark, [ping(1, at("2024-01-01") + timedelta(hours=i)) for i in range(10)])
    assert S.training_sequences(short)[0].count() == 0


def test_a_vessel_that_reports_every_two_minutes_keeps_its_sequences(spark):
    rows = [ping(1, at("2024-01-01") + timedelta(minutes=2 * i), lat=10 + i / 1e4) for i in range(30 * 96)]
    seqs, points = S.training_sequences(table(spark, rows))
    assert {r.length for r in seqs.collect()} == {720}
    per_window = points.groupBy("window_no").agg(F.count("*").alias("n"), F.max("position").alias("last")).collect()
    assert {(r.n, r.last) for r in per_window} == {(720, 719)}
    assert seqs.count() == len(per_window) == 12


def test_fast_rows_are_left_out_of_tracks_of_any_length(spark):
    rows = [ping(1, at("2024-01-01") + timedelta(hours=i), sog=150.0 if i == 3 else 5.0) for i in range(40)]
    seqs, points = S.training_sequences(table(spark, rows))
    assert seqs.filter("window_no = 0").first().length == 23
    assert points.filter("sog > 100").count() == 0


def test_sequences_without_measurement_columns(spark):
    rows = table(spark, [ping(1, at("2024-01-01") + timedelta(hours=i), lat=10 + i / 100) for i in range(60)]).drop("SOG", "COG", "Heading")
    seqs, points = S.training_sequences(rows)
    assert seqs.count() > 0 and seqs.filter("target_sog IS NOT NULL").count() == 0
    assert [c for c in points.columns if c in S.FEATURES] == ["lat", "lon"]
    assert S.sequence_matrix(points).first().feature_columns == ["lat", "lon"]
    assert K.track_features(K.segment_tracks(rows, walk=True)).first().points == 60
    assert C.filter_outliers(K.segment_tracks(rows), keys=K.TRACK).count() == 60


def test_windows_of_one_huge_vessel_join_by_time_chunk(spark):
    rows = table(spark, [ping(1, at("2024-01-01") + timedelta(hours=i)) for i in range(100)])
    text = S.window_points(K.segment_tracks(rows))._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in text.splitlines() if "Join" in line and "segment_id" in line]
    assert joins and all("time_chunk" in line for line in joins)


def test_batches_stay_even_where_vessel_numbers_are_dense(spark):
    rows = spark.range(5000).select((F.col("id") % 3 + 366000000).alias("MMSI"), F.lit(0).cast("long").alias("segment_id"), F.col("id").alias("window_no"), F.lit(5).cast("long").alias("length"))
    got = S.length_batches(rows).groupBy("batch").count()
    assert got.count() == 157 and got.filter("count > 32").count() == 0
