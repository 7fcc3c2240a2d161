"""Rolling medians against brute force: sparse and dense windows, ties, nulls, hot moments and series."""

import datetime as dt
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerweave.llm import rolling_median
from ledgerweave.llm.common import table

SCHEMA = "click_id long, ts timestamp_ntz, kind string, value double, n long, us long, series string"
START = dt.datetime(2024, 3, 1)
MINUTE = dt.timedelta(minutes=1)


def by_brute_force(rows, window=dt.timedelta(hours=1)):
    once = {}
    for click, ts, kind, value in rows:
        key = (ts is None, ts or START, kind is not None and True, kind or "", value is None, value or 0.0)
        if click not in once or key < once[click][0]:
            once[click] = (key, ts, kind, value)
    series = defaultdict(list)
    for click, (_, ts, kind, value) in once.items():
        if ts is not None:
            cents = math.floor(100 * value + 0.5) if value is not None and abs(value) < 1e15 else None
            series[kind].append((ts, click, cents))
    out = Counter()
    for kind, found in series.items():
        for ts, click, cents in found:
            v = sorted(c for t, _, c in found if ts - window < t <= ts and c is not None)
            n = len(v)
            if n < 2:
                out[click, kind, n, None, None, None] += 1
                continue
            m = v[(n - 1) // 2] + v[n // 2]
            d = sorted(abs(2 * c - m) for c in v)
            mad = d[(n - 1) // 2] + d[n // 2]
            out[click, kind, n, m, mad, None if cents is None else 2 * abs(2 * cents - m) > 3 * mad] += 1
    return out


def check(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)
    got = rolling_median.rolling_medians(df, **options)
    assert got.columns == ["click_id", "kind", "n", "median2", "mad4", "far"]
    assert Counter(map(tuple, got.collect())) == by_brute_force(rows)


def test_given_clicks(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "clicks").select("click_id", "ts", "kind", "value").collect()]
    got = rolling_median.rolling_medians(table(spark, sf_dir, "clicks"))
    assert Counter(map(tuple, got.collect())) == by_brute_force(rows)


def test_awkward_rows(spark):
    far = dt.datetime(9998, 1, 1)
    rows = [
        (1, START, "a", 1.005), (1, START, "a", 1.005), (2, None, "a", 5.0), (3, START, None, 2.0), (4, START, None, None), (5, START, "", -3.0),
        (6, START + 59 * MINUTE, None, 4.0), (7, START + 60 * MINUTE, None, 4.0), (8, START + 60 * MINUTE - dt.timedelta(microseconds=1), None, float("nan")),
        (9, dt.datetime(1960, 1, 1, 0, 0, 0, 7), "a", -0.005), (10, dt.datetime(1960, 1, 1, 0, 59), "a", float("inf")), (11, far, "a", 1e300), (12, far, "a", 9e14), (13, far, "a", -9e14),
        (None, START, "a", 7.0), (None, START, "a", 7.0), (14, START, "a", None), (15, START, "A", 7.0),
    ]
    check(spark, rows)
    assert rolling_median.rolling_medians(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_windows_over_many_blocks(spark, seed):
    """Dense series, so that whole blocks are summed, with hot values, steps in level and hot moments cut between blocks."""
    rng, rows = random.Random(seed), []
    for k in range(1400):
        kind = rng.choice(["hot", "hot", "hot", "b", None])
        minute = rng.uniform(0, 200) if seed < 3 else rng.choice([3.0, 3.0, 20.0, 62.9999, 63.0, 70.5])
        level = 1000.0 if minute > 90 else 10.0
        value = rng.choice([level, level, rng.lognormvariate(1, 2), float(rng.randint(1, 40)), None])
        rows.append((k, START + MINUTE * round(minute, rng.choice([0, 1, 4])), kind, value))
    rows += rng.sample(rows, 60)
    check(spark, rows, block_rows=40, buckets=rng.choice([4, 16, 64]))


def test_dense_windows_use_the_boundary_table(spark, monkeypatch):
    seen = []
    kept = rolling_median.written
    monkeypatch.setattr(rolling_median, "written", lambda df, name: seen.append(name) or kept(df, name))
    rows = [(k, START + dt.timedelta(seconds=7 * k), "a", float(k * 37 % 101)) for k in range(1200)]
    check(spark, rows, block_rows=50, buckets=8)
    assert {"boundary-table", "needed"} <= set(seen)


def test_times_do_not_depend_on_the_session_zone(spark):
    rows = spark.createDataFrame([(dt.datetime(2024, 3, 31, 2, 30, 0, 123456),), (dt.datetime(1969, 12, 31, 23, 59, 59, 999999),)], "ts timestamp_ntz")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        got = [r[0] for r in rows.select(rolling_median.micros(F.col("ts"), rows.schema["ts"].dataType)).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert sorted(got) == [-1, 1711852200123456]
