"""Daily features resumed from states equal those of the whole history."""

from datetime import date, datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from barograph.operators.daily_features import contract_columns, price_features
from barograph.operators.feature_state import kept_days, next_states, resumed_rows
from barograph.schemas import FEATURE_COLUMNS, FEATURE_STATE
from barograph.sources import tables as tb
from barograph.streaming import jobs

START = date(2023, 1, 2)


def _history(n=420, seed=8):
    """Bars of a long symbol, one that begins late, one that never moves for a long time, and a market with holes."""
    rng, rows, market = np.random.default_rng(seed), [], []
    for i in range(n):
        day = START + timedelta(days=i)
        if i % 11 and i > 3:
            market.append((day, float(400 + 30 * np.sin(i / 9) + rng.normal())))
        for s, begin, still in (("AAA", 0, 0), ("LATE", 130, 0), ("FLAT", 0, 60), ("HOLES", 0, 0)):
            if i < begin or (s == "HOLES" and i % 5 == 2):
                continue
            c = 50.0 if i < still else float(np.round(100 * np.exp(0.1 * np.sin(i / 17) + rng.normal(0, 0.02)), 2))
            up, down = (0.0, 0.0) if i < still else np.round(rng.random(2) * 2, 2).tolist()
            rows.append((day, s, c, c + up, c - down, c, int(rng.integers(0, 5000))))
    return rows, market


def _rows(df):
    return {(r.symbol, r.day): [r[c] for c in (*FEATURE_COLUMNS, "maxdd90")] for r in df.collect()}


def _same(got, want, digits=1e-7):
    assert got.keys() == want.keys()
    for key, row in want.items():
        for name, a, b in zip((*FEATURE_COLUMNS, "maxdd90"), got[key], row):
            assert (a is None) == (b is None), (key, name, a, b)
            assert a is None or (a == b) or abs(a - b) <= digits * max(1, abs(b)), (key, name, a, b)


def test_resumed_rows_equal_the_whole_history(spark, tmp_path):
    rows, market = _history()
    adjust = True
    bars = spark.createDataFrame(rows, tb.TABLES["silver.daily_bars"][0])
    bench = spark.createDataFrame(market, "day date, close double")
    want = _rows(price_features(bars, bench, drop_incomplete=False, adjust=adjust))
    got, states = {}, spark.createDataFrame([], FEATURE_STATE)
    cuts = [0, 1, 270, 271, 420]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        span = F.col("day").between(F.lit(START + timedelta(days=a)), F.lit(START + timedelta(days=b - 1)))
        series = resumed_rows(states, bars.where(span), bench.where(span), adjust)
        series.write.parquet(f"{tmp_path}/{k}")
        series = spark.read.parquet(f"{tmp_path}/{k}")
        got |= _rows(contract_columns(series.where("new")))
        fresh = next_states(series, kept_days(series)).unionByName(states.select("day", "symbol", "rn", "carry", "halo"))
        newest = fresh.groupBy("symbol").agg(F.max_by(F.struct("day", "rn", "carry", "halo"), "rn").alias("s")).select("s.day", "symbol", "s.rn", "s.carry", "s.halo")
        states = spark.createDataFrame(newest.collect(), FEATURE_STATE)
    _same(got, want)
    assert all(len(r.halo) == min(r.rn, 252) and (r.carry is None) == (r.rn <= 252) for r in states.collect())


def _silver(spark, rows):
    now = datetime(2024, 9, 1)
    return tb.with_day(spark.createDataFrame(
        [(datetime(d.year, d.month, d.day, 15), s, o, h, low, c, v, 0.0, 0.0, h - low, 0.5, now, now) for d, s, o, h, low, c, v in rows],
        tb.TABLES["silver.market"][0]))


def test_daily_batches_corrections_and_thinning(spark, tmp_path):
    base, (rows, market) = str(tmp_path), _history(300, 4)
    rows = [r for r in rows if r[1] in ("AAA", "FLAT", "HOLES")] + [(d, "SPY", c, c, c, c, 1) for d, c in market]
    last = START + timedelta(days=299)
    schema = tb.TABLES["silver.daily_bars"][0]

    def run(part, k):
        tb.append(_silver(spark, part), f"{base}/silver/market")
        jobs.feature_batch(base)(_silver(spark, part), k)

    def batch_features(own):
        bars = spark.createDataFrame(own, schema)
        return _rows(price_features(bars.where("symbol <> 'SPY'"), bars.where("symbol = 'SPY'").select("day", "close")))

    def stored():
        out = tb.read_table(spark, base, "ml.features").withColumn("maxdd90", F.lit(None).cast("double"))
        return {k: v[:-1] for k, v in _rows(out).items()}

    def expect(own, days):
        got, want = stored(), {k: v[:-1] for k, v in batch_features(own).items() if k[1] in days}
        _same({k: v for k, v in got.items() if k[1] in days}, want)
        assert want

    first = [r for r in rows if r[0] < last]
    run(first, 0)
    expect(first, {r[0] for r in first})
    # Nothing before the new day is read: bars of the past may be anything by now.
    path = f"{base}/silver/daily_bars"
    old = spark.createDataFrame([(d, s, 1e6, 1e9, 1e-6, 1e6, 7) for d, s, *_ in first], schema)
    good = spark.createDataFrame(first, schema)
    tb.upsert(old, path, schema, ["day", "symbol"])
    run([r for r in rows if r[0] == last], 1)
    expect(rows, {last})
    tb.upsert(good, path, schema, ["day", "symbol"])
    before = tb.read_table(spark, base, "ml.feature_state").count()
    # A price 40 days back is corrected: later states follow, and the next day's features with them.
    jobs.thin_states(spark, base, str(last))
    assert tb.read_table(spark, base, "ml.feature_state").count() < before + 1
    wrong = last - timedelta(days=40)
    fixed = [(d, s, o, 300.0, low, 250.0, v) if (d, s) == (wrong, "AAA") else (d, s, o, h, low, c, v) for d, s, o, h, low, c, v in rows]
    tb.append(_silver(spark, [r for r in fixed if (r[0], r[1]) == (wrong, "AAA")]).withColumn("ts", F.expr("ts + interval 1 minute")), f"{base}/silver/market")
    jobs.feature_batch(base)(_silver(spark, [r for r in fixed if (r[0], r[1]) == (wrong, "AAA")]), 12)
    bars = {(r.symbol, r.day): r.close for r in tb.read_table(spark, base, "silver.daily_bars").collect()}
    assert bars["AAA", wrong] == 250.0
    after = last + timedelta(days=1)
    extra = [(after, s, 101.0, 104.0, 99.0, 102.0 + k, 900) for k, s in enumerate(("AAA", "FLAT", "SPY"))]
    run(extra, 13)
    joined = [(d, s, o, max(h, old_h), min(low, old_low), c, 2 * v if (d, s) == (wrong, "AAA") else v)
              for (d, s, o, h, low, c, v), (_, _, _, old_h, old_low, _, _) in zip(fixed, rows)]
    joined = [(d, s, *x) for d, s, *x in joined]
    expect(joined + extra, {after})
