"""Window algorithms against pandas and brute force on small fixtures."""

from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from barograph.functions.ewm import Ewm, add_ewm
from barograph.functions.ranks import auc, quantiles, spearman
from barograph.operators import intraday
from barograph.operators.halo import number_rows, own_rows, with_halo


def _series(n=900, keys=2, seed=3):
    rng, rows = np.random.default_rng(seed), []
    for k in range(keys):
        p = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
        x = p.copy()
        x[rng.random(n) < 0.1] = np.nan
        x[:5] = np.nan
        x[300:390] = np.nan
        rows += [(k, i, float(p[i]), None if np.isnan(x[i]) else float(x[i])) for i in range(n)]
    return rows


@pytest.mark.parametrize("block", [None, 64])
def test_ewm_equals_pandas(spark, block):
    rows = _series()
    frame = pd.DataFrame(rows, columns=["symbol", "day", "p", "x"])
    specs = [Ewm("a", "p", 2 / 201, True), Ewm("b", "p", 0.2), Ewm("c", "x", 1 / 14, dense=False),
             Ewm("d", "x", 2 / 21, True, dense=False)]
    got = add_ewm(spark.createDataFrame(rows, "symbol int, day int, p double, x double"), ["symbol"], "day", specs,
                  block=block).toPandas().sort_values(["symbol", "day"])
    for s in specs:
        want = pd.concat([g[s.value].ewm(alpha=s.alpha, adjust=s.adjust).mean() for _, g in frame.groupby("symbol")]).values
        have = got[s.out].values.astype(float)
        assert (np.isnan(want) == np.isnan(have)).all()
        assert np.nanmax(np.abs(want - have) / np.abs(want)) < 1e-11


def test_halo_blocks_equal_whole_windows(spark):
    begin = datetime(2024, 1, 1)
    rows = [("A" if i % 3 else "B", begin + timedelta(minutes=17 * i), float((i * 7919) % 101)) for i in range(700)]
    df = number_rows(spark.createDataFrame(rows, "symbol string, ts timestamp, x double"))
    w = Window.partitionBy("symbol").orderBy("ts")
    want = df.withColumn("s", F.sum("x").over(w.rowsBetween(-9, 0))).withColumn("check", F.row_number().over(w))
    assert want.where("check <> rn").count() == 0
    parts = with_halo(df, 12, 50)
    wb = Window.partitionBy("symbol", "block").orderBy("rn")
    got = own_rows(parts.withColumn("s", F.sum("x").over(wb.rowsBetween(-9, 0))))
    assert {tuple(r) for r in got.select("symbol", "rn", "s").collect()} == {
        tuple(r) for r in want.select("symbol", "rn", "s").collect()}


def test_indicators_do_not_depend_on_blocks(spark):
    begin, rng = datetime(2024, 1, 1), np.random.default_rng(5)
    p = 100 + np.cumsum(rng.normal(0, 1, 2600))
    rows = [("A", begin + timedelta(minutes=i), float(p[i]), float(p[i] + 1), float(p[i] - 1), float(p[i]), int(i % 13 + 1))
            for i in range(2600)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume bigint")
    whole = intraday.indicators(df).toPandas().sort_values("ts")[intraday.INDICATORS]
    cut = intraday.indicators(df, block=1100).toPandas().sort_values("ts")[intraday.INDICATORS]
    assert (whole.isna().values == cut.isna().values).all()
    assert np.nanmax(np.abs(whole.values - cut.values)) < 1e-8


def test_rank_statistics(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"g": rng.integers(0, 2, 400), "x": np.round(rng.normal(0, 1, 400), 1), "y": rng.normal(0, 1, 400)})
    frame.loc[frame.index % 3 == 0, "x"] = 0.0  # one value holds a third of the rows
    df = spark.createDataFrame(frame)
    got = spearman(df, "x", "y").first()
    assert got["n"] == 400
    assert abs(got["spearman"] - np.corrcoef(frame.x.rank(), frame.y.rank())[0, 1]) < 1e-12
    q = {r["g"]: r for r in quantiles(df, "x", {"m": 0.5, "p9": 0.9}, ["g"]).collect()}
    for g, part in frame.groupby("g"):
        assert abs(q[g]["m"] - part.x.median()) < 1e-12 and abs(q[g]["p9"] - part.x.quantile(0.9)) < 1e-12
    pos = frame.y > frame.y.median()
    pairs = [(a > b) + 0.5 * (a == b) for a in frame.x[pos] for b in frame.x[~pos]]
    area = auc(df.withColumn("l", (F.col("y") > float(frame.y.median())).cast("int")), "x", "l").first()["auc"]
    assert abs(area - np.mean(pairs)) < 1e-12


def _bars(spark, rows):
    return spark.createDataFrame([(s, date(2024, 1, 1) + timedelta(days=d), h, low, c) for s, d, h, low, c in rows],
                                 "symbol string, day date, high double, low double, close double")


def test_trade_exits(spark):
    from barograph.config import TradeRules
    from barograph.operators.backtest import run_trades

    rows = [("SL", 0, 1, 1, 100), ("SL", 1, 200, 90, 150), ("TP", 0, 1, 1, 100), ("TP", 1, 105, 99, 104), ("TP", 2, 111, 99, 100),
            ("TM", 0, 1, 1, 100), ("TM", 1, 101, 99, 101), ("TM", 2, 102, 98, 97), ("TM", 3, 900, 1, 5), ("NO", 0, 1, 1, 100)]
    bars = _bars(spark, [(s, d, float(h), float(low), float(c)) for s, d, h, low, c in rows])
    sig = bars.where("day = date'2024-01-01'").select("symbol", "day", F.lit(0.1).alias("pred_a"), F.lit(0.1).alias("risk_prob"))
    got = {r["symbol"]: (r["exit_day"].day, round(r["ret"], 6), r["exit_reason"]) for r in
           run_trades(sig, bars, TradeRules(horizon=2)).collect()}
    assert got == {"SL": (2, -0.06, "Risk Hit (SL)"), "TP": (3, 0.1, "Target Hit (TP)"), "TM": (3, -0.03, "Time Exit (2D)")}


def test_sessions(spark):
    from barograph.functions.dates import completed_candidate, is_session, latest_session

    closed = ["2024-01-01", "2024-03-29", "2023-04-07", "2024-07-04", "2021-12-24", "2024-11-28", "2022-06-20", "2025-05-26", "2024-06-15"]
    open_ = ["2024-01-02", "2024-11-29", "2022-12-30", "2024-12-24"]
    df = spark.createDataFrame([(d,) for d in closed + open_], "d string").selectExpr("d", "to_date(d) as day")
    got = {r["d"]: r["s"] for r in df.selectExpr("d", f"{is_session('day')} as s").collect()}
    assert got == {**{d: False for d in closed}, **{d: True for d in open_}}
    assert df.where("d = '2024-01-01'").selectExpr(f"{latest_session('day')} as s").first()[0] == date(2023, 12, 29)
    t = spark.sql("select timestamp'2024-07-03 20:14:59' as a, timestamp'2024-07-03 20:15:00' as b")
    assert [x.day for x in t.selectExpr(completed_candidate("a"), completed_candidate("b")).first()] == [2, 3]


def test_plans_have_no_python_and_push_filters(spark, sf):
    from barograph.plans import timeseries as ts

    for fn in (ts.daily_features, ts.intraday_alerts, ts.prices_as_of_rebalance):
        text = fn(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in text and "CartesianProduct" not in text
    scan = ts.indicator_daily_close(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,click)" in scan and "props" not in scan


def test_ranks_of_values_in_a_narrow_band(spark):
    """Values that share their first digits are still cut into many pieces, and ranked exactly."""
    from barograph.functions.ranks import value_ranks

    rows = spark.range(3000).selectExpr("1000 + id * 1e-9 as x").union(spark.createDataFrame([(1000.0,)], "x double"))
    got = sorted((r.x, r.n, r.before, r.total) for r in value_ranks(rows, "x").collect())
    values = sorted(1000 + i * 1e-9 for i in range(3000))
    distinct = sorted(set(values))
    assert [x for x, *_ in got] == distinct and all(total == 3001 for *_, total in got)
    below = 0
    for x, n, before, _ in got:
        assert before == below
        below += n
    assert below == 3001


def test_equity_after_a_total_loss(spark):
    from datetime import date

    from barograph.operators.backtest import equity_curve

    days = [date(2024, 1, k) for k in range(1, 5)]
    bench = spark.createDataFrame([(d, 100.0) for d in days], "day date, close double")
    trades = spark.createDataFrame([(days[0], days[1], -1.0), (days[1], days[2], 0.5)], "entry_day date, exit_day date, ret double")
    curve = {r.day: r.strategy for r in equity_curve(trades, bench, "2024-01-01", "2024-01-31").collect()}
    assert [curve[d] for d in days] == [0.0, -1.0, -1.0, -1.0]
