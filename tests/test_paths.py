"""First passages, the equity sweep and ranks against brute force, and the shape of their plans."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barograph.config import TradeRules
from barograph.functions.ranks import spearman, value_ranks
from barograph.operators.backtest import equity_curve, run_trades

START = date(2022, 1, 3)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("horizon", [1, 2, 14, 16, 200])
def test_first_passage_equals_a_walk_along_the_bars(spark, horizon):
    rng, rows = np.random.default_rng(horizon), []
    for s, n in (("A", 260), ("B", 30), ("C", 1), ("D", 17)):
        c = np.round(100 * np.exp(np.cumsum(rng.normal(0, 0.02 if horizon < 100 else 0.004, n))), 2)
        rows += [(s, START + timedelta(days=3 * i), float(c[i] + rng.integers(0, 3)), float(c[i] - rng.integers(0, 3)), float(c[i])) for i in range(n)]
    bars = spark.createDataFrame(rows, "symbol string, day date, high double, low double, close double")
    signals = [(s, d, float(rng.choice([0.0, 0.03, 0.08])), 0.1) for s, d, *_ in rows if rng.random() < 0.7]
    out = run_trades(spark.createDataFrame(signals, "symbol string, day date, pred_a double, risk_prob double"), bars, TradeRules(horizon=horizon))
    assert "collect_list" not in _plan(out)
    want = {}
    for s, d, a, _ in signals:
        own = [r for r in rows if r[0] == s]
        at = next(k for k, r in enumerate(own) if r[1] == d)
        entry, path = own[at][4], own[at + 1 : at + 1 + horizon]
        if not path:
            continue
        want[s, d] = (path[-1][1], (path[-1][4] - entry) / entry, "Time")
        for _, day, high, low, _ in path:
            if low <= entry * (1 - 0.06):
                want[s, d] = (day, -0.06, "Risk")
                break
            if high >= entry * (1 + a):
                want[s, d] = (day, a, "Target")
                break
    got = {(r.symbol, r.entry_day): (r.exit_day, r.ret, r.exit_reason.split()[0]) for r in out.collect()}
    assert got == want and len({x[2] for x in want.values()}) > 1


def test_sweep_over_long_overlapping_trades(spark):
    rng = np.random.default_rng(2)
    days = [START + timedelta(days=i) for i in range(0, 900, 2)]
    bench = spark.createDataFrame([(d, float(100 + rng.normal())) for d in days], "day date, close double")
    trades = []
    for _ in range(400):
        a = START + timedelta(days=int(rng.integers(-50, 880)))
        trades.append((a, a + timedelta(days=int(rng.choice([0, 1, 2, 365, 500]))), float(rng.choice([1e-7, 0.3, -0.2, 25.0, 1 / 3]))))
    curve = equity_curve(spark.createDataFrame(trades, "entry_day date, exit_day date, ret double"), bench, str(days[20]), str(days[-20]))
    assert "sequence(" not in _plan(curve)
    inside = days[20 : len(days) - 19]
    sums, open_ = dict.fromkeys(inside, 0.0), dict.fromkeys(inside, 0)
    for a, b, r in trades:
        own = [d for d in inside if a < d <= b] or [d for d in inside if d == b]
        for d in own:
            sums[d] += r / len(own)
            open_[d] += 1
    growth, want = 1.0, {}
    for d in inside:
        growth *= 1 + (sums[d] / open_[d] if open_[d] else 0.0)
        want[d] = growth - 1
    got = {r.day: r.strategy for r in curve.collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[d] - x) <= 1e-9 * max(1, abs(x)) for d, x in want.items())


def test_ranks_over_many_pieces(spark):
    """A hot value, a hot group and more pieces than one; ranks come from the pieces' sums."""
    rng = np.random.default_rng(7)
    rows = [(int(min(rng.integers(0, 9), 3)), float(np.round(rng.normal(), 2)) if rng.random() < 0.6 else 0.25) for _ in range(5000)]
    df = spark.createDataFrame(rows, "g int, x double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.g, r.x): (r.n, r.before, r.total) for r in value_ranks(df, "x", ["g"]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g in range(4):
        values = sorted(x for k, x in rows if k == g)
        for x in set(values):
            assert got[g, x] == (values.count(x), values.index(x), len(values))
    assert len(got) == len(set(rows))


def test_spearman_needs_few_exchanges(spark):
    df = spark.range(100).select((F.col("id") % 7).alias("x"), (F.col("id") % 11).cast("double").alias("y"))
    out = spearman(df, "x", "y")
    assert _plan(out).count("Exchange") <= 15
    x, y = [i % 7 for i in range(100)], [i % 11 for i in range(100)]
    rank = lambda v: [sum(a < b for a in v) + (v.count(b) - 1) / 2 for b in v]
    assert abs(out.first()["spearman"] - np.corrcoef(rank(x), rank(y))[0, 1]) < 1e-12
