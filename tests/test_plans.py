"""Plans that are held to a number of exchanges, and calendars against a plain count of days."""

import datetime as dt
import random

import pytest

from barograph.operators import bars, decisions as de
from barograph.plans import decisions as dp, timeseries as ts


def exchanges(df) -> int:
    """Shuffles and broadcasts of the plan before it runs."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_the_calendar_is_read_once(spark, sf):
    assert exchanges(ts.rebalance_calendar(spark, sf)) <= 4
    assert exchanges(ts.prices_as_of_rebalance(spark, sf)) <= 8


def test_positions_and_sections_of_decisions_are_made_once(spark, sf):
    """Line items are not read again for the risk section, and both readers of the sections scan stored lists."""
    got = dp.request_decisions(spark, sf)
    assert not [f for f in got.inputFiles() if "lineitem" in f]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("ml_ready.stock_price_features:") == 0


def test_references_are_folded_once(spark):
    """No reference is put in capitals again for each symbol; relevance and reliability are counted in any case."""
    rows = [(1, s, True, False, ["ML_READY.x:aapl", "other:Msft", "other:none"], ["AAPL", "MSFT"], 2, 2) for s in de.SECTIONS]
    got = de.source_quality(spark.createDataFrame(rows, "request_id int, section string, present boolean, is_stale boolean, "
                                                        "source_refs array<string>, symbols array<string>, wanted long, found long"))
    plan = got._jdf.queryExecution().analyzed().toString()
    assert "contains(upper(" not in plan and "startswith(lower(" not in plan.lower()
    r = got.first()
    assert (r.relevance, r.reliability) == (0.67, 0.33)


@pytest.mark.parametrize("n, warmup, horizon", [(200, 40, 20), (200, 1, 1), (30, 40, 20), (30, 10, 40), (1, 1, 1), (0, 1, 1)])
def test_rebalance_days_by_counting(spark, n, warmup, horizon):
    days = sorted(random.Random(n).sample([dt.date(2020, 1, 1) + dt.timedelta(d) for d in range(400)], n))
    got = bars.rebalance_days(spark.createDataFrame([(s, d) for d in days for s in "ab"], "symbol string, day date"), warmup, horizon)
    first = days[warmup - 1] if n >= warmup else max(days, default=None)
    last = days[n - horizon - 1] if n > horizon else max(days, default=None)
    firsts = {}
    for d in days:
        firsts.setdefault(d.replace(day=1), d)
    want = {(m, d) for m, d in firsts.items() if first <= d <= last}
    assert {tuple(r) for r in got.collect()} == want
