"""Back-tests: point-in-time scores, horizons, portfolios, top-N strategies, path-dependent exits, equity curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from barograph.config import RequestCaps, TradeRules
from barograph.functions.ranks import spearman
from barograph.functions.rolling import compounded
from barograph.operators.bars import as_of, forward_close
from barograph.operators.labels import outcomes, win
from barograph.session import materialized


def point_in_time(predictions: DataFrame, bars: DataFrame, dates: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Latest score per symbol at each rebalance day, its entry price and realised returns.

    All features look backwards, so scores computed once and read as of a date equal scores recomputed on cut history.
    """
    scores = as_of(predictions, dates, "rebalance_day", ["pred_a", "risk_prob", "final_score"]).drop("as_of_day")
    returns = [f"ret_{h}d" for h in horizons]
    prices = as_of(forward_close(bars, horizons), dates, "rebalance_day", ["close", *returns]).drop("as_of_day")
    return scores.join(prices, ["rebalance_day", "symbol"]).withColumnRenamed("close", "entry_price")


def by_horizon(rows: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """One row per prediction and horizon with a realised return."""
    long = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"ret_{h}d").alias("ret")) for h in horizons])
    return (rows.select("rebalance_day", "symbol", "pred_a", "risk_prob", "final_score", F.inline(long))
            .where(F.col("ret").isNotNull()))


def horizon_metrics(rows: DataFrame, horizons: Sequence[int], drop: float = -0.06, edge: int = 3) -> DataFrame:
    long = by_horizon(rows, horizons)
    day = Window.partitionBy("horizon", "rebalance_day")
    long = long.select("*", F.row_number().over(day.orderBy(F.desc("final_score"), "symbol")).alias("_top"),
                       F.row_number().over(day.orderBy("final_score", F.desc("symbol"))).alias("_bottom"))
    risky, fell = F.col("risk_prob") > 0.5, F.col("ret") <= drop
    both = F.count_if(risky & fell)
    out = long.groupBy("horizon").agg(
        F.count(F.lit(1)).alias("samples"),
        F.avg(((F.col("pred_a") > 0) == (F.col("ret") > 0)).cast("double")).alias("direction_acc"),
        (both / F.greatest(F.count_if(risky), F.lit(1))).alias("risk_precision"),
        (both / F.greatest(F.count_if(fell), F.lit(1))).alias("risk_recall"),
        F.avg(F.when(F.col("_top") <= edge, F.col("ret"))).alias("top_ret"),
        F.avg(F.when(F.col("_bottom") <= edge, F.col("ret"))).alias("bottom_ret"))
    ic = spearman(long, "final_score", "ret", ["horizon"]).withColumnRenamed("spearman", "ic").drop("n")
    return out.join(ic, "horizon", "left")


def topk_portfolio(rows: DataFrame, bench: DataFrame, dates: DataFrame, k: int, horizon: int) -> DataFrame:
    """Equal-weight best ``k`` per rebalance day against the benchmark over the same bars."""
    col = f"ret_{horizon}d"
    best = Window.partitionBy("rebalance_day").orderBy(F.desc("final_score"), "symbol")
    picks = (rows.where(F.col(col).isNotNull()).withColumn("_rk", F.row_number().over(best)).where(F.col("_rk") <= k)
             .groupBy("rebalance_day")
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rk", "symbol"))), lambda s: s["symbol"]),
                               ", ").alias("picks"), F.avg(col).alias("portfolio_ret")))
    market = forward_close(bench.select(F.lit("*").alias("symbol"), "day", "close"), [horizon])
    market = as_of(market, dates, "rebalance_day", [col]).select("rebalance_day", F.col(col).alias("bench_ret"))
    return picks.join(market, "rebalance_day", "left").withColumn("alpha", F.col("portfolio_ret") - F.col("bench_ret"))


def portfolio_summary(portfolio: DataFrame) -> DataFrame:
    both = F.col("bench_ret").isNotNull() & F.col("portfolio_ret").isNotNull()
    return portfolio.agg(
        F.count(F.lit(1)).alias("periods"), F.avg("portfolio_ret").alias("mean_ret"), F.avg("bench_ret").alias("mean_bench"),
        F.avg("alpha").alias("mean_alpha"), F.avg(F.coalesce(F.col("alpha") > 0, F.lit(False)).cast("double")).alias("win_rate"),
        compounded(F.when(both, F.col("portfolio_ret"))).alias("compounded_ret"),
        compounded(F.when(both, F.col("bench_ret"))).alias("compounded_bench"))


def with_outcomes(predictions: DataFrame, bars: DataFrame, horizon: int = 14) -> DataFrame:
    keep = predictions.select("symbol", "day", "pred_a", "risk_prob", "final_score")
    return keep.join(outcomes(bars, horizon), ["symbol", "day"])


def topn_daily(scored: DataFrame, score: str, n: int = 10, horizon: int = 14) -> DataFrame:
    """Buy the best ``n`` each day and sell at the best close of the next bars; one row of figures."""
    best = Window.partitionBy("day").orderBy(F.desc(score), "symbol")
    picks = scored.withColumn("_rk", F.row_number().over(best)).where((F.col("_rk") <= n) & (F.col("ahead") > 0))
    daily = picks.groupBy("day").agg(F.avg("max_return").alias("ret"))
    return daily.agg(F.lit(score).alias("ranked_by"), F.count(F.lit(1)).alias("days"), F.avg("ret").alias("mean_ret"),
                     F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"),
                     (F.try_divide(F.avg("ret"), F.stddev_samp("ret")) * F.sqrt(F.lit(252 / horizon))).alias("sharpe"))


def _day_ranks(scored: DataFrame, horizon: int, limit: float) -> DataFrame:
    """Rank by model and rank among the truly good names, side by side: no join of two top lists."""
    safe = (F.col("ahead") == horizon) & (F.col("drawdown") > limit)
    day = Window.partitionBy("day")
    return scored.select(
        "*", F.count(F.lit(1)).over(day).alias("_names"), F.max((F.col("ahead") == horizon)).over(day).alias("_known"),
        F.row_number().over(day.orderBy(F.desc("final_score"), "symbol")).alias("_model"),
        F.when(safe, F.row_number().over(Window.partitionBy("day", safe).orderBy(F.desc("max_return"), "symbol")))
        .alias("_truth"))


def ground_truth_precision(scored: DataFrame, n: int = 10, horizon: int = 14, limit: float = -0.06) -> DataFrame:
    """Per day: how many of the model's best ``n`` are among the best ``n`` safe names."""
    ranked = _day_ranks(scored, horizon, limit).where((F.col("_names") >= n) & F.col("_known"))
    return ranked.groupBy("day").agg(
        F.count_if((F.col("_model") <= n) & (F.col("_truth") <= n)).alias("hits"),
        F.avg(F.when((F.col("_model") <= n) & (F.col("ahead") == horizon), F.col("max_return"))).alias("mean_max_return")
    ).withColumn("precision", F.col("hits") / n)


def topn_sweep(scored: DataFrame, sizes: Sequence[int] = tuple(range(10, 101, 10)), horizon: int = 14,
               limit: float = -0.06) -> DataFrame:
    """Figures for several list sizes from one ranking pass."""
    ranked = _day_ranks(scored, horizon, limit).where(F.col("ahead") == horizon)
    fits = F.filter(F.array(*[F.lit(n) for n in sizes]), lambda n: (F.col("_model") <= n) & (F.col("_names") >= n))
    rows = ranked.withColumn("top_n", F.explode(fits))
    daily = rows.groupBy("top_n", "day").agg(
        F.avg("max_return").alias("_ret"), F.sum("drawdown").alias("_dd"), F.count(F.lit(1)).alias("_k"),
        F.sum(F.expr(win()).cast("int")).alias("_wins"))
    return daily.groupBy("top_n").agg(
        (F.max("top_n") * 21).alias("trades_per_month"), (F.sum("_wins") / F.sum("_k") * 100).alias("win_rate_pct"),
        (F.avg("_ret") * 100).alias("avg_return_pct"), (F.sum("_dd") / F.sum("_k") * 100).alias("avg_drawdown_pct"))


def signals(predictions: DataFrame, rules: TradeRules = TradeRules()) -> DataFrame:
    return predictions.where((F.col("pred_a") >= rules.min_pred_a) & (F.col("risk_prob") <= rules.max_risk))


def run_trades(signal_rows: DataFrame, bars: DataFrame, rules: TradeRules = TradeRules()) -> DataFrame:
    """First exit of each trade in the next ``horizon`` bars: stop before target on the same bar, else time.

    Every bar knows the lowest low and highest high of the next 1, 2, 4, 8 … bars, each span from two of half its length.
    A signal looks up the longest span first and steps over a span in which neither bound is met, so it stands at its
    first hit after one look-up per span. Only signal rows are looked up, by equi-joins on (symbol, bar number).
    """
    spans = [1 << k for k in range(rules.horizon.bit_length())]
    w = "partition by symbol order by day"
    table = bars.selectExpr("symbol", "day", "high", "low", "close", f"row_number() over ({w}) as i", "low as low_1", "high as high_1",
                            f"count(1) over ({w} rows between 1 following and {rules.horizon} following) as ahead")
    for s in spans[1:]:
        table = table.selectExpr("*", f"least(low_{s // 2}, lead(low_{s // 2}, {s // 2}) over ({w})) as low_{s}",
                                 f"greatest(high_{s // 2}, lead(high_{s // 2}, {s // 2}) over ({w})) as high_{s}")
    longest = spans[-1]
    table = materialized(table.selectExpr("*", f"lead(low_{longest}) over ({w}) as _lo", f"lead(high_{longest}) over ({w}) as _hi"))
    rows = (signal_rows.select("symbol", "day", "pred_a", "risk_prob").join(
        table.selectExpr("symbol", "day", "close as entry_price", "i + 1 as p", "ahead as rest", "_lo", "_hi"), ["symbol", "day"])
        .where("rest > 0").selectExpr("*", f"entry_price * (1 - {rules.stop_loss}d) as stop", "entry_price * (1 + pred_a) as target"))
    for s in reversed(spans):
        if s != longest:
            rows = rows.join(table.selectExpr("symbol", "i as p", f"low_{s} as _lo", f"high_{s} as _hi"), ["symbol", "p"], "left")
        step = f"if(rest >= {s} and _lo > stop and _hi < target, {s}, 0)"
        rows = rows.selectExpr("symbol", "day", "pred_a", "risk_prob", "entry_price", "stop", "target", f"p + {step} as p", f"rest - {step} as rest")
    # Without a hit, all bars have been stepped over, and the last of them is the exit.
    rows = rows.selectExpr("*", "if(rest > 0, p, p - 1) as i").join(
        table.selectExpr("symbol", "i", "day as exit_day", "low", "close"), ["symbol", "i"])
    return rows.selectExpr(
        "day as entry_day", "symbol", "pred_a", "risk_prob", "entry_price", "exit_day",
        f"case when rest = 0 then (close - entry_price) / entry_price when low <= stop then -{rules.stop_loss}d else pred_a end as ret",
        f"case when rest = 0 then 'Time Exit ({rules.horizon}D)' when low <= stop then 'Risk Hit (SL)' "
        f"else 'Target Hit (TP)' end as exit_reason")


def equity_curve(trades: DataFrame, bench: DataFrame, start: str, end: str) -> DataFrame:
    """Cumulative return per benchmark day. A trade's return is spread evenly over its days after entry up to exit.

    A sweep: a trade adds its daily share on its first day and takes it away after its last, and running sums over the
    calendar give each day's open trades. Shares are decimals, so what is taken away is exactly what was added.
    """
    days = bench.where(F.col("day").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    numbered = days.select("day", "close", F.row_number().over(Window.orderBy("day")).alias("i"))
    # number of benchmark days up to any date in use; a calendar, not a fact table
    dates = trades.select(F.explode(F.array("entry_day", "exit_day")).alias("day")).distinct()
    seen = dates.join(numbered.select("day", "i"), "day", "full")
    index = seen.select("day", F.coalesce(F.max("i").over(Window.orderBy("day")), F.lit(0)).alias("i"),
                        F.col("i").isNotNull().alias("is_day"))
    spans = (trades.join(index.select(F.col("day").alias("entry_day"), F.col("i").alias("a")), "entry_day")
             .join(index.select(F.col("day").alias("exit_day"), F.col("i").alias("b"), "is_day"), "exit_day")
             .where((F.col("b") > F.col("a")) | F.col("is_day")))
    share = (F.col("ret") / F.greatest(F.col("b") - F.col("a"), F.lit(1))).cast("decimal(38,18)")
    event = lambda at, sign: F.struct(at.alias("i"), (sign * F.col("share")).cast("decimal(38,18)").alias("r"), F.lit(sign).alias("k"))
    events = spans.select(F.least(F.col("a") + 1, F.col("b")).alias("first"), (F.col("b") + 1).alias("after"), share.alias("share"))
    events = (events.select(F.inline(F.array(event(F.col("first"), 1), event(F.col("after"), -1)))).groupBy("i")
              .agg(F.sum("r").alias("r"), F.sum("k").alias("k")))
    run = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    daily = numbered.join(events, "i", "left").select(
        "day", "close", F.coalesce(F.try_divide(F.sum("r").over(run).cast("double"), F.sum("k").over(run)), F.lit(0.0)).alias("ret"))
    lost = lambda c: F.max(F.when(c <= -1, 1)).over(run).isNotNull()  # noqa: E731 - nothing is left after a total loss
    growth = lambda c: F.when(lost(c), -1.0).otherwise(F.exp(F.sum(F.when(c > -1, F.log1p(c))).over(run)) - 1)
    rows = daily.select("day", "ret", F.coalesce(F.try_divide("close", F.lag("close").over(Window.orderBy("day"))) - 1, F.lit(0.0)).alias("_b"))
    return rows.select("day", growth(F.col("ret")).alias("strategy"), growth(F.col("_b")).alias("benchmark"))


def trade_metrics(trades: DataFrame, curve: DataFrame) -> DataFrame:
    figures = trades.agg(F.count(F.lit(1)).alias("trade_count"), (F.avg((F.col("ret") > 0).cast("double")) * 100)
                         .alias("win_rate"), (F.avg("ret") * 100).alias("avg_return_per_trade"),
                         (F.coalesce(F.sum("ret"), F.lit(0.0)) * 100).alias("raw_trade_return_sum"))
    ends = curve.agg((F.max_by("strategy", "day") * 100).alias("strategy_total_return"),
                     (F.max_by("benchmark", "day") * 100).alias("benchmark_total_return"))
    return figures.crossJoin(ends)


def exit_counts(trades: DataFrame) -> DataFrame:
    return trades.groupBy("exit_reason").agg(F.count(F.lit(1)).alias("n"))


def price_backtest(bars: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Total return per symbol between two dates, with the number of rows."""
    rows = bars
    if start:
        rows = rows.where(F.col("day") >= F.to_date(F.lit(start)))
    if end:
        rows = rows.where(F.col("day") <= F.to_date(F.lit(end)))
    return rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), (F.coalesce(F.try_divide(
        F.max_by("close", "day"), F.min_by("close", "day")) - 1, F.lit(0.0))).alias("total_return"))


def equal_weight_return(per_symbol: DataFrame) -> DataFrame:
    return per_symbol.agg(F.count(F.lit(1)).alias("symbols"), F.sum("rows").alias("rows"),
                          F.avg("total_return").alias("total_return"))


def equity_sample(bars: DataFrame, points: int = 25) -> DataFrame:
    """At most ``points`` evenly spaced points of each symbol's growth curve, from its first close."""
    w = "partition by symbol order by day"
    rows = bars.selectExpr("symbol", "day", "close", f"row_number() over ({w}) - 1 as i",
                           "count(1) over (partition by symbol) as n", f"first_value(close) over ({w}) as first_close")
    step = f"greatest(1, n div {points})"
    return rows.where(f"i % {step} = 0 and i div {step} < {points}").selectExpr(
        "symbol", "day", "coalesce(try_divide(close, first_close), 1.0d) as equity")


def capped_requests(requests: DataFrame, caps: RequestCaps = RequestCaps()) -> DataFrame:
    """Apply the request limits: symbol lists are cut with a warning, long ranges are refused."""
    n, days = "size(symbols)", "datediff(end_date, start_date) + 1"
    return requests.selectExpr(
        "request_id", f"slice(array_sort(symbols), 1, {caps.max_symbols}) as symbols", f"{days} as requested_days",
        f"if({days} > {caps.max_days}, 'disabled', 'accepted') as status",
        f"filter(array(if({n} > {caps.max_symbols}, 'symbol cap applied: max_symbols={caps.max_symbols}', null), "
        f"if({days} > {caps.max_days}, concat('date range cap rejected: requested_days=', {days}, "
        f"', max_date_range_days={caps.max_days}'), null)), w -> w is not null) as warnings")
