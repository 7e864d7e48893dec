"""Common table expressions shared by the twins."""

from __future__ import annotations

import re

R20 = "rows between 19 preceding and current row"


def r(expr: str, n: int = 6) -> str:
    """Round half away from zero without a negative zero."""
    return f"(round(({expr})::double, {n}) + 0.0)"


TICKS = """ticks as (
  select p_brand as symbol, l_shipdate as ts, l_shipdate::date as day, l_extendedprice / l_quantity as price,
         l_quantity as volume,
         (l_orderkey * 8 + l_linenumber) * 1048576
           + (round(l_extendedprice * 100)::bigint * 64 + l_quantity::bigint) % 1048576 as seq
  from lineitem join part on l_partkey = p_partkey)"""

EOD = TICKS + """, eod as (
  select symbol, day, arg_min(price, seq) as open, max(price) as high, min(price) as low,
         arg_max(price, seq) as close, sum(volume) as volume
  from ticks group by symbol, day)"""

BENCH = """bench as (
  select l_shipdate::date as day, avg(l_extendedprice / l_quantity) as close from lineitem group by 1)"""

HOURS = """hours as (
  select event_type as symbol, date_trunc('hour', ts) as ts, arg_min(value, ts) as open, max(value) as high,
         min(value) as low, arg_max(value, ts) as close, count(*)::bigint as volume
  from events group by 1, 2)"""


def roll(agg: str, x: str, n: int, need: int | None = None, second: str | None = None) -> str:
    frame = f"over (partition by symbol order by rn rows between {n - 1} preceding and current row)"
    call = f"{agg}({x}, {second})" if second else f"{agg}({x})"
    seen = f"{x} + {second}" if second else x
    return f"case when count({seen}) {frame} >= {need or n} then {call} {frame} end"


W = "over (partition by symbol order by rn)"


def chg(x: str, k: int) -> str:
    return f"({x} / nullif(lag({x}, {k}) {W}, 0) - 1)"


# Light features need no recursion: the stand-in model's inputs and the columns most serving queries read.
LIGHT = EOD + ", " + BENCH + f""", b0 as (
  select eod.*, bench.close as bench, row_number() over (partition by symbol order by eod.day) as rn
  from eod left join bench using (day)),
b1 as (
  select *, lag(close) {W} as pc, (high + low + close) / 3 as typical, {chg('close', 1)} as r1,
         {chg('close', 3)} as r3, {chg('close', 5)} as r5, {chg('close', 20)} as r20, {chg('bench', 1)} as rb,
         max(close) over (partition by symbol order by rn) as peak
  from b0),
b2 as (
  select *, lag(typical) {W} as ptyp, (close - peak) / nullif(peak, 0) as dd from b1),
b3 as (
  select *, case when typical > ptyp then typical * volume else 0 end as inflow,
         case when typical < ptyp then typical * volume else 0 end as outflow from b2),
light as (
  select symbol, day, rn, close, r1, r3, r5, r20,
    (close - low) / nullif(high - low, 0) - 0.5 as CLV,
    (close - ({roll('avg', 'close', 20)} - 2 * {roll('stddev_samp', 'close', 20)}))
       / nullif(4 * {roll('stddev_samp', 'close', 20)}, 0) as BB_pctB,
    100 - 100 / (1 + {roll('sum', 'inflow', 14)} / nullif({roll('sum', 'outflow', 14)}, 0)) as MFI14,
    volume / nullif({roll('avg', 'volume', 20)}, 0) as RVOL20, {roll('stddev_samp', 'r1', 20)} as vol20,
    -({roll('min', 'dd', 20)}) as maxdd20, -({roll('min', 'dd', 90)}) as maxdd90,
    {roll('covar_samp', 'r1', 60, second='rb')} / nullif({roll('var_samp', 'rb', 60)}, 0) as beta_60D
  from b3)"""


def scored(source: str) -> str:
    return f"""scored as (
  select *, pred_a * (1 - risk_prob) as final_score from (
    select *, 0.02 + 0.05 * CLV + 0.03 * BB_pctB + 0.001 * MFI14 as pred_a,
         1 / (1 + exp(-(-1.0 - 1.5 * CLV + 0.5 * BB_pctB + 0.01 * MFI14))) as risk_prob
    from {source}) where pred_a is not null and risk_prob is not null)"""


PRED = LIGHT + ", " + scored("light")


def _dx(a: str, p: str, m: str) -> str:
    pdi, mdi = f"(100 * {p} / nullif({a}, 0))", f"(100 * {m} / nullif({a}, 0))"
    return f"100 * abs({pdi} - {mdi}) / nullif({pdi} + {mdi}, 0)"


# The full contract: recursive averages walk row by row.
FULL = "recursive " + EOD + ", " + BENCH + f""", c0 as (
  select eod.*, bench.close as bench, row_number() over (partition by symbol order by eod.day) as rn
  from eod left join bench using (day)),
c1 as (
  select *, lag(close) {W} as pc, high - lag(high) {W} as up, lag(low) {W} - low as down,
    (high + low + close) / 3 as typical, close / nullif(bench, 0) as rs, {chg('bench', 1)} as rb,
    {chg('bench', 20)} as SPY_20d_return, (volume - lag(volume, 5) {W}) / 5 as volume_slope_20,
    max(close) over (partition by symbol order by rn) as peak,
    {', '.join(f"{chg('close', k)} as r{k}" for k in (1, 3, 5, 10, 14, 20, 21))}
  from c0),
c2 as (
  select *, case when up > down and up > 0 then up else 0 end as pdm,
    greatest(high - low, abs(high - pc), abs(low - pc)) as tr, greatest(close - pc, 0) as gain_,
    greatest(pc - close, 0) as loss_, lag(typical) {W} as ptyp,
    coalesce(sign(close - pc), 0) * volume as sv, case when r1 < 0 then r1 else 0 end as down_ret,
    (close - peak) / nullif(peak, 0) as dd from c1),
c3 as materialized (
  select *, case when down > pdm and down > 0 then down else 0 end as mdm,
    case when pc is null then null else gain_ end as gain, case when pc is null then null else loss_ end as loss,
    case when typical > ptyp then typical * volume else 0 end as inflow,
    case when typical < ptyp then typical * volume else 0 end as outflow,
    sum(sv) over (partition by symbol order by rn rows unbounded preceding) as obv from c2),
walk as (
  select symbol, rn, close as e12, close as e26, 0.0::double as macd, 0.0::double as sig, null::double as ag,
    null::double as al, tr as atr, 0.0::double as p, 0.0::double as m, close as n20, 1.0::double as m20, close as n50,
    1.0::double as m50, close as n200, 1.0::double as m200, bench as bn, 1.0::double as bm, null::double as adx,
    0 as gap
  from c3 where rn = 1
  union all
  select symbol, rn, e12, e26, macd, 0.8 * sig + 0.2 * macd, ag, al, atr, p, m, n20, m20, n50, m50, n200, m200, bn, bm,
    case when dx is null then adx when adx is null then dx
         else (pow(13/14.0, gap) * adx + dx / 14.0) / (pow(13/14.0, gap) + 1/14.0) end,
    case when dx is null then gap + 1 else 1 end
  from (select *, {_dx('atr', 'p', 'm')} as dx, e12 - e26 as macd from (
    select c.symbol, c.rn, k.e12 * (1 - 2/13.0) + c.close * 2/13.0 as e12,
      k.e26 * (1 - 2/27.0) + c.close * 2/27.0 as e26, k.sig,
      case when k.ag is null then c.gain else k.ag * 13/14.0 + c.gain / 14.0 end as ag,
      case when k.al is null then c.loss else k.al * 13/14.0 + c.loss / 14.0 end as al,
      k.atr * 13/14.0 + c.tr / 14.0 as atr, k.p * 13/14.0 + c.pdm / 14.0 as p, k.m * 13/14.0 + c.mdm / 14.0 as m,
      k.n20 * (1 - 2/21.0) + c.close as n20, k.m20 * (1 - 2/21.0) + 1 as m20,
      k.n50 * (1 - 2/51.0) + c.close as n50, k.m50 * (1 - 2/51.0) + 1 as m50,
      k.n200 * (1 - 2/201.0) + c.close as n200, k.m200 * (1 - 2/201.0) + 1 as m200,
      k.bn * (1 - 2/51.0) + c.bench as bn, k.bm * (1 - 2/51.0) + 1 as bm, k.adx, k.gap
    from walk k join c3 c on c.symbol = k.symbol and c.rn = k.rn + 1))),
c4 as (
  select c3.*, n20 / m20 as ema20, n50 / m50 as ema50, n200 / m200 as ema200, macd - sig as MACD_hist,
    100 - 100 / (1 + ag / nullif(al, 0)) as RSI14, adx as ADX14, bench > bn / bm as above
  from c3 join walk using (symbol, rn)),
c5 as (
  select *, {roll('avg', 'tr', 14)} / nullif(close, 0) as ATR14_ratio, {roll('stddev_samp', 'r1', 20)} as vol20,
    (obv - lag(obv, 5) {W}) / 5 as OBV_slope, {roll('stddev_samp', 'close', 20)} as s20, {roll('avg', 'close', 20)} as m20_
  from c4),
feats as (
  select symbol, day, rn, close, r1, r3, r5, r10, r14, r20, r21, r20 as cumret_20,
    (r20 - {roll('avg', 'r20', 20)}) / nullif({roll('stddev_samp', 'r20', 20)}, 0) as return_z_20, r1 as gap_return,
    (close - low) / nullif(high - low, 0) - 0.5 as CLV, (ema20 - ema50) / nullif(close, 0) as EMA20_50_spread,
    (ema50 - ema200) / nullif(close, 0) as EMA50_200_spread, (ema20 - lag(ema20, 5) {W}) / 5 as EMA20_slope,
    (ema50 - lag(ema50, 5) {W}) / 5 as EMA50_slope, MACD_hist, RSI14, 100 * r10 as ROC10, 100 * r20 as ROC20, ADX14,
    ({roll('max', 'high', 20)} - close) / nullif(close, 0) as dist_20d_high,
    ({roll('max', 'high', 55)} - close) / nullif(close, 0) as dist_55d_high,
    ({roll('max', 'high', 252)} - close) / nullif(close, 0) as dist_52w_high,
    (close - (m20_ - 2 * s20)) / nullif(4 * s20, 0) as BB_pctB, 4 * s20 / nullif(close, 0) as BB_width,
    (close - ema20) / nullif(close, 0) as dist_ema20, (close - ema50) / nullif(close, 0) as dist_ema50, ATR14_ratio,
    vol20, {roll('stddev_samp', 'down_ret', 20)} as downside_vol20, -({roll('min', 'dd', 20)}) as maxdd20,
    {roll('stddev_samp', 'r1', 10)} as realized_vol_10, vol20 as realized_vol_20,
    vol20 / nullif({roll('stddev_samp', 'r1', 60)}, 0) as vol_ratio_20_60,
    (ATR14_ratio - {roll('avg', 'ATR14_ratio', 20)}) / nullif({roll('stddev_samp', 'ATR14_ratio', 20)}, 0) as true_range_zscore,
    volume / nullif({roll('avg', 'volume', 20)}, 0) as RVOL20, OBV_slope,
    100 - 100 / (1 + {roll('sum', 'inflow', 14)} / nullif({roll('sum', 'outflow', 14)}, 0)) as MFI14,
    ln(case when close * volume = 0 then 1 else close * volume end) as dollar_volume_log, volume_slope_20,
    case when OBV_slope < 0 then 1.0 else 0.0 end::double as OBV_slope_neg, {chg('rs', 14)} as RS_vs_SPY_14,
    {chg('rs', 30)} as RS_vs_SPY_30,
    {roll('covar_samp', 'r1', 60, second='rb')} / nullif({roll('var_samp', 'rb', 60)}, 0) as beta_60D,
    case when above then 1.0 else 0.0 end::double as SPY_above_EMA50, SPY_20d_return,
    0.5::double as sector_percentile_20d, -({roll('min', 'dd', 90)}) as maxdd90
  from c5)"""


def with_(*parts: str) -> str:
    return "with " + ", ".join(parts)


def tidy(sql: str) -> str:
    return re.sub(r"\s+", " ", sql).strip()
