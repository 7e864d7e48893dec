from barograph.schemas import FEATURE_COLUMNS
from twins.base import BENCH, EOD, FULL, HOURS, LIGHT, TICKS, W, r, roll, with_

_EASTER = """easter as (
  select y, make_date(y, mm, dd) - 2 as good_friday from (
    select y, (h + l - 7 * m + 114) // 31 as mm, (h + l - 7 * m + 114) % 31 + 1 as dd from (
      select *, (a + 11 * h + 22 * l) // 451 as m from (
        select *, (32 + 2 * e + 2 * i - h - k) % 7 as l from (
          select *, (19 * a + b - d - g + 15) % 30 as h from (
            select y, y % 19 as a, y // 100 as b, y % 100 as c, (y // 100) // 4 as d, (y // 100) % 4 as e,
              (y // 100 - (y // 100 + 8) // 25 + 1) // 3 as g, (y % 100) // 4 as i, (y % 100) % 4 as k
            from (select unnest(range(1990, 2040)) as y))))))),
fixed as (
  select unnest([make_date(y, 1, 1), make_date(y, 6, 19), make_date(y, 7, 4), make_date(y, 12, 25)]) as d from easter),
alld as (select unnest(generate_series(date '1990-01-01', date '2039-12-31', interval 1 day))::date as d),
floating as (
  select d from (
    select d, month(d) as m, isodow(d) as wd, (day(d) - 1) // 7 + 1 as nth, day(d + 7) < day(d) as is_last from alld)
  where (m = 1 and wd = 1 and nth = 3) or (m = 2 and wd = 1 and nth = 3) or (m = 5 and wd = 1 and is_last)
     or (m = 9 and wd = 1 and nth = 1) or (m = 11 and wd = 4 and nth = 4)),
holidays as (
  select case isodow(d) when 6 then d - 1 when 7 then d + 1 else d end as d from fixed
  union select good_friday from easter union select d from floating),
sessions as (
  select d, isodow(d) < 6 and d not in (select d from holidays) as open from alld),
cal as (
  select d, open, last_value(case when open then d end ignore nulls) over (order by d) as latest from sessions)"""

_IND = HOURS + f""", h0 as (
  select *, row_number() over (partition by symbol order by ts) as rn from hours),
h1 as (
  select *, close - lag(close) {W} as d, lag(close) {W} as pc, close - lag(close, 5) {W} as momentum5,
    close / nullif(lag(close) {W}, 0) - 1 as ret from h0),
h2 as (
  select *, greatest(d, 0) as g_, greatest(-d, 0) as l_, greatest(high - low, abs(high - pc), abs(low - pc)) as tr from h1),
h3 as (
  select *, case when d is not null then g_ end as gain, case when d is not null then l_ end as loss from h2),
ew as (
  select symbol, rn, close as e9, close as e20, close as e50 from h3 where rn = 1
  union all
  select h.symbol, h.rn, e9 * 0.8 + h.close * 0.2, e20 * (1 - 2/21.0) + h.close * 2/21.0,
    e50 * (1 - 2/51.0) + h.close * 2/51.0
  from ew join h3 h on h.symbol = ew.symbol and h.rn = ew.rn + 1),
h4 as (
  select h3.*, case when rn >= 9 then e9 end as ema9, case when rn >= 20 then e20 end as ema20,
    case when rn >= 50 then e50 end as ema50, {roll('avg', 'gain', 14)} as ag, {roll('avg', 'loss', 14)} as al_,
    {roll('avg', 'volume', 20)} as avg_volume20, {roll('avg', 'tr', 14)} as atr14,
    {roll('stddev_samp', 'ret', 20)} as volatility20, {roll('avg', 'close', 20)} as sma20,
    {roll('stddev_samp', 'close', 20)} as std20, lag(momentum5) {W} as prev_momentum5
  from h3 join ew using (symbol, rn)),
ind as (
  select *, case when al_ = 0 and ag > 0 then 100 when al_ = 0 and ag = 0 then 50
                 else 100 - 100 / (1 + ag / al_) end as rsi14,
    lag(ema9) {W} as prev_ema9, lag(ema20) {W} as prev_ema20, lag(ema50) {W} as prev_ema50,
    volume / nullif(avg_volume20, 0) as rvol20, {roll('avg', 'atr14', 50, 20)} as avg_atr50,
    {roll('avg', 'volatility20', 50, 20)} as avg_volatility50, sma20 + 2 * std20 as bb_upper20,
    sma20 - 2 * std20 as bb_lower20
  from h4)"""
IND = "recursive " + _IND

_INDICATORS = ["rsi14", "ema9", "ema20", "ema50", "prev_ema9", "prev_ema20", "prev_ema50", "avg_volume20", "rvol20",
               "atr14", "avg_atr50", "volatility20", "avg_volatility50", "sma20", "std20", "bb_upper20", "bb_lower20",
               "momentum5", "prev_momentum5"]

_STRONG = "close > 0 and abs(momentum5) >= greatest(close * 0.005, coalesce(atr14, 0))"
_CASES = [
    ("RSI_OVERBOUGHT", "'MEDIUM'", "rsi14", "rsi14", "70.0", "rsi14 > 70",
     "printf('%s RSI14=%.2f > %.2f: overbought', symbol, rsi14, 70.0::double)"),
    ("RSI_OVERSOLD", "'MEDIUM'", "rsi14", "rsi14", "30.0", "rsi14 < 30",
     "printf('%s RSI14=%.2f < %.2f: oversold', symbol, rsi14, 30.0::double)"),
    ("VOLUME_SPIKE", "case when rvol20 > 5 then 'HIGH' else 'MEDIUM' end", "rvol20", "rvol20", "3.0", "rvol20 > 3",
     "printf('%s volume is %.2fx the 20-minute average', symbol, rvol20)"),
    ("PRICE_ABOVE_BOLLINGER_UPPER", "'MEDIUM'", "close_vs_bb_upper20", "close", "bb_upper20", "close > bb_upper20",
     "printf('%s close=%.4f crossed above Bollinger upper band=%.4f', symbol, close, bb_upper20)"),
    ("PRICE_BELOW_BOLLINGER_LOWER", "'MEDIUM'", "close_vs_bb_lower20", "close", "bb_lower20", "close < bb_lower20",
     "printf('%s close=%.4f crossed below Bollinger lower band=%.4f', symbol, close, bb_lower20)"),
    ("BULLISH_EMA_CROSS", "'MEDIUM'", "ema9_vs_ema20", "ema9", "ema20", "ema9 > ema20 and prev_ema9 <= prev_ema20",
     "symbol || ' EMA9 crossed above EMA20'"),
    ("BEARISH_EMA_CROSS", "'MEDIUM'", "ema9_vs_ema20", "ema9", "ema20", "ema9 < ema20 and prev_ema9 >= prev_ema20",
     "symbol || ' EMA9 crossed below EMA20'"),
    ("BULLISH_TREND_EMA_CROSS", "'HIGH'", "ema20_vs_ema50", "ema20", "ema50",
     "ema20 > ema50 and prev_ema20 <= prev_ema50", "symbol || ' EMA20 crossed above EMA50'"),
    ("BEARISH_TREND_EMA_CROSS", "'HIGH'", "ema20_vs_ema50", "ema20", "ema50",
     "ema20 < ema50 and prev_ema20 >= prev_ema50", "symbol || ' EMA20 crossed below EMA50'"),
    ("ATR_SPIKE", "'HIGH'", "atr14", "atr14", "2 * avg_atr50", "avg_atr50 > 0 and atr14 > 2 * avg_atr50",
     "printf('%s ATR14=%.4f exceeded 2.0x baseline', symbol, atr14)"),
    ("VOLATILITY_SPIKE", "'HIGH'", "volatility20", "volatility20", "2 * avg_volatility50",
     "avg_volatility50 > 0 and volatility20 > 2 * avg_volatility50",
     "printf('%s volatility20=%.6f exceeded 2.0x baseline', symbol, volatility20)"),
    ("BULLISH_MOMENTUM_REVERSAL", "'MEDIUM'", "momentum5", "momentum5", "prev_momentum5",
     f"prev_momentum5 < 0 and momentum5 > 0 and {_STRONG}", "symbol || ' 5-minute momentum reversed upward strongly'"),
    ("BEARISH_MOMENTUM_REVERSAL", "'MEDIUM'", "momentum5", "momentum5", "prev_momentum5",
     f"prev_momentum5 > 0 and momentum5 < 0 and {_STRONG}", "symbol || ' 5-minute momentum reversed downward strongly'"),
]
ALERTS = IND + ", raised as (" + " union all ".join(
    f"select symbol, ts as event_time, '{k}' as alert_type, {lv} as alert_level, '{f}' as feature_name, "
    f"({v})::double as feature_value, ({t})::double as threshold_value, {m} as message, close, rsi14 from ind where {c}"
    for k, lv, f, v, t, c, m in _CASES) + ")"

REBALANCE = EOD + """, days as (select day, row_number() over (order by day) as rk from (select distinct day from eod)),
rebalance as (
  select date_trunc('month', day)::date as month, min(day) as rebalance_day from days group by 1
  having min(day) >= (select coalesce(max(case when rk = 260 then day end), max(day)) from days)
     and min(day) <= (select coalesce(max(case when rk = (select max(rk) from days) - 20 then day end), max(day)) from days))"""

_FWD = ", ".join(f"lead(close, {h}) over (partition by symbol order by day) as close_{h}d" for h in (5, 10, 20))
_FOUR = {"close", "EMA20_slope", "EMA50_slope", "MACD_hist", "OBV_slope"}

TWINS = {
    "latest_tick_version": """select symbol, minute, ts, price, event_id from (
        select event_type as symbol, date_trunc('minute', ts) as minute, ts, value as price, event_id,
          row_number() over (partition by event_type, date_trunc('minute', ts) order by ts desc, event_id desc) as k
        from events) where k = 1""",
    "daily_bars": f"""{with_(EOD)} select symbol, day, open, high, low, close, volume from eod""",
    "quarter_hour_bars": """select event_type as symbol, time_bucket(interval '15 minutes', ts) as ts,
        arg_min(value, ts) as open, max(value) as high, min(value) as low, arg_max(value, ts) as close,
        count(*)::bigint as volume from events group by 1, 2""",
    "indicator_daily_close": """select ts::date as day, arg_max(value, ts) as close from events
        where event_type = 'click' group by 1""",
    "benchmark_alignment": f"""{with_(EOD)} select e.symbol, e.day, e.close,
        last_value(b.close ignore nulls) over (partition by e.symbol order by e.day) as bench
        from eod e left join (select day, close from eod where symbol = 'Brand#1') b using (day)""",
    "rebalance_calendar": f"{with_(REBALANCE)} select month, rebalance_day from rebalance",
    "prices_as_of_rebalance": f"""{with_(REBALANCE)} select rebalance_day, symbol, max(day) as as_of_day,
        arg_max(close, day) as close from eod join rebalance on day <= rebalance_day group by 1, 2""",
    "forward_returns": f"""{with_(EOD)} select symbol, day, close,
        {', '.join(f"close_{h}d, {r(f'(close_{h}d - close) / close')} as ret_{h}d"
                   for h in (5, 10, 20))}
        from (select symbol, day, close, {_FWD} from eod)""",
    "session_calendar": f"""{with_(_EASTER)} select day, trades, open as is_session, latest as latest_session
        from (select l_shipdate::date as day, count(*) as trades from lineitem group by 1) join cal on d = day""",
    "latest_completed_session": f"""{with_(_EASTER)} select ts, ticks, latest as session_day from (
        select ts, ticks, case when strftime(ny, '%H:%M:%S') < '16:15:00' then ny::date - 1 else ny::date end as c from (
          select date_trunc('hour', ts) as ts, count(*) as ticks,
            date_trunc('hour', ts) - interval 5 hour as ny from events group by 1)) join cal on d = c""",
    "wide_to_long": f"""select l_returnflag as symbol, l_shipdate::date as day,
        max(l_extendedprice / l_quantity) as high, min(l_extendedprice / l_quantity) as low,
        sum(l_quantity) as volume from lineitem group by 1, 2""",
    "daily_features": f"""{with_(FULL)} select day, symbol, {', '.join(
        f'{r(c, 4 if c in _FOUR else 6)} as {c}' for c in [*FEATURE_COLUMNS, 'maxdd90'])}, close from feats""",
    "complete_feature_vectors": f"""{with_(FULL)} select day, symbol, {len(FEATURE_COLUMNS)} as width,
        {', '.join(f'{r(c, 4)} as v{k}' for k, c in enumerate(FEATURE_COLUMNS))},
        'v1' as feature_version, 7::bigint as source_batch_id, timestamp '2024-01-01' as process_date
        from feats where {' and '.join(f'{c} is not null' for c in FEATURE_COLUMNS)}""",
    "features_of_touched_days": f"""{with_(LIGHT)} select day, symbol, {', '.join(
        f'{r(c)} as {c}' for c in ('r1', 'CLV', 'MFI14', 'vol20'))} from light
        where day >= (select date_trunc('month', max(l_shipdate))::date from lineitem)""",
    "features_on_target_day": f"""{with_(LIGHT)} select day, symbol, {', '.join(
        f'{r(c)} as {c}' for c in ('r1', 'r20', 'BB_pctB'))} from light
        where day = (select max(day) from light where day <= date '2035-01-01')""",
    "intraday_indicators": f"""{with_(IND)} select symbol, ts, {', '.join(
        f'{r(c, 5)} as {c}' for c in _INDICATORS)}, open, high, low, close, volume from ind""",
    "intraday_alerts": f"""{with_(ALERTS)} select symbol, event_time, alert_type, alert_level, feature_name,
        {r('feature_value', 4)} as feature_value, {r('threshold_value', 4)} as threshold_value, message,
        3::bigint as source_batch_id, {r('close', 4)} as meta_close, {r('rsi14', 4)} as meta_rsi14, '1m' as timeframe
        from raised""",
    "alert_counts": f"""{with_(ALERTS)} select symbol, alert_type, alert_level, count(*) as n,
        min(event_time) as first_time, max(event_time) as last_time from raised group by 1, 2, 3""",
}
