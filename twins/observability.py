from twins.base import EOD, HOURS, LIGHT, W, r, roll, with_
from twins.timeseries import ALERTS

_NOW = "now_ as (select max(ts) as t from events)"


def _lag(expr: str) -> str:
    return f"(round((epoch_us((select t from now_)) - epoch_us({expr})) / 6e7, 2) + 0.0)"


def _health(name: str, source: str, time: str) -> str:
    return f"""select '{name}' as table_name, max({time})::timestamp as latest_time, count(*) as row_count,
      {_lag(f'max({time})::timestamp')} as lag_minutes, 'ok' as status from {source}"""


def _fresh(name: str, source: str, time: str, key: str = "symbol") -> str:
    return f"""select '{name}' as table_name, {key} as symbol, max({time}) as latest_time, {_lag(f'max({time})')} as lag_minutes
      from {source} group by {key}"""


_SHORT = LIGHT.split(", light as (")[0].replace("with ", "")
# The same light features on bars since 1998, under other names.
_CUT = f"""s0 as (
  select eod.*, row_number() over (partition by symbol order by day) as rn from eod where day >= date '1998-01-01'),
s1 as (
  select *, close / nullif(lag(close) {W}, 0) - 1 as r1, (high + low + close) / 3 as typical,
    max(close) over (partition by symbol order by rn) as peak from s0),
s2 as (select *, lag(typical) {W} as ptyp, (close - peak) / nullif(peak, 0) as dd from s1),
s3 as (select *, case when typical > ptyp then typical * volume else 0 end as inflow,
         case when typical < ptyp then typical * volume else 0 end as outflow from s2),
cut as (
  select symbol, day, r1, {roll('stddev_samp', 'r1', 20)} as vol20, -({roll('min', 'dd', 20)}) as maxdd20,
    100 - 100 / (1 + {roll('sum', 'inflow', 14)} / nullif({roll('sum', 'outflow', 14)}, 0)) as MFI14 from s3)"""
_DRIFT = " union all ".join(f"""select '{c}' as feature, count(*) filter (where l.symbol is null) as stream_only,
  count(*) filter (where cut.symbol is null) as batch_only, {r(f'max(abs(cut.{c} - l.{c}))')} as max_delta,
  {r(f'avg(abs(cut.{c} - l.{c}))')} as mean_delta, count(*) filter (where abs(cut.{c} - l.{c}) > 1e-6) as drifted
  from cut full join light l on l.symbol = cut.symbol and l.day = cut.day""" for c in ("r1", "vol20", "maxdd20", "MFI14"))

TWINS = {
    "table_health": f"""{with_(ALERTS, _NOW)} {_health('silver.market', 'events', 'ts')} union all
        {_health('silver.indicator', 'hours', 'ts')} union all {_health('alert.market', 'raised', 'event_time')} union all
        {_health('silver.news', "(select date '2024-01-01' + (doc_id % 60)::int as d from documents)", 'd')}""",
    "symbol_freshness": f"""{with_(ALERTS, _NOW)} {_fresh('silver.market', 'events', 'ts', 'event_type')} union all
        {_fresh('silver.indicator', 'hours', 'ts')} union all {_fresh('alert.market', 'raised', 'event_time')}""",
    "active_alerts": f"""{with_(ALERTS, _NOW)} select symbol, event_time, alert_type, alert_level from raised
        where alert_level = 'HIGH' and event_time >= (select t from now_) - interval 4320 minutes
        order by event_time desc, symbol, alert_type limit 50""",
    "missing_symbol_incidents": """select 'silver.news' as table_name, 'missing_symbol' as incident_type,
          'Missing or blank symbol detected.' as message, to_timestamp(n_chars)::timestamp as ts
        from documents where doc_id not in (select doc_id from labels)
        union all select 'silver.market', 'missing_symbol', 'Missing or blank symbol detected.', ts from events
        where user_id % 50 = 0""",
    "feature_drift": f"{with_(LIGHT, _CUT)} {_DRIFT}",
    "offset_report": """with t as (select user_id % 4 as partition, event_id as o from events
          union all select user_id % 4, event_id from events where event_id % 97 = 0),
        g as (select partition, o, count(*) as n, o - lag(o) over (partition by partition order by o) as d from t group by 1, 2)
        select 'stock_market' as topic, partition::int as partition, min(o) as first_offset, max(o) as last_offset,
          sum(n)::bigint as rows, (sum(n) - count(*))::bigint as duplicates, (max(o) - min(o) + 1 - count(*))::bigint as missing,
          count(*) filter (where d > 1) as gaps from g group by 2""",
    "symbol_monitor": f"""{with_(ALERTS, _NOW)} select f.*, coalesce(n, 0) as active_alerts, last_alert from (
        {_fresh('silver.market', 'events', 'ts', 'event_type')}) f left join (
          select symbol, count(*) as n, max(event_time) as last_alert from raised
          where event_time >= (select t from now_) - interval 7200 minutes group by 1) a using (symbol)""",
    "request_readiness": """with o as (
          select o_custkey, count(*) filter (where o_orderstatus = 'P') as m, max(o_orderdate) as newest from orders group by 1),
        b as (select c_custkey as request_id, c_nationkey % 2 = 0 as portfolio, newest is not null
            and newest >= timestamp '2000-06-01' and coalesce(m, 0) = 0 as market,
            newest is not null and newest >= timestamp '2000-06-01' as risk, c_acctbal > 0 as acct
          from customer left join o on o_custkey = c_custkey)
        select request_id, case when portfolio then 'portfolio_recommendation' else 'single_symbol_advisory' end as decision_mode,
          case when portfolio then market and risk and acct else market end as ready,
          ((not market)::int + case when portfolio then (not risk)::int + (not acct)::int else 0 end)::bigint as blocking_sections
        from b""",
}
