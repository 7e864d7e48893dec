from twins.base import EOD, FULL, HOURS, PRED, r, scored, with_
from twins.context import NEWS
from twins.timeseries import ALERTS

POS = """pos as (
  select o_custkey as account_id, c_mktsegment as tenant_id, p_brand as symbol, sum(l_extendedprice) as market_value,
    greatest(max(c_acctbal), 0) as cash
  from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey
    join customer on c_custkey = o_custkey group by 1, 2, 3)"""

_PICKS = PRED + """, pk as (
  select day as date, symbol as ticker, close as entry_price, pred_a, risk_prob * 100 as risk_prob_pct,
    pred_a * (1 - risk_prob * 100 / 100) as final_score from scored
  where pred_a >= 0.06 and risk_prob * 100 <= 45 order by day desc, final_score desc, ticker limit 25)"""

_LATEST = """latest as (
  select * from (select *, row_number() over (partition by symbol order by day desc) as k from scored) where k = 1)"""

_CTX = ("r1", "RVOL20", "RSI14", "BB_pctB", "EMA20_50_spread", "ROC10", "ADX14", "vol20", "maxdd20", "beta_60D", "pred_a",
        "risk_prob", "final_score", "latest_polarity")

TWINS = {
    "advisory_context": f"""{with_(FULL, scored('feats'), NEWS)}, senti as (
          select replace(symbol, 'src', 'Brand#') as symbol, arg_max(ifnull(polarity, 'nan'), day * 1) as p from (
            select symbol, polarity, row_number() over (partition by symbol order by day, id) as day from news) group by 1)
        select symbol, day, 'v1' as feature_version, {', '.join(f'{r(c)} as {c}' for c in _CTX)},
          {r('MACD_hist', 4)} as MACD_hist, {r('EMA20_slope', 4)} as EMA20_slope, close
        from (select scored.*, case when isnan(p) then null else p end as latest_polarity
              from scored left join senti using (symbol) where day = (select max(day) from scored where day <= date '2001-01-01'))""",
    "valid_latest_rows": f"""{with_(PRED)} select upper(symbol) as symbol, day, close, {r('pred_a')} as pred_a, {r('risk_prob')} as risk_prob,
        {r('final_score')} as final_score, t as prediction_time from (
          select *, row_number() over (partition by symbol order by t desc, day desc) as k from (
            select *, day + (day(day) % 3)::int as t from scored) where close > 0) where k = 1""",
    "request_context_status": f"""{with_(PRED, POS)}, ctx as (
          select symbol, day::timestamp as updated_at from scored where day = (select max(day) from scored)),
        j as (select account_id as request_id, updated_at from pos left join ctx using (symbol)),
        a as (select request_id, count(updated_at) as found, count(*) - count(updated_at) as missing,
          (select max(updated_at) + interval 2 days from ctx) as as_of, max(updated_at) as u from j group by 1)
        select request_id, found, missing, case when found = 0 then 'UNAVAILABLE' when missing > 0 then 'PARTIAL'
          else 'SUCCESS' end as status, coalesce(u, as_of) as last_updated,
          epoch(as_of) - epoch(coalesce(u, as_of)) > 86400 as is_stale from a""",
    "latest_screen": f"""{with_(PRED)}, top as (
          select * from scored where day = (select max(day) from scored) order by final_score desc nulls last, symbol limit 5),
        px as (select symbol, arg_max(close, day) as latest_price from eod group by 1),
        lf as (select * from (select symbol, r1, r3, r5, RVOL20, row_number() over (partition by symbol order by day desc) as k
               from light) where k = 1)
        select top.symbol, day, {r('pred_a')} as pred_a, {r('risk_prob')} as risk_prob, {r('final_score')} as final_score,
          latest_price, {r('lf.r1')} as r1, {r('lf.r3')} as r3, {r('lf.r5')} as r5, {r('lf.RVOL20')} as RVOL20
        from top left join px using (symbol) left join lf on lf.symbol = top.symbol""",
    "latest_scores": f"""{with_(PRED, _LATEST)} select symbol, day, close, {r('pred_a')} as pred_a, {r('risk_prob')} as risk_prob,
        {r('final_score')} as final_score, 'v1' as feature_version from latest""",
    "holdings_comparison": f"""{with_(PRED, _LATEST, POS)} select account_id, symbol, day, close as latest_price,
        {r('final_score')} as final_score,
        row_number() over (partition by account_id order by coalesce(final_score, 0) desc, symbol)::int as rank,
        list_filter([case when day is null then 'missing as_of' end, case when close is null then 'missing latest_price' end,
          case when final_score is null then 'missing final_score' end], lambda x: x is not null) as warnings,
        case when final_score is null then 'warning' else 'ok' end as status
        from pos left join latest using (symbol)""",
    "stock_picks": f"""{with_(_PICKS)} select date, ticker, entry_price, {r('pred_a')} as pred_a,
        {r('risk_prob_pct')} as risk_prob_pct, {r('final_score')} as final_score from pk""",
    "picks_summary": f"""{with_(_PICKS)} select count(*) as signals, {r('max(final_score)')} as best_score,
        {r('avg(pred_a) * 100')} as mean_upside_pct from pk where final_score >= 0.02 and risk_prob_pct <= 42""",
    "market_overview": f"""with l as (
          select event_type as indicator, max(ts) as latest_time, arg_max(value, ts) as close from events group by 1),
        p as (select e.event_type as indicator, arg_max(e.value, e.ts) as previous_close from events e
          join l on l.indicator = e.event_type where e.ts < latest_time and e.ts::date < latest_time::date group by 1)
        select indicator, latest_time, close, previous_close, {r('close - previous_close')} as change_value,
          {r('(close - previous_close) / nullif(previous_close, 0) * 100')} as change_pct, 1::bigint as volume
        from l left join p using (indicator)""",
    "latest_market": f"""{with_(HOURS)} select symbol, ts, open, high, low, close, volume,
        {r('(close - open) / nullif(open, 0) * 100')} as day_change_pct from (
          select *, row_number() over (partition by symbol order by ts desc) as k from hours) where k = 1""",
    "symbol_directory": "select distinct p_brand as symbol from part where p_partkey in (select l_partkey from lineitem)",
    "symbol_history": f"""{with_(HOURS)} select symbol, ts, open, high, low, close, volume from hours
        where symbol = 'purchase' and ts >= timestamp '2024-01-10' order by ts limit 20000""",
    "news_search": f"""{with_(NEWS)} select ts, symbol, id, url, event_timestamp from (
        select day::timestamp as ts, symbol, md5(headline) as id, url, id as event_timestamp,
          row_number() over (partition by md5(headline) order by id desc, day desc) as k from news
        where headline ilike '%the %') where k = 1 order by ts desc, id limit 300""",
    "alert_search": f"""{with_(ALERTS)} select symbol, event_time, alert_type, alert_level, feature_name from raised
        where symbol in ('click', 'purchase', 'view') and alert_level in ('HIGH', 'MEDIUM')
          and event_time >= timestamp '2024-01-05' and event_time < timestamp '2024-01-21'
        order by event_time desc, symbol, alert_type limit 100""",
    "alert_facets": f"""{with_(ALERTS)} select list_sort(list(distinct symbol)) as symbols,
        list_sort(list(distinct alert_type)) as alert_types, list_sort(list(distinct alert_level)) as alert_levels from raised""",
    "market_page": f"""{with_(EOD)} select symbol, day::timestamp as ts, open, high, low, close, volume,
        {r('(close - open) / nullif(open, 0) * 100')} as day_change_pct from (
          select *, row_number() over (partition by symbol order by day desc) as k from eod) where k = 1
        order by (close - open) / nullif(open, 0) desc nulls last, symbol limit 5 offset 5""",
    "indicator_names": """select '^' || replace(p_name, ' ', '_') || '=F' as code, count(*) as n,
        array_to_string(list_transform(string_split(any_value(p_name), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') as name
        from part group by p_name""",
    "table_diagnostics": f"""{with_(PRED, POS)} select 'predictions' as table_name, count(*) as row_count, max(day)::varchar as latest,
        ['symbol', 'day', 'close', 'pred_a', 'risk_prob', 'final_score', 'feature_version'] as columns, 'ok' as status,
        []::varchar[] as warnings from scored
        union all select 'positions', count(*), null, ['account_id', 'tenant_id', 'symbol', 'market_value', 'cash'], 'warning',
        ['positions missing day column'] from pos""",
}
