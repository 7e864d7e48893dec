from twins.base import EOD, PRED, r, with_
from twins.context import NEWS

MSG = """msg as (
  select case when event_id % 31 = 0 then null else ts end as ts, case when event_id % 47 = 0 then '  ' else ' ' || event_type end
      as symbol, value as open, case when event_id % 37 = 0 then value - 1 else value + 1 end as high, value as low,
    case when event_id % 41 = 0 then 0.0 else value end::double as close, case when event_id % 43 = 0 then 0 else user_id end as volume,
    0.0::double as dividends, (event_id % 3)::double as stock_splits, 'stock_market' as topic, (user_id % 4)::int as partition,
    event_id as "offset" from events)"""
_OK = "ts is not null and length(trim(symbol)) > 0 and close > 0 and high >= low"

NMSG = NEWS + """, nm as (
  select day::timestamp as ts, case when id % 4 = 0 then 'S' || symbol else symbol end as symbol, epoch(day)::bigint as event_timestamp,
    ' ' || upper(lang) as category, id, symbol as related, url, case when id % 29 = 0 then ' ' else headline end as headline,
    headline as summary, (id % 4)::int as partition, id as "offset" from news)"""

LAND = """land as (
  select l_shipdate::date as day, upper(p_brand) as symbol, case when l_linenumber <> 7 then l_extendedprice / l_quantity end as open,
    l_extendedprice / l_quantity + 1 as high, l_extendedprice / l_quantity + case when l_linenumber = 6 then 2 else 0 end as low,
    l_extendedprice / l_quantity as close, case when l_linenumber = 5 then 0 else l_quantity end::bigint as volume,
    l_discount as stock_splits from lineitem join part on l_partkey = p_partkey)"""
_WANT = "(select distinct p_brand as symbol from part union select p_type from part)"

TWINS = {
    "decoded_market": f"""{with_(MSG)} select *, timestamp '2024-02-01' as etl_load from msg""",
    "decoded_indicators": f"""{with_(MSG)} select * exclude (symbol), symbol as indicator, timestamp '2024-02-01' as etl_load
        from msg where ts is not null""",
    "decoded_news": f"""{with_(NMSG)} select ts, symbol, event_timestamp, category, id, related, url, md5(headline) as digest,
        partition, "offset" from nm""",
    "silver_market": f"""{with_(MSG)} select ts, trim(symbol) as symbol, open, high, low, close, volume, dividends, stock_splits,
        {r('high - low')} as daily_range, {r('case when high > low then (close - low) / (high - low) end')} as close_position
        from msg where {_OK} and volume > 0""",
    "silver_indicators": f"""{with_(MSG)} select trim(symbol) as indicator, count(*) as rows,
        {r('avg(case when high > low then (close - low) / (high - low) end)')} as mean_position from msg where {_OK} group by 1""",
    "silver_indicator_rows": f"""{with_(MSG)} select ts, trim(symbol) as indicator, open, high, low, close, volume, dividends,
        stock_splits, {r('high - low')} as daily_range, {r('case when high > low then (close - low) / (high - low) end')}
          as close_position, timestamp '2024-02-01' as etl_load, timestamp '2024-02-01' as process_date from msg where {_OK}""",
    "silver_news": f"""{with_(NMSG)} select ts, trim(symbol) as symbol, id, lower(trim(category)) as category,
        md5(trim(headline, ' ')) as digest, 'wire' as source, md5(regexp_replace(trim(summary, ' '), '\\s+', ' ', 'g'))
          as summary_digest, url from nm where length(trim(headline)) > 0""",
    "rejected_market_rows": f"""{with_(MSG)} select count(*) as rows, count(*) filter (where ts is null) as bad_time,
        count(*) filter (where length(trim(symbol)) = 0) as bad_symbol, count(*) filter (where close <= 0) as bad_close,
        count(*) filter (where high < low) as bad_range, count(*) filter (where volume <= 0) as bad_volume,
        count(*) filter (where not coalesce({_OK} and volume > 0, false)) as rejected from msg""",
    "raw_prices": f"""{with_(LAND)} select symbol, 'yfinance' as source, count(*) as rows, count(open) as opens,
        sum(volume)::bigint as volume, count(*) filter (where volume = 0) as no_volume, {r('avg(stock_splits)')} as mean_splits
        from land group by 1""",
    "raw_price_rows": f"""{with_(LAND)} select day, symbol, open, high, low, close, close as adj_close, volume, 0.0::double as dividends,
        {r('stock_splits')} as stock_splits, 'yfinance' as source, timestamp '2024-02-01' as etl_load from land""",
    "clean_prices": f"""{with_(LAND)} select symbol, day, count(*) as rows, {r('sum(high - low)')} as ranges,
        {r('avg(case when high > low then (close - low) / (high - low) end)')} as mean_position from land
        where day <= date '2000-06-30' and open > 0 and low > 0 and close > 0 and high >= low group by 1, 2""",
    "price_history_gate": f"""{with_(EOD)} select symbol, coalesce(n, 0) as days, case when n is null then 'missing'
        when n < 1500 then 'short' else 'ok' end as status from {_WANT}
        left join (select symbol, count(distinct day) as n from eod group by 1) using (symbol)""",
    "current_tickers": """select distinct replace(case k when 'AGN' then 'ABBV' when 'BRK.B' then 'BRK-B' when 'CELG' then 'BMY'
          when 'FB' then 'META' when 'PCLN' then 'BKNG' when 'RTN' then 'RTX' when 'UTX' then 'RTX' else k end, '.', '-') as symbol
        from (select case when p_size > 25 then (['AGN', 'BRK.B', 'CELG', 'FB', 'MON', 'PCLN', 'RTN', 'TWX', 'UTX', 'WBA'])
          [p_partkey % 10 + 1] else upper(p_brand) end as k from part) where k not in ('MON', 'TWX', 'WBA')""",
    "canonical_bars": f"{with_(EOD)} select day as Datetime, symbol as Symbol, close as Close, volume from eod",
    "typed_context": """select o_orderkey, case when o_orderkey % 7 <> 0 then o_orderdate::date end as as_of_date,
        case when o_orderkey % 7 <> 0 then date_trunc('day', o_orderdate) + interval '10 hours 30 minutes' end as process_date
        from orders""",
    "merged_prices": f"""{with_(EOD)} select day, symbol, case when day >= date '2000-01-01' then close * 2 else close end as close,
        volume, case when day >= date '2000-01-01' then 'fixed' end as note from eod""",
    "load_windows": f"""{with_(EOD)}, m as (select symbol, d as max_day from {_WANT} left join (
          select symbol, max(day) as d from eod group by 1) using (symbol))
        select symbol, max_day, case when max_day is null then date '1992-01-01' else least(max_day, date '2001-01-31') - 10 end
          as start_day, date '2001-02-01' as end_day, case when max_day is null then 'initial_load' else 'rolling_overwrite' end
          as load_mode, 'incremental' as rule from m
        union all select symbol, max_day, date '2001-01-21', date '2001-02-01', 'rolling_overwrite', 'rolling' from m""",
    "table_state": f"""{with_(EOD)} select symbol, coalesce(n, 0) as days, last_day from {_WANT} left join (
        select symbol, count(distinct day) as n, max(day) as last_day from eod group by 1) using (symbol)""",
    "summarised_state": f"""{with_(EOD)} select symbol, coalesce(n, 0) as days, last_day from {_WANT} left join (
        select symbol, count(distinct day) as n, max(day) as last_day from eod group by 1) using (symbol)""",
    "summarised_health": f"""{with_(EOD)} select 'prices' as table_name, max(day)::timestamp as latest_time, count(*) as row_count,
        round((epoch(timestamp '2024-02-01') - epoch(max(day)::timestamp)) / 60.0, 2) as lag_minutes, 'ok' as status from eod""",
    "summarised_freshness": f"""{with_(EOD)} select 'prices' as table_name, symbol, max(day)::timestamp as latest_time,
        round((epoch(timestamp '2024-02-01') - epoch(max(day)::timestamp)) / 60.0, 2) as lag_minutes from eod group by symbol""",
    "run_manifest": f"""{with_(EOD)} select 'r1' as run_id, 'clean' as stage, count(*) as rows, min(day) as first_day,
        max(day) as last_day, count(distinct symbol) as symbols,
        ['symbol', 'day', 'open', 'high', 'low', 'close', 'volume'] as columns from eod""",
    "prediction_preview": f"""{with_(PRED)} select day, symbol, close as entry_price, {r('pred_a')} as pred_a,
        {r('pred_a * 100')} as upside_pct, {r('risk_prob')} as risk_prob, {r('risk_prob * 100')} as risk_prob_pct,
        {r('final_score')} as final_score, {r('pred_a * 100 * (1 - risk_prob * 100 / 100)')} as final_score_pct from scored""",
}
