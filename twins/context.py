from twins.base import r, with_

NEWS = """news as (
  select source as symbol, doc_id as id, text as headline, lang, date '2024-01-01' + (doc_id % 60)::int as day,
    (quality - toxic)::double as polarity, 'doc/' || doc_id as url
  from documents left join labels using (doc_id))"""

ALIASES = """aliases as (
  select distinct symbol, alias from (select 'src' || (item_id % 20) as symbol,
    lower(trim(unnest(string_split_regex(text, '\\s+')), '.,')) as alias from benchmark) where length(alias) >= 6)"""

MERGED = NEWS + """, both_ as (
  select symbol, id, headline, polarity, day::timestamp as published_at,
    case when id % 3 = 0 then url end as url, 0 as prio, 'yfinance' as data_source from news
  union all
  select symbol, id, headline, polarity, day::timestamp, url, 1, 'finnhub' from news),
keyed as (
  select *, case when length(trim(coalesce(url, ''))) > 0 then 'url:' || lower(trim(url))
    else 'title:' || lower(trim(headline)) || ':' || strftime(published_at, '%Y-%m-%d') end as k from both_),
merged as (
  select * from (select *, row_number() over (partition by symbol, k order by prio, id) as first_ from keyed)
  where first_ = 1)"""

_RELEVANT = """exists (select 1 from aliases a where a.symbol = x.symbol and a.alias <> '' and contains(lower(x.headline), a.alias))"""

SENT = MERGED + ", " + ALIASES + f""", newest as (
  select * from (select *, row_number() over (partition by symbol order by published_at desc nulls last, id) as rank
                 from merged) where rank <= 30),
rel as (select x.* from newest x where {_RELEVANT}),
windowed as (
  select *, published_at >= timestamp '2024-02-06' and published_at < timestamp '2024-02-21' as fresh,
    row_number() over (partition by symbol order by rank) as pos from rel),
kept as (
  select *, least(greatest(coalesce(polarity, 0), -1), 1) as score from (
    select *, bool_or(fresh) over (partition by symbol) as any_ from windowed) where fresh or (not any_ and pos <= 10)),
sent as (
  select symbol, avg(score) as m, count(*)::int as article_count, max(published_at) as latest_article_published_at,
    min(published_at) as oldest_article_published_at,
    (count(*) filter (where published_at < timestamp '2024-02-06'))::int as stale_article_count,
    bool_or(score > 0.2) as pos_, bool_or(score < -0.2) as neg_, bool_or(data_source = 'yfinance') as y,
    bool_or(data_source = 'finnhub') as f, (list(headline order by abs(score) desc, rank))[1:3] as drivers
  from kept group by symbol),
sentiment as (
  select date '2024-02-20' as as_of_date, symbol, least(greatest(m, -1), 1) as sentiment_score,
    case when pos_ and neg_ then 'MIXED' when m >= 0.2 then 'BULLISH' when m <= -0.2 then 'BEARISH' else 'NEUTRAL' end
      as sentiment_label,
    article_count, latest_article_published_at, oldest_article_published_at, stale_article_count, drivers,
    list_filter([case when y then 'yfinance.news:' || symbol end, case when f then 'finnhub.company_news:' || symbol end,
                 'finbert:ProsusAI/finbert'], lambda x: x is not null) as source_refs
  from sent)"""

FUND = """fund as (
  select p_partkey as symbol, p_type as sector, case when p_retailprice > 0 then p_retailprice end as price,
    coalesce(case when p_size % 7 <> 0 and p_size > 0 then p_size::double end,
             case when p_size % 5 <> 0 then (p_size + 1)::double end) as pe,
    case when p_size % 3 = 0 then p_retailprice * (0.8::double + p_size / 100.0::double) end as target,
    case when p_size % 10 > 0 then (p_size % 10)::double end as analysts from part),
sec as (select sector, median(pe) as sector_median, count(pe) as n from fund where pe is not null group by sector),
v0 as (
  select fund.*, sector_median, coalesce(n, 0)::int as n, coalesce(target, price * sector_median / pe) as fair,
    case when sector_median is null then 'fallback_sector_pe' when target is not null then 'analyst_target'
         else 'sector_pe_relative' end as method
  from fund left join sec using (sector)),
valuation as (
  select date '2024-02-20' as as_of_date, symbol,
    case when fair is null then 'UNKNOWN' when (fair - price) / price * 100 >= 10 then 'UNDERVALUED'
         when (fair - price) / price * 100 <= -10 then 'OVERVALUED' else 'FAIRLY_VALUED' end as valuation_label,
    pe as pe_ratio, sector_median as sector_pe_ratio, fair as fair_value_estimate,
    (fair - price) / price * 100 as upside_downside_pct,
    case when fair is null then 'unavailable' else method end as valuation_method,
    case when fair is null then 'UNKNOWN' when method = 'analyst_target' and analysts >= 5 then 'MEDIUM'
         when method = 'sector_pe_relative' and pe is not null and n >= 10 then 'MEDIUM' else 'LOW' end as valuation_quality,
    n as sector_sample_count, analysts as analyst_count, ['yfinance.fundamentals:' || symbol] as source_refs
  from v0)"""

_DYN = "over (partition by symbol order by day)"

TWINS = {
    "daily_news": f"""{with_(NEWS)} select symbol, day, {r('avg(coalesce(polarity, 0))')} as S_it, count(headline) as N_it
        from news group by 1, 2""",
    "news_dynamics": f"""{with_(NEWS)}, d0 as (
        select symbol, day, avg(coalesce(polarity, 0)) as S_it, count(headline) as N_it from news group by 1, 2),
        d1 as (select *, greatest(coalesce(day - lag(day) {_DYN}, 1), 1) as delta_t,
          S_it - coalesce(lag(S_it) {_DYN}, 0) as delta_S,
          N_it / coalesce(avg(N_it) over (partition by symbol order by day rows between 20 preceding and 1 preceding), 1)
            as Z from d0),
        d2 as (select *, delta_S / delta_t as V from d1),
        d3 as (select *, V - coalesce(lag(V) {_DYN}, 0) as A from d2)
        select symbol, day, {r('S_it')} as S_it, N_it, delta_t::int as delta_t, {r('delta_S')} as delta_S, {r('V')} as V,
          {r('A')} as A, {r('Z')} as Z, {r('delta_S * ln(1 + Z) * (1 + A)')} as M from d3""",
    "merged_news": f"""{with_(MERGED)} select symbol, id, data_source, published_at, length(headline)::int as chars,
        md5(headline) as digest, url from merged""",
    "flattened_payloads": f"""{with_(NEWS)} select symbol, id, case when id % 3 = 0 then url else 'plain/' || url end as url,
        day::timestamp as published_at, md5(headline) as digest from news""",
    "relevant_news": f"""{with_(NEWS, ALIASES)} select symbol, id, lang from news x where {_RELEVANT}""",
    "sentiment_snapshot": f"""{with_(SENT)} select as_of_date, symbol, {r('sentiment_score')} as sentiment_score,
        sentiment_label, article_count, latest_article_published_at, oldest_article_published_at, stale_article_count,
        source_refs, list_transform(drivers, lambda x: md5(x)) as driver_digests from sentiment""",
    "sector_price_earnings": f"""{with_(FUND)} select sector, {r('sector_median')} as sector_median,
        n as sector_sample_count from sec""",
    "valuation_snapshot": f"""{with_(FUND)} select as_of_date, symbol, valuation_label, {', '.join(
        f'{r(c)} as {c}' for c in ('pe_ratio', 'sector_pe_ratio', 'fair_value_estimate', 'upside_downside_pct',
                                   'analyst_count'))},
        valuation_method, valuation_quality, sector_sample_count, source_refs from valuation""",
}
