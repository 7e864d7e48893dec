from twins.base import FULL, r, scored, with_
from twins.context import FUND, SENT
from twins.serving import POS


def two(x: str) -> str:
    """Half up on the shortest decimal form."""
    return f"round(({x})::double::varchar::decimal(30,20), 2)::double"


def even(x: str) -> str:
    """Two digits of the exact binary value, ties to even, as C formats it."""
    return f"(printf('%.2f', ({x})::double)::double + 0.0)"


CTX = FULL + ", " + scored("feats") + """, ctx as (
  select * replace (pred_a * 5 as pred_a, least(1.0, risk_prob * 1.4) as risk_prob) from scored),
sg0 as (
  select *, greatest(0, least(1, pred_a)) as pu, coalesce(sign(EMA20_50_spread), 0) + coalesce(sign(EMA20_slope), 0)
    + coalesce(sign(ROC10), 0) as votes from ctx),
sg1 as (
  select *, case when pu >= 0.55 then 'UP' when pu <= 0.45 then 'DOWN' else 'NEUTRAL' end as pdir from sg0),
sg as (
  select *, case when coalesce(ADX14, 0) >= 15 and votes > 0 then 'UP' when coalesce(ADX14, 0) >= 15 and votes < 0 then 'DOWN'
      else pdir end as trend,
    case when risk_prob >= 0.75 then 'CRITICAL' when risk_prob >= 0.6 then 'HIGH' when risk_prob >= 0.35 then 'MEDIUM'
      else 'LOW' end as risk_label, greatest(0.25, least(0.9, 1 - risk_prob / 2)) as cap from sg1),
st as (
  select *, case when ml and pu >= 0.6 then 'BULLISH' when ml and 1 - pu >= 0.6 then 'BEARISH' when trend = 'UP' then 'BULLISH'
      when trend = 'DOWN' then 'BEARISH' else 'NEUTRAL' end as stance,
    case when ml then """ + even("(tc + greatest(pu, 1 - pu)) / 2") + """ else tc end as conf
  from (select *, case when trend in ('UP', 'DOWN') then 0.66 else 0.55 end::double as tc, day(day) % 5 <> 0 as ml from sg))"""

ROWS = CTX + ", " + POS + ", " + SENT + ", " + FUND + """, req as (
  select c_custkey as request_id, c_nationkey % 2 = 0 as portfolio,
    case when c_mktsegment = 'BUILDING' then 'SHORT_TERM' else 'LONG_TERM' end as time_horizon,
    case c_custkey % 3 when 0 then 'BUY' when 1 then 'SELL' end as prop,
    case when c_custkey % 2 = 0 then 'INCREASE_WEIGHT' else 'EXIT' end as act, (c_custkey % 40)::double as turnover from customer),
cur as (
  select symbol, case when pu >= 0.6 then 'BULLISH' when 1 - pu >= 0.6 then 'BEARISH' when trend = 'UP' then 'BULLISH'
      when trend = 'DOWN' then 'BEARISH' else 'NEUTRAL' end as stance,
    """ + even("(case when trend in ('UP', 'DOWN') then 0.66 else 0.55 end::double + greatest(pu, 1 - pu)) / 2") + """ as conf, pu,
    risk_label, cap from sg where day = (select max(day) from sg)),
bs as (
  select replace(symbol, 'src', 'Brand#') as symbol, sentiment_label, sentiment_score,
    latest_article_published_at < timestamp '2024-02-15' as stale from sentiment),
bv as (
  select p_brand as symbol, v.symbol as part, valuation_label, valuation_quality from valuation v join part on p_partkey = v.symbol
  qualify row_number() over (partition by p_brand order by v.symbol desc) = 1),
rows_ as (
  select req.*, pos.symbol, cur.symbol is not null as hm, stance, conf, pu, risk_label, cap, sentiment_label, sentiment_score,
    stale, part, valuation_label, valuation_quality
  from req join pos on account_id = request_id left join cur using (symbol) left join bs using (symbol) left join bv using (symbol)),
mroll as (
  select request_id, coalesce(""" + even("round(avg(conf) filter (where hm), 10)") + """, 0) as market_confidence,
    arg_min(stance, (-conf, symbol)) filter (where hm) as market_stance,
    max(greatest(pu, 1 - pu)) as ml_confidence,
    coalesce(list(('market_features.' || symbol) order by symbol) filter (where not hm), []) as missing_fields,
    case when count(*) filter (where hm) = 0 then 'ERROR' when count(*) filter (where not hm) > 0 then 'DEGRADED'
      else 'SUCCESS' end as market_status
  from rows_ group by 1),
hold as (
  select account_id, tenant_id, upper(symbol) as symbol,
    """ + even("market_value / (sum(market_value) over (partition by account_id) + cash) * 100") + """ as weight from pos),
heavy as (
  select account_id as request_id, coalesce(list(symbol order by symbol) filter (where weight > 12), []) as overweight
  from hold where account_id % 7 <> 0 group by 1),
rroll0 as (
  select request_id, portfolio, max(case risk_label when 'LOW' then 0 when 'MEDIUM' then 1 when 'HIGH' then 2 when 'CRITICAL'
      then 3 end) as sev, min(cap) as cap,
    coalesce(list(('risk_snapshot.' || symbol) order by symbol) filter (where not hm), []) as miss
  from rows_ group by 1, 2),
rroll as (
  select request_id, coalesce(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][sev + 1], 'HIGH') as risk_label,
    coalesce(cap, 0.45) as risk_cap, case when sev is null then 0 else """ + even("least(0.8, cap)") + """ end as risk_confidence,
    case when portfolio then coalesce(overweight, []) else [] end as overweight, lst as risk_missing,
    case when sev is null then 'ERROR' when len(lst) > 0 then 'DEGRADED' else 'SUCCESS' end as risk_status
  from (select rroll0.*, overweight, case when portfolio and overweight is null then list_append(miss, 'portfolio_snapshot') else miss
        end as lst from rroll0 left join heavy using (request_id))),
sroll as (
  select request_id, case when n = 0 then 'UNAVAILABLE' when d > 1 then 'MIXED' else l end as sentiment_label,
    case when n = 0 then 0 when old then least(c, 0.45) else c end as sentiment_confidence,
    case when n = 0 then 'SKIPPED' when n < k or old then 'DEGRADED' else 'SUCCESS' end as sentiment_status
  from (select request_id, count(sentiment_label) as n, count(*) as k, count(distinct sentiment_label) as d,
      min(sentiment_label) as l, coalesce(bool_or(stale), false) as old,
      """ + even("round(0.5 + least(avg(abs(sentiment_score)), 1) * 0.3, 10)") + """ as c from rows_ group by 1)),
vroll as (
  select request_id, l as valuation_label, case when n = 0 then 0 when unk or l = 'UNKNOWN' then 0.35 when low then 0.45 else 0.58 end
      as valuation_confidence,
    case when n = 0 then 'SKIPPED' when n < k or low or unk then 'DEGRADED' else 'SUCCESS' end as valuation_status
  from (select request_id, count(valuation_label) as n, count(*) as k,
      coalesce(bool_or(valuation_quality = 'LOW'), false) as low,
      coalesce(bool_or(valuation_label = 'UNKNOWN' or valuation_quality = 'UNKNOWN'), false) as unk,
      case when bool_or(valuation_label = 'OVERVALUED') then 'OVERVALUED' when bool_or(valuation_label = 'UNDERVALUED')
        then 'UNDERVALUED' when bool_or(valuation_label = 'FAIRLY_VALUED') then 'FAIRLY_VALUED' else 'UNKNOWN' end as l
    from rows_ group by 1)),
refs as (
  select request_id, 1 as o, 'ml_ready.stock_price_features:' || symbol as ref, true as trust from rows_ where hm
  union all select request_id, 2, 'ml.predictions:' || symbol, true from rows_ where hm
  union all select request_id, 3, 'finbert.news:' || symbol, false from rows_ where sentiment_label is not null
  union all select request_id, 4, 'yfinance.fundamentals:' || part, false from rows_ where valuation_label is not null
  union all select request_id, 5, 'ml.risk:' || symbol, true from rows_ where hm
  union all select distinct request_id, 6, 'postgresql.portfolio_positions:' || request_id, true from rows_ where request_id % 7 <> 0),
cites as (
  select request_id, list(ref order by o, ref) as cited from (select distinct request_id, o, ref from refs) group by 1),
hits as (
  select request_id, count(*) as n, count(*) filter (where exists (select 1 from rows_ s
      where s.request_id = refs.request_id and contains(upper(ref), upper(s.symbol)))) as rel,
    count(*) filter (where trust) as trust from refs group by 1),
sq0 as (
  select request_id, stale_data, m > 0 as market, case when present = 0 then 0 else
    """ + even("(present - stale_data::int) / present::double") + """ end as freshness,
    """ + even("(3 * m + s + v + (portfolio and held)::int) / (5 * n + portfolio::int)") + """ as completeness
  from (select *, 3 * (m > 0)::int + (s > 0)::int + (v > 0)::int + held::int as present from (
    select request_id, portfolio, request_id % 7 <> 0 as held, count(*) as n, count(*) filter (where hm) as m,
      count(sentiment_label) as s, count(valuation_label) as v,
      coalesce(bool_or(stale) filter (where sentiment_label is not null), false) as stale_data from rows_ group by 1, 2))),
sq1 as (
  select sq0.*, coalesce(""" + even("rel / n") + """, 0.5)::double as relevance, coalesce(""" + even("trust / n") + """, 0.5)::double as reliability
  from sq0 left join hits using (request_id)),
sq2 as (
  select *, """ + even("0.35::double * freshness + 0.25::double * relevance + 0.25::double * completeness + 0.15::double * reliability") + """ as quality from sq1),
sq as (
  select *, case when freshness < 0.6 or quality < 0.6 then 0.55 when quality < 0.7 then 0.65 else 0.9 end::double as quality_cap,
    """ + even("least(0, (quality - 1) * 0.2::double)") + """ as quality_adjustment,
    list_filter([case when not market then 'Required market feature data is missing.' end,
      case when stale_data then 'One or more tool results are stale.' end,
      case when relevance < 0.7 then 'Some source references do not directly mention requested symbols.' end,
      case when completeness < 0.7 then 'Optional or per-symbol tool context is incomplete.' end], lambda x: x is not null)
      as quality_warnings from sq2)"""

DEC = ROWS + """, j0 as (
  select * from req join mroll using (request_id) join rroll using (request_id) join sroll using (request_id)
    join vroll using (request_id) join sq using (request_id) left join cites using (request_id)),
j1 as (
  select *, risk_label in ('HIGH', 'CRITICAL') as risky, coalesce(market_stance = 'BULLISH', false) as bull,
    valuation_label = 'OVERVALUED' as over_ from j0),
j2 as (
  select *, list_filter([case when risky and bull then 'Risk is high while market or ML signals are bullish.' end,
      case when risky and over_ then 'Valuation is overvalued while risk is high.' end,
      case when sentiment_label = 'BEARISH' and bull then 'Sentiment is bearish while technical signals are bullish.' end,
      case when quality < 0.7 then 'Source quality is low enough to cap confidence.' end,
      case when stale_data then 'Market or supporting data is stale.' end], lambda x: x is not null) as conflicting_signals from j1),
j3 as (
  select *, case when len(conflicting_signals) = 0 then 'NONE' when risk_label in ('CRITICAL', 'HIGH') or len(conflicting_signals) >= 2
      then 'HIGH' when time_horizon = 'SHORT_TERM' then 'MEDIUM' else 'LOW' end as conflict_level,
    """ + two("0.3::double * market_confidence + 0.25::double * coalesce(ml_confidence, 0.5) + 0.2::double * coalesce(sentiment_confidence, 0.5) + 0.15::double * coalesce(valuation_confidence, 0.5) + 0.1::double * quality") + """ as base_confidence,
    case risk_label when 'LOW' then 0.02 when 'MEDIUM' then -0.04 when 'HIGH' then -0.12 else -0.25 end::double as risk_adjustment
  from j2),
j4 as (
  select *, conflict_level in ('MEDIUM', 'HIGH') as major_conflict,
    case when conflict_level in ('MEDIUM', 'HIGH') then least(risk_cap, 0.7) else risk_cap end as applied_risk_cap,
    case when freshness < 0.6 then least(quality_cap, 0.55) else quality_cap end as applied_quality_cap from j3),
decided as (
  select *, """ + two("least(" + two("greatest(0, least(1, base_confidence + risk_adjustment))") + ", applied_risk_cap, applied_quality_cap)") + """ as final_confidence from j4)"""

TWINS = {
    "symbol_signals": f"""{with_(CTX)} select symbol, day, pdir as predicted_direction, {r('pu')} as probability_up,
        {r('1 - pu')} as probability_down, trend as trend_direction, {r('coalesce(r1, 0)')} as price_change_1d,
        {r('greatest(coalesce(RVOL20, 1), 0)')} as volume_ratio, {r('case when RSI14 between 0 and 100 then RSI14 end')} as rsi_14,
        case when coalesce(MACD_hist, 0) > 0 then 'BULLISH' when coalesce(MACD_hist, 0) < 0 then 'BEARISH' else 'NEUTRAL' end
          as macd_signal,
        case when BB_pctB >= 0.8 then 'UPPER' when BB_pctB <= 0.2 then 'LOWER' else 'MIDDLE' end as bollinger_position, risk_label,
        (1 + (coalesce(vol20, 0) >= 0.04)::int + (coalesce(maxdd20, 0) <= -0.1)::int)::int as factors,
        printf('upstream risk_prob=%.4f', risk_prob) as first_factor, {r('greatest(0, coalesce(vol20, 0))')} as volatility,
        {r('coalesce(maxdd20, 0)')} as max_drawdown, {r('cap')} as confidence_cap from sg""",
    "market_stances": f"{with_(CTX)} select symbol, day, stance, {r('conf')} as market_confidence from st",
    "market_rollup": f"""{with_(ROWS)} select request_id, {r('market_confidence')} as market_confidence, market_stance,
        {r('ml_confidence')} as ml_confidence, missing_fields, market_status from mroll""",
    "risk_rollup": f"""{with_(ROWS)} select request_id, risk_label, {r('risk_cap')} as risk_cap, {r('risk_confidence')} as
        risk_confidence, overweight, risk_missing, risk_status from rroll""",
    "sentiment_rollup": f"""{with_(ROWS)} select request_id, sentiment_label, {r('sentiment_confidence')} as sentiment_confidence,
        sentiment_status from sroll""",
    "valuation_rollup": f"""{with_(ROWS)} select request_id, valuation_label, {r('valuation_confidence')} as valuation_confidence,
        valuation_status from vroll""",
    "source_quality": f"""{with_(ROWS)} select request_id, stale_data, {', '.join(f'{r(c)} as {c}' for c in (
        'freshness', 'relevance', 'completeness', 'reliability', 'quality', 'quality_cap', 'quality_adjustment'))},
        quality_warnings from sq""",
    "request_decisions": f"""{with_(DEC)} select request_id, conflict_level, major_conflict, conflicting_signals,
        case when prop = 'BUY' and risky then 'HOLD' when prop = 'BUY' and (quality < 0.6 or stale_data) then 'WATCH' else prop end
          as recommendation,
        case when act = 'INCREASE_WEIGHT' and (risky or over_) then 'MAINTAIN_WEIGHT' else act end as portfolio_action,
        {', '.join(f'{r(c)} as {c}' for c in ('base_confidence', 'risk_adjustment', 'applied_risk_cap', 'applied_quality_cap',
                                              'final_confidence'))},
        list_filter([case when final_confidence < 0.55 then 'LOW_CONFIDENCE' end, case when risky then 'HIGH_RISK' end,
          case when quality < 0.65 then 'DATA_QUALITY' end, case when stale_data then 'STALE_DATA' end,
          case when conflict_level in ('MEDIUM', 'HIGH') then 'CONFLICTING_SIGNALS' end,
          case when turnover > 25 then 'PORTFOLIO_CONSTRAINT_VIOLATION' end], lambda x: x is not null) as review_reasons,
        final_confidence < 0.55 or risky or quality < 0.65 or stale_data or conflict_level in ('MEDIUM', 'HIGH') or turnover > 25
          as requires_review,
        list_concat(list_concat(list_transform(missing_fields, lambda x: 'missing:' || x),
          list_transform(risk_missing, lambda x: 'missing:' || x)), quality_warnings) as limitations,
        coalesce(cited, []) as citations from decided""",
    "evidence_hashes": """select c_custkey as request_id, 'sha256:' || sha256('{"decision_mode":"'
        || case when c_nationkey % 2 = 0 then 'portfolio_recommendation' else 'single_symbol_advisory' end
        || '","proposed_recommendation":' || case c_custkey % 3 when 0 then '"BUY"' when 1 then '"SELL"' else 'null' end
        || ',"request_id":' || c_custkey || ',"time_horizon":"'
        || case when c_mktsegment = 'BUILDING' then 'SHORT_TERM' else 'LONG_TERM' end || '"}') as result_hash from customer""",
    "account_holdings": f"""{with_(POS)} select account_id, tenant_id, upper(symbol) as symbol, {even(
        'market_value / (sum(market_value) over (partition by account_id) + cash) * 100')} as weight from pos""",
    "tenant_holdings": f"""{with_(POS)} select account_id, tenant_id, upper(symbol) as symbol, {even(
        'market_value / (sum(market_value) over (partition by account_id) + cash) * 100')} as weight from pos
        where tenant_id = 'BUILDING'""",
    "rebalance_plan": f"""{with_(POS)}, h as (select account_id, upper(symbol) as symbol, {even(
        'market_value / (sum(market_value) over (partition by account_id) + cash) * 100')} as w from pos),
        k as (select *, count(*) over (partition by account_id) as n from h where symbol not in ('BRAND#3', 'BRAND#7')),
        t as (select *, least(6, {even('90.0::double / n')}) as target from k)
        select account_id, symbol, w as current_weight, target as target_weight, {even('target - w')} as change,
          {even('greatest(10, 100 - ' + even('target * n') + ')')} as cash_target from t
        union all select distinct account_id, null, null::double, null::double, null::double, 100.0::double from h
        where account_id not in (select account_id from k)""",
    "allocation_checks": f"""{with_(POS)}, h as (select account_id, symbol, {even(
        'market_value / (sum(market_value) over (partition by account_id) + cash) * 100')} as w, cash,
          sum(market_value) over (partition by account_id) as mv from pos),
        a as (select account_id as portfolio_id, count(*) filter (where w < 0) as negative, count(*) filter (where w > 15) as over_weight,
          round(max(cash) / (max(mv) + max(cash)) * 100, 2) as c, sum(w) as s from h group by 1),
        b as (select portfolio_id, negative, over_weight, 0::bigint as not_numeric, round(abs(s + c - 100), 6) >= 0.01 as total_off,
          c < 0.5 as cash_short from a)
        select *, negative = 0 and over_weight = 0 and not total_off and not cash_short as passed from b""",
    "forbidden_claim_scan": """select doc_id, list_filter(list_transform(['guaranteed profit', 'risk-free', 'certain return'],
          lambda c: case when contains(lower(text), c) then c end), lambda x: x is not null) as claims, length(text)::int as chars
        from (select doc_id, text from documents union all select -conv_id * 1000 - turn, text from conversations)""",
    "message_routes": """with own as (
          select conv_id, turn, list_filter(list_distinct(regexp_split_to_array(text, '[^A-Za-z0-9-]+')), lambda t:
            regexp_full_match(t, '[A-Z]{1,5}(-[A-Z])?') and t not in ('I', 'A', 'THE', 'AND', 'OR', 'FOR', 'API', 'SQL', 'HTML',
              'CSS', 'JSON', 'CSV')) as o,
            row_number() over (partition by conv_id order by turn) as i from conversations),
        past as (select a.conv_id, a.turn, list_distinct(flatten(list(b.o))) as p from own a
          join own b on b.conv_id = a.conv_id and b.i between a.i - 5 and a.i - 1 group by 1, 2),
        s as (select own.conv_id, own.turn, list_sort(case when len(o) > 0 then o else coalesce(p, []) end) as symbols
          from own left join past using (conv_id, turn))
        select conv_id, turn, symbols, case when len(symbols) > 1 then 'symbol_comparison' when len(symbols) = 1
          then 'single_symbol_advisory' else 'clarification' end as route,
          case when len(symbols) > 0 then 0.35 else 0.0 end::double as router_confidence from s""",
}
