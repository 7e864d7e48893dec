from barograph.schemas import FEATURE_COLUMNS
from twins.base import EOD, FULL, PRED, r, with_

_F14 = "over (partition by symbol order by day rows between 1 following and 14 following)"
OUT = f"""outc as (
  select symbol, day, close as entry_close, count(close) {_F14} as ahead,
    (max(close) {_F14} - close) / nullif(close, 0) as max_return, (min(close) {_F14} - close) / nullif(close, 0) as drawdown
  from eod)"""
LABELS = OUT + """, labelled as (
  select symbol, day, case when ahead = 14 then max_return end as label_upside,
    case when ahead = 14 then (drawdown <= -0.06)::int end as label_risk from outc)"""
JUDGED = PRED + ", " + LABELS + """, judged as (
  select * from scored join labelled using (symbol, day) where label_upside is not null)"""
_T14 = "over (partition by symbol order by day rows between 12 preceding and 1 following)"


def _daily_top(score: str, hit: str) -> str:
    return f"""{with_(JUDGED)} select day, count(*) as picked, {r(f'avg(({hit})::int)')} as hit_share from (
        select *, row_number() over (partition by day order by {score} desc, symbol) as rk,
          count(*) over (partition by day) as n from judged)
        where n >= 10 and rk <= greatest(1, floor(n * 0.1)) group by day"""


_SUMMARY = " union all ".join(f"""select '{c}' as measure, count({c}) as n, {r(f'avg({c})')} as mean,
  {r(f'stddev_samp({c})')} as std, {r(f'min({c})')} as min, {r(f'max({c})')} as max, {', '.join(
      f'{r(f"quantile_cont({c}, {p / 100})")} as p{p}' for p in (10, 25, 50, 75, 90))} from scored"""
                              for c in ("pred_a", "risk_prob", "final_score"))
_DIFFS = " union all ".join(f"""select '{c}' as measure, count(*) as rows, {r(f'max(abs({c} - floor({c} * 1000) / 1000))')}
  as max_diff, {r(f'avg(abs({c} - floor({c} * 1000) / 1000))')} as mean_diff from scored"""
                            for c in ("pred_a", "risk_prob", "final_score"))

TWINS = {
    "forward_labels": f"""{with_(EOD, LABELS)} select symbol, day, {r('label_upside')} as label_upside, label_risk
        from labelled""",
    "trailing_risk_labels": f"""{with_(EOD)} select symbol, day, case when n = 14 and nxt is not null
        and (lo - close) / close <= -0.06 then 1 else 0 end as label_risk from (
          select symbol, day, close, count(close) {_T14} as n, min(close) {_T14} as lo,
            lead(day) over (partition by symbol order by day) as nxt from eod)""",
    "win_labels": f"""{with_(EOD, OUT)} select symbol, day, {r('max_return')} as max_return, {r('drawdown')} as drawdown,
        (max_return > 0 and drawdown > -0.05)::int as win from outc where ahead > 0""",
    "training_set_split": f"""{with_(FULL, LABELS)}, big as (
        select * from feats where symbol in (select symbol from eod group by 1 having count(*) >= 50)
          and {' and '.join(f'{c} is not null' for c in FEATURE_COLUMNS)}),
        parts as (select *, case when day <= date '2000-06-30' - 20 then 'train' when day >= date '2000-07-01' then 'test' end
          as part from big join labelled using (symbol, day) where label_upside is not null)
        select part, symbol, count(*) as rows, min(day) as first_day, max(day) as last_day,
          {r('avg(label_upside)')} as mean_upside, sum(label_risk)::bigint as risky, {r('avg(RSI14)')} as mean_rsi
        from parts where part is not null group by 1, 2""",
    "scored_predictions": f"""{with_(PRED)} select day, symbol, 'linear-a+logit-c' as model_version, close as entry_price,
        {r('pred_a')} as pred_a, {r('risk_prob')} as risk_prob, {r('final_score')} as final_score from scored""",
    "score_contract": f"""{with_(PRED)} select count(*) as rows, count(*) filter (where not isfinite(pred_a)) as bad_upside,
        count(*) filter (where not risk_prob between 0 and 1) as bad_risk from scored""",
    "score_rank_correlation": f"""{with_(JUDGED)} select {r('corr(a, b)')} as spearman, count(*) as n from (
        select rank() over (order by pred_a) + (count(*) over (partition by pred_a) - 1) / 2.0 as a,
          rank() over (order by label_upside) + (count(*) over (partition by label_upside) - 1) / 2.0 as b from judged)""",
    "daily_hit_rate": _daily_top("pred_a", "label_upside > 0"),
    "daily_risk_capture": _daily_top("risk_prob", "label_risk = 1"),
    "risk_classification": f"""{with_(JUDGED)}, rk as (select *, rank() over (order by risk_prob)
          + (count(*) over (partition by risk_prob) - 1) / 2.0 as a from judged)
        select count(*) as rows,
          {r('count(*) filter (where risk_prob >= 0.5 and label_risk = 1) / nullif(count(*) filter (where risk_prob >= 0.5), 0)')} as precision,
          {r('count(*) filter (where risk_prob >= 0.5 and label_risk = 1) / nullif(sum(label_risk), 0)')} as recall,
          {r('(sum(a * label_risk) - sum(label_risk) * (sum(label_risk) + 1) / 2.0) / (sum(label_risk) * (count(*) - sum(label_risk)))')} as auc
        from rk""",
    "prediction_summary": f"{with_(PRED)} {_SUMMARY}",
    "upside_buckets": f"""{with_(PRED)} select {r('avg((pred_a < 0.05)::int)')} as below_005,
        {r('avg((pred_a >= 0.05 and pred_a < 0.1)::int)')} as from_005,
        {r('avg((pred_a >= 0.1 and pred_a < 0.2)::int)')} as from_010, {r('avg((pred_a >= 0.5)::int)')} as from_050
        from scored""",
    "stored_score_differences": f"{with_(PRED)} {_DIFFS}",
    "upstream_context": f"""{with_(PRED)}, senti as (
          select 'Brand#' || regexp_extract(source, '(\\d+)', 1) as symbol, avg(coalesce(quality - toxic, 0)) as sentiment_score
          from documents left join labels using (doc_id) group by 1),
        worth as (select p_brand as symbol, max(case when p_size > 48 then 'OVERVALUED' end) as valuation_label
          from part group by 1),
        lastp as (select * from scored where day = (select max(day) from scored))
        select day, symbol, {r('pred_a')} as pred_a, {r('final_score')} as final_score, close, {r('vol20')} as vol20,
          case when maxdd90 is not null then '90d' else '20d_proxy' end as risk_window, {r('sentiment_score')} as sentiment_score,
          valuation_label, (select bool_or(s.sentiment_score is not null) from lastp join senti s using (symbol)) as has_sentiment,
          (select bool_or(w.valuation_label is not null) from lastp join worth w using (symbol)) as has_valuation,
          'ml.predictions:' || symbol as source_ref, 'SPY' as market_context_symbol
        from lastp left join senti using (symbol) left join worth using (symbol)""",
    "universe_ranking": f"""{with_(PRED)} select symbol, day, {r('pred_a * 100')} as upside_pct, {r('risk_prob * 100')} as risk_pct,
        {r('final_score * 100')} as final_pct from (
          select *, row_number() over (partition by symbol order by day desc) as k from scored) where k = 1
        order by final_score desc nulls last, symbol limit 20""",
}
