from twins.base import EOD, PRED, r, with_
from twins.models import OUT

_REB = """days as (select day, row_number() over (order by day) as rk from (select distinct day from eod)),
rebalance as (
  select min(day) as rebalance_day from days group by date_trunc('month', day)
  having min(day) >= (select coalesce(max(case when rk = 260 then day end), max(day)) from days)
     and min(day) <= (select max(case when rk = (select max(rk) from days) - 20 then day end) from days))"""
_LEADS = ", ".join(f"lead(close, {h}) over (partition by symbol order by day) / close - 1 as ret_{h}d" for h in (5, 10, 20))
PIT = PRED + ", " + _REB + f""", fwd as (select symbol, day, close, {_LEADS} from eod),
px as (
  select * from (select rebalance_day, fwd.*, row_number() over (partition by rebalance_day, symbol order by day desc) as k
                 from rebalance join fwd on day <= rebalance_day) where k = 1),
ps as (
  select * from (select rebalance_day, scored.*, row_number() over (partition by rebalance_day, symbol order by day desc) as k
                 from rebalance join scored on day <= rebalance_day) where k = 1),
pit as (
  select rebalance_day, symbol, ps.pred_a, ps.risk_prob, ps.final_score, px.close as entry_price, ret_5d, ret_10d, ret_20d
  from ps join px using (rebalance_day, symbol))"""
LONG = PIT + ", long as (" + " union all ".join(
    f"select *, {h} as horizon, ret_{h}d as ret from pit where ret_{h}d is not null" for h in (5, 10, 20)) + """),
lr as (
  select *, row_number() over (partition by horizon, rebalance_day order by final_score desc, symbol) as top_,
    row_number() over (partition by horizon, rebalance_day order by final_score, symbol desc) as bottom_,
    rank() over (partition by horizon order by final_score)
      + (count(*) over (partition by horizon, final_score) - 1) / 2.0 as ra,
    rank() over (partition by horizon order by ret) + (count(*) over (partition by horizon, ret) - 1) / 2.0 as rb
  from long)"""
PORT = PIT + """, best as (
  select *, row_number() over (partition by rebalance_day order by final_score desc, symbol) as k from pit
  where ret_20d is not null),
bfwd as (select day, lead(close, 20) over (order by day) / close - 1 as ret from bench),
bret as (select rebalance_day, arg_max(ifnull(ret, 'nan'), day) as bench_ret from rebalance join bfwd on day <= rebalance_day group by 1),
port as (
  select rebalance_day, string_agg(symbol, ', ' order by k) as picks, avg(ret_20d) as portfolio_ret,
    any_value(case when isnan(bench_ret) then null else bench_ret end) as bench_ret
  from best left join bret using (rebalance_day) where k <= 3 group by 1)"""
OUTC = PRED + ", " + OUT + """, so as (
  select scored.symbol, day, pred_a, risk_prob, final_score, ahead, max_return, drawdown from scored join outc using (symbol, day))"""
RANKED = OUTC + """, rk as (
  select *, count(*) over (partition by day) as names, bool_or(ahead = 14) over (partition by day) as known,
    row_number() over (partition by day order by final_score desc, symbol) as model,
    case when ahead = 14 and drawdown > -0.06 then row_number() over (
      partition by day, (ahead = 14 and drawdown > -0.06) order by max_return desc, symbol) end as truth from so)"""
TRADES = PRED + """, num as (select *, row_number() over (partition by symbol order by day) as i from eod),
sig as (select scored.symbol, scored.day, pred_a, risk_prob, num.close as entry, num.i
        from scored join num using (symbol, day) where pred_a >= 0.06 and risk_prob <= 0.3),
path as (
  select s.*, b.day as bday, b.i - s.i as k, b.close as bclose, b.low <= entry * (1 - 0.5) as sl,
    b.high >= entry * (1 + pred_a) as tp
  from sig s join num b on b.symbol = s.symbol and b.i between s.i + 1 and s.i + 14),
ends as (
  select symbol, day, coalesce(min(case when sl or tp then k end), max(k)) as k from path group by 1, 2),
trades as (
  select p.day as entry_day, p.symbol, pred_a, risk_prob, entry as entry_price, bday as exit_day,
    case when sl then -0.5 when tp then pred_a else (bclose - entry) / entry end::double as ret,
    case when sl then 'Risk Hit (SL)' when tp then 'Target Hit (TP)' else 'Time Exit (14D)' end as exit_reason
  from path p join ends e on e.symbol = p.symbol and e.day = p.day and e.k = p.k)"""
CURVE = TRADES + """, bd as (
  select day, close from bench where day between date '1999-01-01' and date '2001-12-31'),
spread as (
  select entry_day, symbol, exit_day, ret, bd.day, count(*) over (partition by entry_day, symbol) as n
  from trades join bd on bd.day > entry_day and bd.day <= exit_day
  union all
  select entry_day, symbol, exit_day, ret, bd.day, 1 from trades join bd on bd.day = exit_day
  where not exists (select 1 from bd b where b.day > entry_day and b.day <= exit_day)),
daily_ret as (select day, avg(ret / n) as ret from spread group by day),
curve as (
  select day, exp(sum(ln(1 + coalesce(ret, 0))) over (order by day)) - 1 as strategy,
    exp(sum(ln(g)) over (order by day)) - 1 as benchmark
  from (select day, coalesce(close / lag(close) over (order by day), 1) as g from bd) left join daily_ret using (day))"""


def _topn(score: str) -> str:
    return f"""select '{score}' as ranked_by, count(*) as days, {r('avg(ret)')} as mean_ret,
      {r('avg((ret > 0)::int)')} as win_rate, {r('avg(ret) / stddev_samp(ret) * sqrt(252 / 14.0)')} as sharpe
      from (select day, avg(max_return) as ret from (
        select *, row_number() over (partition by day order by {score} desc, symbol) as k from so)
        where k <= 3 and ahead > 0 group by day)"""


def _sweep(sizes) -> str:
    return " union all ".join(f"""select {n} as top_n, {n * 21} as trades_per_month, {r('sum(w) / sum(c) * 100', 4)} as win_rate_pct,
  {r('avg(m) * 100', 4)} as avg_return_pct, {r('sum(d) / sum(c) * 100', 4)} as avg_drawdown_pct from (
    select day, avg(max_return) as m, sum(drawdown) as d, count(*) as c,
      sum((max_return > 0 and drawdown > -0.05)::int) as w
    from rk where ahead = 14 and model <= {n} and names >= {n} group by day) having count(*) > 0""" for n in sizes)

TWINS = {
    "point_in_time_scores": f"""{with_(PIT)} select rebalance_day, symbol, entry_price, {', '.join(
        f'{r(c)} as {c}' for c in ('pred_a', 'risk_prob', 'final_score', 'ret_5d', 'ret_10d', 'ret_20d'))} from pit""",
    "horizon_metrics": f"""{with_(LONG)} select horizon, count(*) as samples,
        {r('avg(((pred_a > 0) = (ret > 0))::int)')} as direction_acc,
        {r('count(*) filter (where risk_prob > 0.5 and ret <= -0.06) / greatest(count(*) filter (where risk_prob > 0.5), 1)')} as risk_precision,
        {r('count(*) filter (where risk_prob > 0.5 and ret <= -0.06) / greatest(count(*) filter (where ret <= -0.06), 1)')} as risk_recall,
        {r('avg(ret) filter (where top_ <= 3)')} as top_ret, {r('avg(ret) filter (where bottom_ <= 3)')} as bottom_ret,
        {r('corr(ra, rb)')} as ic from lr group by horizon""",
    "topk_portfolio": f"""{with_(PORT)} select rebalance_day, picks, {r('portfolio_ret')} as portfolio_ret,
        {r('bench_ret')} as bench_ret, {r('portfolio_ret - bench_ret')} as alpha from port""",
    "portfolio_summary": f"""{with_(PORT)} select count(*) as periods, {r('avg(portfolio_ret)', 4)} as mean_ret,
        {r('avg(bench_ret)', 4)} as mean_bench, {r('avg(portfolio_ret - bench_ret)', 4)} as mean_alpha,
        {r('avg(coalesce((portfolio_ret > bench_ret)::int, 0))', 4)} as win_rate,
        {r('ln(product(1 + portfolio_ret) filter (where bench_ret is not null))', 4)} as compounded_ret,
        {r('ln(product(1 + bench_ret))', 4)} as compounded_bench from port""",
    "topn_strategy_comparison": f"{with_(OUTC)} {_topn('final_score')} union all {_topn('pred_a')}",
    "ground_truth_precision": f"""{with_(RANKED)} select day, count(*) filter (where model <= 5 and truth <= 5) as hits,
        {r('avg(max_return) filter (where model <= 5 and ahead = 14)')} as mean_max_return,
        {r('count(*) filter (where model <= 5 and truth <= 5) / 5')} as precision
        from rk where names >= 5 and known group by day""",
    "topn_sweep": f"{with_(RANKED)} {_sweep((2, 4, 6, 8, 10))}",
    "topn_sweep_default": f"{with_(RANKED)} {_sweep(range(10, 101, 10))}",
    "trade_signals": f"""{with_(PRED)} select day, symbol, {r('pred_a')} as pred_a, {r('risk_prob')} as risk_prob,
        {r('final_score')} as final_score from scored where pred_a >= 0.06 and risk_prob <= 0.3""",
    "executed_trades": f"""{with_(TRADES)} select entry_day, symbol, {r('pred_a')} as pred_a, {r('risk_prob')} as risk_prob,
        entry_price, exit_day, {r('ret')} as ret, exit_reason from trades""",
    "equity_curve": f"{with_(CURVE)} select day, {r('strategy')} as strategy, {r('benchmark')} as benchmark from curve",
    "strategy_metrics": f"""{with_(CURVE)} select count(*) as trade_count, {r('avg((ret > 0)::int) * 100')} as win_rate,
        {r('avg(ret) * 100')} as avg_return_per_trade, {r('coalesce(sum(ret), 0) * 100')} as raw_trade_return_sum,
        (select {r('arg_max(strategy, day) * 100')} from curve) as strategy_total_return,
        (select {r('arg_max(benchmark, day) * 100')} from curve) as benchmark_total_return from trades""",
    "exit_reasons": f"{with_(TRADES)} select exit_reason, count(*) as n from trades group by 1",
    "price_backtest": f"""{with_(EOD)} select symbol, count(*) as rows, {r('arg_max(close, day) / arg_min(close, day) - 1')}
        as total_return from eod where day between date '1996-01-01' and date '2000-12-31' group by 1""",
    "equal_weight_backtest": f"""{with_(EOD)} select count(*) as symbols, sum(n)::bigint as rows, {r('avg(t)')} as total_return
        from (select count(*) as n, arg_max(close, day) / arg_min(close, day) - 1 as t from eod group by symbol)""",
    "equity_samples": f"""{with_(EOD)} select symbol, day, {r('close / f')} as equity from (
        select *, row_number() over (partition by symbol order by day) - 1 as i, count(*) over (partition by symbol) as n,
          first_value(close) over (partition by symbol order by day) as f from eod)
        where i % greatest(1, n // 25) = 0 and i // greatest(1, n // 25) < 25""",
    "capped_backtest_requests": """with o as (
          select o_custkey as request_id, min(o_orderdate)::date as s, max(o_orderdate)::date as e from orders group by 1),
        b as (select o_custkey as request_id, list(distinct p_brand) as symbols from orders join lineitem on l_orderkey = o_orderkey
          join part on p_partkey = l_partkey group by 1)
        select request_id, list_sort(symbols)[1:15] as symbols, (e - s + 1)::int as requested_days,
          case when e - s + 1 > 1500 then 'disabled' else 'accepted' end as status,
          list_filter([case when len(symbols) > 15 then 'symbol cap applied: max_symbols=15' end,
            case when e - s + 1 > 1500 then 'date range cap rejected: requested_days=' || (e - s + 1)
              || ', max_date_range_days=1500' end], lambda x: x is not null) as warnings
        from o join b using (request_id) where request_id in (select c_custkey from customer)""",
}
