"""Holdings, allocation checks, rebalancing, and text rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from barograph.config import FORBIDDEN_CLAIMS, NOT_TICKERS, PortfolioRules
from barograph.functions.rounding import half_even
from barograph.operators.halo import number_rows, own_rows, with_halo


def holdings(positions: DataFrame, tenant: str | None = None) -> DataFrame:
    """Weights in percent of an account's value with cash. An account is bounded by the universe of symbols."""
    rows = positions.where(F.col("tenant_id") == tenant) if tenant is not None else positions
    total = (F.sum(F.coalesce("market_value", F.lit(0.0))).over(Window.partitionBy("account_id"))
             + F.greatest(F.col("cash"), F.lit(0.0)))
    given = F.col("weight") if "weight" in rows.columns else F.lit(None).cast("double")
    weight = F.coalesce(given, F.when(total > 0, F.try_divide("market_value", total) * 100))
    return rows.select("account_id", "tenant_id", F.replace(F.upper(F.trim("symbol")), F.lit("."), F.lit("-")).alias("symbol"),
                       half_even(weight).alias("weight")).where((F.col("symbol") != "") & F.col("weight").isNotNull())


def rebalance(held: DataFrame, rules: PortfolioRules = PortfolioRules()) -> DataFrame:
    """Equal weight under the caps, the rest in cash; an account without any eligible symbol goes to cash, in one row."""
    rows = held
    if rules.excluded:
        rows = rows.where(~F.col("symbol").isin(list(rules.excluded)))
    if rules.allowed:
        rows = rows.where(F.col("symbol").isin(list(rules.allowed)))
    n = F.count(F.lit(1)).over(Window.partitionBy("account_id"))
    rows = rows.withColumn("_n", n).withColumn(
        "target_weight", F.least(F.lit(rules.max_weight), half_even((100.0 - rules.min_cash) / F.col("_n"))))
    cash = half_even(F.greatest(F.lit(rules.min_cash), 100.0 - half_even(F.col("target_weight") * F.col("_n"))))
    plan = rows.select("account_id", "symbol", F.col("weight").alias("current_weight"), "target_weight",
                       half_even(F.col("target_weight") - F.col("weight")).alias("change"), cash.alias("cash_target"))
    idle = held.select("account_id").distinct().join(rows.select("account_id").distinct(), "account_id", "left_anti")
    return plan.unionByName(idle.withColumn("cash_target", F.lit(100.0)), allowMissingColumns=True)


def allocation_faults(allocations: DataFrame, max_weight: float, min_cash: float | None = None) -> DataFrame:
    """Violations per portfolio from (portfolio_id, symbol, weight_pct) rows; cash is the symbol CASH."""
    cash, w = F.upper("symbol") == "CASH", F.col("weight_pct")
    agg = allocations.groupBy("portfolio_id").agg(
        F.count_if(w < 0).alias("negative"), F.count_if(~cash & (w > max_weight)).alias("over_weight"),
        F.sum("weight_pct").alias("total"), F.coalesce(F.sum(F.when(cash, w)), F.lit(0.0)).alias("cash"),
        F.count_if(w.isNull()).alias("not_numeric"))
    # The bound itself fails, as it does in binary arithmetic; rounding makes that independent of the summing order.
    off = F.round(F.abs(F.coalesce("total", F.lit(0.0)) - 100.0), 6) >= 0.01
    short = (F.col("cash") < min_cash) if min_cash is not None else F.lit(False)
    return agg.select("portfolio_id", "negative", "over_weight", "not_numeric", off.alias("total_off"), short.alias("cash_short"),
                      ((F.col("negative") == 0) & (F.col("over_weight") == 0) & (F.col("not_numeric") == 0) & ~off & ~short)
                      .alias("passed"))


def forbidden_claims(rows: DataFrame, text: str = "text") -> DataFrame:
    """Claims found in each text; whole texts, no split."""
    low = F.lower(text)
    return rows.withColumn("claims", F.filter(F.array(*[F.when(low.contains(c), c) for c in FORBIDDEN_CLAIMS]),
                                              lambda c: c.isNotNull()))


# fixed value: pattern of a ticker
_TICKER = r"(?<![A-Za-z0-9])([A-Z]{1,5}(?:-[A-Z])?)(?![A-Za-z0-9])"


def tickers_in(text: str, stop: tuple[str, ...] = NOT_TICKERS) -> F.Column:
    """Distinct words of a text that look like tickers, without the stop list, in order."""
    found = F.regexp_extract_all(F.col(text), F.lit(_TICKER), F.lit(1))
    return F.array_distinct(F.filter(found, lambda t: ~t.isin(list(stop))))


def ticker_hints(values: F.Column) -> F.Column:
    """Distinct tickers among given texts, written with a hyphen and in capitals; other texts and nulls are left out."""
    plain = F.transform(values, lambda v: F.replace(F.upper(F.trim(v)), F.lit("."), F.lit("-")))
    return F.coalesce(F.array_distinct(F.filter(plain, lambda t: t.rlike(r"^[A-Z]{1,5}(-[A-Z])?$"))),
                      F.array().cast("array<string>"))


def message_tickers(messages: DataFrame, history: int = 5, block: int = 4096, stop: tuple[str, ...] = NOT_TICKERS,
                    hints: str | None = None) -> DataFrame:
    """Tickers of each turn; a turn without any falls back to its last turns. Adds the rule-based route.

    ``hints`` names a column with the symbols that a turn's metadata gives (array of texts); they go before its words.
    Conversations are cut into overlapping blocks of turns, so one that holds most of the rows is spread over tasks.
    """
    own = tickers_in("text", stop)
    if hints:
        own = F.array_distinct(F.concat(ticker_hints(F.col(hints)), F.coalesce(own, F.array().cast("array<string>"))))
    rows = number_rows(messages.withColumn("_tickers", own), "conv_id", "turn",
                       slice_by=F.floor(F.col("turn") / block))
    w = Window.partitionBy("conv_id", "block").orderBy("rn")
    rows = with_halo(rows, history, block).withColumn("_past", F.array_distinct(F.flatten(
        F.collect_list("_tickers").over(w.rowsBetween(-history, -1)))))
    rows = own_rows(rows)
    own = F.size("_tickers") > 0
    rows = rows.withColumn("symbols", F.when(own, F.col("_tickers")).otherwise(F.col("_past")))
    n = F.size("symbols")
    route = F.when(n > 1, "symbol_comparison").when(n == 1, "single_symbol_advisory").otherwise("clarification")
    return rows.withColumn("route", route).withColumn(
        "router_confidence", F.when(n > 0, 0.35).otherwise(0.0)).drop("_tickers", "_past", "rn")
