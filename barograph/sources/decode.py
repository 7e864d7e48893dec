"""Decoding of stream payloads and normalising of landed end-of-day rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from barograph.config import SYMBOL_ALIASES
from barograph.schemas import INDICATOR_JSON, MARKET_JSON, NEWS_JSON

_LINEAGE = ("topic", "partition", "offset")


def _load_time(now) -> Column:
    return (F.current_timestamp() if now is None else F.lit(now).cast("timestamp")).alias("etl_load")


#: Column in which the parser keeps a payload that doesn't fit its schema.
_CORRUPT = "_corrupt"
_KEPT = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}


def _fault(parsed: Column, malformed: Column) -> Column:
    """Why a message is no row: nothing in it, not of the schema, or without an event time; null for a good one."""
    return (F.when(F.length(F.trim(F.coalesce(F.col("payload"), F.lit("")))) == 0, "empty").when(malformed, "malformed")
            .when(parsed.isNull(), "no items").when(F.col("ts").isNull(), "no time"))


def _prices(raw: DataFrame, schema: T.StructType, key: str, now, faults: bool) -> DataFrame:
    value = F.col("value").cast("string")
    parsed = F.from_json(value, schema.add(_CORRUPT, T.StringType()), _KEPT) if faults else F.from_json(value, schema)
    # behind a generator, so that conditions on the fields stay above it and a payload is parsed once
    doc = raw.select(F.explode(F.array(parsed)).alias("_d"), *_LINEAGE, *[value.alias("payload")] * faults)
    fields = [F.col(f"_d.{c}").alias(c.lower()) for c in ("Open", "High", "Low", "Close", "Volume", "Dividends")]
    extra = ["payload", "_d"] if faults else []
    rows = doc.select(F.try_to_timestamp("_d.Datetime").alias("ts"), F.col(f"_d.{key}").alias(key.lower()), *fields,
                      F.col("_d.`Stock Splits`").alias("stock_splits"), *_LINEAGE, _load_time(now), *extra)
    if not faults:
        return rows
    return rows.withColumn("fault", _fault(F.col("_d"), F.col(f"_d.{_CORRUPT}").isNotNull())).drop("_d")


def market_messages(raw: DataFrame, now=None, faults: bool = False) -> DataFrame:
    """``faults`` adds the payload and why it is no row (``fault``, null for good ones); see ``dead_letters``."""
    return _prices(raw, T.StructType(list(MARKET_JSON)), "Symbol", now, faults)


def indicator_messages(raw: DataFrame, now=None, faults: bool = False) -> DataFrame:
    return _prices(raw, T.StructType(list(INDICATOR_JSON)), "Indicator", now, faults)


def news_messages(raw: DataFrame, now=None, faults: bool = False) -> DataFrame:
    """A payload is one object or an array of objects; both read as an array, so no item appears twice."""
    value = F.col("value").cast("string")
    if faults:  # an array that is null could not be parsed, an empty one has no items
        parsed = raw.select(value.alias("payload"), *_LINEAGE, F.explode(F.array(F.from_json(value, T.ArrayType(NEWS_JSON)))).alias("_a"))
        items = parsed.select("payload", *_LINEAGE, F.col("_a").isNull().alias("_bad"), F.explode_outer("_a").alias("_d"))
    else:
        items = raw.select(F.explode(F.from_json(value, T.ArrayType(NEWS_JSON))).alias("_d"), *_LINEAGE)
    plain = [F.col(f"_d.{c}").alias(c) for c in ("category", "headline", "id", "image", "related", "source", "summary", "url")]
    rows = items.select(F.timestamp_seconds("_d.datetime").alias("ts"),
                        F.coalesce("_d.Symbol", "_d.related").alias("symbol"),
                        F.col("_d.datetime").alias("event_timestamp"), *plain, *_LINEAGE, _load_time(now),
                        *(["payload", "_d", "_bad"] if faults else []))
    return rows.withColumn("fault", _fault(F.col("_d"), F.col("_bad"))).drop("_d", "_bad") if faults else rows


def _misfit(kind: T.DataType, found: Column) -> Column:
    """Whether a JSON value of the found type cannot be read as the schema's type."""
    fits = {T.DoubleType(): "^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$", T.LongType(): "^BIGINT$"}.get(kind, "^(STRING|BIGINT|DECIMAL.*|DOUBLE|BOOLEAN)$")
    return found.isNotNull() & (found != "VOID") & ~found.rlike(fits)


def dead_letters(rows: DataFrame, schema: T.StructType, time: str) -> DataFrame:
    """The faulty rows of a decoder: lineage, raw payload, fault, the field at fault, and the payload as a VARIANT.

    The document keeps all fields, also those outside the schema. Only faulty payloads are parsed again.
    """
    bad = rows.where("fault is not null").select(*_LINEAGE, "payload", "fault", "etl_load", F.try_parse_json("payload").alias("document"))
    kind = lambda name: F.schema_of_variant(F.try_variant_get("document", f"$['{name}']", "variant"))
    field = F.coalesce(*[F.when(_misfit(f.dataType, kind(f.name)), F.lit(f.name)) for f in schema.fields])
    return bad.select(*_LINEAGE, "payload", "fault", F.when(F.col("fault") == "no time", F.lit(time)).otherwise(field).alias("field"),
                      "document", "etl_load", F.to_date("etl_load").alias("day"))


def unknown_fields(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """Lineage, name and value (a VARIANT) of every field of an object that the schema does not have."""
    doc = raw.select(*_LINEAGE, F.explode(F.array(F.try_parse_json(F.col("value").cast("string")))).alias("_v"))
    fields = doc.select(*_LINEAGE, F.explode(F.try_variant_get("_v", "$", "map<string,variant>")).alias("field", "found"))
    return fields.where(~F.col("field").isin(schema.fieldNames()))


def known_time(rows: DataFrame) -> DataFrame:
    """Rows without an event time are not stored."""
    return rows.where(F.col("ts").isNotNull())


def raw_eod(rows: DataFrame, source: str = "yfinance", now=None) -> DataFrame:
    """Typed end-of-day rows: clean symbol, numbers or null, missing volume as zero, source and load time."""
    num = lambda c: F.expr(f"try_cast(`{c}` as double)")
    return rows.select(
        F.to_date("Datetime").alias("day"), F.trim(F.upper("Symbol")).alias("symbol"),
        *[num(c).alias(c.lower()) for c in ("Open", "High", "Low", "Close")], num("Adj Close").alias("adj_close"),
        F.coalesce(num("Volume"), F.lit(0.0)).cast("bigint").alias("volume"), num("Dividends").alias("dividends"),
        num("Stock Splits").alias("stock_splits"), F.lit(source).alias("source"), _load_time(now))


def normalized_symbols(rows: DataFrame, column: str = "symbol", aliases: dict[str, str] = SYMBOL_ALIASES) -> DataFrame:
    """Distinct current tickers: upper case, renamed, delisted ones dropped, class dots as dashes."""
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    raw = F.upper(F.trim(column))
    now = F.replace(F.coalesce(F.element_at(table, raw), raw), F.lit("."), F.lit("-"))
    return rows.select(now.alias("symbol")).where(F.length("symbol") > 0).distinct()


def canonical_columns(rows: DataFrame, names: list[str]) -> DataFrame:
    """Rename columns that differ only in case; a missing one is an error."""
    lower = {c.lower(): c for c in rows.columns}
    missing = [n for n in names if n.lower() not in lower]
    if missing:
        raise KeyError(f"missing columns {missing}; there are {rows.columns}")
    rest = [c for c in rows.columns if c.lower() not in {n.lower() for n in names}]
    return rows.select(*[F.col(f"`{lower[n.lower()]}`").alias(n) for n in names], *[F.col(f"`{c}`") for c in rest])


def typed_context(rows: DataFrame, dates: tuple[str, ...] = ("as_of_date", "fundamentals_as_of"),
                  times: tuple[str, ...] = ("latest_article_published_at", "oldest_article_published_at",
                                            "sentiment_scored_at", "valuation_fetched_at", "process_date")) -> DataFrame:
    """Dates and times from text; what cannot be read becomes null."""
    kinds = {**{c: F.to_date(F.try_to_timestamp(F.col(c).cast("string"))) for c in dates if c in rows.columns},
             **{c: F.try_to_timestamp(F.col(c).cast("string")) for c in times if c in rows.columns}}
    return rows.select(*[kinds[c].alias(c) if c in kinds else F.col(c) for c in rows.columns])
