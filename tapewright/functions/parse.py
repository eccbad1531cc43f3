"""Column expressions for values as exchanges and registries write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER_PREFIX = r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)"
INTEGER_PREFIX = r"^(-?\d+)"


def parse_side(side: Column, buy: str = "BUY", sell: str = "SELL") -> Column:
    """Buy or Sell whatever the case, else Unknown."""
    value = F.upper(side)
    return F.when(value == buy.upper(), "Buy").when(value == sell.upper(), "Sell").otherwise("Unknown")


def parse_book_side(side: Column) -> Column:
    """bid or ask; offer is ask; null for anything else."""
    value = F.lower(side)
    return F.when(value == "bid", "bid").when(value.isin("ask", "offer"), "ask")


def parse_double(text: Column, default: float = 0.0) -> Column:
    """The longest numeric prefix, else the default."""
    return F.coalesce(F.regexp_extract(text, NUMBER_PREFIX, 1).try_cast("double"), F.lit(default))


def parse_int(text: Column, default: int = 0) -> Column:
    return F.coalesce(F.regexp_extract(text, INTEGER_PREFIX, 1).try_cast("long"), F.lit(default).cast("long"))


def parse_exchange_ts(text: Column, arrival: Column) -> Column:
    """ISO-8601 with offset, to the microsecond; the arrival time where it can't be read."""
    return F.coalesce(text.try_cast("timestamp"), arrival)


def format_exchange_ts(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def valid_symbol(symbol: Column) -> Column:
    """Upper case and trimmed; null without a dash."""
    value = F.upper(F.trim(symbol))
    return F.when(F.contains(value, F.lit("-")), value)


def ticker_of(symbol: Column) -> Column:
    return F.split_part(valid_symbol(symbol), F.lit("-"), F.lit(1))


def log_intensity(liquidity: Column, scale: float) -> Column:
    """min(1, ln(1 + liquidity) * scale); 0 for none."""
    return F.when(liquidity > 0, F.least(F.lit(1.0), F.log1p(liquidity) * scale)).otherwise(0.0)


def price_resolution(span: Column) -> Column:
    """Width of a price bucket for a visible span of prices."""
    return F.when(span > 500, 25.0).when(span > 100, 5.0).when(span > 50, 1.0).when(span > 10, 0.5).otherwise(0.25)
