"""Trading pairs in the writings of exchanges: any of them read as BASE/QUOTE, and that written as each exchange does. What cannot be read is NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..registry import query
from ..sources.frames import table

# What exchanges call assets, and what they quote in where a currency is not offered.
KRAKEN_NAMES = {"BTC": "XBT"}
KRAKEN_CODES = {"XBT": "XXBT", "ETH": "XETH", "USD": "ZUSD", "EUR": "ZEUR", "USDT": "USDT"}
IN_DOLLARS, IN_TETHER = {"USDT": "USD", "USDC": "USD"}, {"USD": "USDT"}


def _renamed(c: Column, names: dict[str, str]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), c), c)


def _reversed(names: dict[str, str]) -> dict[str, str]:
    return {v: k for k, v in names.items()}


def _asset(c: Column) -> Column:
    return _renamed(_renamed(c, _reversed(KRAKEN_CODES)), _reversed(KRAKEN_NAMES))


def parts(c: Column) -> Column:
    """base and quote of btcusdt, BTC-USDT-SWAP, BTC/USDT, XBTUSD or XXBTZUSD as a struct."""
    s = F.upper(F.trim(c))
    cut = F.filter(F.split(s, "[/-]"), lambda p: p != "")
    # A Z after four or five letters stands before the quote; without it the base has three.
    piece = lambda k: F.when(s.rlike("^.{5}Z.{3}"), F.regexp_extract(s, "^(.{5})Z(.*)$", k)).when(s.rlike("^.{4}Z.{3}"), F.regexp_extract(s, "^(.{4})Z(.*)$", k)).otherwise(F.regexp_extract(s, "^(.{0,3})(.*)$", k))
    apart = F.struct(_renamed(F.get(cut, F.lit(0)), _reversed(KRAKEN_NAMES)).alias("base"), F.get(cut, F.lit(1)).alias("quote"))
    joined = F.struct(_asset(piece(1)).alias("base"), _asset(piece(2)).alias("quote"))
    return F.when(s.rlike("[/-]"), F.when(F.size(cut) >= 2, apart)).otherwise(F.when(F.length(joined["quote"]) >= 3, joined))


def normalized(c: Column) -> Column:
    return F.concat(parts(c)["base"], F.lit("/"), parts(c)["quote"])


def compact(c: Column) -> Column:
    """As most exchanges write it: BTCUSDT."""
    return F.concat(parts(c)["base"], parts(c)["quote"])


def dashed(c: Column, quotes: dict[str, str] | None = None, swap: bool = False) -> Column:
    """BTC-USDT, with quotes that are not offered replaced (IN_DOLLARS, IN_TETHER), or BTC-USDT-SWAP."""
    p = parts(c)
    return F.concat(p["base"], F.lit("-"), _renamed(p["quote"], quotes) if quotes else p["quote"], F.lit("-SWAP" if swap else ""))


def kraken(c: Column, codes: bool = False) -> Column:
    """XBTUSD, or with the codes of old XXBTZUSD."""
    p = parts(c)
    base, quote = _renamed(p["base"], KRAKEN_NAMES), p["quote"]
    return F.concat(_renamed(base, KRAKEN_CODES), _renamed(quote, KRAKEN_CODES)) if codes else F.concat(base, quote)


_PIECE = "CASE event_id % 4 WHEN 0 THEN 'BTC' WHEN 1 THEN 'XBT' WHEN 2 THEN 'ETH' ELSE 'SOL' END", "CASE user_id % 3 WHEN 0 THEN 'USDT' WHEN 1 THEN 'USD' ELSE 'EUR' END"


@query("record_pairs", f"""WITH e AS (SELECT event_id, event_id % 7 AS form, {_PIECE[0]} AS b, {_PIECE[1]} AS q FROM events), n AS (SELECT *, CASE WHEN form = 5 AND b IN ('BTC', 'SOL') THEN 'X' || b WHEN b = 'XBT' THEN 'BTC' ELSE b END AS base FROM e),
  k AS (SELECT *, CASE WHEN base = 'BTC' THEN 'XBT' ELSE base END AS kb FROM n WHERE form <> 6)
  SELECT event_id, base || '/' || q AS pair, base || q AS joined, base || '-' || q || '-SWAP' AS swap, base || '-' || CASE q WHEN 'USDT' THEN 'USD' ELSE q END AS dollars, base || '-' || CASE q WHEN 'USD' THEN 'USDT' ELSE q END AS tether, kb || q AS kraken,
    CASE kb WHEN 'XBT' THEN 'XXBT' WHEN 'ETH' THEN 'XETH' ELSE kb END || CASE q WHEN 'USD' THEN 'ZUSD' WHEN 'EUR' THEN 'ZEUR' ELSE q END AS codes FROM k
  UNION ALL SELECT event_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM n WHERE form = 6""")
def q_pairs(spark, sf_dir):
    """Pairs written in seven ways, one of which cannot be read."""
    b, q, form = F.expr(_PIECE[0]), F.expr(_PIECE[1]), F.col("event_id") % 7
    way = F.when(form == 0, F.concat(b, q)).when(form == 1, F.concat(b, F.lit("-"), q)).when(form == 2, F.concat(F.lit(" "), b, F.lit("/"), q)).when(form == 3, F.lower(F.concat(b, q))).when(form == 4, F.concat(b, F.lit("-"), q, F.lit("-SWAP")))
    way = way.when(form == 5, F.concat(F.lit("X"), b, F.lit("Z"), q)).otherwise(F.concat(b, F.lit("/")))
    e = table(spark, sf_dir, "events").select("event_id", way.alias("s"))
    s = F.col("s")
    return e.select("event_id", normalized(s).alias("pair"), compact(s).alias("joined"), dashed(s, swap=True).alias("swap"), dashed(s, IN_DOLLARS).alias("dollars"), dashed(s, IN_TETHER).alias("tether"), kraken(s).alias("kraken"), kraken(s, codes=True).alias("codes"))
