"""Readers of numbers in text. They differ on purpose; each serves one surface."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Magnitudes in the order in which they are looked for.
MAGNITUDES = (
    ("trillion", 1e12), ("tn", 1e12), ("billion", 1e9), ("bn", 1e9), ("b", 1e9),
    ("million", 1e6), ("mn", 1e6), ("m", 1e6), ("thousand", 1e3), ("k", 1e3),
)


def gate_number(text: Column) -> Column:
    """Numeric companion of the SQL surface: the whole text is a number with an optional prefix and lower-case magnitude."""
    plain = F.btrim(text)
    shape = r"^[$£€¥₹A-Z]?[0-9][0-9,]*(\.[0-9]+)?\s*(bn|b|million|mn|thousand|m|k|billion)?\s*$"
    digits = F.regexp_replace(plain, "[^0-9.]", "").cast("double")
    factor = F.when(plain.rlike("(?i)(billion|bn|b)"), 1e9).when(plain.rlike("(?i)(million|mn|m)"), 1e6).when(plain.rlike("(?i)(thousand|k)"), 1e3).otherwise(1.0)
    return F.when(plain.rlike(shape), digits * factor)


def agent_number(text: Column) -> Column:
    """The reader of the question tools: the first magnitude found anywhere scales the remaining digits."""
    low = F.regexp_replace(F.lower(F.btrim(text)), "usd|gbp|eur", "")
    found, factor = F.lit(""), F.lit(1.0)
    for word, scale in reversed(MAGNITUDES):
        found = F.when(F.contains(low, F.lit(word)), word).otherwise(found)
        factor = F.when(F.contains(low, F.lit(word)), scale).otherwise(factor)
    bare = F.when(found == "", low).otherwise(F.replace(low, found, F.lit(" ")))
    digits = F.regexp_replace(bare, r"[^0-9.\-]", "")
    return F.when(digits.rlike(r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)$"), digits.cast("double") * factor)


def currency_sign(text: Column) -> Column:
    """The sign of a money text; dollars may be spelled usd; empty if there is none."""
    out = F.when(F.contains(text, F.lit("$")) | F.contains(F.lower(text), F.lit("usd")), "$").otherwise("")
    for sign in ("C$", "A$", "₹", "¥", "€", "£"):
        out = F.when(F.contains(text, F.lit(sign)), sign).otherwise(out)
    return out


def profile_number(text: Column) -> Column:
    """The reader of the profile: one trailing unit and separators go, no magnitude is applied."""
    bare = F.regexp_replace(F.btrim(text), r"(?i)\s*(?:%|eur|usd|inr|gbp|million|billion|bn|mn|m|k)$", "")
    bare = F.regexp_replace(bare, r"[,$\s]", "")
    return F.when(bare.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), bare.cast("double"))


def currency_amount(text: Column) -> Column:
    """struct(amount, currency): the first number with its magnitude, truncated; USD if a dollar is named."""
    bare = F.replace(text, F.lit(","), F.lit(""))
    shape = r"(?i)([0-9.]+)\s*(billion|million|thousand|[bmk])?"
    digits, unit = F.regexp_extract(bare, shape, 1), F.lower(F.regexp_extract(bare, shape, 2))
    factor = F.when(unit.isin("b", "billion"), 1e9).when(unit.isin("m", "million"), 1e6).when(unit.isin("k", "thousand"), 1e3).otherwise(1.0)
    number = F.when(digits.rlike(r"^([0-9]+\.?[0-9]*|\.[0-9]+)$"), digits.cast("double"))
    dollars = F.contains(text, F.lit("$")) | F.contains(F.lower(text), F.lit("usd"))
    return F.struct((number * factor).cast("long").alias("amount"), F.when(number.isNotNull() & dollars, "USD").alias("currency"))
