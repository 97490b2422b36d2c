"""Small column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def finite(v: Column) -> Column:
    """v as double, with null for NaN, infinities and what is no number."""
    x = v.try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(INF)), None).otherwise(x)


def n_words(text: Column) -> Column:
    return F.when(text.isNull(), 0).otherwise(F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")))


def company_key(name: Column) -> Column:
    """Letters and digits of a company's name in lower case, one blank between words, so that spellings agree; null for none."""
    k = F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))
    return F.when(k != "", k)


def form_key(form: Column) -> Column:
    return F.upper(F.trim(form))


def contains_ci(text: Column, part: Column | str) -> Column:
    p = F.lit(part) if isinstance(part, str) else part
    return F.contains(F.lower(text), F.lower(p))


def any_hint(text: Column, hints: list[str]) -> Column:
    """Whether some hint is part of text, ignoring case; true without hints, false for a null text with hints."""
    if not hints:
        return F.lit(True)
    return F.coalesce(F.exists(F.array(*[F.lit(h.lower()) for h in hints]), lambda h: F.contains(F.lower(text), h)), F.lit(False))


def percent_display(v: Column) -> Column:
    """0..1 counts as a share of 100; rounded and clamped to 0..100; null stays null."""
    whole = F.round(F.when(v <= 1, v * 100).otherwise(v), 0)
    return F.when(v.isNotNull(), F.least(F.greatest(whole, F.lit(0.0)), F.lit(100.0)))


def two_decimals(v: Column) -> Column:
    """Two decimals as text, -- for null."""
    return F.when(v.isNull(), "--").otherwise(F.format_string("%.2f", F.round(v, 2)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; null if one is null, a norm is 0, or the lengths differ."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    sq = lambda z: F.aggregate(z, F.lit(0.0), lambda s, v: s + v * v)
    norm = F.sqrt(sq(x)) * F.sqrt(sq(y))
    return F.when((F.size(x) == F.size(y)) & (norm > 0), dot / norm)


def latest(df, keys: list[str], order: list[str]):
    """One row for each key, the greatest by `order` and then by all other columns that can be ordered; null keys are a key of
    their own. Uses partial aggregation, so a key with many rows costs no task more than its share."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    plain = [c for c in rest if not any(k in df.schema[c].dataType.simpleString() for k in ("map<", "variant"))]
    maps = [c for c in rest if c not in plain]
    packed = F.struct(*order, *plain)
    if maps:  # maps can't be ordered, so they ride along
        r = df.groupBy(*keys).agg(F.max_by(F.struct(*order, *plain, *maps), packed).alias("r"))
    else:
        r = df.groupBy(*keys).agg(F.max(packed).alias("r"))
    return r.select(*keys, *[F.col(f"r.{c}").alias(c) for c in df.columns if c not in keys]).select(*df.columns)
