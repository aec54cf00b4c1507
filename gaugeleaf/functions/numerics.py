"""Rounding rules, clamps and other column functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def js_round(x: Column) -> Column:
    """Halves go up, also for negative numbers."""
    return F.floor(x + 0.5)


def js_round_n(x: Column, digits: int) -> Column:
    scale = 10**digits
    return F.floor(x * scale + 0.5) / scale


def pg_round(x: Column, digits: int = 1) -> Column:
    """Halves go away from zero, on the decimal value."""
    return F.round(x.cast("decimal(30,10)"), digits).cast("double")


def py_round(x: Column) -> Column:
    """Halves go to the even number."""
    return F.rint(x)


def clamp(x: Column, low: float, high: float) -> Column:
    """Null stays null (least and greatest alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, null where there is no whole."""
    return F.when(whole > 0, part / whole)


def or_else(x: Column, other: Column | str) -> Column:
    """other where x is null or empty."""
    return F.coalesce(F.nullif(x, F.lit("")), other if isinstance(other, Column) else F.lit(other))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def normalized_answer(x: Column) -> Column:
    """Trimmed, lower case, without white space."""
    return F.regexp_replace(F.lower(F.trim(x)), r"\s+", "")


# Circled digits of answer keys.
CIRCLED = "①②③④⑤"


def circled_to_digit(x: Column) -> Column:
    return F.translate(x, CIRCLED, "12345")


def latex_answer(x: Column) -> Column:
    """The bare answer inside LaTeX wrappers, delimiters and closing punctuation."""
    out = F.trim(x)
    for pattern, to in ((r"\\(?:text|boxed|mathrm)\{([^{}]*)\}", "$1"), (r"\\[()\[\]]|\$", ""), (r"\\[,;!]", ""), (r"[.。]\s*$", "")):
        out = F.regexp_replace(out, pattern, to)
    return F.lower(F.regexp_replace(out, r"\s+", ""))


def leading_int(x: Column) -> Column:
    """The integer at the start, sign allowed, else null."""
    return F.nullif(F.regexp_extract(x, r"^\s*([+-]?\d+)", 1), F.lit("")).cast("int")


def strip_tags(x: Column) -> Column:
    return F.regexp_replace(x, r"<[^>]+>", "")


# The five characters XML must escape, ampersand first.
XML_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))


def xml_escape(x: Column) -> Column:
    for plain, escaped in XML_ESCAPES:
        x = F.replace(x, F.lit(plain), F.lit(escaped))
    return x


def xml_unescape(x: Column) -> Column:
    for plain, escaped in reversed(XML_ESCAPES):
        x = F.replace(x, F.lit(escaped), F.lit(plain))
    return x


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return dot / (norm(a) * norm(b))


def json_number(payload: Column, path: str) -> Column:
    """The value at path only if it is a JSON number."""
    v = F.try_variant_get(F.try_parse_json(payload), path, "variant")
    return F.when(F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|DECIMAL.*|FLOAT)$"), F.try_variant_get(F.try_parse_json(payload), path, "double"))


def json_boolean(payload: Column, path: str) -> Column:
    """The value at path only if it is a JSON boolean: the string "true" is none."""
    v = F.try_variant_get(F.try_parse_json(payload), path, "variant")
    return F.when(F.schema_of_variant(v) == "BOOLEAN", F.try_variant_get(F.try_parse_json(payload), path, "boolean"))
