"""Column expressions that parse, clean and type raw text values.

Everything here returns a ``pyspark.sql.Column`` built from built-in functions,
so it stays inside whole-stage codegen; no Python runs per row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour.
# ---------------------------------------------------------------------------
# Placeholders that mean "missing" (each matched against the whole cell).
NULL_LIKE_PATTERNS = [
    r"^\s*$",
    r"^\s*-\s*$",
    r"^\s*_\s*$",
    r"^\s*(?:n/?a)\s*$",
    r"^\s*null\s*$",
    r"^\s*none\s*$",
]
# Boolean vocabularies (compared after trim + lower-case).
TRUE_WORDS = ["yes", "true", "1", "active", "enabled", "y", "t"]
FALSE_WORDS = ["no", "false", "0", "inactive", "disabled", "n", "f"]
# Gender vocabularies.
MALE_WORDS = ["m", "male"]
FEMALE_WORDS = ["f", "female"]
# Age words and their values.
AGE_WORDS = {
    "eighteen": 18,
    "nineteen": 19,
    "twenty": 20,
    "twenty one": 21,
    "twenty two": 22,
    "twenty three": 23,
    "twenty four": 24,
    "twenty five": 25,
    "thirty": 30,
}
# Currency words removed from money text (optional plural "s").
MONEY_CURRENCY_WORDS = ["usd", "egp", "sar", "aed", "eur", "gbp", "dollar", "riyal", "pound"]
# Timestamp layouts tried in order by ``to_timestamp_mixed`` (month-first).
DATETIME_PATTERNS = [
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "yyyy/MM/dd HH:mm:ss",
    "yyyy/MM/dd",
    "M/d/yyyy H:mm:ss",
    "M/d/yyyy H:mm",
    "M/d/yyyy",
    "M-d-yyyy",
    "d.M.yyyy",
    "MMM d yyyy",
    "MMM d, yyyy",
    "d MMM yyyy",
    "MMMM d yyyy",
    "MMMM d, yyyy",
    "yyyyMMdd'T'HHmmss",
]
# ---------------------------------------------------------------------------

_NUMBER_RE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_WHOLE_NUMBER_RE = _NUMBER_RE.removesuffix("$") + r"\z"
_INF_RE = r"^\s*[+-]?(?i)(inf|infinity)\s*$"


# What a text needs at least so that a layout's field can accept it: digits, and months and days that exist.
# Month names have three letters when short, and more when not, except for May, which both spell alike.
_FIELD_SHAPES = {
    "yyyy": r"[+-]?\d{4,}", "MMMM": "[A-Za-z]{4,}", "MMM": "[A-Za-z]{3}", "MM": r"(?:0[1-9]|1[0-2])", "M": r"0*(?:[1-9]|1[0-2])",
    "dd": r"(?:0[1-9]|[12]\d|3[01])", "d": r"0*(?:[1-9]|[12]\d|3[01])", "HH": r"\d\d", "H": r"\d+", "mm": r"\d\d",
    "ss": r"\d\d", "SSSSSS": r"\d{1,6}", "'T'": "[Tt]",
}


def _layout_shape(pattern: str) -> str:
    """Regex that every text of a timestamp layout matches; no text matches those of two layouts."""
    fields = re.finditer(r"'T'|([A-Za-z])\1*|.", pattern)
    return "".join(_FIELD_SHAPES.get(m[0]) or re.escape(m[0]) for m in fields)


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_like_to_null(c: str | Column, case_insensitive: bool = False) -> Column:
    """Placeholder text → null (case-sensitive by default, as the reference)."""
    c = col_of(c)
    pattern = "|".join(f"(?:{p})" for p in NULL_LIKE_PATTERNS)
    if case_insensitive:
        pattern = "(?i)" + pattern
    return F.when(c.rlike(pattern), F.lit(None)).otherwise(c)


def to_number(c: str | Column, dtype: T.DataType | None = None) -> Column:
    """Lenient numeric parse like ``to_numeric(errors="coerce")``.

    Typed numeric columns are cast directly (the cheap path); text must look
    like a number (Spark alone would accept ``'1d'``).  NaN becomes null.
    """
    c = col_of(c)
    if dtype is not None and isinstance(dtype, T.NumericType):
        v = c.cast("double")
        return F.when(F.isnan(v), F.lit(None)).otherwise(v)
    if dtype is not None and isinstance(dtype, T.BooleanType):
        return c.cast("double")
    s = F.trim(c.cast("string"))
    # The match itself is cast, so the text, often the end of a chain of replacements, is built once; without
    # a match there is nothing to cast, as a failed cast costs an exception.
    number = F.get(F.regexp_extract_all(s, F.lit(_WHOLE_NUMBER_RE), F.lit(0)), F.lit(0))
    return F.coalesce(number.try_cast("double"), F.when(
        s.rlike(_INF_RE), F.when(s.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    ))


def is_number_text(c: str | Column) -> Column:
    return col_of(c).cast("string").rlike(_NUMBER_RE)


def to_timestamp_mixed(c: str | Column, dtype: T.DataType | None = None) -> Column:
    """Parse mixed date layouts into wall-clock ``timestamp_ntz``.

    Results never depend on the session time zone (like pandas' naive
    datetimes); a bare number is never a date.
    """
    c = col_of(c)
    if dtype is not None and isinstance(dtype, T.TimestampNTZType):
        return c
    if dtype is not None and isinstance(dtype, (T.TimestampType, T.DateType)):
        return c.cast("timestamp_ntz")
    s = F.trim(c.cast("string"))
    # Each failed parse costs an exception, so a text is parsed by the one layout whose shape it has.
    by_mark = {"/": [], "-": [], "": []}
    for p in DATETIME_PATTERNS:
        by_mark[next(m for m in by_mark if m in p)].append(F.when(s.rlike(f"^{_layout_shape(p)}$"), F.lit(p)))
    layout = F.coalesce(*[F.when(s.contains(mark), F.coalesce(*found)) for mark, found in by_mark.items()])
    # Every layout has a 4-digit year and a separator; a bare number is never a
    # date (D6).  The cheap guard skips the layout list for other text.
    plausible = s.rlike(r"\d{4}") & s.rlike(r"[-/.:\s,T]")
    return F.when(plausible, F.try_to_timestamp(s, layout).cast("timestamp_ntz"))


def clean_money(c: str | Column) -> Column:
    """P5: strip ``$``, currency words, ``,`` and ``_``; ``k`` suffix × 1000."""
    v = F.lower(F.trim(col_of(c).cast("string")))
    v = F.regexp_replace(v, r"\$", "")
    words = "|".join(MONEY_CURRENCY_WORDS)
    v = F.regexp_replace(v, rf"\b(?:{words})s?\b", "")
    v = F.trim(F.regexp_replace(v, r"[,_]", ""))
    thousands = to_number(F.regexp_replace(v, r"k$", "")) * 1000
    return F.when(v.endswith("k"), thousands).otherwise(to_number(v))


def clean_financial(c: str | Column) -> Column:
    """``(x)`` → −x; strip ``$ , € £ _``, spaces and currency words."""
    s = F.trim(col_of(c).cast("string"))
    negative = s.startswith("(") & s.rlike(r"^\(.*\)$")
    body = F.lower(F.when(negative, F.regexp_replace(s, r"^\((.*)\)$", "$1")).otherwise(s))
    words = "|".join(MONEY_CURRENCY_WORDS)
    body = F.when(body.rlike("[a-z]"), F.regexp_replace(body, rf"\b(?:{words})s?\b", "")).otherwise(body)
    body = F.regexp_replace(body, r"[$,€£_\s]", "")
    num = to_number(body) * F.when(negative, F.lit(-1.0)).otherwise(F.lit(1.0))
    return F.when(s.rlike("[0-9fF]"), num)  # no amount without a digit or the f of infinity


def to_bool(c: str | Column) -> Column:
    """yes/true/1/... → true, no/false/0/... → false, else null."""
    v = F.lower(F.trim(col_of(c).cast("string")))
    return F.when(v.isin(*TRUE_WORDS), F.lit(True)).when(v.isin(*FALSE_WORDS), F.lit(False))


def normalize_gender(c: str | Column) -> Column:
    """Male / Female / Unknown (null → Unknown)."""
    v = F.lower(F.trim(col_of(c).cast("string")))
    return (
        F.when(v.isin(*MALE_WORDS), F.lit("Male"))
        .when(v.isin(*FEMALE_WORDS), F.lit("Female"))
        .otherwise(F.lit("Unknown"))
    )


def clean_age(c: str | Column) -> Column:
    """Digits or an age word; anything else null."""
    v = F.lower(F.trim(col_of(c).cast("string")))
    words = F.create_map(*[x for k, n in AGE_WORDS.items() for x in (F.lit(k), F.lit(n))])
    return F.when(v.rlike(r"^[0-9]+$"), v.try_cast("long")).otherwise(F.element_at(words, v).cast("long"))


def id_text(c: str | Column) -> Column:
    """Trim; empty → null; ``123.0`` → ``123``."""
    v = F.trim(col_of(c).cast("string"))
    v = F.regexp_replace(v, r"^(-?\d+)\.0$", "$1")
    return F.when(v == "", F.lit(None)).otherwise(v)


def dimension_text(c: str | Column) -> Column:
    """P12 (first half): trim, collapse inner whitespace, empty → null."""
    v = F.trim(F.regexp_replace(col_of(c).cast("string"), r"\s+", " "))
    return F.when(v == "", F.lit(None)).otherwise(v)


def truncate_text(c: str | Column, n: int = 5000) -> Column:
    """Keep the first ``n`` characters, nulls stay null."""
    c = col_of(c)
    return F.when(c.isNull(), F.lit(None)).otherwise(F.substring(c, 1, n))
