"""Label and formatting expressions: time buckets, grains, number text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from briskbi.functions.parse import col_of

GRAINS = ("day", "week", "month", "quarter", "year")

# Span limits in days for the automatic grain.
# Dashboard rule: <= 31 day, <= 183 week, <= 1095 month, <= 3650 quarter, else year.
DASHBOARD_GRAIN_LIMITS = [(31, "day"), (183, "week"), (1095, "month"), (3650, "quarter")]
# Chat rule: <= 60 day, <= 400 week, <= 2000 month, else year.
CHAT_GRAIN_LIMITS = [(60, "day"), (400, "week"), (2000, "month")]


def iso_week_label(ts: str | Column) -> Column:
    """``%G-W%V`` (ISO year and week), e.g. 2021-01-01 → ``2020-W53``."""
    ts = col_of(ts)
    return F.concat(
        F.extract(F.lit("YEAROFWEEK"), ts).cast("string"),
        F.lit("-W"),
        F.lpad(F.weekofyear(ts).cast("string"), 2, "0"),
    )


def bucket_label(ts: str | Column, grain: str) -> Column:
    """Sortable string label of a timestamp at ``grain``."""
    ts = col_of(ts)
    if grain == "week":
        return iso_week_label(ts)
    if grain == "month":
        return F.date_format(ts, "yyyy-MM")
    if grain == "quarter":
        return F.concat(F.year(ts).cast("string"), F.lit("-Q"), F.quarter(ts).cast("string"))
    if grain == "year":
        return F.date_format(ts, "yyyy")
    return F.date_format(ts, "yyyy-MM-dd")


def grain_for_span(span_days: int | None, limits=DASHBOARD_GRAIN_LIMITS, last: str = "year") -> str:
    """Grain from the (min, max) span in whole days."""
    if span_days is None:
        return "day"
    for bound, grain in limits:
        if span_days <= bound:
            return grain
    return last


def ts_text(ts: str | Column) -> Column:
    """Timestamp as pandas ``str(Timestamp)``: microseconds only when non-zero."""
    ts = col_of(ts)
    whole = F.date_format(ts, "SSSSSS") == "000000"
    return F.when(whole, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def week_end_sunday(ts: str | Column) -> Column:
    """The Sunday that ends ``ts``'s Monday-based week (resample "W")."""
    return F.date_add(F.date_trunc("week", col_of(ts)).cast("date"), 6)


def compact_number(x: str | Column, currency: bool = False) -> Column:
    """``1.2K``, ``3.4M``, ``5.0B``; integers with separators, else 2 decimals."""
    x = col_of(x).cast("double")
    a = F.abs(x)
    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
    cur = F.lit("$" if currency else "")
    num = (
        F.when(a >= 1e9, F.concat(F.format_number(a / 1e9, 1), F.lit("B")))
        .when(a >= 1e6, F.concat(F.format_number(a / 1e6, 1), F.lit("M")))
        .when(a >= 1e3, F.concat(F.format_number(a / 1e3, 1), F.lit("K")))
        .when((a >= 1) & (a == F.floor(a)), F.format_number(a, 0))
        .when(a >= 1, F.format_number(a, 2))
        .otherwise(F.format_number(a, 2))
    )
    return F.when(x.isNull(), F.lit(None)).otherwise(F.concat(sign, cur, num))


def title_case_name(c: str | Column, acronyms=("id", "kpi", "url", "api", "ip")) -> Column:
    """snake_case name → ``Title Case`` with upper-case acronyms."""
    words = F.split(F.regexp_replace(F.trim(col_of(c)), r"[_\s]+", " "), " ")
    acr = F.array(*[F.lit(a) for a in acronyms])
    pretty = F.transform(
        words,
        lambda w: F.when(F.array_contains(acr, F.lower(w)), F.upper(w)).otherwise(
            F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 10_000)))
        ),
    )
    return F.array_join(pretty, " ")
