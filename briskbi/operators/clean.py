"""Cleaning and smart typing of raw tables.

Column choices come from the schema and column names (driver side); every
value transformation is a Column expression, so ``clean`` is one projection,
one statistics aggregate (for dropping empty / constant columns) and one
``dropDuplicates``.  ``smart`` is one wide statistics pass plus one projection.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from briskbi.functions import parse as P
from briskbi.operators.ranking import exact_percentiles, forward_fill

# ---------------------------------------------------------------------------
# Name rules of the cleaning step.
# ---------------------------------------------------------------------------
MAX_NULL_RATIO_TO_KEEP = 0.95
EMAIL_HINTS = ["email", "e_mail"]
GENDER_HINTS = ["gender", "sex"]
MONEY_TOKENS = ["salary", "wage", "income", "pay", "amount", "price", "cost"]
DATETIME_TOKENS = ["date", "time", "timestamp"]
NUMERIC_FORCE_TOKENS = ["salary", "amount"]
BOOLEAN_PREFIXES = ["is_", "has_"]
BOOLEAN_SUFFIXES = ["_flag", "_enabled", "_active"]
# Smart typing thresholds.
MEASURE_MIN_SUCCESS = 0.90
MEASURE_MAX_FILL = 0.30
DATE_MIN_SUCCESS = 0.90
DATE_MAX_FILL = 0.10
BOOLEAN_MIN_SUCCESS = 0.85
BOOLEAN_MAX_FILL = 0.20
DIMENSION_MAX_FILL = 0.10
RISKY_ROLE_MIN_CONFIDENCE = 0.75
PROMOTION_MIN_SHARE = 0.90
PROMOTION_MIN_NON_NULL = 50
PROMOTION_MAX_UNIQUE_RATIO = 0.995
CONFORMANCE_MAX_NUMERIC_TEXT = 0.15
ROLE_ALIASES = {"time": "date", "geo": "geographic", "category": "dimension"}
ROLE_TYPE_COMPATIBILITY = {
    "measure": {"numeric", "text"},
    "date": {"datetime", "text"},
    "boolean": {"boolean", "text"},
    "id": {"text", "numeric"},
    "dimension": {"text", "numeric", "datetime", "boolean"},
    "descriptive": {"text", "numeric", "datetime", "boolean"},
    "geographic": {"text", "numeric"},
}
PROMOTABLE_ROLES = {"dimension", "descriptive", "unknown"}
IDENTIFIER_HINTS = ["id", "identifier", "uuid", "guid", "phone", "mobile", "tel", "fax", "zip", "postal", "ssn", "passport"]
# ---------------------------------------------------------------------------


# B1/B2 --------------------------------------------------------------------

def _snake(name: str, splits, empty: str) -> str:
    """ASCII letters and digits of a name in lower case, words joined by ``_`` where a character ``splits``; others vanish."""
    words = [""]
    for ch in str(name).lower():
        if ch.isascii() and ch.isalnum():
            words[-1] += ch
        elif splits(ch) and words[-1]:
            words.append("")
    return "_".join(w for w in words if w) or empty


def snake_clean(name: str) -> str:
    """B1: every character that is no ASCII letter or digit ends a word; empty → ``unnamed``."""
    return _snake(name, lambda ch: True, "unnamed")


def snake_merge(name: str) -> str:
    """B2: white space, dashes and underscores end a word, other symbols vanish; empty → ``column``."""
    return _snake(name, lambda ch: ch in "-_" or ch.isspace(), "column")


def normalize_names(df: DataFrame, style: str = "clean") -> DataFrame:
    """Rename all columns with the B1 (``clean``) or B2 (``merge``) rule."""
    fn = snake_clean if style == "clean" else snake_merge
    return df.toDF(*[fn(c) for c in df.columns])


# B3 name predicates ---------------------------------------------------------

def tokens(name: str) -> set[str]:
    """The non-empty words of a snake-case name."""
    return set(name.split("_")) - {""}


def has_token(name: str, words) -> bool:
    return not tokens(name).isdisjoint(words)


def is_boolean_like(name: str) -> bool:
    """A flag by its first or its last word."""
    return name.startswith(tuple(BOOLEAN_PREFIXES)) or name.endswith(tuple(BOOLEAN_SUFFIXES))


def is_datetime_like(name: str) -> bool:
    """A moment by any of its words, or by a closing ``at``."""
    return name[-3:] == "_at" or not tokens(name).isdisjoint(DATETIME_TOKENS)


# B8 -----------------------------------------------------------------------

def low_information_columns(df: DataFrame, max_null: float = MAX_NULL_RATIO_TO_KEEP) -> list[str]:
    """Columns all null, ≥ ``max_null`` null, or with ≤ 1 distinct non-null value.

    One aggregate of null counts and min/max (≤ 1 distinct value ⇔ min = max);
    only unorderable columns use a sketch plus an exact count when it is small.
    """
    cols = df.columns
    if not cols:
        return []
    orderable = {c for c in cols if not isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType,
                                                                           T.BinaryType))}
    aggs = [F.count(F.lit(1)).alias("__n")] + [F.count(F.col(c)).alias(f"nn{i}") for i, c in enumerate(cols)]
    for i, c in enumerate(cols):
        if c in orderable:  # ≤ 1 distinct non-null value ⇔ min = max
            aggs += [F.min(F.col(c)).alias(f"lo{i}"), F.max(F.col(c)).alias(f"hi{i}")]
        else:
            aggs.append(F.approx_count_distinct(F.col(c)).alias(f"ad{i}"))
    st = df.agg(*aggs).collect()[0]
    n = st["__n"]
    drop, check = [], []
    for i, c in enumerate(cols):
        null_ratio = 1.0 if n == 0 else 1 - st[f"nn{i}"] / n
        if null_ratio == 1.0 or null_ratio >= max_null:
            drop.append(c)
        elif c in orderable:
            if st[f"lo{i}"] == st[f"hi{i}"]:
                drop.append(c)
        elif st[f"ad{i}"] <= 3:
            check.append((i, c))
    if check:
        ex = df.agg(*[F.count_distinct(F.col(c)).alias(f"d{i}") for i, c in check]).collect()[0]
        drop += [c for i, c in check if ex[f"d{i}"] <= 1]
    return [c for c in cols if c in set(drop)]


def drop_low_information(df: DataFrame, max_null: float = MAX_NULL_RATIO_TO_KEEP) -> DataFrame:
    return df.drop(*low_information_columns(df, max_null))


# P21 ----------------------------------------------------------------------

def clean_expressions(df: DataFrame, case_insensitive_nulls: bool = False, max_text: int | None = None) -> list[Column]:
    """P1–P8 for every column, chosen from its (already snake_case) name and type."""
    out = []
    for f in df.schema.fields:
        c, name = F.col(f.name), f.name
        is_text = isinstance(f.dataType, T.StringType)
        if is_text:
            c = F.trim(P.null_like_to_null(c, case_insensitive_nulls))
        if any(h in name for h in EMAIL_HINTS) and is_text:
            c = F.lower(c)
        kind = "keep"
        if any(h in name for h in GENDER_HINTS):
            c, kind = P.normalize_gender(c), "gender"
        if "age" in tokens(name):
            c, kind = P.clean_age(c), "age"
        if has_token(name, MONEY_TOKENS):
            c, kind = P.clean_money(c), "money"
        if is_datetime_like(name):
            c, kind = P.to_timestamp_mixed(c, f.dataType if kind == "keep" else None), "datetime"
        if is_boolean_like(name):
            c, kind = P.to_bool(c), "boolean"
        if has_token(name, NUMERIC_FORCE_TOKENS) or "age" in tokens(name):
            typed = kind in ("money", "age") or isinstance(f.dataType, T.NumericType)
            c = P.to_number(c, T.DoubleType() if typed else None)
        if kind in ("keep", "gender") and is_text:
            c = P.truncate_text(c, max_text) if max_text else c
        out.append(c.alias(name))
    return out


def clean(df: DataFrame, case_insensitive_nulls: bool = False, max_text: int | None = None) -> DataFrame:
    """Names → values → drop low-information columns → drop all-null rows → dedup.

    Texts stay whole unless ``max_text`` names a length.
    """
    df = normalize_names(df, "clean")
    df = df.select(*clean_expressions(df, case_insensitive_nulls, max_text))
    df = drop_low_information(df)
    return df.dropna(how="all").dropDuplicates()


# P9–P20 smart typing --------------------------------------------------------

@dataclass
class ColumnPlan:
    name: str
    role: str
    transforms: list[str] = field(default_factory=list)
    imputation: str | None = None
    success: float | None = None
    applied: bool = True
    reason: str = ""


def _id_like(name: str) -> bool:
    return bool(tokens(name.lower()) & set(IDENTIFIER_HINTS))


def _original_types(df: DataFrame, st: dict) -> dict[str, str]:
    """Q2 types from the schema and the conformance counts (all non-null values must parse)."""
    out = {}
    for i, c in enumerate(df.columns):
        dt = df.schema[c].dataType
        if any(h in c.lower() for h in ("phone", "mobile", "fax", "tel", "cell", "whatsapp")):
            out[c] = "text"
        elif isinstance(dt, T.BooleanType):
            out[c] = "boolean"
        elif isinstance(dt, T.NumericType):
            out[c] = "numeric"
        elif isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            out[c] = "datetime"
        elif st[f"nn{i}"] and st[f"dt{i}"] == st[f"nn{i}"]:
            out[c] = "datetime"
        elif st[f"nn{i}"] and st[f"num{i}"] == st[f"nn{i}"]:
            out[c] = "numeric"
        else:
            out[c] = "text"
    return out


def _conformance(df: DataFrame, roles: dict[str, str]) -> dict:
    """Wide statistics of every column (parse successes, nulls)."""
    types = [df.schema[c].dataType for c in df.columns]
    # Text columns as rows (column, text): one set of expressions for all, as many sets make code too long to be compiled.
    text = [i for i, dt in enumerate(types) if isinstance(dt, T.StringType)]
    typed = {i: dt for i, dt in enumerate(types) if i not in text}  # parse exactly as their type allows; no text work
    st = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(F.col(df.columns[i])).alias(f"nn{i}") for i in typed]).collect()[0].asDict()
    if text:
        cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(df.columns[i]).alias("v")) for i in text]))
        v, dt = F.col("v"), T.StringType()
        b, num = P.to_bool(v), P.to_number(v, dt)
        # What is a number is the same amount of money, and never a date.
        counts = df.select(cells.alias("c")).select("c.i", "c.v").groupBy("i").agg(
            F.count(v).alias("nn"), F.count(num).alias("num"), F.count(F.coalesce(num, P.clean_financial(v))).alias("fin"),
            F.count(F.when(num.isNull(), P.to_timestamp_mixed(v, dt))).alias("dt"), F.count(b).alias("bo"),
            F.count(F.when(b, 1)).alias("bt"), F.count(F.when(~b, 1)).alias("bf"))
        found = {r["i"]: r.asDict() for r in counts.collect()}  # one row per text column
        st.update({f"{k}{i}": found.get(i, {}).get(k, 0) for i in text for k in ("nn", "num", "fin", "dt", "bo", "bt", "bf")})
    for i, dt in typed.items():
        nn = st[f"nn{i}"]
        num = isinstance(dt, (T.NumericType, T.BooleanType))
        tsl = isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType))
        st.update({f"num{i}": nn if num else 0, f"fin{i}": nn if num else 0, f"dt{i}": nn if tsl else 0,
                   f"bo{i}": nn if isinstance(dt, T.BooleanType) else 0, f"bt{i}": 0, f"bf{i}": 0})
    return st


def smart(df: DataFrame, roles: dict[str, str], order_by: str | None = None,
          confidences: dict[str, float] | None = None,
          stats_from: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Type every column by its role; returns (typed frame, audit).

    Measures: plain or financial parse, whichever parses more (P10), applied at
    ≥ 90 % success, median fill at ≤ 30 % nulls.  Dates: ≥ 90 %, forward fill
    in ``order_by`` order at ≤ 10 % nulls.  Booleans: ≥ 85 %, mode fill at
    ≤ 20 %.  Ids: trimmed text.  Dimensions: collapsed text, ``Unknown`` at
    ≤ 10 % nulls.  Mostly-numeric dimensions are promoted to measures (P16).

    U8: imputation statistics (medians, boolean modes) come from the rows being
    typed (``stats_from=None``, the reference's default for appended batches) or
    from another frame such as the accumulated base (``stats_from=base``).
    """
    confidences = confidences or {}
    st = _conformance(df, roles)
    fill_st = _conformance(stats_from.select(*df.columns), roles) if stats_from is not None else st
    n = st["__n"] or 0
    plans: dict[str, ColumnPlan] = {}
    original = _original_types(df, st)
    def promotable(i: int, c: str) -> bool:
        share = (max(st[f"num{i}"], st[f"fin{i}"]) / st[f"nn{i}"]) if st[f"nn{i}"] else 0.0
        return ROLE_ALIASES.get(roles.get(c, "unknown"), roles.get(c, "unknown")) in PROMOTABLE_ROLES and not _id_like(c) and share >= PROMOTION_MIN_SHARE

    # Exact distinct counts, only for the few columns that could be promoted.
    unique = [(i, c) for i, c in enumerate(df.columns) if promotable(i, c) and st[f"nn{i}"] >= PROMOTION_MIN_NON_NULL]
    if unique:
        st.update(df.agg(*[F.count_distinct(F.col(c)).alias(f"ud{i}") for i, c in unique]).collect()[0].asDict())
    for i, c in enumerate(df.columns):
        role = ROLE_ALIASES.get(roles.get(c, "unknown"), roles.get(c, "unknown"))
        nn = st[f"nn{i}"]
        if promotable(i, c):
            unique_ok = nn < PROMOTION_MIN_NON_NULL or (st[f"ud{i}"] / nn) <= PROMOTION_MAX_UNIQUE_RATIO
            if unique_ok:
                role = "measure"
        risky = role in ("measure", "date", "boolean") and confidences.get(c, 1.0) < RISKY_ROLE_MIN_CONFIDENCE
        if risky:
            plans[c] = ColumnPlan(c, role, applied=False,
                                  reason=f"low_confidence:{confidences.get(c, 1.0):.3f}<required:{RISKY_ROLE_MIN_CONFIDENCE:.3f}")
            continue
        allowed = ROLE_TYPE_COMPATIBILITY.get(role)
        if allowed is not None and original[c] not in allowed:
            # The role does not fit the column's detected type; leave it as is.
            plans[c] = ColumnPlan(c, role, applied=False, reason=f"incompatible_role_and_type:{role}/{original[c]}")
            continue
        plans[c] = ColumnPlan(c, role)

    medians: dict[str, float] = {}
    med_cols = []
    exprs = {}
    for i, c in enumerate(df.columns):
        p, dt, nn = plans[c], df.schema[c].dataType, st[f"nn{i}"]
        if not p.applied:
            continue
        if p.role == "measure":
            fin = st[f"fin{i}"] > st[f"num{i}"]
            expr = P.clean_financial(F.col(c)) if fin and not isinstance(dt, T.NumericType) else P.to_number(F.col(c), dt)
            ok = st[f"fin{i}"] if fin else st[f"num{i}"]
            p.transforms = ["financial_numeric_parse" if fin else "numeric_parse"]
            p.success = round(ok / nn, 4) if nn else 1.0
            if p.success < MEASURE_MIN_SUCCESS:
                p.applied, p.reason = False, "conversion_success_too_low"
                continue
            null_ratio = 1 - ok / n if n else 1.0
            exprs[c] = expr
            if null_ratio <= MEASURE_MAX_FILL and ok > 0 and null_ratio > 0:
                med_cols.append(c)
        elif p.role == "date":
            ok = st[f"dt{i}"]
            p.transforms, p.success = ["datetime_parse"], (round(ok / nn, 4) if nn else 1.0)
            if p.success < DATE_MIN_SUCCESS:
                p.applied, p.reason = False, "conversion_success_too_low"
                continue
            expr = P.to_timestamp_mixed(F.col(c), dt)
            null_ratio = 1 - ok / n if n else 1.0
            if null_ratio <= DATE_MAX_FILL and ok > 0 and null_ratio > 0:
                if order_by is None:
                    raise ValueError("forward fill needs an explicit order_by column (row order is undefined)")
                p.transforms.append("fill_forward")
                p.imputation = "ffill"
            exprs[c] = expr
        elif p.role == "boolean":
            ok = st[f"bo{i}"]
            p.transforms, p.success = ["boolean_map"], (round(ok / nn, 4) if nn else 1.0)
            if p.success < BOOLEAN_MIN_SUCCESS:
                p.applied, p.reason = False, "conversion_success_too_low"
                continue
            expr = P.to_bool(F.col(c))
            null_ratio = 1 - ok / n if n else 1.0
            if null_ratio <= BOOLEAN_MAX_FILL and ok > 0:
                mode = fill_st[f"bt{i}"] > fill_st[f"bf{i}"] if fill_st[f"bt{i}"] != fill_st[f"bf{i}"] else False
                expr = F.coalesce(expr, F.lit(mode))
                p.transforms.append("fill_mode")
                p.imputation = f"mode:{mode}"
            exprs[c] = expr
        elif p.role == "id":
            exprs[c] = P.id_text(F.col(c))
            p.transforms = ["normalize_id_string"]
        elif p.role in ("dimension", "descriptive", "geographic"):
            expr = P.dimension_text(F.col(c))
            p.transforms = ["normalize_text"]
            share = (st[f"num{i}"] / nn) if nn and isinstance(dt, T.StringType) else 0.0
            if 0 < share <= CONFORMANCE_MAX_NUMERIC_TEXT:
                # A few numeric-looking values in a text column are outliers.
                expr = F.when(P.is_number_text(expr), F.lit("Unknown")).otherwise(expr)
                p.transforms.append("text_numeric_outlier_to_unknown")
            null_ratio = 1 - nn / n if n else 1.0
            if null_ratio <= DIMENSION_MAX_FILL:
                expr = F.coalesce(expr, F.lit("Unknown"))
                p.transforms.append("fill_unknown")
                p.imputation = "constant:Unknown"
            exprs[c] = expr
    ffill = [c for c, p in plans.items() if p.imputation == "ffill"]
    out = source = df
    done = {}
    if ffill and order_by not in med_cols:
        # Filled dates are kept on disk in order; measures are parsed beside them once, so their medians read numbers.
        done = {c: exprs[c] for c in df.columns if c in exprs and c in {*ffill, *med_cols, order_by}}
        out = forward_fill(df, [exprs.get(order_by, F.col(order_by))], ffill, typed=done)
        source = out
    if med_cols:
        parsed = {c: F.col(c) if c in done and stats_from is None else exprs[c] for c in med_cols}
        src = stats_from.select(*df.columns) if stats_from is not None else source
        long = src.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), parsed[c].cast("double").alias("v"))
                                               for c in med_cols])).alias("kv")).select("kv.column", "kv.v")
        for r in exact_percentiles(long, ["column"], "v", [0.5], ["median"]).collect():
            medians[r["column"]] = r["median"]
        for c in med_cols:
            if c in done:
                done[c] = F.coalesce(F.col(c), F.lit(medians[c]))
            exprs[c] = F.coalesce(exprs[c], F.lit(medians[c]))
            plans[c].transforms.append("fill_median")
            plans[c].imputation = f"median:{round(medians[c], 6)}"
    left = {**exprs, **{c: done[c] if c in med_cols else F.col(c) for c in done}}
    out = out.select(*[left.get(c, F.col(c)).alias(c) for c in df.columns])
    if ffill and not done:
        out = forward_fill(out, [F.col(order_by)], ffill)
    return out, transform_audit(df, exprs, plans)


def transform_audit(before: DataFrame, exprs: dict[str, Column], plans: dict[str, ColumnPlan]) -> DataFrame:
    """One row per column with role, transforms, imputation, success and
    the number of values whose text changed.

    The transformed values are projections of the same rows, so the change
    counts are one aggregate over ``before`` (no join with the output).
    """
    spark = before.sparkSession
    rows = [(p.name, p.role, p.transforms, p.imputation, p.success, p.applied, p.reason) for p in plans.values()]
    meta = spark.createDataFrame(rows, "column string, role string, transforms array<string>, imputation string, "
                                       "success double, applied boolean, reason string")
    if not exprs:
        return meta.withColumn("values_modified", F.lit(0).cast("long"))
    # ≤ one row per column on both sides.
    return meta.join(F.broadcast(values_modified(before, exprs)), "column", "left").withColumn(
        "values_modified", F.coalesce(F.col("values_modified"), F.lit(0).cast("long")))


def values_modified(before: DataFrame, after_exprs: dict[str, Column]) -> DataFrame:
    """P19 counts: per column, rows whose text differs after the transform (null-safe)."""
    aggs = [F.count(F.when(~F.col(c).cast("string").eqNullSafe(e.cast("string")), 1)).alias(c)
            for c, e in after_exprs.items()]
    wide = before.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("values_modified")) for c in after_exprs])
    return wide.select(F.explode(rows).alias("r")).select("r.*")
