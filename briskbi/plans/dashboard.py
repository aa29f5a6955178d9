"""Dashboard blueprint (Q7) and the chart cache run.

The blueprint is a rule set over the (small) profile table: it never touches
the data; ``charts.build_charts`` then aggregates every chosen chart in one pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briskbi.operators import charts

DIM_MIN_DISTINCT, DIM_MAX_DISTINCT = 2, 25


def auto_blueprint(profile_rows: list[dict], roles: dict[str, str], n_rows: int, max_charts: int | None = None) -> list[dict]:
    """Q7: default chart specs from the column index, in the order of ``FALLBACK``.

    Categories come from the roles (date / measure / dimension); a dimension
    needs 2–25 distinct values (``distinct`` of the profile row where given, which stays exact on
large tables, else from its rounded unique ratio).  All charts that fit, or the
    first ``max_charts``; with no date or dimension the KPI and histogram fallbacks fill in.
    """
    by = {r["column"]: r for r in profile_rows}
    measures = [c for c, r in roles.items() if r == "measure" and c in by]
    dates = [c for c, r in roles.items() if r in ("date", "time") and c in by]
    dims = []
    for c, r in roles.items():
        if r in ("dimension", "category") and c in by:
            nd = by[c].get("distinct")
            if nd is None:
                nd = round((by[c].get("unique_ratio") or 0) * n_rows)
            if DIM_MIN_DISTINCT <= nd <= DIM_MAX_DISTINCT:
                dims.append((nd, c))
    pick = {"metric": measures[0] if measures else None, "date": dates[0] if dates else None,
            "dimension": min(dims)[1] if dims else None}
    specs = []
    for kind, x, y, dated in FALLBACK:
        if dated is not None and dated != bool(pick["date"]):
            continue
        axes = {"x_axis": pick[x] if x else None, "y_axis": pick[y] if y else None}
        if all(pick[a] for a in (x, y) if a):
            specs.append({"chart_type": kind, **axes})
    return specs[:max_charts]


# Default charts in order: type, x, y, and whether a date column must exist or be absent.
FALLBACK = [
    ("kpi_card", None, "metric", None),
    ("line", "date", "metric", None),
    ("bar", "dimension", "metric", None),
    ("pie", "dimension", "metric", None),
    ("combo", "date", "metric", True),
    ("treemap", "dimension", "metric", False),
    ("histogram", "metric", None, False),
    ("pareto", "dimension", "metric", None),
]
# What each chart type asks of its axes.  "metric": a number, the first measure where
# none is named; "number?": a number that is no id, left out otherwise; None: no such axis.
AXES = {
    "bar": ("any", "any"), "line": ("any", "any"), "horizontal_bar": ("any", "any"),
    "combo": ("any", "number"), "pareto": ("any", "number"), "histogram": ("number", None),
    "pie": ("any", "number?"), "donut": ("any", "number?"), "treemap": ("any", "number?"), "funnel": ("any", "number?"),
    "kpi_card": (None, "metric"), "radial": (None, "metric"),
}


def validate_charts(specs: list[dict], profile_rows: list[dict], roles: dict[str, str]) -> tuple[list[dict], list[str]]:
    """Q7: specs whose type and axes the profile supports, and a note on every change or rejection.

    Column names match without regard to case; a horizontal bar with its axes the wrong
    way round is turned; a combo takes the first other numeric column as its line.
    """
    kinds = {r["column"]: r["data_type"] for r in profile_rows}
    named = {c.lower(): c for c in kinds}
    number = lambda c: kinds.get(c) == "numeric"
    first = next((c for c in kinds if number(c) and roles.get(c) == "measure"), None)
    good, notes = [], []
    for i, spec in enumerate(specs):
        kind = str(spec.get("chart_type") or "").strip().lower()
        if kind not in AXES:
            notes.append(f"{i}: unknown chart type {kind!r}")
            continue
        x, y = (named.get(str(spec.get(a) or "").lower()) for a in ("x_axis", "y_axis"))
        if kind == "horizontal_bar" and x and y and number(x) and not number(y):
            x, y = y, x
            notes.append(f"{i}: axes turned")
        fault = None
        found = {}
        for axis, column, rule in zip(("x_axis", "y_axis"), (x, y), AXES[kind], strict=True):
            if rule == "metric" and column is None:
                column = first
            if rule is None:
                column = None
            elif rule == "number?":
                if column and (not number(column) or roles.get(column) == "id"):
                    notes.append(f"{i}: {axis} {column} left out")
                    column = None
            elif column is None:
                fault = f"{i}: {kind} needs a column for {axis}"
            elif rule in ("number", "metric") and not number(column):
                fault = f"{i}: {kind} needs a number for {axis}, not {column}"
            found[axis] = column
        if fault:
            notes.append(fault)
            continue
        if kind == "line" and kinds[found["x_axis"]] != "datetime":
            notes.append(f"{i}: {found['x_axis']} is no date")
        if kind == "combo":
            others = [named.get(str(c).lower()) for c in [spec.get("y_axis_secondary"), *(spec.get("columns") or [])]]
            second = next((c for c in others if c and c not in found.values() and number(c)), None)
            if second:
                found["y_axis_secondary"] = second
        good.append({"chart_type": kind, **found})
    return good, notes


def chart_cache(df: DataFrame, specs: list[dict], scale: int | None = None) -> DataFrame:
    """Every chart as rows of one results table ``(chart_key, row_json)``."""
    built = charts.build_charts(df, specs, scale)
    out = None
    for key, res in built.items():
        part = res.select(F.lit(key).alias("chart_key"), F.to_json(F.struct(*res.columns)).alias("row_json"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return df.sparkSession.createDataFrame([], "chart_key string, row_json string")
    return out
