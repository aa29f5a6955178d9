"""Typing of text columns: each text is parsed by one layout, and rows are typed once."""

import datetime as dt
import math
import re

from pyspark.sql import functions as F

from briskbi.functions import parse as P
from briskbi.operators import clean
from briskbi.operators.ranking import forward_fill

DATES = ["2026-01-09 10:11:12.123456", "2026-01-09 10:11:12.5", "2026-01-09 10:11:12", "2026-01-09T10:11:12.25", "2026-01-09t10:11:12",
         "2026-01-09 10:11", "2026-01-09", "+12026-01-09", "-2026-01-09", "2026/01/09 10:11:12", "2026/01/09", "1/9/2026 1:02:03", "01/0009/2026 10:11",
         "1/9/2026", "13/9/2026", "1-9-2026", "2026-1-9", "2026-02-30", "9.1.2026", "9.13.2026", "Jan 9 2026", "may 9 2026", "May 9, 2026",
         "Sept 9 2026", "9 Jan 2026", "January 9 2026", "JANUARY 09, 2026", "Janu 9 2026", "20260109T101112", "20260109t101112", "2026-01-09 25:00",
         "1001", "2026.5", "$1234.50 USD", "(1234.50)", "2026-01-09 ", "2026-01-09\n", "2026-01-09x", "", " ", None]


def test_f1_a_text_is_parsed_by_one_layout_with_the_result_of_trying_all(spark):
    df = spark.createDataFrame([(v,) for v in DATES], "s string")
    s = F.trim("s")
    plausible = s.rlike(r"\d{4}") & s.rlike(r"[-/.:\s,T]") & ~s.rlike(r"^\s*[+-]?\d+(\.\d+)?\s*$")
    tried = F.when(plausible, F.coalesce(*[F.try_to_timestamp(s, F.lit(p)) for p in P.DATETIME_PATTERNS]).cast("timestamp_ntz"))
    mixed = df.select(P.to_timestamp_mixed(F.col("s")).alias("got"))
    rows = df.select("s", P.to_timestamp_mixed(F.col("s")).cast("string").alias("got"), tried.cast("string").alias("want")).collect()
    assert [(r["s"], r["got"]) for r in rows] == [(r["s"], r["want"]) for r in rows]
    assert sum(r["got"] is not None for r in rows) > 20
    plan = mixed._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("gettimestamp", plan, re.IGNORECASE)) == 1


def test_f1_layout_shapes_do_not_overlap():
    for text in filter(None, DATES):
        assert sum(bool(re.search(f"^{P._layout_shape(p)}$", text)) for p in P.DATETIME_PATTERNS) <= 1, text


def test_f1_money_and_numbers(spark):
    vals = ["(12.50)", "$1,234.5 USD", "( usd 5 )", "-3", "(-3)", "1e5", "i$nf", "-Infinity", "(inf)", "1d", "12 dollars", "x", "()", "(5)(6)", "7\u0085", "", None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "s string").select(P.clean_financial(F.col("s"))).collect()]
    assert got[:8] == [-12.5, 1234.5, -5.0, -3.0, 3.0, 1e5, math.inf, -math.inf] and got[8] == -math.inf
    assert got[9] is None and got[10] == 12.0 and got[11:] == [None] * 6


def test_f1_forward_fill_types_rows_after_they_move(spark):
    n = 5_000
    df = spark.range(n).select(F.col("id").alias("k"), F.when(F.col("id") % 7 == 3, F.concat(F.lit("2026-01-0"), (F.col("id") % 9 + 1).cast("string"))).alias("d"),
                               F.when(F.col("id") % 2 == 0, (F.lit(2**53 + 1) + F.col("id"))).alias("big"), F.lit("t").alias("t"))
    typed = {"d": P.to_timestamp_mixed(F.col("d"))}
    out = forward_fill(df.repartition(5), [F.col("k")], ["d"], n_parts=6, typed=typed)
    got = {r["k"]: r for r in out.collect()}
    last = None
    for k in range(n):
        last = dt.datetime(2026, 1, k % 9 + 1) if k % 7 == 3 else last
        assert got[k]["d"] == last and got[k]["t"] == "t"
        assert got[k]["big"] == (2**53 + 1 + k if k % 2 == 0 else None)


def test_f1_smart_median_beside_filled_dates(spark):
    rows = [(k, None if k % 10 == 0 else f"(${k}.50)", None if k % 20 == 0 else f"1/{k % 28 + 1}/2026", "Yes" if k % 3 else None if k % 9 == 3 else "no") for k in range(1, 400)]
    df = spark.createDataFrame(rows, "k long, paid string, day string, ok string")
    out, audit = clean.smart(df, {"paid": "measure", "day": "date", "ok": "boolean"}, order_by="k")
    got = {r["k"]: r for r in out.collect()}
    paid = sorted(-k - 0.5 for k in range(1, 400) if k % 10)
    median = (paid[(len(paid) - 1) // 2] + paid[len(paid) // 2]) / 2
    for k in range(1, 400):
        assert got[k]["paid"] == (median if k % 10 == 0 else -k - 0.5)
        seen = k - 1 if k % 20 == 0 else k
        assert got[k]["day"] == dt.datetime(2026, 1, seen % 28 + 1)
        assert got[k]["ok"] == (k % 3 != 0 or k % 9 == 3)
    assert {r["column"]: r["imputation"] for r in audit.collect()}["paid"] == f"median:{round(median, 6)}"
