"""Write the formatted physical plans of key queries to PLANS.md (plan review aid).

Usage: python tests/dump_plans.py [sf_dir]
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

KEYS = {
    "q_month_revenue": "filter/projection pushdown, partial aggregation, TakeOrderedAndProject",
    "q_date_filter": "date range pushed into the Parquet scan",
    "q_top_values": "top-k per column: WindowGroupLimit (partial) before the shuffle",
    "q_upsert": "last-wins upsert: max_by with partial aggregation, no per-key window",
    "q_pie_others": "Others slice: left-anti join against a broadcast of ≤ 11 names",
    "q_abc": "ABC running share: range-partitioned order, one-row-per-partition offsets (checkpointed input)",
}
LINE = re.compile(r"^(\(\d+\) |[ +\-:*|]*[A-Z][A-Za-z]+|PushedFilters|ReadSchema|Partition|Arguments|Keys|Functions|Join type)")


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    from briskbi.session import build_session

    spark = build_session()
    import __spark_entry__ as E

    qs = E.queries()
    out = ["# Physical plans of key queries", "", f"Generated by `tests/dump_plans.py` on `{sf}`.", ""]
    for name, why in KEYS.items():
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            qs[name](spark, sf).explain("formatted")
        text = buf.getvalue()
        head = text.split("\n\n(1)")[0]
        details = [ln for ln in text.splitlines() if ln.startswith(("PushedFilters", "ReadSchema"))][:4]
        out += [f"## {name}", "", why, "", "```", head.strip(), *details, "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
