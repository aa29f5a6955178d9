"""Cleaning, typing, accumulation, source and text queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from briskbi.functions import parse as P
from briskbi.functions import text as X
from briskbi.operators import accumulate, charts, clean, ranking
from briskbi.plans.registry import register
from briskbi.session import ensure_checkpoint_dir, table
from briskbi.sources import files


def _re2(pattern: str) -> str:
    """Spark (Java) regex → DuckDB (RE2) literal: drop Java-only flags, quote."""
    return pattern.replace("(?d)", "").replace("'", "''")


# B12 ----------------------------------------------------------------------
def _count_sql(cls: str, t: str = "text") -> str:
    return f"length(regexp_replace(COALESCE({t}, ''), '[^{_re2(cls)}]+', '', 'g'))"


_OTHER_SQL = f"length(regexp_replace(COALESCE(text, ''), '[{_re2(X.OTHER_EXCLUDED)}]+', '', 'g'))"


@register("q_script_filter", f"""
WITH c AS (SELECT doc_id, lang, {_count_sql(X.ARABIC_CLASS)} AS arabic, {_count_sql(X.LATIN_CLASS)} AS latin,
  {_count_sql(X.DEVANAGARI_CLASS)} AS devanagari, {_count_sql(X.CYRILLIC_CLASS)} AS cyrillic, {_OTHER_SQL} AS other,
  regexp_matches(COALESCE(text, ''), '^[{_re2(X.SPACE_CLASS)}]*$') AS blank,
  lower(trim(COALESCE(NULLIF(lang, ''), 'en-US'))) AS lg FROM documents)
SELECT doc_id, lang, arabic, latin, devanagari, cyrillic, other,
  CASE WHEN blank THEN false WHEN arabic + latin + devanagari + cyrillic + other = 0 THEN true
       WHEN devanagari > 0 OR cyrillic > 0 THEN false
       WHEN starts_with(lg, 'ar') THEN CASE WHEN arabic = 0 AND latin > 0 THEN false ELSE arabic > 0 OR latin <= arabic * 2 END
       WHEN starts_with(lg, 'en') THEN CASE WHEN latin = 0 AND arabic > 0 THEN false ELSE latin > 0 OR arabic <= latin END
       ELSE true END AS allowed
FROM c
""")
def q_script_filter(spark, d):
    """Script letter counts and the language filter over whole documents."""
    docs = table(spark, d, "documents")
    docs = docs.select("doc_id", "lang", "text", X.script_counts(F.col("text")).alias("s"))
    return docs.select("doc_id", "lang", "s.arabic", "s.latin", "s.devanagari", "s.cyrillic", "s.other",
                       X.allow_script(F.col("text"), F.col("lang"), F.col("s")).alias("allowed"))


# P23 ----------------------------------------------------------------------
_MD_STEPS = [
    (r"```[\s\S]*?```", " "), (r"`([^`]+)`", r"\1"), (r"(?m)^#{1,6}\s+", ""), (r"\*\*(.+?)\*\*", r"\1"),
    (r"\*(.+?)\*", r"\1"), (r"(?m)^\s*[-*]\s+", ""), (r"(?m)^\s*\d+\.\s+", ""), (r"\[(.+?)\]\(.+?\)", r"\1"),
    (r"[ \t]{2,}", " "), (r"\n{3,}", r"\n\n"), (r"^\s+|\s+$", ""),
]


def _md_sql(col: str) -> str:
    t = f"COALESCE({col}, '')"
    for pat, rep in _MD_STEPS:
        rep_sql = rep.replace("\\n", "\n")
        t = f"regexp_replace({t}, '{_re2(pat)}', '{rep_sql}', 'g')"
    return t


@register("q_markdown_strip", f"SELECT doc_id, {_md_sql('text')} AS clean_text FROM documents")
def q_markdown_strip(spark, d):
    """Markdown and whitespace cleanup of whole documents."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", X.strip_markdown(F.col("text")).alias("clean_text"))


# The texts get an identifier of each kind, names and a date between them.
_IDENTIFIERS = " 'spend_vs_cost' on 2024-01-01: McDonald re-entry, iPhone, revenueByMarketingChannel_KPIList and salesByRegionAndMonth, 3a_b"


@register("q_humanize", rf"""
WITH t AS (SELECT conv_id, turn, text || '{_IDENTIFIERS.replace("'", "''")}' AS text FROM conversations),
pieces AS (SELECT conv_id, turn, regexp_extract_all(text, '[A-Za-z][A-Za-z0-9]*(?:[_-][A-Za-z0-9]+)+|[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+') AS p FROM t),
spaced AS (SELECT conv_id, turn, array_to_string(list_transform(p, lambda x:
  CASE WHEN regexp_matches(x, '^[A-Za-z][A-Za-z0-9]*([_-][A-Za-z0-9]+)+$') OR regexp_matches(x, '^[a-z]+([A-Z][a-z]+){{3,}}$') OR regexp_matches(x, '^([A-Z][a-z]+){{3,}}$')
  THEN regexp_replace(regexp_replace(translate(x, '_-', '  '), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g') ELSE x END), '') AS s FROM pieces)
SELECT conv_id, turn, regexp_replace(s, '[''"`‘’“”]([A-Za-z][A-Za-z0-9 ]{{2,40}})[''"`‘’“”]', '\1', 'g') AS text FROM spaced
""")
def q_humanize(spark, d):
    """Identifier splitting (snake/kebab/camel case) of conversation turns; names, dates and prose stay."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.concat("text", F.lit(_IDENTIFIERS)).alias("text"))
    return turns.withColumn("text", X.humanize_identifiers("text"))


# P3–P6, P11 -----------------------------------------------------------------
_DEC = "CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR)"
_MONEY_TEXT_SQL = (f"CASE l_linenumber % 4 WHEN 0 THEN '$' || {_DEC} WHEN 1 THEN {_DEC} || ' USD' "
                   f"WHEN 2 THEN 'eur ' || {_DEC} ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || 'k' END")
_NUM_RE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _money_sql(x: str) -> str:
    words = "|".join(P.MONEY_CURRENCY_WORDS)
    v = f"lower(trim({x}))"
    v = f"replace({v}, '$', '')"
    v = f"regexp_replace({v}, '\\b(?:{words})s?\\b', '', 'g')"
    v = f"trim(regexp_replace({v}, '[,_]', '', 'g'))"
    num = lambda e: f"CASE WHEN regexp_matches({e}, '{_NUM_RE}') THEN TRY_CAST(trim({e}) AS DOUBLE) END"
    return f"CASE WHEN ends_with({v}, 'k') THEN {num(f'regexp_replace({v}, ' + chr(39) + 'k$' + chr(39) + ', ' + chr(39) + chr(39) + ')')} * 1000 ELSE {num(v)} END"


@register("q_money_clean", f"""
SELECT l_orderkey, l_linenumber, {_MONEY_TEXT_SQL} AS money_text, {_money_sql(_MONEY_TEXT_SQL)} AS amount FROM lineitem
""")
def q_money_clean(spark, d):
    """P5: money text (currency signs, words, k suffix) built from lineitem, parsed back."""
    li = table(spark, d, "lineitem")
    dec = F.col("l_extendedprice").cast("decimal(12,2)").cast("string")
    txt = (F.when(F.col("l_linenumber") % 4 == 0, F.concat(F.lit("$"), dec))
           .when(F.col("l_linenumber") % 4 == 1, F.concat(dec, F.lit(" USD")))
           .when(F.col("l_linenumber") % 4 == 2, F.concat(F.lit("eur "), dec))
           .otherwise(F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("k"))))
    return li.select("l_orderkey", "l_linenumber", txt.alias("money_text"), P.clean_money(txt).alias("amount"))


_BOOL_TEXT_SQL = "CASE o_orderstatus WHEN 'F' THEN 'yes' WHEN 'O' THEN ' No ' ELSE 'maybe' END"


def _bool_sql(x: str) -> str:
    v = f"lower(trim({x}))"
    t = ", ".join(f"'{w}'" for w in P.TRUE_WORDS)
    f = ", ".join(f"'{w}'" for w in P.FALSE_WORDS)
    return f"CASE WHEN {v} IN ({t}) THEN true WHEN {v} IN ({f}) THEN false END"


@register("q_bool_map", f"""
SELECT o_orderkey, {_bool_sql('o_orderstatus')} AS status_bool, {_bool_sql(_BOOL_TEXT_SQL)} AS answer_bool FROM orders
""")
def q_bool_map(spark, d):
    """Boolean vocabulary map over order status text."""
    o = table(spark, d, "orders")
    txt = (F.when(F.col("o_orderstatus") == "F", F.lit("yes")).when(F.col("o_orderstatus") == "O", F.lit(" No "))
           .otherwise(F.lit("maybe")))
    return o.select("o_orderkey", P.to_bool(F.col("o_orderstatus")).alias("status_bool"), P.to_bool(txt).alias("answer_bool"))


@register("q_id_norm", """
SELECT o_orderkey, NULLIF(regexp_replace(trim(' ' || CAST(CAST(o_custkey AS DOUBLE) AS VARCHAR) || ' '), '^(-?\\d+)\\.0$', '\\1'), '') AS cust_id
FROM orders
""")
def q_id_norm(spark, d):
    """Id text normalisation (``123.0`` → ``123``) of customer keys read as floats."""
    o = table(spark, d, "orders")
    raw = F.concat(F.lit(" "), F.col("o_custkey").cast("double").cast("string"), F.lit(" "))
    return o.select("o_orderkey", P.id_text(raw).alias("cust_id"))


_GENDER_TEXT_SQL = "CASE c_custkey % 5 WHEN 0 THEN 'M' WHEN 1 THEN 'female' WHEN 2 THEN ' f ' WHEN 3 THEN 'x' END"
_AGE_TEXT_SQL = ("CASE c_custkey % 4 WHEN 0 THEN CAST(c_nationkey + 18 AS VARCHAR) WHEN 1 THEN 'Twenty One' "
                 "WHEN 2 THEN ' thirty' ELSE 'n/a' END")


@register("q_gender_age", f"""
SELECT c_custkey,
  CASE WHEN lower(trim({_GENDER_TEXT_SQL})) IN ('m', 'male') THEN 'Male'
       WHEN lower(trim({_GENDER_TEXT_SQL})) IN ('f', 'female') THEN 'Female' ELSE 'Unknown' END AS gender,
  CASE WHEN regexp_matches(lower(trim({_AGE_TEXT_SQL})), '^[0-9]+$') THEN CAST(lower(trim({_AGE_TEXT_SQL})) AS BIGINT)
       WHEN lower(trim({_AGE_TEXT_SQL})) = 'twenty one' THEN 21 WHEN lower(trim({_AGE_TEXT_SQL})) = 'thirty' THEN 30 END AS age
FROM customer
""")
def q_gender_age(spark, d):
    """Gender and age normalisation of text derived from customers."""
    c = table(spark, d, "customer")
    k5, k4 = F.col("c_custkey") % 5, F.col("c_custkey") % 4
    g = (F.when(k5 == 0, F.lit("M")).when(k5 == 1, F.lit("female")).when(k5 == 2, F.lit(" f "))
         .when(k5 == 3, F.lit("x")))
    a = (F.when(k4 == 0, (F.col("c_nationkey") + 18).cast("string")).when(k4 == 1, F.lit("Twenty One"))
         .when(k4 == 2, F.lit(" thirty")).otherwise(F.lit("n/a")))
    return c.select("c_custkey", P.normalize_gender(g).alias("gender"), P.clean_age(a).alias("age"))


# P21 / B1 / B8 -------------------------------------------------------------
@register("q_clean", """
SELECT DISTINCT o_orderkey AS order_id, o_totalprice AS total_price, o_orderdate AS order_date,
  CASE o_orderstatus WHEN 'O' THEN true WHEN 'F' THEN false END AS is_open,
  trim(o_orderpriority) AS priority_
FROM orders
""")
def q_clean(spark, d):
    """clean() of renamed order columns (money, date and flag rules by name)."""
    o = table(spark, d, "orders")
    open_text = (F.when(F.col("o_orderstatus") == "O", F.lit(" Yes")).when(F.col("o_orderstatus") == "F", F.lit("no"))
                 .otherwise(F.lit("N/A")))
    o = o.select(F.col("o_orderkey").alias("Order ID"), F.col("o_totalprice").alias("Total Price"),
                 F.col("o_orderdate").alias("Order Date"), open_text.alias("Is Open"),
                 F.col("o_orderpriority").alias("Priority (!)"))
    return clean.clean(o)


# Oracle column name of the last column follows the B1 rule: "Priority (!)" → "priority".
from briskbi.plans.registry import ORACLE as _OR  # noqa: E402

_OR["q_clean"] = _OR["q_clean"].replace("AS priority_", "AS priority")


# P20 ----------------------------------------------------------------------
_ROLES = {"o_orderkey": "id", "o_custkey": "id", "o_orderstatus": "dimension", "o_totalprice": "measure",
          "o_orderdate": "date", "o_orderpriority": "category"}


@register("q_smart", """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey,
  COALESCE(NULLIF(trim(regexp_replace(o_orderstatus, '\\s+', ' ', 'g')), ''), 'Unknown') AS o_orderstatus,
  o_totalprice, o_orderdate,
  COALESCE(NULLIF(trim(regexp_replace(o_orderpriority, '\\s+', ' ', 'g')), ''), 'Unknown') AS o_orderpriority
FROM orders
""")
def q_smart(spark, d):
    """Role-driven typing of orders (ids, dimensions, measure, date)."""
    out, _ = clean.smart(table(spark, d, "orders"), _ROLES, order_by="o_orderkey")
    return out


@register("q_smart_audit", r"""
SELECT 'o_orderkey' AS "column", 'id' AS role, ['normalize_id_string'] AS transforms, CAST(NULL AS VARCHAR) AS imputation,
  CAST(NULL AS DOUBLE) AS success, true AS applied, '' AS reason,
  COUNT(*) FILTER (WHERE CAST(o_orderkey AS VARCHAR) IS DISTINCT FROM NULLIF(regexp_replace(trim(CAST(o_orderkey AS VARCHAR)), '^(-?\d+)\.0$', '\1'), '')) AS values_modified FROM orders
UNION ALL
SELECT 'o_custkey' AS "column", 'id' AS role, ['normalize_id_string'] AS transforms, CAST(NULL AS VARCHAR) AS imputation,
  CAST(NULL AS DOUBLE) AS success, true AS applied, '' AS reason,
  COUNT(*) FILTER (WHERE CAST(o_custkey AS VARCHAR) IS DISTINCT FROM NULLIF(regexp_replace(trim(CAST(o_custkey AS VARCHAR)), '^(-?\d+)\.0$', '\1'), '')) AS values_modified FROM orders
UNION ALL
SELECT 'o_orderstatus', 'dimension',
  CASE WHEN COUNT(*) FILTER (WHERE o_orderstatus IS NULL) / COUNT(*) <= 0.10 THEN ['normalize_text', 'fill_unknown'] ELSE ['normalize_text'] END,
  CASE WHEN COUNT(*) FILTER (WHERE o_orderstatus IS NULL) / COUNT(*) <= 0.10 THEN 'constant:Unknown' END,
  CAST(NULL AS DOUBLE), true, '',
  COUNT(*) FILTER (WHERE o_orderstatus IS DISTINCT FROM COALESCE(NULLIF(trim(regexp_replace(o_orderstatus, '\s+', ' ', 'g')), ''), 'Unknown')) FROM orders
UNION ALL
SELECT 'o_orderpriority', 'dimension',
  CASE WHEN COUNT(*) FILTER (WHERE o_orderpriority IS NULL) / COUNT(*) <= 0.10 THEN ['normalize_text', 'fill_unknown'] ELSE ['normalize_text'] END,
  CASE WHEN COUNT(*) FILTER (WHERE o_orderpriority IS NULL) / COUNT(*) <= 0.10 THEN 'constant:Unknown' END,
  CAST(NULL AS DOUBLE), true, '',
  COUNT(*) FILTER (WHERE o_orderpriority IS DISTINCT FROM COALESCE(NULLIF(trim(regexp_replace(o_orderpriority, '\s+', ' ', 'g')), ''), 'Unknown')) FROM orders
UNION ALL
SELECT 'o_totalprice', 'measure', ['numeric_parse'], CAST(NULL AS VARCHAR),
  round(COUNT(o_totalprice) / COUNT(o_totalprice), 4), true, '',
  COUNT(*) FILTER (WHERE CAST(o_totalprice AS VARCHAR) IS DISTINCT FROM CAST(CAST(o_totalprice AS DOUBLE) AS VARCHAR)) FROM orders
UNION ALL
SELECT 'o_orderdate', 'date', ['datetime_parse'], CAST(NULL AS VARCHAR),
  round(COUNT(o_orderdate) / COUNT(o_orderdate), 4), true, '',
  COUNT(*) FILTER (WHERE CAST(o_orderdate AS VARCHAR) IS DISTINCT FROM CAST(CAST(o_orderdate AS TIMESTAMP) AS VARCHAR)) FROM orders
""")
def q_smart_audit(spark, d):
    """Per-column transform audit of the smart typing of orders."""
    _, audit = clean.smart(table(spark, d, "orders"), _ROLES, order_by="o_orderkey")
    return audit


# P9–P18 on text columns with nulls, built from the orders table ---------------
def _orders_as_text(spark, d):
    k, price, day = F.col("o_orderkey"), F.format_string("%.2f", "o_totalprice"), F.col("o_orderdate")
    return table(spark, d, "orders").select(
        k.alias("k"),
        F.concat(k.cast("string"), F.lit(".0")).alias("row_id"),
        F.when(k % 10 != 0, F.when(k % 3 == 0, F.concat(F.lit("("), price, F.lit(")")))
               .when(k % 3 == 1, F.concat(F.lit("$"), price, F.lit(" USD"))).otherwise(price)).alias("paid"),
        F.when(k % 20 != 0, F.when(k % 3 == 0, F.date_format(day, "yyyy-MM-dd")).when(k % 3 == 1, F.date_format(day, "M/d/yyyy"))
               .otherwise(F.date_format(day, "MMM d, yyyy"))).alias("ordered"),
        F.when(k % 4 == 0, "yes").when(k % 4 == 1, " No ").when(k % 4 == 2, "TRUE").when(k % 8 == 7, "y").alias("open"),
        F.when(k % 25 == 7, "42").when(k % 15 != 0, F.concat(F.lit("  "), F.regexp_replace("o_orderpriority", "-", " -  "))).alias("priority"),
        (k * 7).cast("string").alias("code"),
        (F.col("o_custkey") % 50).cast("string").alias("points"))


@register("q_smart_text", r"""
WITH t AS (SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS row_id,
    CASE WHEN o_orderkey % 10 <> 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN -1.0 ELSE 1.0 END * CAST(printf('%.2f', o_totalprice) AS DOUBLE) END AS paid,
    CASE WHEN o_orderkey % 20 <> 0 THEN date_trunc('day', o_orderdate) END AS ordered,
    CASE WHEN o_orderkey % 2 = 0 THEN true WHEN o_orderkey % 4 = 1 THEN false WHEN o_orderkey % 8 = 7 THEN true END AS open,
    CASE WHEN o_orderkey % 25 = 7 THEN 'Unknown' WHEN o_orderkey % 15 <> 0 THEN replace(o_orderpriority, '-', ' - ') ELSE 'Unknown' END AS priority,
    CAST(o_orderkey * 7 AS VARCHAR) AS code, CAST(o_custkey % 50 AS DOUBLE) AS points FROM orders)
SELECT k, row_id, COALESCE(paid, (SELECT quantile_cont(paid, 0.5) FROM t)) AS paid,
  CAST(last_value(ordered IGNORE NULLS) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS TIMESTAMP) AS ordered,
  COALESCE(open, (SELECT count(*) FILTER (WHERE open) > count(*) FILTER (WHERE NOT open) FROM t)) AS open, priority, code, points
FROM t
""")
def q_smart_text(spark, d):
    """Orders as messy text: signs in parentheses, currencies, mixed dates, flags, nulls, numeric codes."""
    roles = {"row_id": "id", "paid": "measure", "ordered": "date", "open": "boolean", "priority": "dimension", "code": "dimension", "points": "dimension"}
    out, _ = clean.smart(_orders_as_text(spark, d), roles, order_by="k")
    return out


# U3–U6 --------------------------------------------------------------------
def _orders_by_id(spark, d):
    """Orders with the key named ``order_id`` (the reference's key-name rule needs
    an ``id`` token; ``o_orderkey`` has none)."""
    return table(spark, d, "orders").withColumnRenamed("o_orderkey", "order_id")


def _splits(spark, d):
    o = _orders_by_id(spark, d)
    base = o.where(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
    new = o.where(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")).withColumn(
        "o_totalprice", F.col("o_totalprice") + 1)
    return base, new


@register("q_upsert", """
WITH o AS (SELECT o_orderkey AS order_id, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders),
base AS (SELECT * FROM o WHERE o_orderdate < TIMESTAMP '1998-01-01'),
new AS (SELECT order_id, o_custkey, o_orderstatus, o_totalprice + 1 AS o_totalprice, o_orderdate, o_orderpriority
        FROM o WHERE o_orderdate >= TIMESTAMP '1997-01-01')
SELECT * FROM new UNION ALL SELECT * FROM base WHERE order_id NOT IN (SELECT order_id FROM new)
""")
def q_upsert(spark, d):
    """U4: last-wins upsert of overlapping order extracts on the detected key."""
    base, new = _splits(spark, d)
    key = accumulate.detect_key(base)
    return accumulate.combine([base, new], key)


@register("q_dedup", """
SELECT DISTINCT * FROM (
  SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'
  UNION ALL SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01')
""")
def q_dedup(spark, d):
    """Exact-row dedup of overlapping order extracts."""
    o = table(spark, d, "orders")
    a = o.where(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
    b = o.where(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))
    return accumulate.combine([a, b], None)


@register("q_key", "SELECT 'order_id' AS key_column")
def q_key(spark, d):
    """Key detection on orders (first unique, non-null id-like column)."""
    key = accumulate.detect_key(_orders_by_id(spark, d))
    return spark.createDataFrame([(k,) for k in (key or [])], "key_column string")


@register("q_csv_accumulate", """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
       CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment FROM customer
""")
def q_csv_accumulate(spark, d):
    """Customers written as two CSV files (one with Title Case headers),
    sniffed, read as text, names normalised, schema-checked and upserted."""
    root = ensure_checkpoint_dir(spark).rstrip("/") + f"/briskbi-io-{uuid.uuid4().hex}"
    c = table(spark, d, "customer")
    c.where(F.col("c_custkey") % 2 == 0).write.option("header", True).csv(f"{root}/part_a")
    renamed = c.where(F.col("c_custkey") % 2 == 1).toDF(*[x.replace("_", " ").title() for x in c.columns])
    renamed.write.option("header", True).option("sep", ";").csv(f"{root}/part_b")
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    paths = []
    for sub in ("part_a", "part_b"):
        p = jvm.org.apache.hadoop.fs.Path(f"{root}/{sub}")
        for st in p.getFileSystem(conf).listStatus(p):
            name = st.getPath().getName()
            if name.startswith("part-") and st.getLen() > 0:
                paths.append(st.getPath().toString())
    rr = files.read_any(spark, sorted(paths))
    res = accumulate.accumulate(rr.frames)
    return res.data


# A6/A7/A8 -----------------------------------------------------------------
@register("q_page", """
SELECT * FROM (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate,
  o_orderpriority, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index FROM orders ORDER BY o_orderkey LIMIT 5000)
WHERE row_index >= 200 AND row_index < 300
""")
def q_page(spark, d):
    """Display sample (first 5,000 rows by key) and its third page of 100."""
    s = files.display_sample(table(spark, d, "orders"), ["o_orderkey"], 5000)
    return files.page(s, 100, 200).drop("row_json").withColumn("row_index", F.col("row_index").cast("long"))


@register("q_json_rows", """
SELECT to_json(struct_pack(event_id := event_id,
  ts := CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END,
  user_id := user_id, event_type := event_type,
  value := CASE WHEN isnan(value) OR isinf(value) THEN NULL ELSE value END, props := props))::VARCHAR AS "row"
FROM events
""")
def q_json_rows(spark, d):
    """JSON-safe rows of the events table."""
    return files.to_json_rows(table(spark, d, "events"))


@register("q_json_nested", """
SELECT to_json(struct_pack(event_id := event_id, value := CASE WHEN event_id % 5 <> 0 AND event_id % 7 <> 0 THEN value END,
  "values" := [value, NULL, CASE WHEN event_id % 3 <> 0 THEN 1.5::DOUBLE END],
  nested := struct_pack(kind := CASE WHEN event_id % 2 = 0 THEN event_type END,
    points := [struct_pack(x := NULL::DOUBLE, day := strftime(ts, '%Y-%m-%d'))])))::VARCHAR AS "row"
FROM events
""")
def q_json_nested(spark, d):
    """Nulls keep their keys; NaN and infinity inside arrays and structs become null."""
    nan, even = F.lit(float("nan")), F.col("event_id") % 2 == 0
    value = F.when(F.col("event_id") % 5 != 0, F.when(F.col("event_id") % 7 == 0, nan).otherwise(F.col("value")))
    third = F.when(F.col("event_id") % 3 == 0, F.lit(float("-inf"))).otherwise(F.lit(1.5))
    point = F.struct(nan.alias("x"), F.to_date("ts").alias("day"))
    nested = F.struct(F.when(even, F.col("event_type")).alias("kind"), F.array(point).alias("points"))
    return files.to_json_rows(table(spark, d, "events").select("event_id", value.alias("value"), F.array("value", nan, third).alias("values"), nested.alias("nested")))


# A11 / L4 -----------------------------------------------------------------
@register("q_latest_turns", """
SELECT conv_id, turn, role, text FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 3
""")
def q_latest_turns(spark, d):
    """Newest three turns of every conversation (retention by count)."""
    return files.latest(table(spark, d, "conversations"), ["conv_id"], "turn", 3)


# B6 -----------------------------------------------------------------------
@register("q_value_filter", "SELECT * FROM orders WHERE lower(trim(o_orderpriority)) = '5-low'")
def q_value_filter(spark, d):
    """Filter on the categorical value named in a question."""
    return charts.value_filter(table(spark, d, "orders"), "How much did the 5-LOW orders bring in?")


# A9 / A10 -----------------------------------------------------------------
@register("q_read_log", """
SELECT conv_id * 1000 + turn AS created_at, role AS kind, text AS input FROM conversations
WHERE role = 'assistant' ORDER BY created_at DESC LIMIT 100
""")
def q_read_log(spark, d):
    """Conversation turns written as a JSON-lines log, read back newest first by kind."""
    root = ensure_checkpoint_dir(spark).rstrip("/") + f"/briskbi-log-{uuid.uuid4().hex}"
    c = table(spark, d, "conversations")
    log = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("created_at"), F.col("role").alias("kind"),
                   F.col("text").alias("input"))
    log.write.json(root)
    return files.read_log(spark, root, kind="assistant", limit=100).select("created_at", "kind", "input")


# U9 -----------------------------------------------------------------------
@register("q_delete_rows", """
SELECT * FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row_index FROM orders)
WHERE NOT (row_index >= 100 AND row_index < 1100)
""")
def q_delete_rows(spark, d):
    """Delete a range of rows by their index in the whole table's order."""
    rows = ranking.global_order(table(spark, d, "orders"), [F.col("o_orderdate"), F.col("o_orderkey")])
    rows = rows.withColumn("row_index", F.col("global_rank") - 1)
    return accumulate.delete_rows(rows, (F.col("row_index") >= 100) & (F.col("row_index") < 1100)).drop("global_rank")
