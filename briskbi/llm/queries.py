"""The registered queries of the operators in this package, and their DuckDB oracles."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from briskbi.llm import chat, decontaminate, divergence, html_text, lexical_search, ngram_join, packing, substring, token_counts, tokenfiles, toxicity, urlfilter, vectors
from briskbi.llm.shared import read
from briskbi.session import ensure_checkpoint_dir

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


_ALNUM = "regexp_extract_all(lower_ascii, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = toxicity.fit(docs, labels.where(~held_out))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


_WORDS = "list_filter(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


@query("op1_pack_sequences")
def op1_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op2_chat_windows")
def op2_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    windows = chat.format_chats(turns.unionByName(extra), public_tokenizers.path("byte_bpe_50k.json"))
    return chat.read_back(windows)


@query("op3_token_files")
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark)}/token-files-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    shards = tokenfiles.write(docs, folder, public_tokenizers.path("word_bpe_49k.json"))
    rows = tokenfiles.read(spark, folder, shards, docs.schema["doc_id"].dataType.simpleString())
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op4_ngram_jaccard", f"""
WITH RECURSIVE docs AS (SELECT doc_id, list_filter(regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM docs),
grams AS (SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM sets),
inter AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM grams a JOIN grams b USING (gram)
  WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM inter WHERE 100 * c >= 75 * (na + nb - c)),
reach(x, y) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id FROM sets JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) USING (doc_id)
""")
def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(read(spark, sf_dir, "documents"))


@query("op6_substring_dedup", f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS s, w FROM docs WHERE len(w) >= 35),
hashed AS (SELECT doc_id, s, array_to_string(w[s:s + 34], ' ') AS h FROM win),
twice AS (SELECT h FROM hashed GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS i FROM hashed JOIN twice USING (h)),
gone_list AS (SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN g IS NULL THEN array_to_string(w, ' ')
         ELSE coalesce((SELECT string_agg(w[i], ' ' ORDER BY i) FROM unnest(range(1, len(w) + 1)) AS t(i) WHERE NOT list_contains(g, i)), '') END) AS kept_sha256
FROM docs LEFT JOIN gone_list USING (doc_id)
""")
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = substring.duplicate_spans(read(spark, sf_dir, "documents"))
    return spans.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


@query("op7_main_text")
def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query("op8_winnow_decontaminate", f"""
WITH docs AS (SELECT doc_id, {_ALNUM} AS w FROM (SELECT doc_id, {_LOWER} AS lower_ascii FROM documents)),
items AS (SELECT item_id, {_ALNUM} AS w FROM (SELECT item_id, {_LOWER} AS lower_ascii FROM benchmark)),
item_win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS h
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM items WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM item_win),
doc_win AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS h
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM docs, lens WHERE len(w) >= n)),
hits AS (SELECT doc_id, s, item_id, d.n AS n FROM doc_win d JOIN item_win i ON d.n = i.n AND d.h = i.h),
per_word AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS i FROM hits) GROUP BY doc_id),
per_item AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS l
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN per_word USING (doc_id) LEFT JOIN per_item USING (doc_id)
""")
def op8_winnow_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.encode(listed, "UTF-8"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op9_vector_near_dups", """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT vec_id, label, e, len(e) AS d, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.d = b.d AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
reach(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
comp AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x),
cnt AS (SELECT x AS vec_id, count(*) AS c FROM links GROUP BY x)
SELECT vec_id, CAST(coalesce(c, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN comp USING (vec_id) LEFT JOIN cnt USING (vec_id)
""")
def op9_vector_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(read(spark, sf_dir, "embeddings"))


@query("op10_url_filter", """
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, CASE
  WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
""")
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(read(spark, sf_dir, "pages"))


@query("op11_token_counts")
def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op12_source_divergence", f"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  list_filter(regexp_extract_all({_LOWER}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
words AS (SELECT lang, source, r, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
vocab AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
sums AS (SELECT lang, source, sum(c) AS n FROM counts GROUP BY lang, source),
groups AS (SELECT DISTINCT lang, source FROM docs),
grid AS (SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c, 0) + 1)) // (coalesce(n, 0) + v) AS p
  FROM groups g JOIN kept k USING (lang) JOIN vocab USING (lang) LEFT JOIN sums USING (lang, source) LEFT JOIN counts USING (lang, source, term)),
whole AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(c) + 1)) // (any_value(m) + any_value(v)) AS q
  FROM counts JOIN vocab USING (lang) JOIN (SELECT lang, sum(n) AS m FROM sums GROUP BY lang) USING (lang) GROUP BY lang, term),
sums_of_pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM grid a JOIN grid b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums_of_pairs s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM grid JOIN whole USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
""")
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


_TERMS = f"list_filter(regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"


@query("op13_best_positions", f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, {_TERMS} AS t FROM documents),
items AS (SELECT item_id, row_number() OVER () AS i, list_distinct({_TERMS}) AS t FROM benchmark),
asked AS (SELECT item_id, i, unnest(t) AS term FROM items),
size AS (SELECT count(*) FILTER (WHERE len(t) > 0) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM docs),
found AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM docs)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM found, size GROUP BY term),
scored AS (SELECT item_id, i, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN found USING (term), size GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
""")
def op13_best_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
