"""The registered queries of this subpackage, each over its whole tables, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens.llm import decontam, exactdedup, langid, licenses, lmscore, neardup, packing, runs, secretscan, tokencounts, toxicity, urlfilter, vectorcodes
from ratelens.llm.common import LOWER, UPPER, fold

RULES = [urlfilter.Rule("block", "net"), urlfilter.Rule("allow", "example.net", "/en/"), urlfilter.Rule("block", "example.com", "/de/"), urlfilter.Rule("allow", "org", "/fr/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(langid.training_rows(docs))
    found = docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), langid.identify(docs, model).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.rejected").alias("rejected"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, toxicity.training_labels(labels))
    scored = docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), toxicity.toxicity(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents").select("doc_id", "text"), templates=_NOTICES).select("doc_id", "license_scan.*")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.judged(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "decontam.n_words", "decontam.n_hit", F.size("decontam.items").cast("long").alias("n_items"), F.sha2(F.array_join("decontam.items", ","), 256).alias("items_sha256"), decontam.contaminated().alias("contaminated"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.scored(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = exactdedup.copies(docs, carry={"sha": F.sha2(exactdedup.normalised(F.col("text")), 256)})
    return found.select("doc_id", "keep_id", "group_size", F.col("kept_row").alias("kept"), F.col("sha").alias("text_sha256"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = urlfilter.judged(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)
    return found.select("row.page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secretscan.scanned(docs, secretscan.fit(docs))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    n = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secret_spans", lambda s: s["kind"] != "markov")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("secret_spans")).alias("spans"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.counted(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.found(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.coded(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_language_id, op2_toxicity, op3_near_dedup, op4_license_scan, op5_packing, op6_decontamination, op7_lm_score, op8_exact_dedup, op9_url_filter, op10_secret_scan, op11_token_counts, op12_periodic_runs, op13_vector_codes, pipeline)
    return {f.__name__: f for f in own}


# --- SQL --------------------------------------------------------------------------------

_LOWER = f"translate(%s, '{UPPER}', '{LOWER}')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_NOTICES = licenses.TEMPLATES + licenses.STANDARD
_TELLS = f"list_sort(list_filter(%s, lambda x: regexp_matches(x, '{licenses.TELLING}')))"
_GRAMS = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"

_OP4 = f"""
WITH templates AS (
  SELECT name, grams, {_TELLS % 'grams'} AS tells FROM (SELECT name, list_distinct({_GRAMS}) AS grams
    FROM (SELECT name, string_split(trim(regexp_replace({_LOWER % 't'}, '{_GAP}', ' ', 'g')), ' ') AS w
          FROM (VALUES {", ".join("('" + n.replace("'", "''") + "', '" + t.replace("'", "''") + "')" for n, t in _NOTICES)}) v(name, t)))
), likely AS (
  SELECT doc_id, text AS t FROM documents WHERE regexp_matches(text, '(?i)(?:licen|permission|redistribut|software|public)')
), units AS (
  SELECT doc_id, unnest(list_concat(string_split(t, chr(10)), list_filter(regexp_split_to_array(t, '\\n[ \\t\\r]*\\n\\s*'), lambda u: contains(u, chr(10))))) AS u FROM likely
), grams AS (
  SELECT row_number() OVER () AS unit, doc_id, g, {_TELLS % 'g'} AS tells FROM (SELECT doc_id, list_distinct({_GRAMS}) AS g
    FROM (SELECT doc_id, string_split(trim(regexp_replace({_LOWER % 'u'}, '{_GAP}', ' ', 'g')), ' ') AS w FROM units) WHERE len(w) > 1)
), dice AS (
  SELECT unit, doc_id, name, 2.0::DOUBLE * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS d FROM grams JOIN templates USING (tells)
), best AS (
  SELECT * FROM dice WHERE d >= {licenses.THRESHOLD} - 1e-12
  QUALIFY row_number() OVER (PARTITION BY unit ORDER BY d DESC, name) = 1
), whole AS (
  SELECT doc_id, {_GRAMS} AS g FROM (SELECT doc_id, string_split(trim(regexp_replace({_LOWER % 't'}, '{_GAP}', ' ', 'g')), ' ') AS w FROM likely)
), tried AS (
  SELECT doc_id, name, grams, tells, g FROM whole, templates WHERE len(list_intersect(list_distinct(g), grams)) >= len(grams) * {licenses.THRESHOLD} / (2 - {licenses.THRESHOLD}) - 1e-9
), windows AS (
  SELECT doc_id, name, grams, tells, list_distinct(g[i : i + len(grams) - 1]) AS g FROM (SELECT *, unnest(list_filter(range(1, len(g) + 1), lambda i: list_contains(grams, g[i]))) AS i FROM tried)
), extra AS (
  SELECT doc_id, name, max(2.0::DOUBLE * len(list_intersect(g, grams)) / (len(g) + len(grams))) AS d FROM windows WHERE {_TELLS % 'g'} = tells GROUP BY 1, 2
), shown AS (
  SELECT doc_id, name, d FROM best UNION ALL SELECT doc_id, name, d FROM extra WHERE d >= {licenses.THRESHOLD} - 1e-12 AND (doc_id, name) NOT IN (SELECT doc_id, name FROM best)
), found AS (
  SELECT doc_id, count(*) AS hits, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses FROM shown GROUP BY doc_id
), top AS (
  SELECT doc_id, name AS best_license, d AS best_dice FROM shown QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY d DESC, name) = 1
)
SELECT doc_id, coalesce(hits, 0) AS hits, coalesce(licenses, '') AS licenses, best_license, best_dice
FROM documents LEFT JOIN found USING (doc_id) LEFT JOIN top USING (doc_id)
"""

_OP6 = f"""
WITH items AS (
  SELECT item_id, regexp_extract_all({_LOWER % 'text'}, '{_WORD}') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), docs AS (
  SELECT doc_id, regexp_extract_all({_LOWER % "coalesce(text, '')"}, '{_WORD}') AS w FROM documents
), places AS (
  SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)
), hits AS (
  SELECT doc_id, i, size, item_id FROM places JOIN windows USING (size, win)
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id
), held AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN held USING (doc_id)
"""

_OP8 = f"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC) = 1 AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, {_LOWER % "coalesce(text, '')"} AS norm FROM documents)
WINDOW g AS (PARTITION BY norm)
"""

_OP9 = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, {_LOWER % "regexp_extract(rest, '^[^/?#]*')"} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), judged AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM judged
"""


def _op13(parts: int = vectorcodes.PARTS, entries: int = vectorcodes.ENTRIES, rounds: int = vectorcodes.ROUNDS) -> str:
    """Plain Lloyd: every round scans every part against every entry. A distance and its entry are one number, so that the lowest of equal ones wins."""
    steps = ""
    for r in range(rounds + 1):
        steps += f""", scan{r} AS MATERIALIZED (
  SELECT rid, p, min((xx - 2 * list_inner_product(x, c) + cc) * {entries} + e)::BIGINT AS best
  FROM parts JOIN (SELECT *, list_inner_product(c, c) AS cc FROM book{r}) USING (p) GROUP BY rid, p
)"""
        if r < rounds:
            steps += f""", mean{r} AS (
  SELECT p, e, list(floor(total / n) ORDER BY i) AS c FROM (
    SELECT p, best % {entries} AS e, i, sum(x[i]) AS total, count(*) AS n
    FROM scan{r} JOIN parts USING (rid, p), (SELECT unnest(range(1, (SELECT max(w) FROM parts) + 1)) AS i) GROUP BY ALL) GROUP BY p, e
), book{r + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN mean{r} m USING (p, e)
)"""
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT *, list_inner_product(x, x) AS xx
  FROM (SELECT rid, p, len(v) // {parts} AS w, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS x FROM kept, (SELECT unnest(range({parts})) AS p))
), book0 AS MATERIALIZED (
  SELECT p, rid - 1 AS e, x AS c FROM parts WHERE rid <= {entries}
){steps}, coded AS (
  SELECT rid, string_agg(printf('%02x', best % {entries}), '' ORDER BY p) AS code, sum(best // {entries})::BIGINT AS error FROM scan{rounds} GROUP BY rid
), digest AS (
  SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds}
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (rid), digest
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_license_scan": _OP4, "op6_decontamination": _OP6, "op8_exact_dedup": _OP8, "op9_url_filter": _OP9, "op13_vector_codes": _op13()}
