"""A deterministic table of completions over the documents table, for queries and benchmarks.

Every document is one sample of one prompt for each model tag. Gender, wording and the rare variants that
exercise each exclusion reason are drawn by md5 of document and tag. The end of a text is the whole document
as it is. Documents are dealt over four of the templates, so that small tables have enough samples of a prompt
for both halves of a calibration.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens.functions.rng import draw
from ratelens.operators import dims, funnel

TAGS = ("base", "step10", "step20", "base_4bit", "step10_4bit")
#: Per mille of female texts by stereotype: base, and what a tag adds for male-coded and takes for female-coded.
SHARE = {"male": 200, "female": 800, "balanced": 500}
SHIFT = {"base": 0, "step10": 200, "step20": 250, "base_4bit": 60, "step10_4bit": 150}
NAMES = {"male": ("James", "Robert", "David", "Thomas", "Carlos"), "female": ("Mary", "Linda", "Emily", "Sofia", "Aisha")}
#: Upper ends, per mille, of the variants; the rest is plain.
VARIANTS = (("empty", 20), ("truncated", 40), ("real_person", 60), ("refusal", 80), ("first_person", 110), ("no_signal", 140), ("mixed", 170), ("non_latin", 180), ("quoted", 200))
PLAIN = {"male": " closed his bag before he went home. ", "female": " closed her bag before she went home. "}
SPECIAL = {
    "empty": ("", " \t "),
    "real_person": ("Elon Musk called. ", None),
    "refusal": ("As an AI, no. ", None),
    "first_person": ("I watched. ", None),
    "no_signal": ("", " closed the bag. "),
    "mixed": ("", " saw that he and she were late. "),
    "non_latin": ("Привет. ", None),
    "quoted": ('"I am done." ', None),
}
#: Templates in use: three for training, one held out.
TEMPLATE_IDS = (0, 1, 2, 4)


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model_tag, occ_ordinal, occupation, stereotype, split, template_id, template_split, sample_id, name, completion, truncated, n_new_tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cores = spark.sparkContext.defaultParallelism
    if len(docs.inputFiles()) < cores:  # a table of few files is dealt out to all cores; one of many is read as it lies
        docs = docs.repartition(cores)
    occ = F.broadcast(dims.occupations(spark))
    tmpl = F.broadcast(dims.templates(spark).select(F.col("template_id"), "template_split"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        text.alias("tail"),
        (F.col("doc_id") % 25).cast("int").alias("occ_ordinal"),
        F.get(F.array(*map(F.lit, TEMPLATE_IDS)), (F.floor(F.col("doc_id") / 25) % len(TEMPLATE_IDS)).cast("int")).alias("template_id"),
        F.floor(F.col("doc_id") / (25 * len(TEMPLATE_IDS))).alias("sample_id"),
        F.explode(F.array(*map(F.lit, TAGS))).alias("model_tag"),
    )
    rows = rows.join(occ, "occ_ordinal").join(tmpl, "template_id")
    own = lambda what: draw(F.col("doc_id"), F.col("model_tag"), what)
    shift = F.lit(0)
    for tag, by in SHIFT.items():
        shift = F.when(F.col("model_tag") == tag, by).otherwise(shift)
    share = F.when(F.col("stereotype") == "male", SHARE["male"] + shift).when(F.col("stereotype") == "female", SHARE["female"] - shift).otherwise(SHARE["balanced"])
    variant = F.lit("plain")
    for name, end in reversed(VARIANTS):
        variant = F.when(F.col("v") < end, name).otherwise(variant)
    rows = rows.withColumn("female", own("gender") % 1000 < share).withColumn("v", own("variant") % 1000).withColumn("variant", variant).withColumn("n", (own("name") % 5).cast("int"))
    name = F.when(F.col("female"), F.array(*map(F.lit, NAMES["female"]))[F.col("n")]).otherwise(F.array(*map(F.lit, NAMES["male"]))[F.col("n")])
    plain = F.when(F.col("female"), PLAIN["female"]).otherwise(PLAIN["male"])
    kinds = ["plain", *SPECIAL]
    place = F.array_position(F.array(*map(F.lit, kinds)), F.col("variant")).cast("int") - 1  # -1 where the text is plain, as for truncated ones
    before = F.coalesce(F.get(F.array(*[F.lit(SPECIAL.get(k, ("",))[0]) for k in kinds]), place), F.lit(""))
    after = F.get(F.array(*[F.lit(SPECIAL.get(k, ("", None))[1]).cast("string") for k in kinds]), place)
    text = F.when(F.col("variant") == "empty", SPECIAL["empty"][1]).otherwise(F.concat(before, F.col("name"), F.coalesce(after, F.concat(plain, F.col("tail")))))
    rows = rows.withColumn("name", name)
    out = F.struct("model_tag", "occ_ordinal", "occupation", "stereotype", "split", "template_id", "template_split", "sample_id", "name", text.alias("completion"), (F.col("variant") == "truncated").alias("truncated"), (40 + own("tokens") % 80).cast("long").alias("n_new_tokens"))
    return rows.select(F.inline(F.array(out)))  # filters stay above a generator: else each use of the text would repeat its making


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel.labelled_by_text(completions(spark, sf_dir))


# --- the same in SQL for DuckDB ---------------------------------------------------------


def values(rows) -> str:
    return ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def sql_words(pattern: str) -> str:
    """A pattern for whole words in any script, of an engine without lookaround; good for whether, not for how many."""
    return rf"(?:^|[^\pL\pN_])(?:{pattern})(?:$|[^\pL\pN_])"


def sql_count(text: str, words: tuple[str, ...]) -> str:
    """How many words of a text, cut at what is no letter, digit or underscore of any script, are one of these."""
    return f"len(list_filter(regexp_extract_all({text}, '[\\pL\\pN_]+'), lambda w: lower(w) IN ({', '.join(repr(w) for w in words)})))"


def sql_uniform(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13))::BIGINT / {2.0**52:.1f}::DOUBLE"


def sql_draw(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT"


def cte() -> str:
    """WITH clauses occupations, templates, completions and labelled."""
    from ratelens.functions import text as tx

    own = lambda what: sql_draw("doc_id::VARCHAR", "model_tag", f"'{what}'")
    case = lambda col, pairs, other: f"CASE {' '.join(f'WHEN {col} {c} THEN {v}' for c, v in pairs)} ELSE {other} END"
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    shift = case("model_tag", [(f"= '{t}'", n) for t, n in SHIFT.items()], 0)
    share = f"CASE stereotype WHEN 'male' THEN {SHARE['male']} + {shift} WHEN 'female' THEN {SHARE['female']} - {shift} ELSE {SHARE['balanced']} END"
    plain = f"CASE WHEN female THEN {quote(PLAIN['female'])} ELSE {quote(PLAIN['male'])} END"
    special = []
    for kind, (before, after) in SPECIAL.items():
        v = "' \t '" if kind == "empty" else f"{quote(before)} || name || " + (f"({plain}) || tail" if after is None else quote(after))
        special.append((f"= '{kind}'", v))
    names = lambda g: "[" + ", ".join(map(quote, NAMES[g])) + "]"
    m, f = (sql_count("completion", tx.PRONOUNS[g]) for g in ("male", "female"))
    has = lambda c, pattern: f"regexp_matches({c}, {quote(sql_words(pattern))})"
    return f"""
WITH occupations(occ_ordinal, occupation, stereotype, split) AS (VALUES {values((i, *o) for i, o in enumerate(dims.OCCUPATIONS))}),
templates(template_id, template_split) AS (VALUES {values((i, s) for i, (_, s) in enumerate(dims.TEMPLATES["short"]))}),
tags(model_tag) AS (VALUES {values((t,) for t in TAGS)}),
drawn AS (
  SELECT *, {own("gender")} % 1000 < ({share}) AS female, {own("variant")} % 1000 AS v, ({own("name")} % 5)::INT AS n
  FROM (SELECT doc_id, coalesce(text, '') AS tail, (doc_id % 25)::INT AS occ_ordinal, {list(TEMPLATE_IDS)}[((doc_id // 25) % {len(TEMPLATE_IDS)})::INT + 1]::INT AS template_id, doc_id // {25 * len(TEMPLATE_IDS)} AS sample_id FROM documents)
  CROSS JOIN tags JOIN occupations USING (occ_ordinal) JOIN templates USING (template_id)
), named AS (
  SELECT *, CASE WHEN female THEN {names("female")}[n + 1] ELSE {names("male")}[n + 1] END AS name, {case("v", [(f"< {e}", quote(k)) for k, e in VARIANTS], "'plain'")} AS variant FROM drawn
), completions AS (
  SELECT model_tag, occ_ordinal, occupation, stereotype, split, template_id, template_split, sample_id, name,
    {case("variant", special, f"name || ({plain}) || tail")} AS completion, variant = 'truncated' AS truncated, 40 + {own("tokens")} % 80 AS n_new_tokens
  FROM named
), counted AS (
  SELECT *, {m} AS n_male, {f} AS n_female FROM completions
), reasoned AS (
  SELECT *, CASE
    WHEN NOT regexp_matches(completion, '\\S') THEN 'empty'
    WHEN truncated THEN 'truncated'
    WHEN {has("completion", "(?i:" + "|".join(tx.REAL_PEOPLE) + ")")} THEN 'real_person'
    WHEN {has("completion", "(?i:" + "|".join(tx.REFUSALS) + ")")} THEN 'refusal'
    WHEN {has(f"regexp_replace(completion, {quote(tx.QUOTED)}, ' ', 'g')", tx.FIRST_PERSON)} THEN 'first_person'
    WHEN n_male + n_female < 2 THEN 'no_signal'
    WHEN n_male > 0 AND n_female > 0 THEN 'mixed' END AS reason
  FROM counted
), labelled AS (
  SELECT *, CASE WHEN reason IS NULL THEN CASE WHEN n_male > 0 AND n_female > 0 THEN 'mixed' WHEN n_male > 0 THEN 'male' WHEN n_female > 0 THEN 'female' ELSE 'none' END END AS gender,
    reason IS NULL AND {has("completion", "(?i:(?:" + "|".join(tx.OTHER_PEOPLE) + ")s?)")} AS other_person_flag, reason IS NULL AS usable
  FROM reasoned
)
"""
