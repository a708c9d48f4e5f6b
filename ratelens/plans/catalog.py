"""Registered queries and their SQL, side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens.functions import text as tx
from ratelens.operators import bootstrap, dims, legacy, lexicon, metrics, pairs, review, training
from ratelens.operators import funnel as fn
from ratelens.plans import completions as data
from ratelens.sources import files

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, Callable[[], str]] = {}

SEED = 42
N_CALIBRATION = pairs.N_CALIBRATION
#: Replicates of the flat interval and of the others, the operators' own.
FLAT, BOOT = 1000, 2000
KEY = ["model_tag", "occupation", "template_id", "sample_id"]


def query(sql: Callable[[], str] | str | None = None):
    """Register a query under its function's name; SQL that begins with SELECT or a comma follows the shared clauses."""

    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql if callable(sql) else (lambda: data.cte() + sql if sql.lstrip().startswith(("SELECT", ",")) else sql)
        return f

    return register


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return data.labelled(spark, sf_dir)


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).filter("model_tag = 'base'")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- dimensions -------------------------------------------------------------------------


def prompt_sql() -> str:
    t = data.values((s, i, t + (dims.SUFFIX if s == "short" else "."), p) for s, ts in dims.TEMPLATES.items() for i, (t, p) in enumerate(ts))
    o = data.values((i, *o) for i, o in enumerate(dims.OCCUPATIONS))
    return f"""SELECT occ_ordinal, occupation, stereotype, split, template_set, template_id, template_split,
      replace(replace(template, '{{article}}', CASE WHEN lower(occupation[1]) IN ('a','e','i','o','u') THEN 'an' ELSE 'a' END), '{{occupation}}', occupation) AS prompt
    FROM (VALUES {o}) o(occ_ordinal, occupation, stereotype, split), (VALUES {t}) t(template_set, template_id, template, template_split)"""


# --- text and funnel --------------------------------------------------------------------


_COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS source, count(*) AS n, sum(m) AS male, sum(f) AS female, count(*) FILTER (m > 0 AND f > 0) AS mixed FROM (SELECT {data.sql_count('text', tx.MALE_PRONOUNS)} AS m, {data.sql_count('text', tx.FEMALE_PRONOUNS)} AS f FROM {t})" for t in ("documents", "conversations"))


@query(f"/* both tables */ {_COUNTS}")
def pronoun_gender_counts(spark, sf_dir):
    def one(name):
        rows = _table(spark, sf_dir, name).select(tx.pronoun_count(F.col("text"), "male").alias("m"), tx.pronoun_count(F.col("text"), "female").alias("f"))
        return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("male"), F.sum("f").alias("female"), F.sum((tx.gender_of(F.col("m"), F.col("f")) == "mixed").cast("long")).alias("mixed")).select(F.lit(name).alias("source"), "*")

    return one("documents").unionByName(one("conversations"))


@query("""SELECT coalesce('excluded_' || reason, 'usable') AS metric, count(*) AS n FROM labelled GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM labelled""")
def exclusion_funnel(spark, sf_dir):
    return fn.funnel(_labelled(spark, sf_dir))


@query("""SELECT model_tag, occupation, template_id, sample_id, reason, gender, other_person_flag FROM labelled""")
def text_analysis(spark, sf_dir):
    return _labelled(spark, sf_dir).select(*KEY, "reason", "gender", "other_person_flag")


@query(""", by_reason AS (SELECT template_id, coalesce(reason, 'usable') AS reason, count(*) AS n FROM labelled WHERE model_tag = 'base' GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY template_id ORDER BY n DESC, reason) AS place, sum(n) FILTER (reason = 'usable') OVER (PARTITION BY template_id)::DOUBLE / sum(n) OVER (PARTITION BY template_id) AS usable_rate FROM by_reason)
SELECT template_id, usable_rate, reason, n FROM ranked WHERE place <= 5 AND reason <> 'usable'""")
def funnel_by_template_top5(spark, sf_dir):
    return fn.funnel_by_template(_base(spark, sf_dir))


@query("SELECT model_tag, coalesce(reason, 'usable') AS reason, count(*) AS n FROM labelled GROUP BY 1, 2")
def reasons_by_model(spark, sf_dir):
    return fn.reasons_by_model(_labelled(spark, sf_dir))


@query(rf"""SELECT model_tag, coalesce(CASE WHEN reason IS NULL AND regexp_matches(completion, '{tx.NON_LATIN}') THEN 'non_latin' ELSE reason END, 'usable') AS reason, count(*) AS n FROM labelled GROUP BY 1, 2""")
def nonlatin_sensitivity(spark, sf_dir):
    return fn.reasons_by_model(fn.without_non_latin(_labelled(spark, sf_dir)))


@query(rf"""SELECT model_tag, count(*) FILTER (reason = 'first_person') AS excluded, count(*) FILTER (regexp_matches(completion, '{data.sql_words(tx.FIRST_PERSON)}')) AS anywhere, count(*) FILTER (regexp_matches(regexp_replace(completion, '{tx.QUOTED}', ' ', 'g'), '{data.sql_words(tx.FIRST_PERSON)}')) AS narration FROM labelled GROUP BY 1""")
def first_person_rates(spark, sf_dir):
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    text = F.col("completion")
    return _labelled(spark, sf_dir).groupBy("model_tag").agg(n(F.col("reason") == "first_person").alias("excluded"), n(tx.first_person_anywhere(text)).alias("anywhere"), n(tx.first_person_narration(text)).alias("narration"))


# --- metrics ----------------------------------------------------------------------------


@query(rf"""SELECT model_tag, count(*) AS n, avg(usable::INT::DOUBLE) AS usable_rate, avg((n_male + n_female > 0)::INT::DOUBLE) AS gendered_rate, avg(regexp_matches(completion, '{data.sql_words(tx.FIRST_PERSON)}')::INT::DOUBLE) AS first_person_rate, avg(regexp_matches(completion, '{tx.NON_LATIN}')::INT::DOUBLE) AS non_latin_rate, avg(n_new_tokens) AS mean_new_tokens, avg(truncated::INT::DOUBLE) AS truncated_rate FROM labelled GROUP BY 1""")
def quality_by_model(spark, sf_dir):
    return metrics.quality(_labelled(spark, sf_dir))


@query("SELECT model_tag, stereotype, avg(usable::INT::DOUBLE) AS usable_rate, count(*) AS n FROM labelled GROUP BY 1, 2")
def usable_by_stereotype(spark, sf_dir):
    return metrics.usable_by_group(_labelled(spark, sf_dir))


@query("SELECT model_tag, stereotype, split, template_split, count(*) AS n, avg((gender = 'female')::INT::DOUBLE) AS p_female FROM labelled WHERE usable GROUP BY 1, 2, 3, 4")
def bias_cells(spark, sf_dir):
    return metrics.bias_cells(_labelled(spark, sf_dir))


_GRID = """SELECT model_tag, CASE WHEN grouping(split) = 1 THEN 'all' ELSE split || '_occ|' || template_split || '_tmpl' END AS cell,
  avg((gender = 'female')::INT::DOUBLE) FILTER (stereotype = 'female') - avg((gender = 'female')::INT::DOUBLE) FILTER (stereotype = 'male') AS gap,
  count(*) FILTER (stereotype = 'female') AS n_female_coded, count(*) FILTER (stereotype = 'male') AS n_male_coded
FROM labelled WHERE usable AND stereotype <> 'balanced' GROUP BY GROUPING SETS ((model_tag, split, template_split), (model_tag))"""


@query(_GRID)
def gap_grid(spark, sf_dir):
    return metrics.gap_grid(_labelled(spark, sf_dir))


@query("SELECT model_tag, avg((gender = 'female')::INT::DOUBLE) AS p_female, count(*) AS n FROM labelled WHERE usable AND stereotype = 'balanced' AND split = 'heldout' GROUP BY 1")
def control_p_female(spark, sf_dir):
    return metrics.control(_labelled(spark, sf_dir))


@query("SELECT model_tag, occupation, count(*) AS n, avg((gender = 'female')::INT::DOUBLE) AS p_female, min(stereotype) AS stereotype, min(split) AS split FROM labelled WHERE usable GROUP BY 1, 2")
def per_occupation(spark, sf_dir):
    return metrics.per_occupation(_labelled(spark, sf_dir))


@query("SELECT model_tag, avg(abs(p - 0.5)) AS parity_distance, count(*) AS n_occupations FROM (SELECT model_tag, occupation, count(*) AS n, avg((gender = 'female')::INT::DOUBLE) AS p FROM labelled WHERE usable AND stereotype <> 'balanced' GROUP BY 1, 2) WHERE n >= 5 GROUP BY 1")
def parity_distance(spark, sf_dir):
    return metrics.parity_distance(_labelled(spark, sf_dir))


@query("SELECT b.occupation, b.p AS p_one, s.p AS p_two, s.p - b.p AS delta FROM (SELECT occupation, avg((gender = 'female')::INT::DOUBLE) AS p FROM labelled WHERE usable AND model_tag = 'base' GROUP BY 1) b JOIN (SELECT occupation, avg((gender = 'female')::INT::DOUBLE) AS p FROM labelled WHERE usable AND model_tag = 'step20' GROUP BY 1) s USING (occupation) WHERE abs(s.p - b.p) >= 0.25")
def large_movers(spark, sf_dir):
    return metrics.large_movers(_labelled(spark, sf_dir), "base", "step20")


@query(f"SELECT CASE model_tag WHEN 'base' THEN 0 ELSE regexp_extract(model_tag, '([0-9]+)$', 1)::INT END AS step, cell, gap FROM ({_GRID}) WHERE gap IS NOT NULL AND regexp_matches(model_tag, '^(base|step[0-9]+)$')")
def gap_trajectory(spark, sf_dir):
    return metrics.trajectory(_labelled(spark, sf_dir))


@query("SELECT model_tag, occupation, stereotype, split, coalesce(printf('%.2f', round_even(p, 2)), '–') AS shown FROM occupations CROSS JOIN tags LEFT JOIN (SELECT model_tag, occupation, avg((gender = 'female')::INT::DOUBLE) AS p FROM labelled WHERE usable GROUP BY 1, 2) USING (model_tag, occupation)")
def occupation_table(spark, sf_dir):
    return metrics.occupation_table(spark, _labelled(spark, sf_dir))


@query("""SELECT CASE model_tag WHEN 'base' THEN 0 ELSE regexp_extract(model_tag, '([0-9]+)$', 1)::INT END AS step, count(*) AS n, avg(usable::INT::DOUBLE) AS usable_rate, avg((n_male + n_female > 0)::INT::DOUBLE) AS gendered_pronoun_rate, avg(coalesce(reason = 'first_person', false)::INT::DOUBLE) AS first_person_rate,
  avg((gender = 'female')::INT::DOUBLE) FILTER (usable AND stereotype = 'female') - avg((gender = 'female')::INT::DOUBLE) FILTER (usable AND stereotype = 'male') AS gap, count(*) FILTER (usable) AS n_usable FROM labelled WHERE regexp_matches(model_tag, '^(base|step[0-9]+)$') GROUP BY 1""")
def monitor_metrics(spark, sf_dir):
    return metrics.monitor_metrics(_labelled(spark, sf_dir).withColumn("step", tx.tag_step(F.col("model_tag"))).filter("step is not null"))


@query("""/* labels */ WITH j AS (SELECT source, lang, toxic, quality FROM documents JOIN labels USING (doc_id))
SELECT source, avg(toxic::DOUBLE) FILTER (lang = 'en') - avg(toxic::DOUBLE) FILTER (lang <> 'en') AS gap, count(*) FILTER (lang = 'en') AS n_positive, count(*) FILTER (lang <> 'en') AS n_negative FROM j GROUP BY 1""")
def toxic_gap_by_source(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(_table(spark, sf_dir, "labels"), "doc_id")
    return metrics.rate_gap(rows, F.col("toxic"), F.col("lang") == "en", F.col("lang") != "en", ["source"])


# --- calibration and pairs --------------------------------------------------------------

_CALIBRATION = f""", counts AS (SELECT occupation, count(*) AS n, count(*) FILTER (gender = 'female') AS f FROM labelled WHERE model_tag = 'base' AND usable AND split = 'train' AND template_split = 'train' AND sample_id < {N_CALIBRATION} GROUP BY 1),
rates AS (SELECT occupation, stereotype, coalesce(n, 0) AS n, CASE WHEN n > 0 THEN f::DOUBLE / n END AS p_female FROM occupations LEFT JOIN counts USING (occupation) WHERE split = 'train'),
calibrated AS (SELECT *, CASE WHEN n < {pairs.LEAST_N} THEN 'too_few_usable' WHEN abs(p_female - 0.5) < {pairs.MARGIN} - 1e-9 THEN 'near_parity' ELSE 'targeted' END AS decision FROM rates),
calibration AS (SELECT *, CASE WHEN decision = 'targeted' THEN CASE WHEN p_female < 0.5 THEN 'female' ELSE 'male' END END AS target_gender FROM calibrated),
sources AS (SELECT l.*, target_gender, CASE WHEN target_gender IS NULL THEN 'occupation_not_targeted' WHEN gender = target_gender THEN 'already_target_gender' ELSE 'candidate' END AS outcome FROM labelled l JOIN calibration USING (occupation) WHERE model_tag = 'base' AND usable AND l.split = 'train' AND template_split = 'train' AND sample_id >= {N_CALIBRATION})
"""


@query(_CALIBRATION + "SELECT occupation, stereotype, n, p_female, decision, target_gender FROM calibration")
def calibration(spark, sf_dir):
    return pairs.calibration(spark, _base(spark, sf_dir))


@query(_CALIBRATION + "SELECT outcome, count(*) AS n FROM sources GROUP BY 1")
def pair_source_outcomes(spark, sf_dir):
    base = _base(spark, sf_dir)
    return pairs.sources(base, pairs.calibration(spark, base)).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


_POOL = lambda: f", names(name, gender) AS (VALUES {data.values(sorted(lexicon.default_names().items()))}), pool AS (SELECT names.gender, name, count(*) AS n FROM labelled JOIN names USING (name) WHERE model_tag = 'base' AND usable AND names.gender <> 'unisex' AND name NOT IN ({', '.join(repr(n) for n in sorted(lexicon.SURNAMES))}) GROUP BY 1, 2)"


@query(lambda: data.cte() + _POOL() + "SELECT gender, name, n FROM pool")
def name_pool(spark, sf_dir):
    return pairs.name_pool(_base(spark, sf_dir), lexicon.names_table(spark), lexicon.surnames_table(spark))


@query(lambda: data.cte() + _POOL() + "SELECT gender, max(n)::DOUBLE / sum(n) AS top_share, count(*) AS n_names, max(n)::DOUBLE / sum(n) > greatest(0.15, 3.0 / count(*)) AS warn FROM pool GROUP BY 1")
def name_overrepresentation(spark, sf_dir):
    return pairs.over_represented(pairs.name_pool(_base(spark, sf_dir), lexicon.names_table(spark), lexicon.surnames_table(spark)))


@query(lambda: data.cte() + _POOL() + f""", every AS (SELECT gender, list(name ORDER BY n DESC, name) FILTER (n >= 2) AS frequent FROM pool GROUP BY 1),
picked AS (SELECT occupation, template_id, sample_id, l.name, list_filter(frequent, lambda x: x <> l.name) AS names FROM labelled l JOIN every ON every.gender = CASE l.gender WHEN 'male' THEN 'female' ELSE 'male' END WHERE model_tag = 'base' AND usable)
SELECT occupation, template_id, sample_id, name, names[1 + {data.sql_draw("'42'", "'name'", 'occupation', 'template_id::VARCHAR', 'sample_id::VARCHAR')} % len(names)] AS picked FROM picked""")
def replacement_names(spark, sf_dir):
    base = _base(spark, sf_dir).filter("usable")
    pool = pairs.pool_arrays(pairs.name_pool(base, lexicon.names_table(spark), lexicon.surnames_table(spark)))
    other = base.withColumn("gender", F.when(F.col("gender") == "male", "female").otherwise("male")).join(F.broadcast(pool), "gender")
    return other.select("occupation", "template_id", "sample_id", "name", pairs.pick_name(F.col("frequent"), F.col("every"), F.col("name"), SEED, "name", F.col("occupation"), F.col("template_id"), F.col("sample_id")).alias("picked"))


# --- around training --------------------------------------------------------------------


@query(f""", ranked AS (SELECT occupation, template_id, sample_id, count(*) OVER (PARTITION BY occupation) AS n, row_number() OVER (PARTITION BY occupation ORDER BY {data.sql_draw("'42'", "'split'", 'occupation', 'template_id::VARCHAR', 'sample_id::VARCHAR')}, occupation, template_id, sample_id) AS r FROM labelled WHERE model_tag = 'base' AND usable AND split = 'train')
SELECT occupation, template_id, sample_id, CASE WHEN r <= CASE WHEN round_even(0.1::DOUBLE * n, 0) = 0 AND n >= 5 THEN 1 ELSE round_even(0.1::DOUBLE * n, 0) END THEN 'eval' ELSE 'train' END AS part FROM ranked""")
def stratified_split(spark, sf_dir):
    rows = _base(spark, sf_dir).filter("usable and split = 'train'").select("occupation", "template_id", "sample_id")
    return training.stratified_split(rows, ["occupation", "template_id", "sample_id"])


_SUMMARY = """, summary AS (SELECT model_tag, avg(usable::INT::DOUBLE) AS usable_rate, avg((gender = 'female')::INT::DOUBLE) FILTER (usable AND split = 'train' AND template_split = 'train' AND stereotype = 'female') - avg((gender = 'female')::INT::DOUBLE) FILTER (usable AND split = 'train' AND template_split = 'train' AND stereotype = 'male') AS gap FROM labelled GROUP BY 1)"""


@query(_SUMMARY + """ SELECT (SELECT model_tag FROM summary s, (SELECT usable_rate AS base_usable FROM summary WHERE model_tag = 'base') WHERE regexp_matches(model_tag, '^step[0-9]+$') AND gap IS NOT NULL AND usable_rate >= base_usable - 0.1 ORDER BY abs(gap), regexp_extract(model_tag, '([0-9]+)$', 1)::INT LIMIT 1) AS selected""")
def select_checkpoint(spark, sf_dir):
    return training.select_checkpoint(metrics.gap_summary(_labelled(spark, sf_dir)))


@query(_SUMMARY + """ SELECT model_tag, usable_rate, gap, row_number() OVER (ORDER BY CASE WHEN model_tag LIKE '%_4bit' THEN 1 ELSE 0 END, CASE WHEN model_tag LIKE 'base%' THEN -1 ELSE regexp_extract(model_tag, '^step([0-9]+)', 1)::BIGINT END) AS place FROM summary""")
def model_summary(spark, sf_dir):
    from pyspark.sql import Window

    return metrics.gap_summary(_labelled(spark, sf_dir)).withColumn("place", F.row_number().over(Window.orderBy(*tx.model_order(F.col("model_tag")))))  # a row a model


@query("""/* events */ WITH daily AS (SELECT event_type AS run, (epoch(date_trunc('day', ts)) // 86400)::INT AS step, avg((value < 50)::INT::DOUBLE) AS usable_rate FROM events GROUP BY 1, 2),
struck AS (SELECT *, usable_rate < first_value(usable_rate) OVER w - 0.02 AND row_number() OVER w > 1 AS strike FROM daily WINDOW w AS (PARTITION BY run ORDER BY step)),
twice AS (SELECT *, strike AND coalesce(lag(strike) OVER (PARTITION BY run ORDER BY step), false) AS two FROM struck)
SELECT run, step, usable_rate, strike, coalesce(step = min(step) FILTER (two) OVER (PARTITION BY run), false) AS stop FROM twice""")
def monitor_early_stop(spark, sf_dir):
    day = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 86400).cast("int")
    log = _table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("run"), day.alias("step")).agg(F.avg((F.col("value") < 50).cast("double")).alias("usable_rate"))
    return training.early_stop(log, 0.02, ["run"])


@query("/* lineitem */ WITH x AS (SELECT l_returnflag AS grp, l_discount AS loss, l_quantity AS k FROM lineitem) SELECT grp, exp(sum(loss * k) / nullif(sum(k), 0)) AS perplexity FROM x GROUP BY 1")
def ppl_pooling(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("grp")).agg(training.pooled_perplexity(F.col("l_discount"), F.col("l_quantity")).alias("perplexity"))


_COSTS = "SELECT model_tag, sum(n_new_tokens) AS tokens, sum(n_new_tokens) / nullif(sum(0.25::DOUBLE * (1 + sample_id % 3)), 0) AS tokens_per_s, nullif(sum(CASE WHEN model_tag LIKE '%4bit' THEN 0 ELSE 0.0001220703125::DOUBLE END), 0) * 1000 / (sum(n_new_tokens) / 1000) AS wh_per_1k_tokens, nullif(sum(CASE WHEN model_tag LIKE '%4bit' THEN 0 ELSE 0.0001220703125::DOUBLE END), 0) * 1000 / nullif(count(*) FILTER (usable), 0) AS wh_per_usable FROM labelled GROUP BY 1"


@query(_COSTS)
def energy_per_1k(spark, sf_dir):
    kwh = F.when(F.col("model_tag").endswith("4bit"), 0.0).otherwise(2.0**-13)
    rows = _labelled(spark, sf_dir).select("model_tag", F.col("n_new_tokens").alias("tokens"), (0.25 * (1 + F.col("sample_id") % 3)).alias("seconds"), kwh.alias("kwh"), F.col("usable").cast("long").alias("usable"))
    return training.costs(rows, ["model_tag"])


# --- review -----------------------------------------------------------------------------


@query("""SELECT what, key, n FROM (SELECT 'occupation' AS what, occupation AS key, count(*) AS n FROM labelled WHERE usable GROUP BY 2 UNION ALL SELECT 'template', template_id::VARCHAR, count(*) FROM labelled WHERE usable GROUP BY 2 UNION ALL SELECT 'gender', gender, count(*) FROM labelled WHERE usable GROUP BY 2 UNION ALL SELECT 'flag', other_person_flag::VARCHAR, count(*) FROM labelled WHERE usable GROUP BY 2)""")
def composition_counts(spark, sf_dir):
    return review.composition(_labelled(spark, sf_dir))


@query("SELECT gender, name, n, place FROM (SELECT gender, name, count(*) AS n, row_number() OVER (PARTITION BY gender ORDER BY count(*) DESC, name) AS place FROM labelled WHERE usable AND model_tag = 'base' GROUP BY 1, 2) WHERE place <= 3")
def top_names(spark, sf_dir):
    return review.top_names(_base(spark, sf_dir), 3)


@query(f"SELECT model_tag, occupation, template_id, sample_id FROM (SELECT *, row_number() OVER (PARTITION BY gender ORDER BY {data.sql_draw("'42'", "'sample'", 'model_tag', 'occupation', 'template_id::VARCHAR', 'sample_id::VARCHAR')}, model_tag, occupation, template_id, sample_id) AS r FROM labelled WHERE usable) WHERE r <= 10")
def audit_sample(spark, sf_dir):
    return review.sampled(_labelled(spark, sf_dir).filter("usable"), 10, KEY, by=["gender"]).select(*KEY)


@query(f"SELECT model_tag, occupation, template_id, sample_id FROM labelled WHERE split = 'heldout' AND NOT truncated ORDER BY {data.sql_draw("'42'", "'sample'", 'model_tag', 'occupation', 'template_id::VARCHAR', 'sample_id::VARCHAR')}, model_tag, occupation, template_id, sample_id LIMIT 200")
def reference_pool(spark, sf_dir):
    return review.reference_pool(_labelled(spark, sf_dir), KEY).select(*KEY)


@query("""SELECT occupation, template_id, sample_id, base_gender, selected_gender, base_text, selected_text FROM (
  SELECT b.occ_ordinal, b.occupation, b.template_id, b.sample_id, b.gender AS base_gender, s.gender AS selected_gender, b.completion AS base_text, s.completion AS selected_text, row_number() OVER (PARTITION BY b.occupation ORDER BY b.template_id, b.sample_id) AS r
  FROM labelled b JOIN labelled s USING (occupation, template_id, sample_id) WHERE b.model_tag = 'base' AND s.model_tag = 'step20' AND b.usable AND s.usable AND b.gender <> s.gender) WHERE r = 1 ORDER BY occ_ordinal LIMIT 4""")
def flip_examples(spark, sf_dir):
    return review.flip_examples(_labelled(spark, sf_dir).drop("name"), "base", "step20")


@query(rf"SELECT model_tag, occupation, template_id, sample_id, array_to_string(list_transform(regexp_extract_all(completion, '[\pL\pN_]+|[^\pL\pN_]+'), lambda w: CASE WHEN lower(w) IN ({', '.join(map(repr, tx.MALE_PRONOUNS + tx.FEMALE_PRONOUNS))}) THEN '[[' || w || ']]' ELSE w END), '') AS shown FROM labelled WHERE usable")
def highlighted_texts(spark, sf_dir):
    return _labelled(spark, sf_dir).filter("usable").select(*KEY, tx.highlighted(F.col("completion")).alias("shown"))


# --- the retired builder ----------------------------------------------------------------

_LEGACY = rf""", old AS (SELECT *, CASE WHEN NOT regexp_matches(completion, '\S') THEN 'empty' WHEN truncated THEN 'truncated' WHEN regexp_matches(lower(completion), '{"|".join(tx.LEGACY_REAL_PEOPLE)}') THEN 'real_person' WHEN regexp_matches(completion, '{data.sql_words("(?i:" + "|".join(tx.REFUSALS) + ")").replace("'", "''")}') THEN 'refusal'
  WHEN regexp_matches(regexp_replace(completion, '{tx.QUOTED}', ' ', 'g'), '{data.sql_words(tx.FIRST_PERSON)}') THEN 'first_person' WHEN n_male + n_female < 2 THEN 'no_signal' END AS old_reason,
  CASE WHEN n_male > 0 AND n_female > 0 THEN 'mixed' WHEN CASE WHEN n_male > 0 THEN 'male' ELSE 'female' END = stereotype THEN 'stereo' ELSE 'counter' END AS class FROM counted WHERE model_tag = 'base'),
stepped AS (SELECT *, CASE WHEN old_reason IS NOT NULL THEN old_reason WHEN stereotype = 'balanced' THEN 'balanced_control' WHEN class = 'mixed' THEN 'mixed' WHEN split = 'heldout' THEN 'heldout' ELSE 'eligible' END AS step FROM old)
"""


@query(_LEGACY + "SELECT step, count(*) AS n FROM stepped GROUP BY 1")
def legacy_funnel(spark, sf_dir):
    return legacy.labelled(data.completions(spark, sf_dir).filter("model_tag = 'base'")).groupBy("step").agg(F.count(F.lit(1)).alias("n"))


@query(_LEGACY + f"""SELECT occupation, template_id, n_counter, n_stereo, CASE WHEN n_counter = 0 THEN 'no_counter' WHEN n_stereo = 0 THEN 'no_stereo' WHEN near THEN 'paired' ELSE 'length_mismatch_only' END AS outcome
FROM (SELECT occupation, template_id, count(*) FILTER (class = 'counter') AS n_counter, count(*) FILTER (class = 'stereo') AS n_stereo FROM stepped WHERE step = 'eligible' GROUP BY 1, 2)
LEFT JOIN (SELECT c.occupation, c.template_id, bool_or(greatest(c.len, s.len)::DOUBLE / least(c.len, s.len) <= {legacy.MAX_RATIO}::DOUBLE) AS near
  FROM (SELECT *, greatest(length(completion), 1) AS len FROM stepped WHERE step = 'eligible' AND class = 'counter') c JOIN (SELECT *, greatest(length(completion), 1) AS len FROM stepped WHERE step = 'eligible' AND class = 'stereo') s ON c.occupation = s.occupation AND c.template_id = s.template_id GROUP BY 1, 2) USING (occupation, template_id)""")
def legacy_group_outcomes(spark, sf_dir):
    return legacy.group_outcomes(legacy.labelled(data.completions(spark, sf_dir).filter("model_tag = 'base'"))).drop("n_pairs", "too_far")


_WALK = f""", eligible AS (SELECT occupation, template_id, sample_id, class, greatest(length(completion), 1) AS len, {data.sql_draw(f"'{SEED}'", "'legacy'", "occupation", "template_id::VARCHAR", "sample_id::VARCHAR")} AS h FROM stepped WHERE step = 'eligible'),
turns AS (SELECT *, row_number() OVER (PARTITION BY occupation, template_id ORDER BY h, sample_id) AS k FROM eligible WHERE class = 'counter'),
walk AS (SELECT DISTINCT occupation, template_id, 0::BIGINT AS k, []::BIGINT[] AS used, NULL::BIGINT AS chosen, NULL::BIGINT AS rejected, NULL::DOUBLE AS ratio FROM eligible
UNION ALL SELECT occupation, template_id, k, CASE WHEN best.ratio <= {legacy.MAX_RATIO} THEN list_append(used, best.id) ELSE used END, CASE WHEN best.ratio <= {legacy.MAX_RATIO} THEN sample_id END, CASE WHEN best.ratio <= {legacy.MAX_RATIO} THEN best.id END, best.ratio
  FROM (SELECT w.occupation, w.template_id, t.k, w.used, t.sample_id, min({{'ratio': greatest(t.len, s.len)::DOUBLE / least(t.len, s.len), 'id': s.sample_id}}) AS best
    FROM walk w JOIN turns t ON t.occupation = w.occupation AND t.template_id = w.template_id AND t.k = w.k + 1 JOIN eligible s ON s.occupation = w.occupation AND s.template_id = w.template_id AND s.class = 'stereo'
    WHERE len(w.used) < 2 AND NOT list_contains(w.used, s.sample_id) GROUP BY ALL))
"""


@query(lambda: (data.cte() + _LEGACY + _WALK).replace("WITH occupations", "WITH RECURSIVE occupations", 1) + "SELECT occupation, template_id, chosen AS chosen_sample_id, rejected AS rejected_sample_id, ratio FROM walk WHERE chosen IS NOT NULL")
def legacy_pairs(spark, sf_dir):
    return legacy.matched(legacy.labelled(data.completions(spark, sf_dir).filter("model_tag = 'base'")))


@query(lambda: (data.cte() + _LEGACY + _WALK).replace("WITH occupations", "WITH RECURSIVE occupations", 1) + "SELECT occupation, template_id, count(*) FILTER (chosen IS NOT NULL) AS n_pairs, count(*) FILTER (k > 0 AND chosen IS NULL) AS too_far FROM walk GROUP BY 1, 2")
def legacy_counts(spark, sf_dir):
    """How many pairs each prompt gives, and how many texts found none near enough."""
    return legacy.group_outcomes(legacy.labelled(data.completions(spark, sf_dir).filter("model_tag = 'base'"))).select("occupation", "template_id", "n_pairs", "too_far")


# --- bootstraps -------------------------------------------------------------------------


def _distributions_sql(table: str) -> str:
    """The distribution of Binomial(n, f / n) for each pair of a table: outcome k where u lies at or above ``below``."""
    return f"""pairs AS (SELECT DISTINCT n, f, CASE WHEN f > 0 AND f < n THEN ceil({bootstrap.SPREAD} * sqrt(f::DOUBLE * (n - f) / n))::BIGINT + {bootstrap.LEAST_SPREAD} ELSE 0 END AS apart FROM {table}),
outcomes AS (SELECT n, f, unnest(range(greatest(f - apart, 0), least(f + apart, n) + 1)) AS k FROM pairs),
ratios AS (SELECT *, CASE WHEN k = min(k) OVER (PARTITION BY n, f) THEN 0.0::DOUBLE ELSE ln((n - k + 1)::DOUBLE / k * (f::DOUBLE / (n - f))) END AS ratio FROM outcomes),
logs AS (SELECT n, f, k, sum(ratio) OVER (PARTITION BY n, f ORDER BY k) AS log_p FROM ratios),
chances AS (SELECT n, f, k, exp(log_p - max(log_p) FILTER (k = f) OVER (PARTITION BY n, f)) AS p FROM logs),
sums_to AS (SELECT n, f, k, sum(p) OVER (PARTITION BY n, f ORDER BY k) / sum(p) OVER (PARTITION BY n, f) AS up_to FROM chances),
dist AS (SELECT n, f, k, coalesce(lag(up_to) OVER (PARTITION BY n, f ORDER BY k), 0) AS below FROM sums_to)"""


def _stats_sql(cells) -> str:
    rows = data.values((name, s, t) for name, split, tmpl in cells for s in ([split] if split else ["train", "heldout"]) for t in ([tmpl] if tmpl else ["train", "heldout"]))
    return f""", cells(cell, split, template_split) AS (VALUES {rows}),
stats AS (SELECT model_tag, cell, stereotype, occupation, count(*) AS n, count(*) FILTER (gender = 'female') AS f FROM labelled JOIN cells USING (split, template_split) WHERE usable AND stereotype <> 'balanced' GROUP BY 1, 2, 3, 4)
"""


def _flat_sql() -> str:
    u = data.sql_uniform(f"'{SEED}'", "'flat'", "model_tag", "cell", "stereotype", "rep::VARCHAR")
    low, high = int(0.025 * FLAT), int(0.975 * FLAT) - 1
    return data.cte() + _stats_sql((*dims.CELLS, ("all", None, None))) + f""", sides AS (SELECT model_tag, cell, stereotype, sum(n)::BIGINT AS n, sum(f)::BIGINT AS f FROM stats GROUP BY 1, 2, 3),
{_distributions_sql("sides")},
uniforms AS (SELECT *, {u} AS u FROM sides, range({FLAT}) r(rep)),
resampled AS (SELECT d.model_tag, d.cell, d.stereotype, d.rep, dist.k::DOUBLE / d.n AS p FROM uniforms d ASOF JOIN dist ON d.n = dist.n AND d.f = dist.f AND d.u >= dist.below),
gaps AS (SELECT model_tag, cell, rep, max(p) FILTER (stereotype = 'female') - max(p) FILTER (stereotype = 'male') AS g FROM resampled GROUP BY 1, 2, 3),
limits AS (SELECT model_tag, cell, list(g ORDER BY g) FILTER (g IS NOT NULL) AS o FROM gaps GROUP BY 1, 2),
points AS (SELECT model_tag, cell, (sum(f) FILTER (stereotype = 'female'))::DOUBLE / sum(n) FILTER (stereotype = 'female') - (sum(f) FILTER (stereotype = 'male'))::DOUBLE / sum(n) FILTER (stereotype = 'male') AS gap, (sum(n) FILTER (stereotype = 'female'))::BIGINT AS n_female_coded, (sum(n) FILTER (stereotype = 'male'))::BIGINT AS n_male_coded FROM sides GROUP BY 1, 2)
SELECT model_tag, cell, gap, n_female_coded, n_male_coded, CASE WHEN len(o) = {FLAT} THEN o[{low + 1}] END AS ci_low, CASE WHEN len(o) = {FLAT} THEN o[{high + 1}] END AS ci_high FROM points LEFT JOIN limits USING (model_tag, cell)"""


def _contrast_sql(units: list[tuple[str, str, float]], cells) -> str:
    u = data.sql_uniform(f"'{SEED}'", "'text'", "model_tag", "cell", "stereotype", "rep::VARCHAR", "slot::VARCHAR")
    pick = data.sql_draw(f"'{SEED}'", "'pick'", "cell", "stereotype", "rep::VARCHAR", "slot::VARCHAR")
    return data.cte() + _stats_sql(cells) + f""", units(unit, model_tag, coef) AS (VALUES {data.values(units)}),
own AS (SELECT unit, coef, stats.* FROM stats JOIN units USING (model_tag)),
known AS (SELECT *, row_number() OVER (PARTITION BY unit, cell, stereotype ORDER BY occupation) - 1 AS k, count(*) OVER (PARTITION BY unit, cell, stereotype) AS size FROM (SELECT DISTINCT unit, cell, stereotype, occupation FROM own)),
slots AS (SELECT unit, cell, stereotype, size, rep, unnest(range(size)) AS slot FROM (SELECT DISTINCT unit, cell, stereotype, size FROM known), range({BOOT}) r(rep)),
picks AS (SELECT *, {pick} % size AS k FROM slots),
{_distributions_sql("own")},
uniforms AS (SELECT unit, model_tag, coef, cell, stereotype, rep, n, f, {u} AS u FROM picks JOIN known USING (unit, cell, stereotype, k) JOIN own USING (unit, cell, stereotype, occupation)),
resampled AS (SELECT d.*, dist.k AS hits FROM uniforms d ASOF JOIN dist ON d.n = dist.n AND d.f = dist.f AND d.u >= dist.below),
gaps AS (SELECT unit, model_tag, coef, cell, rep, (sum(hits) FILTER (stereotype = 'female'))::DOUBLE / sum(n) FILTER (stereotype = 'female') - (sum(hits) FILTER (stereotype = 'male'))::DOUBLE / sum(n) FILTER (stereotype = 'male') AS gap FROM resampled GROUP BY 1, 2, 3, 4, 5),
models AS (SELECT unit, count(*) AS models FROM units GROUP BY 1),
sums AS (SELECT unit, cell, rep, sum(coef * gap) AS v FROM gaps JOIN models USING (unit) GROUP BY unit, cell, rep, models HAVING count(gap) = models),
limits AS (SELECT unit, cell, quantile_cont(v, 0.025) AS low, quantile_cont(v, 0.975) AS high FROM sums GROUP BY 1, 2),
points AS (SELECT unit, model_tag, coef, cell, (sum(f) FILTER (stereotype = 'female'))::DOUBLE / sum(n) FILTER (stereotype = 'female') - (sum(f) FILTER (stereotype = 'male'))::DOUBLE / sum(n) FILTER (stereotype = 'male') AS gap, sum(n) FILTER (stereotype = 'female') AS nf, sum(n) FILTER (stereotype = 'male') AS nm, count(*) FILTER (stereotype = 'female') AS kf, count(*) FILTER (stereotype = 'male') AS km FROM own GROUP BY 1, 2, 3, 4),
whole AS (SELECT unit, cell, sum(coef * gap) AS diff, count(gap) AS found, min(least(kf, km)) AS k, min(least(nf, nm)) AS fewest FROM points GROUP BY 1, 2)
SELECT unit, cell, CASE WHEN found = models THEN diff END AS diff, CASE WHEN found = models AND k >= 2 THEN low END AS ci_low, CASE WHEN found = models AND k >= 2 THEN high END AS ci_high, coalesce(fewest >= {bootstrap.LEAST_TEXTS}, false) AS interpretable
FROM whole JOIN models USING (unit) LEFT JOIN limits USING (unit, cell)"""


@query(_flat_sql)
def boot_flat(spark, sf_dir):
    return bootstrap.flat(bootstrap.occupation_stats(_labelled(spark, sf_dir), dims.cells(spark)), seed=SEED)


@query(lambda: _contrast_sql([(t, t, 1) for t in data.TAGS], (*dims.CELLS, ("all", None, None))))
def boot_cluster(spark, sf_dir):
    return bootstrap.cluster(spark, _labelled(spark, sf_dir), data.TAGS, seed=SEED)


@query(lambda: _contrast_sql([("step20-base", "step20", 1), ("step20-base", "base", -1), ("base_4bit-base", "base_4bit", 1), ("base_4bit-base", "base", -1)], dims.PAIRED_CELLS))
def boot_paired(spark, sf_dir):
    return bootstrap.paired(spark, _labelled(spark, sf_dir), (("base", "step20"), ("base", "base_4bit")), seed=SEED)


@query(lambda: _contrast_sql([("interaction", "step10_4bit", 1), ("interaction", "step10", -1), ("interaction", "base_4bit", -1), ("interaction", "base", 1)], (("train_occ|all_tmpl", "train", None),)))
def boot_interaction(spark, sf_dir):
    return bootstrap.interaction(spark, _labelled(spark, sf_dir), "base", "step10", "base_4bit", "step10_4bit", seed=SEED)


EXTRA = (("train_occ|all_tmpl", "train", None),)


@query(lambda: _contrast_sql([("base_4bit-base", "base_4bit", 1), ("base_4bit-base", "base", -1)], EXTRA))
def boot_extra_cell(spark, sf_dir):
    """What quantising does to the training occupations over all templates."""
    return bootstrap.paired(spark, _labelled(spark, sf_dir), (("base", "base_4bit"),), seed=SEED, cells=EXTRA)


@query(lambda: f"SELECT CASE unit WHEN 'base' THEN 0 ELSE regexp_extract(unit, '([0-9]+)$', 1)::INT END AS step, cell, diff AS gap, ci_low, ci_high, interpretable FROM ({_contrast_sql([(t, t, 1) for t in data.TAGS if not t.endswith('_4bit')], (*dims.CELLS, ('all', None, None)))}) WHERE diff IS NOT NULL")
def trajectory_intervals(spark, sf_dir):
    """The gap by training step and cell with its interval."""
    return bootstrap.trajectory(spark, _labelled(spark, sf_dir), data.TAGS, seed=SEED)


def oracle_sql_of(name: str) -> str:
    return _SQL[name]()


def queries() -> dict[str, Query]:
    from ratelens.plans import derived, language  # noqa: F401  register their own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from ratelens.plans import derived, language  # noqa: F401

    return {name: sql() for name, sql in _SQL.items()}
