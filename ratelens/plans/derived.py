"""Registered queries of sources, sinks, dimensions and small derived columns, over whole tables.

Sources and sinks write whole tables to the shared work folder and read them back; their SQL is the table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens.functions import text as tx
from ratelens.operators import dims, funnel, lexicon, metrics, pairs, report, review, training
from ratelens.plans import catalog
from ratelens.plans import completions as data
from ratelens.plans.catalog import _SUMMARY, KEY, prompt_sql, query
from ratelens.sources import files, folders, logs
from ratelens.streaming import monitor



def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return data.labelled(spark, sf_dir).filter("model_tag = 'base'")


# --- sources and sinks ------------------------------------------------------------------

CONVERSATIONS = "conv_id long, turn long, role string, text string"


@query("/* table */ SELECT conv_id, turn, role, text FROM conversations")
def jsonl_round_trip(spark, sf_dir):
    path = files.work_path(spark, "jsonl")
    files.write_jsonl(_table(spark, sf_dir, "conversations"), path)
    return files.read_jsonl(spark, path, CONVERSATIONS)


@query("/* table */ SELECT role, count(*) AS n, sum(length(text))::BIGINT AS letters FROM conversations GROUP BY 1")
def jsonl_append(spark, sf_dir):
    path, rows = files.work_path(spark, "appended"), _table(spark, sf_dir, "conversations")
    for k, part in enumerate(("role = 'user'", "role <> 'user'")):
        files.write_jsonl(rows.filter(part), path, append=k > 0)
    return files.read_jsonl(spark, path, CONVERSATIONS).groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("letters"))


@query("/* table */ SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def csv_round_trip(spark, sf_dir):
    path = files.work_path(spark, "csv")
    files.write_csv(_table(spark, sf_dir, "supplier"), path)
    return spark.read.option("header", True).schema("s_suppkey long, s_name string, s_nationkey int, s_acctbal double").csv(path)


@query("/* table */ SELECT count(*) AS n, max(o_orderkey) AS last, avg(o_totalprice) AS mean, NULL::VARCHAR AS nothing FROM orders")
def json_document_round_trip(spark, sf_dir):
    path = files.work_path(spark, "document")
    rows = _table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last"), F.avg("o_totalprice").alias("mean")).withColumn("nothing", F.lit(None).cast("string"))
    files.write_document(rows, path)
    return files.read_json(spark, path, "n long, last long, mean double, nothing string")




@query("""SELECT rtrim(line) AS line FROM (SELECT -1 AS place, '| stereotype | n | usable_rate |' AS line UNION ALL SELECT 0, '|---|---|---|'
UNION ALL SELECT row_number() OVER (ORDER BY stereotype), '| ' || stereotype || ' | ' || n || ' | ' || printf('%.2f', rate) || ' |' FROM (SELECT stereotype, count(*) AS n, avg(usable::INT::DOUBLE) AS rate FROM labelled WHERE model_tag = 'base' GROUP BY 1))""")
def markdown_table(spark, sf_dir):
    rows = _base(spark, sf_dir).groupBy("stereotype").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("usable").cast("double")).alias("usable_rate")).orderBy("stereotype")
    return spark.createDataFrame([(x,) for x in files.markdown(rows).split("\n")], "line string")


@query("/* table */ SELECT n_nationkey, n_name, n_regionkey FROM nation")
def skip_if_there(spark, sf_dir):
    """Made once: the second call must not make an empty table of it."""
    path, rows = files.work_path(spark, "materialised"), _table(spark, sf_dir, "nation")
    files.materialised(spark, path, lambda: rows)
    return files.materialised(spark, path, lambda: rows.limit(0))


@query(lambda: data.cte() + f""" SELECT occupation, template_id, sample_id, '{dims.SYSTEM_PROMPT}' AS system, {data.sql_draw("'x'", "completion")} AS chosen FROM labelled WHERE model_tag = 'base' AND usable""")
def training_conversion(spark, sf_dir):
    """prompt, chosen and rejected as a trainer takes them, from records without stored messages."""
    from ratelens.functions.rng import draw

    rows = dims.with_stored_messages(spark, _base(spark, sf_dir).filter("usable")).select(*KEY[1:], F.col("messages").alias("prompt"), F.col("completion").alias("chosen"), F.lit("").alias("rejected"))
    return pairs.chat_form(rows).select(*KEY[1:], F.col("prompt")[0]["content"].alias("system"), draw("x", F.col("chosen")[0]["content"]).alias("chosen"))


@query()
def files_to_pairs(spark, sf_dir):
    """From a file of raw completions to a file of pairs: read, label, calibrate, swap, write, read back."""
    raw, out = files.work_path(spark, "raw"), files.work_path(spark, "pairs")
    files.write_jsonl(dims.with_stored_messages(spark, data.completions(spark, sf_dir).filter("model_tag = 'base'").drop("name")), raw)
    records = files.read_jsonl(spark, raw).join(F.broadcast(dims.occupations(spark).select("occupation", "occ_ordinal")), "occupation")
    labelled = files.work_table(funnel.labelled(records), "labelled")
    built = pairs.build(spark, labelled, lexicon.names_table(spark), pairs.calibration(spark, labelled))
    files.write_jsonl(pairs.chat_form(pairs.numbered(built)), out)
    message = "array<struct<role:string,content:string>>"
    return files.training_rows(files.read_jsonl(spark, out, f"pair_id long, prompt {message}, chosen {message}, rejected {message}"))


# --- small derived columns --------------------------------------------------------------


@query("SELECT model_tag, quantised FROM (SELECT DISTINCT model_tag, model_tag AS quantised FROM labelled UNION ALL SELECT 'step10_4bit_merged', 'step10_4bit')")
def quantised_tags(spark, sf_dir):
    tags = data.completions(spark, sf_dir).select("model_tag").distinct().unionByName(spark.createDataFrame([("step10_4bit_merged",)], "model_tag string"))
    return tags.withColumn("quantised", report.quantised_tag(F.col("model_tag")))


@query("/* table */ SELECT conv_id, turn, greatest(greatest(length(text), 1), greatest(length(role), 1))::DOUBLE / least(greatest(length(text), 1), greatest(length(role), 1)) AS ratio FROM conversations")
def length_ratios(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.length_ratio(F.col("text"), F.col("role")).alias("ratio"))


@query("/* table */ SELECT l_returnflag AS run, sum(l_extendedprice - l_quantity) / 3600000.0::DOUBLE AS kwh, sum(l_extendedprice - l_quantity) / 3600000.0::DOUBLE - coalesce(sum(l_tax) FILTER (l_linestatus = 'O'), 0) AS net FROM lineitem GROUP BY 1")
def energy_deltas(spark, sf_dir):
    out = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("run")).agg(training.energy_kwh(F.col("l_quantity"), F.col("l_extendedprice")).alias("kwh"), F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_tax"))).alias("monitor"))
    return out.select("run", "kwh", training.net_of_monitor(F.col("kwh"), F.col("monitor")).alias("net"))




@query("SELECT model_tag, avg(truncated::INT::DOUBLE) AS truncated_rate, avg(truncated::INT::DOUBLE) > 0.15 AS alarm FROM labelled GROUP BY 1")
def truncation_alarms(spark, sf_dir):
    return review.alarms(data.labelled(spark, sf_dir))


@query("SELECT occupation, template_id, sample_id, truncated, length(completion) AS letters, reason, gender FROM labelled WHERE model_tag = 'base'")
def raw_with_analysis(spark, sf_dir):
    raw = data.completions(spark, sf_dir).filter("model_tag = 'base'")
    analysis = _base(spark, sf_dir).select(*KEY[1:], "reason", "gender", "truncated")
    return report.with_analysis(raw, analysis).select(*KEY[1:], "truncated", F.length("completion").alias("letters"), "reason", "gender")


@query("SELECT model_tag, array_to_string(list(substr(completion, 1, 200) ORDER BY occ_ordinal, template_id, sample_id)[1:4], '|') AS examples FROM labelled GROUP BY 1")
def monitor_examples(spark, sf_dir):
    return report.examples(data.completions(spark, sf_dir), "model_tag").withColumn("examples", F.array_join("examples", "|"))


@query("SELECT metric, n, row_number() OVER (ORDER BY n DESC, metric) AS place FROM (SELECT coalesce('excluded_' || reason, 'usable') AS metric, count(*) AS n FROM labelled GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM labelled)")
def funnel_order(spark, sf_dir):
    return report.funnel_table(funnel.funnel(data.labelled(spark, sf_dir)))


@query("SELECT occupation, row_number() OVER (ORDER BY stereotype, occupation) AS place FROM occupations WHERE split = 'train'")
def calibration_order(spark, sf_dir):
    return report.calibration_table(pairs.calibration(spark, _base(spark, sf_dir))).select("occupation", "place")


@query("SELECT model_tag, occupation, row_number() OVER (PARTITION BY model_tag ORDER BY stereotype, split, occupation) AS place FROM (SELECT DISTINCT model_tag, occupation, stereotype, split FROM labelled WHERE usable)")
def occupation_order(spark, sf_dir):
    from ratelens.operators import metrics

    return report.occupation_order(metrics.per_occupation(data.labelled(spark, sf_dir))).select("model_tag", "occupation", "place")


@query("""SELECT model_tag, coalesce(split, 'all') AS split, coalesce(template_split, 'all') AS template_split, avg((gender = 'female')::INT::DOUBLE) FILTER (stereotype = 'female') - avg((gender = 'female')::INT::DOUBLE) FILTER (stereotype = 'male') AS gap,
  count(*) FILTER (stereotype = 'female') AS n_female_coded, count(*) FILTER (stereotype = 'male') AS n_male_coded FROM labelled WHERE usable AND stereotype <> 'balanced' GROUP BY GROUPING SETS ((model_tag, split, template_split), (model_tag, split), (model_tag))""")
def baseline_review(spark, sf_dir):
    return report.all_splits(data.labelled(spark, sf_dir))


# --- model folders ----------------------------------------------------------------------


def _run_folders(spark: SparkSession, sf_dir: str, tags=("base", "step10", "step20", "step10_4bit")) -> str:
    """A run of some models, one of which has no metrics yet, with the tag that selection takes of all in summary.json."""
    folders.register(spark)
    root = files.work_path(spark, "run")
    rows = data.labelled(spark, sf_dir).filter(F.col("model_tag").isin(*tags))
    rows.select("model_tag", *KEY[1:], "stereotype", "split", "template_split", "completion", "truncated", "n_new_tokens", "reason").write.format("model_folders").mode("append").save(root)
    for tag in tags[:-1]:
        files.write_document(rows.filter(F.col("model_tag") == tag).agg(F.count(F.lit(1)).alias("n")), f"{root}/{tag}/metrics.json")
    files.write_document(training.select_checkpoint(metrics.gap_summary(data.labelled(spark, sf_dir))), f"{root}/summary.json")
    return root


def _read_folders(spark: SparkSession, root: str) -> DataFrame:
    """Each document of metrics.json is a folder of its own here, as Spark writes it: the source takes both."""
    return spark.read.format("model_folders").load(root)


@query("SELECT model_tag, count(*) AS n, count(*) FILTER (usable) AS n_usable FROM labelled WHERE model_tag IN ('base', 'step20') GROUP BY 1")
def model_folders(spark, sf_dir):
    """Three finished models of four folders, of which a filter on the tag opens two."""
    read = _read_folders(spark, _run_folders(spark, sf_dir)).filter("model_tag in ('base', 'step20', 'step10_4bit', 'step99')")
    return read.groupBy("model_tag").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("usable").cast("long")).alias("n_usable"))


@query(lambda: f"""{data.cte()}{_SUMMARY}, chosen AS (SELECT model_tag FROM summary s, (SELECT usable_rate AS base_usable FROM summary WHERE model_tag = 'base') WHERE regexp_matches(model_tag, '^step[0-9]+$') AND gap IS NOT NULL AND usable_rate >= base_usable - 0.1 ORDER BY abs(gap), regexp_extract(model_tag, '([0-9]+)$', 1)::INT LIMIT 1)
SELECT model_tag, occupation, template_id, sample_id, truncated, reason FROM labelled WHERE model_tag IN ('base', (SELECT model_tag FROM chosen))""")
def selected_tag(spark, sf_dir):
    """The texts of base and of the tag that summary.json names: a semi-join of the folders with the document."""
    root = _run_folders(spark, sf_dir)
    wanted = files.read_json(spark, f"{root}/summary.json", "selected string").select(F.explode(F.array(F.lit("base"), "selected")).alias("model_tag"))
    return _read_folders(spark, root).join(F.broadcast(wanted), "model_tag", "left_semi").select("model_tag", *KEY[1:], "truncated", "reason")  # two rows


@query("/* table */ SELECT l_linenumber * 10 AS step, count(*) AS n FROM lineitem WHERE l_linenumber IN (1, 3) OR l_linenumber = (SELECT max(l_linenumber) FROM lineitem) GROUP BY 1")
def checkpoint_discovery(spark, sf_dir):
    """Folders of checkpoints by number, of which the wanted ones that are there and the last are read."""
    root, rows = files.work_path(spark, "checkpoints"), _table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") * 10).alias("step"), "l_orderkey")
    for (step,) in rows.select("step").distinct().collect():  # seven
        rows.filter(F.col("step") == step).drop("step").write.parquet(f"{root}/checkpoint-{step}/rows.parquet")
    found = files.checkpoints(files.folders_with(spark, f"{root}/*/rows.parquet"), [10, 30, 990])
    parts = [spark.read.parquet(f"{root}/{folder}/rows.parquet").agg(F.count(F.lit(1)).alias("n")).select(F.lit(step).alias("step"), "n") for step, folder in found]
    return reduce(DataFrame.unionByName, parts)


@query("/* lists */ SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS name FROM documents")
def word_list_scan(spark, sf_dir):
    """The capitalised words of all documents, as a word list with comments, and what a scan of it finds."""
    path = files.work_path(spark, "words")
    words = F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0))
    _table(spark, sf_dir, "documents").select(F.explode(F.array(F.concat(F.lit("# Of "), F.coalesce("source", F.lit("?"))), F.array_join(words, "  "))).alias("value")).filter("value is not null").write.text(path)
    return files.read_words(spark, path)


def _capitalised(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").filter(which)
    return rows.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0))).alias("name"))


_LISTS = "/* lists */ WITH m AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS name FROM documents WHERE doc_id % 2 = 0), f AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS name FROM documents WHERE doc_id % 2 = 1)"


@query(_LISTS + " SELECT name, 'male' AS name_gender FROM m WHERE name NOT IN (FROM f) UNION ALL SELECT name, 'female' FROM f WHERE name NOT IN (FROM m) UNION ALL SELECT name, 'unisex' FROM m WHERE name IN (FROM f)")
def name_dictionary(spark, sf_dir):
    """The dictionary of two lists: the capitalised words of documents of even and of odd number."""
    return lexicon.dictionary_table(_capitalised(spark, sf_dir, "doc_id % 2 = 0"), _capitalised(spark, sf_dir, "doc_id % 2 = 1"))


@query(_LISTS + " SELECT name FROM m WHERE name NOT IN (FROM f)")
def surname_difference(spark, sf_dir):
    """One list without what is on the other."""
    return lexicon.without_first_names(_capitalised(spark, sf_dir, "doc_id % 2 = 0"), _capitalised(spark, sf_dir, "doc_id % 2 = 1").distinct())


# --- prompts and their samples ----------------------------------------------------------


@query(lambda: f"{data.cte()} SELECT g.*, coalesce(n, 0) AS n_texts FROM ({prompt_sql()}) g LEFT JOIN (SELECT occupation, template_id, 'short' AS template_set, count(*) AS n FROM completions GROUP BY 1, 2) USING (occupation, template_id, template_set)")
def prompt_grid(spark, sf_dir):
    """Every prompt of the grid and how many texts answer it."""
    grid = dims.prompts(spark).unionByName(dims.prompts(spark, "longform"))
    n = data.completions(spark, sf_dir).groupBy("occupation", "template_id").agg(F.count(F.lit(1)).alias("n")).withColumn("template_set", F.lit("short"))
    return grid.join(n, ["occupation", "template_id", "template_set"], "left").withColumn("n_texts", F.coalesce("n", F.lit(0))).drop("n")


@query(lambda: f"{data.cte()}, base AS (SELECT occupation, template_id, sample_id FROM completions WHERE model_tag = 'base') SELECT occupation, template_id, sample_id, split_part(prompt, '. Begin', 1) AS prefix FROM ({prompt_sql()}), (SELECT unnest(range((SELECT max(sample_id) + 1 FROM base)::BIGINT)) AS sample_id) WHERE template_set = 'short' AND (occupation, template_id, sample_id) NOT IN (FROM base)")
def sample_expansion(spark, sf_dir):
    """The samples of every prompt that no text answers yet."""
    base = data.completions(spark, sf_dir).filter("model_tag = 'base'").select(*KEY[1:])
    most = base.agg(F.max("sample_id")).first()[0]
    grid = dims.samples(dims.prompts(spark), (-1 if most is None else most) + 1) if most is not None else dims.samples(dims.prompts(spark), 1).limit(0)
    return grid.withColumn("sample_id", F.col("sample_id").cast("long")).join(base, KEY[1:], "left_anti").select(*KEY[1:], tx.prompt_prefix(F.col("prompt")).alias("prefix"))


@query(lambda: f"""{data.cte()}, asked AS (SELECT occupation, template_id FROM ({prompt_sql()}) WHERE template_set = 'short' AND split = 'train' AND template_split = 'train' ORDER BY {data.sql_draw("'42'", "'sample'", 'occupation', 'template_id::VARCHAR')}, occupation, template_id LIMIT 10)
SELECT model_tag, occupation, template_id, count(*) AS n, avg(usable::INT::DOUBLE) AS usable_rate FROM labelled JOIN asked USING (occupation, template_id) GROUP BY ALL""")
def monitor_prompt_subset(spark, sf_dir):
    """What the monitor sees: usable rates of a seeded subset of the training prompts."""
    asked = review.monitor_prompts(dims.prompts(spark), 10).select("occupation", "template_id")
    rows = data.labelled(spark, sf_dir).join(F.broadcast(asked), ["occupation", "template_id"])  # ten rows
    return rows.groupBy("model_tag", "occupation", "template_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("usable").cast("double")).alias("usable_rate"))


@query(lambda: f"""{data.cte()}, asked AS (SELECT occ_ordinal, template_id FROM ({prompt_sql()}) WHERE template_set = 'short' ORDER BY occ_ordinal, template_id LIMIT 12) SELECT model_tag, occupation, template_id, count(*) AS n FROM completions JOIN asked USING (occ_ordinal, template_id) GROUP BY ALL""")
def prompt_limit(spark, sf_dir):
    """The texts of a smoke run: those of the first twelve prompts."""
    asked = dims.first_prompts(dims.prompts(spark), 12).select("occ_ordinal", "template_id")
    return data.completions(spark, sf_dir).join(F.broadcast(asked), ["occ_ordinal", "template_id"]).groupBy("model_tag", "occupation", "template_id").agg(F.count(F.lit(1)).alias("n"))


@query(lambda: f"{data.cte()} SELECT model_tag, c.occupation, c.template_id, sample_id, 'system' AS role_0, '{dims.SYSTEM_PROMPT}' AS content_0, 'user' AS role_1, prompt AS content_1 FROM completions c JOIN ({prompt_sql()}) p ON c.occupation = p.occupation AND c.template_id = p.template_id AND template_set = 'short'")
def prompt_messages(spark, sf_dir):
    """The messages of every text, made anew where none are stored."""
    rows = dims.with_stored_messages(spark, data.completions(spark, sf_dir))
    return rows.select(*KEY, *[F.col("messages")[i][f].alias(f"{f}_{i}") for i in (0, 1) for f in ("role", "content")])


# --- small columns ----------------------------------------------------------------------


@query("/* documents */ SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'base' ELSE 'step' || doc_id END AS checkpoint, doc_id % 4 IN (1, 2) AS four_bit, doc_id % 4 = 2 AS merged FROM documents")
def variant_specs(spark, sf_dir):
    """Specifications of a variant for every document, parsed."""
    spec = F.concat(F.when(F.col("doc_id") % 3 == 0, "base").otherwise(F.concat(F.lit("step"), "doc_id")), F.when(F.col("doc_id") % 4 == 1, "_4bit").when(F.col("doc_id") % 4 == 2, "_4bit_merged").otherwise(""))
    return _table(spark, sf_dir, "documents").select("doc_id", tx.variant(spec).alias("v")).select("doc_id", "v.*")


@query("""SELECT model_tag, occupation, CASE WHEN n >= 30 THEN t ELSE '(' || t || ')' END AS shown FROM (SELECT model_tag, occupation, n, printf('%+.2f', round_even(p - 0.5, 2) + 0.0) || ' [' || printf('%+.2f', round_even(p - 0.5 - 1.0 / n, 2) + 0.0) || ', ' || printf('%+.2f', round_even(p - 0.5 + 1.0 / n, 2) + 0.0) || ']' AS t
FROM (SELECT model_tag, occupation, count(*)::DOUBLE AS n, avg((gender = 'female')::INT::DOUBLE) AS p FROM labelled WHERE usable GROUP BY 1, 2))""")
def number_formats(spark, sf_dir):
    """Every occupation's distance from parity with a margin of one text, as reports show it; in brackets where texts are few."""
    p, n = F.col("p_female") - 0.5, F.lit(1.0) / F.col("n")
    rows = metrics.per_occupation(data.labelled(spark, sf_dir))
    return rows.select("model_tag", "occupation", report.interval_text(p, p - n, p + n, F.col("n") >= 30).alias("shown"))


@query("/* conversations */ SELECT conv_id, turn, (CASE WHEN place > 0 THEN place ELSE len(ids) END)::INT AS n_tokens, coalesce(place, 0) = 0 AS truncated FROM (SELECT conv_id, turn, ids, list_position(ids, 4) AS place FROM (SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda w: length(w)) AS ids FROM conversations WHERE text IS NOT NULL))")
def eos_lengths(spark, sf_dir):
    """Lengths up to the first end token, for turns whose tokens are the lengths of their words and end with a four."""
    rows = _table(spark, sf_dir, "conversations").filter("text is not null").select("conv_id", "turn", F.transform(F.split("text", " ", -1), F.length).alias("ids"))
    n, cut = training.generated_length(F.col("ids"), 4)
    return rows.select("conv_id", "turn", n.alias("n_tokens"), cut.alias("truncated"))


# --- reports of unlike entries, audit sheets --------------------------------------------


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report a user with a history of unlike entries: losses, evaluations with their run time, notes, each with fields of its own."""
    path, e = files.work_path(spark, "reports"), _table(spark, sf_dir, "events")
    kinds = {"click": ("loss", "value"), "purchase": ("eval_loss", "value"), "view": ("note", "event_type")}
    entry = F.struct(F.col("event_id").alias("step"), *(F.when(F.col("event_type") == k, F.col(c)).alias(n) for k, (n, c) in kinds.items()), F.when(F.col("event_type") == "purchase", F.lit("1.5s")).alias("eval_runtime"))
    one = e.groupBy("user_id").agg(F.array_sort(F.collect_list(entry)).alias("log_history"), F.sum("value").alias("actual"), F.max("value").alias("pred"))  # a user's events
    report_ = F.struct(F.col("user_id").alias("run"), "log_history", F.struct("actual", "pred", F.lit(0.0).alias("early_stop"), F.lit("cpu").alias("components")).alias("carbon"))
    one.select(F.to_json(report_).alias("value")).write.text(path)
    return logs.read_reports(spark, path)


_RUN = lambda: logs.field(F.col("report"), "$.run", "long").alias("run")


@query("/* events */ SELECT user_id AS run, event_id::INT AS step, value AS eval_loss FROM events WHERE event_type = 'purchase'")
def eval_rows(spark, sf_dir):
    """The evaluations among the unlike entries of every report."""
    return logs.evaluations(logs.entries(_reports(spark, sf_dir), _RUN()), "run")


@query("/* events */ SELECT user_id AS run, unnest(['actual', 'pred', 'components']) AS key, unnest([sum(value), max(value), NULL]) AS value FROM events GROUP BY 1")
def carbon_projection(spark, sf_dir):
    """Of every report's carbon log what was measured, predicted, and the components, which aren't a number here."""
    return logs.carbon(_reports(spark, sf_dir), _RUN())


@query("""/* labels */ WITH v AS (SELECT doc_id % 7 = 0 AS rescued, unnest(['single_character_ok', 'pronouns_refer_to_holder', 'swap_correct', 'chosen_fluent']) AS verdict, unnest([quality = 1, toxic = 0, doc_id % 5 > 0, doc_id % 3 > 0]) AS ok FROM labels)
SELECT verdict, count(*) FILTER (ok) AS yes, count(*) AS n, avg(ok::INT::DOUBLE) AS rate, count(*) FILTER (rescued) AS n_rescued FROM v GROUP BY 1""")
def audit_verdicts(spark, sf_dir):
    """Error rates of an audit sheet of all labels, every seventh line of which is broken."""
    path = files.work_path(spark, "audit")
    yn = lambda ok: F.when(ok, "y").otherwise("n")
    row = F.concat_ws(",", "doc_id", F.lit("nurse"), F.lit("female->male"), yn(F.col("quality") == 1), yn(F.col("toxic") == 0), yn(F.col("doc_id") % 5 > 0), yn(F.col("doc_id") % 3 > 0), F.lit('""fine""'), F.lit("A"))
    whole = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit('"'), row, F.lit('";'))).otherwise(F.replace(row, F.lit('""'), F.lit('"')))
    _table(spark, sf_dir, "labels").select(whole.alias("value")).write.text(path)
    sheet = files.read_whole_audit(spark, path, header=False)
    n = sheet.agg(F.sum(F.col("rescued").cast("long")).alias("n_rescued"))
    return review.audit_rates(sheet).crossJoin(F.broadcast(n))  # one row


# --- parts that are there, nested documents ---------------------------------------------


@query("SELECT model_tag, CASE WHEN model_tag = 'step20' THEN 'second' ELSE 'first' END AS made, count(*) AS n FROM labelled WHERE model_tag IN ('base', 'step10', 'step20') GROUP BY 1, 2")
def skip_by_variant(spark, sf_dir):
    """Asked for two models, then for three: the second call makes the third only."""
    path, rows = files.work_path(spark, "variants"), data.labelled(spark, sf_dir).select(*KEY, "reason")
    make = lambda call: lambda missing: rows.filter(F.col("model_tag").isin(*missing)).withColumn("made", F.lit(call))
    files.materialised_by(spark, path, "model_tag", ["base", "step10"], make("first"))
    got = files.materialised_by(spark, path, "model_tag", ["base", "step10", "step20"], make("second"))
    return got.groupBy("model_tag", "made").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT model_tag, 'cells' AS part, stereotype || '|' || split || '|' || template_split AS key, count(*) AS n, avg((gender = 'female')::INT::DOUBLE) AS value FROM labelled WHERE usable GROUP BY 1, 2, 3
UNION ALL SELECT model_tag, 'per_occupation', occupation, count(*), avg((gender = 'female')::INT::DOUBLE) FROM labelled WHERE usable GROUP BY 1, 2, 3
UNION ALL SELECT model_tag, 'gap', CASE WHEN split IS NULL THEN 'all' ELSE split || '_occ|' || template_split || '_tmpl' END, count(*) FILTER (stereotype = 'female'), avg((gender = 'female')::INT::DOUBLE) FILTER (stereotype = 'female') - avg((gender = 'female')::INT::DOUBLE) FILTER (stereotype = 'male')
FROM labelled WHERE usable GROUP BY GROUPING SETS ((model_tag, split, template_split), (model_tag))""")
def metrics_documents(spark, sf_dir):
    """A nested document a model, written to a file of its own, read back with its maps and taken apart."""
    path = files.work_path(spark, "metrics")
    files.write_documents(metrics.documents(data.labelled(spark, sf_dir)), path, "model_tag")
    read = spark.read.schema(f"{metrics.DOCUMENT}, model_tag string").json(path)
    part = lambda name, n, value: read.select("model_tag", F.lit(name).alias("part"), F.explode(name).alias("key", "v")).select("model_tag", "part", "key", F.col(f"v.{n}").alias("n"), F.col(f"v.{value}").alias("value"))
    return part("cells", "n", "p_female").unionByName(part("per_occupation", "n", "p_female")).unionByName(part("gap", "n_female_coded", "gap"))


# --- streams ----------------------------------------------------------------------------

DAYS_LATE = 400


def _shuffled_events(spark: SparkSession, sf_dir: str, files_: int = 6) -> str:
    """Events as files in no order of time, and a last one whose only event lies so far ahead that it closes all steps."""
    path, rows = files.work_path(spark, "event-files"), _table(spark, sf_dir, "events")
    own = rows.select(F.col("event_type").alias("run"), F.col("ts").cast("timestamp").alias("at"), (F.col("value") < 50).alias("usable"))
    own.repartition(files_, F.xxhash64("event_id")).write.parquet(path)
    end = own.agg((F.max("at") + F.expr(f"INTERVAL {2 * DAYS_LATE} DAYS")).alias("at")).filter("at is not null")
    end.select(F.lit("the end").alias("run"), "at", F.lit(True).alias("usable")).coalesce(1).write.mode("append").parquet(path)
    return path


@query(lambda: catalog.oracle_sql_of("monitor_early_stop").replace("SELECT run, step,", "SELECT run, step::BIGINT AS step,"))
def monitor_stream(spark, sf_dir):
    """The early stop over a stream of events in parts and out of order: the same verdicts as over the table."""
    path = _shuffled_events(spark, sf_dir)
    texts = spark.readStream.schema("run string, at timestamp, usable boolean").option("maxFilesPerTrigger", 3).parquet(path)
    found = monitor.run_to_table(monitor.early_stop_by_time(texts, f"{DAYS_LATE} days", drop=0.02), f"{path}-verdicts", f"{path}-state")
    return found.filter("run <> 'the end'")
