"""Calibration and counterfactual pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratelens.functions.rng import draw
from ratelens.operators import dims, funnel, lexicon

N_CALIBRATION, LEAST_N, MARGIN = 8, 12, 0.20
LEAST_NAME_COUNT = 2


def decision(n: Column, p: Column) -> Column:
    return F.when(n < LEAST_N, "too_few_usable").when(F.abs(p - 0.5) < MARGIN - 1e-9, "near_parity").otherwise("targeted")


def calibration(spark: SparkSession, labelled: DataFrame, n_calibration: int = N_CALIBRATION) -> DataFrame:
    """Of each train occupation: texts of its calibration half, their female share, the decision and the gender to aim at."""
    half = labelled.filter(funnel.train_cell() & (F.col("sample_id") < n_calibration) & F.col("usable"))
    counts = half.groupBy("occupation").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("gender") == "female").cast("long")).alias("f"))
    train = dims.occupations(spark).filter("split = 'train'").select("occ_ordinal", "occupation", "stereotype")
    out = train.join(counts, "occupation", "left").withColumns({"n": F.coalesce("n", F.lit(0)).cast("long"), "f": F.coalesce("f", F.lit(0)).cast("long")})
    out = out.withColumn("p_female", F.when(F.col("n") > 0, F.col("f") / F.col("n")))
    out = out.withColumn("decision", decision(F.col("n"), F.col("p_female")))
    return out.select("occupation", "stereotype", "n", "p_female", "decision", F.when(F.col("decision") == "targeted", F.when(F.col("p_female") < 0.5, "female").otherwise("male")).alias("target_gender"))


def sources(labelled: DataFrame, calibrated: DataFrame, n_calibration: int = N_CALIBRATION) -> DataFrame:
    """Usable texts of the other half with their occupation's target and whether they are candidates for a swap."""
    rows = labelled.filter(funnel.train_cell() & (F.col("sample_id") >= n_calibration) & F.col("usable"))
    out = rows.join(F.broadcast(calibrated.select("occupation", "target_gender")), "occupation")  # one row an occupation
    return out.withColumn("outcome", F.when(F.col("target_gender").isNull(), "occupation_not_targeted").when(F.col("gender") == F.col("target_gender"), "already_target_gender").otherwise("candidate"))


def name_pool(labelled: DataFrame, names: DataFrame, surnames: DataFrame | None = None) -> DataFrame:
    """gender, name, n: first names that the model produced, of that gender, that aren't common surnames."""
    found = labelled.filter("usable and name is not null").select("name").join(F.broadcast(names), "name")  # the dictionary
    found = found.filter("name_gender in ('male', 'female')")
    if surnames is not None:
        found = found.join(F.broadcast(surnames), "name", "left_anti")
    return found.groupBy(F.col("name_gender").alias("gender"), "name").agg(F.count(F.lit(1)).alias("n"))


def pool_arrays(pool: DataFrame) -> DataFrame:
    """gender, frequent names and all names, each in order of (-n, name). A pool holds at most the dictionary's names."""
    entry = F.struct((-F.col("n")).alias("by"), "name")
    return pool.groupBy("gender").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("n") >= LEAST_NAME_COUNT, entry))), lambda e: e["name"]).alias("frequent"), F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["name"]).alias("every"))


def pick_name(frequent: Column, every: Column, current: Column, *key: Column | str | int) -> Column:
    """A name other than the current one: each frequent one is as likely; of all where none is frequent."""
    own = lambda names: F.filter(names, lambda n: ~n.eqNullSafe(current))
    names = F.when(F.size(own(frequent)) > 0, own(frequent)).otherwise(own(every))
    return F.when(F.size(names) > 0, F.get(names, (draw(*key) % F.greatest(F.size(names), F.lit(1))).cast("int")))


def over_represented(pool: DataFrame) -> DataFrame:
    """Per gender the share of its top name, and a warning above max(0.15, 3 / distinct names)."""
    out = pool.groupBy("gender").agg((F.max("n") / F.sum("n")).alias("top_share"), F.count(F.lit(1)).alias("n_names"))
    return out.withColumn("warn", F.col("top_share") > F.greatest(F.lit(0.15), F.lit(3.0) / F.col("n_names")))


def candidates(spark: SparkSession, labelled: DataFrame, names: DataFrame, calibrated: DataFrame, n_calibration: int = N_CALIBRATION, seed: int = 42, surnames: DataFrame | None = None) -> DataFrame:
    """The source texts with outcome, target_gender and, where they are to be swapped, picked: the new name.

    Common surnames, by default those of the lexicon, are never new names.
    """
    if surnames is None:
        surnames = lexicon.surnames_table(spark)
    pool = F.broadcast(pool_arrays(name_pool(labelled, names, surnames)))  # two rows
    rows = sources(labelled, calibrated, n_calibration)
    rows = rows.join(pool.withColumnRenamed("gender", "target_gender"), "target_gender", "left")
    key = (F.col("occupation"), F.col("template_id"), F.col("sample_id"))
    picked = pick_name(F.col("frequent"), F.col("every"), F.col("name"), seed, "name", *key)
    return rows.withColumn("picked", F.when(F.col("outcome") == "candidate", picked)).drop("frequent", "every")


def build(spark: SparkSession, labelled: DataFrame, names: DataFrame, calibrated: DataFrame, n_calibration: int = N_CALIBRATION, seed: int = 42, surnames: DataFrame | None = None) -> DataFrame:
    """Every source text with its outcome: paired, swap_failed (with its code) or why it isn't a candidate.

    prompt holds the text's stored messages, or those of its prompt anew.
    """
    from ratelens.operators.swap import swapped

    rows = candidates(spark, dims.with_stored_messages(spark, labelled), names, calibrated, n_calibration, seed, surnames)
    # the swap sees candidates only; other rows give it nulls, which cost nothing
    rows = swapped(rows, F.when(F.col("picked").isNotNull(), F.col("completion")), F.col("target_gender"), F.col("picked"))
    outcome = F.when(F.col("outcome") != "candidate", F.col("outcome")).when(F.col("swap.text").isNotNull(), "paired").otherwise("swap_failed")
    new_name = F.coalesce(F.filter("swap.log", lambda e: e["old"] == F.col("name"))[0]["new"], F.col("name"))
    rows = rows.withColumn("outcome", outcome)
    return rows.select(
        *("occ_ordinal", "occupation", "stereotype", "template_id", "sample_id", "outcome"),
        F.col("gender").alias("rejected_gender"),
        F.col("target_gender").alias("chosen_gender"),
        F.col("name").alias("old_name"),
        F.when(F.col("outcome") == "paired", new_name).alias("new_name"),
        F.col("completion").alias("rejected"),
        F.col("swap.text").alias("chosen"),
        F.col("swap.log").alias("swap_log"),
        F.coalesce(F.col("swap.fail"), F.when(F.col("outcome") == "swap_failed", F.lit("no_replacement_name"))).alias("swap_failure"),
        "other_person_flag",
        F.col("messages").alias("prompt"),
    )


def numbered(built: DataFrame, order: tuple[str, ...] = ("occ_ordinal", "template_id", "sample_id"), partitions: int | None = None) -> DataFrame:
    """The pairs with pair_id, dense from 0 in the order of the keys.

    Rows are dealt by ranges of the whole key and sorted within them; a range's first number is the sum of the sizes
    before it. No group is larger than a range, whatever keys repeat their beginnings. Rows of equal keys are numbered as
    they come. The ranges are a work table, so that counts and numbers are of the same rows.
    """
    from ratelens.sources.files import work_table

    spark = built.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = built.filter("outcome = 'paired'").drop("outcome", "swap_failure").repartitionByRange(n, *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    table = work_table(dealt.withColumns({"_range": F.spark_partition_id(), "_place": place}), "numbered")
    sizes = table.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    first = sizes.select("_range", (F.sum("n").over(Window.orderBy("_range")) - F.col("n")).alias("_first"))  # a row a range
    return table.join(F.broadcast(first), "_range").withColumn("pair_id", F.col("_first") + F.col("_place")).drop("_range", "_place", "_first")


def statistics(built: DataFrame) -> DataFrame:
    """Tall counters of one pass: outcomes, failures, directions, occupations."""
    paired = F.col("outcome") == "paired"
    keys = {"outcome": F.col("outcome"), "swap_failure": F.col("swap_failure"), "direction": F.when(paired, F.concat_ws("->", "rejected_gender", "chosen_gender")), "occupation": F.when(paired, F.col("occupation"))}
    some = built.groupBy(*(c.alias(k) for k, c in keys.items())).agg(F.count(F.lit(1)).alias("n"))
    tall = some.select("n", F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(k).alias("key")) for k in keys))).alias("x")).select("x.*", "n")
    return tall.filter("key is not null").groupBy("metric", "key").agg(F.sum("n").alias("n"))


def chat_form(pairs_: DataFrame) -> DataFrame:
    """chosen and rejected as the assistant's message after the prompt's messages."""
    said = lambda c: F.array(F.struct(F.lit("assistant").alias("role"), F.col(c).alias("content"))).alias(c)
    return pairs_.withColumns({c: said(c) for c in ("chosen", "rejected")})


def alarms(built: DataFrame, least: int = 200) -> DataFrame:
    """n_pairs, and whether there are too few."""
    return built.agg(F.sum((F.col("outcome") == "paired").cast("long")).alias("n_pairs")).select(F.coalesce("n_pairs", F.lit(0)).alias("n_pairs")).withColumn("alarm", F.col("n_pairs") < least)
