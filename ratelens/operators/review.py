"""Samples and tables for human review, and seeded subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratelens.functions import text as tx
from ratelens.functions.rng import draw


def sampled(rows: DataFrame, n: int, key: list[str], seed: int = 42, by: list[str] | None = None) -> DataFrame:
    """n rows, or n of each group, by the order of a keyed hash."""
    mark = rows.withColumn("_h", draw(seed, "sample", *map(F.col, key)))
    if by is None:
        return mark.orderBy("_h", *key).limit(n).drop("_h")
    return mark.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("_h", *key))).filter(F.col("_r") <= n).drop("_h", "_r")


def reference_pool(completions: DataFrame, key: list[str], n: int = 200, seed: int = 42) -> DataFrame:
    """Held-out texts that aren't truncated, for perplexity."""
    return sampled(completions.filter("split = 'heldout' and not truncated"), n, key, seed)


def monitor_prompts(prompts: DataFrame, n: int, seed: int = 42) -> DataFrame:
    return sampled(prompts.filter("split = 'train' and template_split = 'train'"), n, ["occupation", "template_id"], seed)


def audit_sheet(pairs: DataFrame, n: int = 25, seed: int = 42) -> DataFrame:
    """Sampled pairs with pronouns highlighted and blank verdict columns."""
    own = sampled(pairs, n, ["pair_id"], seed)
    blank = {c: F.lit("") for c in ("single_character_ok", "pronouns_refer_to_holder", "swap_correct", "chosen_fluent", "notes", "reviewer")}
    return own.select("pair_id", "occupation", F.concat_ws("->", "rejected_gender", "chosen_gender").alias("direction"), tx.highlighted(F.col("rejected")).alias("rejected"), tx.highlighted(F.col("chosen")).alias("chosen")).withColumns(blank)


def audit_rates(sheet: DataFrame, columns: tuple[str, ...] = ("single_character_ok", "pronouns_refer_to_holder", "swap_correct", "chosen_fluent")) -> DataFrame:
    """Yes counts and shares of each verdict."""
    own = sheet.select(F.explode(F.array(*[F.struct(F.lit(c).alias("verdict"), F.lower(F.trim(c)).alias("v")) for c in columns])).alias("x")).select("x.*").filter("v in ('y', 'n')")
    return own.groupBy("verdict").agg(F.sum((F.col("v") == "y").cast("long")).alias("yes"), F.count(F.lit(1)).alias("n"), F.avg((F.col("v") == "y").cast("double")).alias("rate"))


def composition(labelled: DataFrame) -> DataFrame:
    """Counts by occupation, template, gender and flag: one scan, grouping sets."""
    own = labelled.filter("usable").select("occupation", F.col("template_id").cast("string").alias("template"), "gender", F.col("other_person_flag").cast("string").alias("flag"))
    sets = own.groupingSets([["occupation"], ["template"], ["gender"], ["flag"]], "occupation", "template", "gender", "flag").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    what = F.when(F.col("g") == 7, "occupation").when(F.col("g") == 11, "template").when(F.col("g") == 13, "gender").otherwise("flag")
    return sets.select(what.alias("what"), F.coalesce("occupation", "template", "gender", "flag").alias("key"), "n")


def top_names(labelled: DataFrame, k: int = 8) -> DataFrame:
    by = labelled.filter("usable and name is not null").groupBy("gender", "name").agg(F.count(F.lit(1)).alias("n"))
    return by.withColumn("place", F.row_number().over(Window.partitionBy("gender").orderBy(F.desc("n"), "name"))).filter(F.col("place") <= k)


def flip_examples(labelled: DataFrame, base: str, selected: str, n: int = 4) -> DataFrame:
    """Prompts whose text changed gender between two models: the first of each occupation, the first n occupations."""
    key = ["occupation", "template_id", "sample_id"]
    last = Window.partitionBy(*key).orderBy(F.desc("completion"))  # of repeated samples one
    one = lambda tag, name: labelled.filter((F.col("model_tag") == tag) & F.col("usable")).withColumn("_r", F.row_number().over(last)).filter("_r = 1").select(*key, "occ_ordinal", F.col("gender").alias(f"{name}_gender"), F.col("completion").alias(f"{name}_text"))
    both = one(base, "base").join(one(selected, "selected").drop("occ_ordinal"), key).filter("base_gender <> selected_gender")
    first = both.withColumn("_r", F.row_number().over(Window.partitionBy("occupation").orderBy("template_id", "sample_id"))).filter("_r = 1").drop("_r")
    return first.orderBy("occ_ordinal").limit(n).drop("occ_ordinal")


def alarms(labelled: DataFrame, most_truncated: float = 0.15) -> DataFrame:
    """Models with too many truncated texts."""
    return labelled.groupBy("model_tag").agg(F.avg(F.col("truncated").cast("double")).alias("truncated_rate")).withColumn("alarm", F.col("truncated_rate") > most_truncated)
