"""Rate gaps and quality figures, for all models in one job.

A gap is the female share over female-coded occupations less that over male-coded ones, pooled over texts;
null where either side is empty. The aggregates below take labelled texts, of which they use usable rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens.functions import text as tx
from ratelens.operators import dims


def share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def p_female() -> Column:
    return share(F.col("gender") == "female")


def gap() -> Column:
    of = lambda s: F.avg(F.when(F.col("stereotype") == s, (F.col("gender") == "female").cast("double")))
    return of("female") - of("male")


def usable(labelled: DataFrame) -> DataFrame:
    return labelled.filter("usable")


def bias_cells(labelled: DataFrame) -> DataFrame:
    return usable(labelled).groupBy("model_tag", "stereotype", "split", "template_split").agg(F.count(F.lit(1)).alias("n"), p_female().alias("p_female"))


def gap_grid(labelled: DataFrame) -> DataFrame:
    """Gap and sizes of each grid cell and of all texts, by grouping sets over one aggregate of counts."""
    sides = usable(labelled).filter(F.col("stereotype") != "balanced").withColumns({"f": F.when(F.col("stereotype") == "female", (F.col("gender") == "female").cast("double")), "m": F.when(F.col("stereotype") == "male", (F.col("gender") == "female").cast("double"))})
    grid = sides.groupingSets([["model_tag", "split", "template_split"], ["model_tag"]], "model_tag", "split", "template_split").agg((F.avg("f") - F.avg("m")).alias("gap"), F.count("f").alias("n_female_coded"), F.count("m").alias("n_male_coded"), F.grouping_id().alias("level"))
    cell = F.when(F.col("level") > 0, "all").otherwise(F.concat("split", F.lit("_occ|"), "template_split", F.lit("_tmpl")))
    return grid.select("model_tag", cell.alias("cell"), "gap", "n_female_coded", "n_male_coded")


def control(labelled: DataFrame) -> DataFrame:
    own = usable(labelled).filter((F.col("stereotype") == "balanced") & (F.col("split") == "heldout"))
    return own.groupBy("model_tag").agg(p_female().alias("p_female"), F.count(F.lit(1)).alias("n"))


def per_occupation(labelled: DataFrame) -> DataFrame:
    return usable(labelled).groupBy("model_tag", "occupation").agg(F.count(F.lit(1)).alias("n"), p_female().alias("p_female"), F.min("stereotype").alias("stereotype"), F.min("split").alias("split"))


def parity_distance(labelled: DataFrame, least: int = 5) -> DataFrame:
    """Mean distance from one half over coded occupations with at least so many usable texts."""
    own = per_occupation(labelled).filter((F.col("stereotype") != "balanced") & (F.col("n") >= least))
    return own.groupBy("model_tag").agg(F.avg(F.abs(F.col("p_female") - 0.5)).alias("parity_distance"), F.count(F.lit(1)).alias("n_occupations"))


def quality(labelled: DataFrame) -> DataFrame:
    """Rates over all texts, usable or not. First person counts inside quotes too; see the monitor for another."""
    text = F.coalesce("completion", F.lit(""))
    return labelled.groupBy("model_tag").agg(
        F.count(F.lit(1)).alias("n"), share(F.col("usable")).alias("usable_rate"), share(F.col("n_male") + F.col("n_female") > 0).alias("gendered_rate"), share(tx.first_person_anywhere(text)).alias("first_person_rate"), share(tx.non_latin(text)).alias("non_latin_rate"), F.avg("n_new_tokens").alias("mean_new_tokens"), share(F.col("truncated")).alias("truncated_rate"),
    )


def usable_by_group(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("model_tag", "stereotype").agg(share(F.col("usable")).alias("usable_rate"), F.count(F.lit(1)).alias("n"))


def monitor_metrics(labelled: DataFrame, step: str = "step") -> DataFrame:
    """What the training monitor logs at each step. Its first-person rate counts excluded texts of that reason."""
    ok = F.col("usable")
    of = lambda s: F.avg(F.when(ok & (F.col("stereotype") == s), (F.col("gender") == "female").cast("double")))
    return labelled.groupBy(step).agg(F.count(F.lit(1)).alias("n"), share(ok).alias("usable_rate"), share(F.col("n_male") + F.col("n_female") > 0).alias("gendered_pronoun_rate"), share(F.coalesce(F.col("reason") == "first_person", F.lit(False))).alias("first_person_rate"), (of("female") - of("male")).alias("gap"), F.sum(ok.cast("long")).alias("n_usable"))


def rate_gap(rows: DataFrame, outcome: Column, positive: Column, negative: Column, by: list[str]) -> DataFrame:
    """The generic form: difference of a 0/1 outcome's rate between two groups, by some columns."""
    side = lambda c: F.avg(F.when(c, outcome.cast("double")))
    return rows.groupBy(*by).agg((side(positive) - side(negative)).alias("gap"), F.count(F.when(positive & outcome.isNotNull(), 1)).alias("n_positive"), F.count(F.when(negative & outcome.isNotNull(), 1)).alias("n_negative"))


def gap_summary(labelled: DataFrame) -> DataFrame:
    """Per model what checkpoint selection needs: usable rate and the gap of the training cell."""
    cell = F.col("usable") & (F.col("split") == "train") & (F.col("template_split") == "train")
    of = lambda s: F.avg(F.when(cell & (F.col("stereotype") == s), (F.col("gender") == "female").cast("double")))
    return labelled.groupBy("model_tag").agg(share(F.col("usable")).alias("usable_rate"), (of("female") - of("male")).alias("gap"))


def large_movers(labelled: DataFrame, one: str, two: str, least: float = 0.25) -> DataFrame:
    """Occupations that both models have and whose share moved by at least so much."""
    per = per_occupation(labelled)
    a = per.filter(F.col("model_tag") == one).select("occupation", F.col("p_female").alias("p_one"))
    b = per.filter(F.col("model_tag") == two).select("occupation", F.col("p_female").alias("p_two"))
    return a.join(b, "occupation").withColumn("delta", F.col("p_two") - F.col("p_one")).filter(F.abs("delta") >= least)


def trajectory(labelled: DataFrame) -> DataFrame:
    """Gap by training step and cell, quantised tags and empty gaps left out."""
    return gap_grid(labelled).withColumn("step", tx.tag_step(F.col("model_tag"))).filter("step is not null and gap is not null").select("step", "cell", "gap")


def occupation_table(spark, labelled: DataFrame) -> DataFrame:
    """Every occupation against every model, with a dash where a model has none of it."""
    tags = labelled.select("model_tag").distinct()
    grid = dims.occupations(spark).select("occupation", "stereotype", "split").crossJoin(F.broadcast(tags))  # 25 rows by the models
    found = per_occupation(labelled).select("model_tag", "occupation", "p_female")
    return grid.join(found, ["model_tag", "occupation"], "left").select("model_tag", "occupation", "stereotype", "split", F.coalesce(F.format_number("p_female", 2), F.lit("–")).alias("shown"))


def documents(labelled: DataFrame) -> DataFrame:
    """One row a model with nested maps: cells ("stereotype|split|template split" to n and p_female), gap (cell to gap and counts) and per_occupation.

    All three come of one count of usable texts by model, occupation, template split and gender.
    """
    keys = ["model_tag", "occupation", "stereotype", "split", "template_split"]
    female = F.sum((F.col("gender") == "female").cast("long"))
    counts = labelled.filter("usable").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), female.alias("f"))
    rate = lambda by: counts.groupBy("model_tag", *by).agg(F.sum("n").alias("n"), (F.sum("f") / F.sum("n")).alias("p_female"))
    as_map = lambda key, value, name: F.map_from_entries(F.array_sort(F.collect_list(F.struct(key.alias("k"), value.alias("v"))))).alias(name)
    cells = rate(["stereotype", "split", "template_split"]).groupBy("model_tag").agg(as_map(F.concat_ws("|", "stereotype", "split", "template_split"), F.struct("n", "p_female"), "cells"))
    occupations = rate(["occupation", "stereotype", "split"]).groupBy("model_tag").agg(as_map(F.col("occupation"), F.struct("n", "p_female", "stereotype", "split"), "per_occupation"))
    side = lambda s, c: F.sum(F.when(F.col("stereotype") == s, F.col(c)))
    sums = counts.groupBy("model_tag", "split", "template_split").agg(*(side(s, c).alias(f"{s}_{c}") for s in ("female", "male") for c in "nf"))
    both = sums.groupingSets([["model_tag", "split", "template_split"], ["model_tag"]], "model_tag", "split", "template_split").agg(*(F.sum(f"{s}_{c}").alias(f"{s}_{c}") for s in ("female", "male") for c in "nf"))
    cell = F.when(F.col("split").isNull(), "all").otherwise(F.concat(F.col("split"), F.lit("_occ|"), F.col("template_split"), F.lit("_tmpl")))
    gap = F.col("female_f") / F.col("female_n") - F.col("male_f") / F.col("male_n")
    gaps = both.groupBy("model_tag").agg(as_map(cell, F.struct(gap.alias("gap"), F.col("female_n").alias("n_female_coded"), F.col("male_n").alias("n_male_coded")), "gap"))
    return cells.join(gaps, "model_tag").join(occupations, "model_tag")


DOCUMENT = "cells map<string,struct<n:long,p_female:double>>, gap map<string,struct<gap:double,n_female_coded:long,n_male_coded:long>>, per_occupation map<string,struct<n:long,p_female:double,stereotype:string,split:string>>"
