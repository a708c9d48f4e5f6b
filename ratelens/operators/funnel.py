"""The labelling funnel: text-level reasons, then name-level reasons for the survivors, and its reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratelens.functions import text as tx


def labelled_by_text(records: DataFrame, least_pronouns: int = 2, legacy: bool = False) -> DataFrame:
    """Adds n_male, n_female, reason, gender, other_person_flag, usable: JVM columns only, one pass.

    Rows with a text-level reason have a null gender and no flag.
    """
    counted = records.withColumns({f"n_{g}": tx.pronoun_count(F.coalesce("completion", F.lit("")), g) for g in ("male", "female")})
    out = counted.withColumn("reason", tx.exclusion_reason(F.col("completion"), F.col("truncated"), F.col("n_male"), F.col("n_female"), least_pronouns, legacy))
    clean = F.col("reason").isNull()
    return out.withColumns({"gender": F.when(clean, tx.gender_of(F.col("n_male"), F.col("n_female"))), "other_person_flag": clean & tx.other_person(F.col("completion")), "usable": clean})


def labelled(records: DataFrame, least_pronouns: int = 2, names: dict[str, str] | None = None) -> DataFrame:
    """labelled_by_text with name, name_gender and the name-level reasons.

    Only texts that survive are looked at for names: the others give a null, which costs nothing.
    """
    from ratelens.operators.words import with_people

    out = labelled_by_text(records, least_pronouns)
    out = with_people(out, F.when(F.col("reason").isNull(), F.col("completion")), "_who", names)
    one = F.col("_who")
    reason = (
        F.when(F.col("reason").isNotNull(), F.col("reason"))
        .when(one["n"] == 0, "no_name")
        .when(one["n"] > 1, "multi_person")
        .when(one["gender"].isNull(), "unknown_name")
        .when((one["gender"] != "unisex") & (one["gender"] != F.col("gender")), "name_pronoun_mismatch")
    )
    return out.withColumns({"name": one["name"], "name_gender": one["gender"], "reason": reason}).withColumn("usable", F.col("reason").isNull()).drop("_who")


def train_cell(columns: bool = True) -> Column:
    return (F.col("split") == "train") & (F.col("template_split") == "train")


def funnel(labelled_: DataFrame) -> DataFrame:
    """Tall counters: total, usable and excluded_<reason>, of one pass over the texts."""
    by = labelled_.groupBy(F.coalesce(F.concat(F.lit("excluded_"), "reason"), F.lit("usable")).alias("metric")).agg(F.count(F.lit(1)).alias("n"))
    # one row a reason goes on; rolled up, and a total of no texts is a row too
    return by.rollup("metric").agg(F.sum("n").alias("n")).select(F.coalesce("metric", F.lit("total")).alias("metric"), F.coalesce("n", F.lit(0)).alias("n"))


def reasons_by_model(labelled_: DataFrame) -> DataFrame:
    return labelled_.groupBy("model_tag", F.coalesce("reason", F.lit("usable")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def funnel_by_template(labelled_: DataFrame, top: int = 5) -> DataFrame:
    """Share of usable texts and the reasons among the top most frequent outcomes of each template; usable itself takes a place."""
    by = labelled_.groupBy("template_id", F.coalesce("reason", F.lit("usable")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("template_id")
    ranked = by.withColumns({"place": F.row_number().over(own.orderBy(F.desc("n"), "reason")), "usable_rate": F.sum(F.when(F.col("reason") == "usable", F.col("n")).otherwise(0)).over(own) / F.sum("n").over(own)})
    return ranked.filter((F.col("place") <= top) & (F.col("reason") != "usable")).select("template_id", "usable_rate", "reason", "n")


def without_non_latin(labelled_: DataFrame) -> DataFrame:
    """Usable texts with non-Latin letters get a reason of their own."""
    now = F.when(F.col("reason").isNull() & tx.non_latin(F.col("completion")), F.lit("non_latin")).otherwise(F.col("reason"))
    return labelled_.withColumn("reason", now).withColumn("usable", F.col("reason").isNull())
