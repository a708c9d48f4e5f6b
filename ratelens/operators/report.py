"""What reports are made of: tags, sorted tables, parts of logs and rows put side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratelens.functions import text as tx
from ratelens.operators import metrics
from ratelens.sources import files

RECORD = ["occupation", "template_id", "sample_id"]


def quantised_tag(tag: Column) -> Column:
    """A merged quantised model goes by the name of the quantised one."""
    return F.regexp_replace(tag, "_4bit_merged$", "_4bit")


def with_analysis(raw: DataFrame, analysis: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Raw records with what their analysis says, joined by record; columns that both have are the raw record's."""
    key = key or RECORD
    return raw.join(analysis.select(*key, *[c for c in analysis.columns if c not in raw.columns]), key)


def excerpt(text: Column, most: int = 200) -> Column:
    return F.substring(text, 1, most)


def examples(labelled: DataFrame, by: str, n: int = 4, most: int = 200) -> DataFrame:
    """The first n texts of each step, cut to a length that a log can hold."""
    order = Window.partitionBy(by).orderBy("occ_ordinal", "template_id", "sample_id")
    first = labelled.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n)
    return first.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", excerpt(F.col("completion"), most).alias("text")))), lambda x: x["text"]).alias("examples"))


def evaluations(history: DataFrame, column: str = "log_history") -> DataFrame:
    """step and eval_loss of the entries of a training log that are evaluations."""
    entries = history.select(F.explode(column).alias("e"))
    return entries.filter("e.eval_loss is not null").select("e.step", "e.eval_loss")


def carbon(log: Column) -> Column:
    """Of a carbon log what was measured, what was predicted, and the components."""
    return F.map_filter(log, lambda k, _: k.isin("actual", "pred", "components"))


def funnel_table(counters: DataFrame) -> DataFrame:
    """Counters with the most frequent first, and their place."""
    order = Window.orderBy(F.desc("n"), "metric")
    return counters.withColumn("place", F.row_number().over(order))  # one row a reason


def calibration_table(calibrated: DataFrame) -> DataFrame:
    order = Window.orderBy("stereotype", "occupation")
    return calibrated.withColumn("place", F.row_number().over(order))  # one row an occupation


def occupation_order(per: DataFrame) -> DataFrame:
    """Occupations by stereotype, split and name, within each model."""
    return per.withColumn("place", F.row_number().over(Window.partitionBy("model_tag").orderBy("stereotype", "split", "occupation")))


def all_splits(labelled: DataFrame) -> DataFrame:
    """The baseline review: gap and sizes of each cell, of each split over all templates, and of everything."""
    sides = metrics.usable(labelled).filter("stereotype <> 'balanced'").withColumns({s[0]: F.when(F.col("stereotype") == s, (F.col("gender") == "female").cast("double")) for s in ("female", "male")})
    out = sides.groupingSets([["model_tag", "split", "template_split"], ["model_tag", "split"], ["model_tag"]], "model_tag", "split", "template_split").agg((F.avg("f") - F.avg("m")).alias("gap"), F.count("f").alias("n_female_coded"), F.count("m").alias("n_male_coded"))
    return out.select("model_tag", F.coalesce("split", F.lit("all")).alias("split"), F.coalesce("template_split", F.lit("all")).alias("template_split"), "gap", "n_female_coded", "n_male_coded")


def model_table(labelled: DataFrame) -> str:
    """All models' quality as Markdown, full precision first, by step."""
    ordered = metrics.quality(labelled).orderBy(*tx.model_order(F.col("model_tag")), "model_tag")
    return files.markdown(ordered.select("model_tag", "n", "usable_rate", "gendered_rate", "first_person_rate", "non_latin_rate", "mean_new_tokens"))


def interval_table(contrasts: DataFrame) -> str:
    """Differences with their intervals as Markdown; those of too few texts in brackets."""
    rows = contrasts.orderBy("unit", "cell").collect()  # a row a comparison and cell
    lines = ["| comparison | cell | difference |", "|---|---|---|"]
    return "\n".join([*lines, *(f"| {r['unit']} | {r['cell']} | {files.fmt_interval(r['diff'], r['ci_low'], r['ci_high'], r['interpretable'])} |" for r in rows)])


def number_text(x: Column, signed: bool = True) -> Column:
    """Two decimals, rounded half to even, with a sign; n/a for null."""
    return F.when(x.isNull(), "n/a").otherwise(F.format_string("%+.2f" if signed else "%.2f", F.bround(x, 2) + 0.0))


def interval_text(point: Column, low: Column, high: Column, interpretable: Column) -> Column:
    """+0.61 [+0.52, +0.70]; in brackets where it isn't to be interpreted."""
    whole = F.when(point.isNull() | low.isNull() | high.isNull(), number_text(point)).otherwise(F.concat(number_text(point), F.lit(" ["), number_text(low), F.lit(", "), number_text(high), F.lit("]")))
    return F.when(interpretable | point.isNull(), whole).otherwise(F.concat(F.lit("("), whole, F.lit(")")))
