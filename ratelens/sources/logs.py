"""Training reports whose entries differ from each other, as VARIANT values: nothing is lost, nothing is declared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """report: one JSON document a line, whatever its fields."""
    return spark.read.option("singleVariantColumn", "report").json(path)


def field(value: Column, path: str, kind: str) -> Column:
    """A field of a VARIANT, null where it is absent or can't be read as that type."""
    return F.try_variant_get(value, path, kind)


def entries(reports: DataFrame, *keep: Column, history: str = "$.log_history") -> DataFrame:
    """The kept columns, place and entry of each element of a report's history, in its order; none for a report without one."""
    listed = field(F.col("report"), history, "array<variant>")
    return reports.select(*keep, F.posexplode(listed).alias("place", "entry"))


def evaluations(entries_: DataFrame, *keep: str) -> DataFrame:
    """The kept columns, step and eval_loss of the entries that are evaluations."""
    own = entries_.select(*keep, field(F.col("entry"), "$.step", "int").alias("step"), field(F.col("entry"), "$.eval_loss", "double").alias("eval_loss"))
    return own.filter("eval_loss is not null")


def entry_schema(entries_: DataFrame) -> str:
    """The fields and types that occur among the entries that are objects."""
    return entries_.filter(F.schema_of_variant("entry").startswith("OBJECT")).agg(F.schema_of_variant_agg("entry")).first()[0]


def numbers(value: Column) -> Column:
    """A VARIANT object as a map of numbers; fields that aren't numbers are null."""
    return value.cast("map<string,variant>")


def carbon(reports: DataFrame, *keep: Column, at: str = "$.carbon", keys: tuple[str, ...] = ("actual", "pred", "components")) -> DataFrame:
    """The kept columns, key and value of a report's carbon log: what was measured, predicted, and the components."""
    own = reports.select(*keep, F.explode(F.map_filter(numbers(field(F.col("report"), at, "variant")), lambda k, _: k.isin(*keys))).alias("key", "v"))
    return own.select(*[c for c in own.columns if c not in ("key", "v")], "key", field(F.col("v"), "$", "double").alias("value"))
