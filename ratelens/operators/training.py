"""Around training: the stratified split, checkpoint selection, the monitor's early stop, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratelens.functions import text as tx
from ratelens.functions.rng import draw
from ratelens.sources.files import work_table

GUARD = 0.10


#: Strata up to so many have their cuts broadcast; more are joined by a shuffle.
BROADCAST_STRATA = 100_000


def stratified_split(pairs: DataFrame, key: list[str], stratum: str = "occupation", fraction: float = 0.1, seed: int = 42, bits: int = 12) -> DataFrame:
    """Adds part: eval for round-half-even(fraction n) rows of each stratum, at least one where n >= 5, by hash order.

    A stratum is never gathered: counts by the hash's first bits, summed up, say which of their buckets holds the last
    row to take; only that bucket's rows are ranked, and every other row compares its hash and key with the cut. Rows that
    repeat a key fall on the same side.
    """
    rows = pairs.withColumn("_h", draw(seed, "split", *map(F.col, key)))
    bucket = F.shiftright("_h", 32 - bits)
    counts = rows.groupBy(F.col(stratum).alias("_s"), bucket.alias("_b")).agg(F.count(F.lit(1)).alias("m"))
    own = Window.partitionBy("_s")
    counts = counts.withColumns({"n": F.sum("m").over(own), "upto": F.sum("m").over(own.orderBy("_b"))})  # at most 2 ** bits rows a stratum
    k = F.bround(F.lit(float(fraction)) * F.col("n")).cast("long")
    k = F.when((k == 0) & (F.col("n") >= 5) & F.lit(fraction > 0), 1).otherwise(k)
    edge = counts.withColumn("k", k).filter((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("m") < F.col("k")))
    edge = work_table(edge.select("_s", "_b", (F.col("k") - F.col("upto") + F.col("m")).alias("take")), "split-edges")
    few = edge.count() <= BROADCAST_STRATA
    small = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    at = rows.withColumn("_b", bucket).join(small(edge.withColumnRenamed("_b", "_e")), F.col(stratum).eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_e")))
    place = F.struct("_h", *key)
    last = at.select("_s", "take", place.alias("cut")).withColumn("_r", F.row_number().over(own.orderBy("cut"))).filter("_r = take").select("_s", "cut")
    joined = rows.join(small(last), F.col(stratum).eqNullSafe(F.col("_s")), "left")
    return joined.withColumn("part", F.when(place <= F.col("cut"), "eval").otherwise("train")).drop("_h", "_s", "cut")


def select_checkpoint(summary: DataFrame, guard: float = GUARD) -> DataFrame:
    """One row: the step of smallest absolute gap, the earliest of equals, among those whose usable rate isn't lower than base's by more than the guard; null if none."""
    base = summary.filter("model_tag = 'base'").select(F.col("usable_rate").alias("base_usable"))
    steps = summary.withColumn("step", tx.tag_step(F.col("model_tag"))).filter("step > 0 and gap is not null")
    ok = steps.join(F.broadcast(base), F.col("usable_rate") >= F.col("base_usable") - guard)  # one row
    return ok.agg(F.min_by("model_tag", F.struct(F.abs("gap"), F.col("step"))).alias("selected"))


def early_stop(log: DataFrame, drop: float = GUARD, by: list[str] | None = None) -> DataFrame:
    """Adds strike and stop to rows (step, usable_rate): a strike lies more than drop below the first step; the second in a row stops.

    by: runs, each of which has few steps.
    """
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy("step")
    strike = F.col("usable_rate") < F.first_value("usable_rate").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - drop
    out = log.withColumn("strike", strike & (F.row_number().over(order) > 1))
    two = out.withColumn("two", F.col("strike") & F.coalesce(F.lag("strike").over(order), F.lit(False)))
    first = F.min(F.when(F.col("two"), F.col("step"))).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return two.withColumn("stop", F.coalesce(F.col("step") == first, F.lit(False))).drop("two")


def pooled_perplexity(loss: Column, k: Column) -> Column:
    """exp of the k-weighted mean loss; null without weight."""
    return F.exp(F.sum(loss * k) / F.nullif(F.sum(k), F.lit(0.0)))


def costs(rows: DataFrame, by: list[str]) -> DataFrame:
    """Tokens per second and Wh per thousand tokens, null where time or energy is missing, of rows (tokens, seconds, kwh, usable)."""
    out = rows.groupBy(*by).agg(F.sum("tokens").alias("tokens"), F.sum("seconds").alias("seconds"), F.sum("kwh").alias("kwh"), F.sum("usable").alias("n_usable"))
    wh = F.nullif(F.col("kwh"), F.lit(0.0)) * 1000.0
    return out.select(*by, "tokens", (F.col("tokens") / F.nullif(F.col("seconds"), F.lit(0.0))).alias("tokens_per_s"), (wh / (F.nullif(F.col("tokens"), F.lit(0)) / 1000.0)).alias("wh_per_1k_tokens"), (wh / F.nullif(F.col("n_usable"), F.lit(0))).alias("wh_per_usable"))


def energy_kwh(begin: Column, end: Column) -> Column:
    """From counters in joules."""
    return F.sum(end - begin) / 3.6e6


def net_of_monitor(total: Column, monitor: Column) -> Column:
    return total - F.coalesce(monitor, F.lit(0.0))


def generated_length(ids: Column, eos: int) -> tuple[Column, Column]:
    """Tokens up to and with the first end token, and whether there is none."""
    at = F.array_position(ids, F.lit(eos))
    return F.when(at > 0, at).otherwise(F.size(ids)).cast("int"), at == 0
