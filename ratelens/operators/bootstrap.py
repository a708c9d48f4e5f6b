"""Bootstrap intervals as DataFrame plans.

Outcomes are 0/1, so resampling n texts of which f are hits is one binomial draw: only counts per model, cell
and occupation are needed, never texts. These few rows are made first and held by the driver: 20 coded
occupations for each model and cell. Draws are keyed by md5, so a replicate doesn't depend on the order of
rows, and two models of one comparison can share the draw of occupations. Every binomial is drawn by inversion
of its exact distribution from one uniform of 52 bits, at every size: the distribution's table of (n, f) holds
all outcomes whose chance the uniform can meet, some twenty standard deviations, and a draw is a binary search.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratelens.functions import text as tx
from ratelens.functions.rng import draw, uniform
from ratelens.operators import dims

#: Outcomes on each side of the mean in a binomial's table: SPREAD standard deviations and LEAST_SPREAD more. By
#: Bernstein's bound less than 2 ** -70 lies beyond.
SPREAD, LEAST_SPREAD = 10, 40
LEAST_TEXTS = 30


def held(stats: DataFrame) -> DataFrame:
    """The same few rows without the plan that made them."""
    return stats.sparkSession.createDataFrame(stats.collect(), stats.schema)


def distributions(counts: DataFrame) -> DataFrame:
    """n, f, least, cdf of each pair (n, f): Binomial(n, f / n) from the outcome ``least`` on, as running sums."""
    n, f, k = (F.col(c) for c in "nfk")
    apart = F.when((f > 0) & (f < n), F.ceil(SPREAD * F.sqrt(f.cast("double") * (n - f) / n)) + LEAST_SPREAD).otherwise(0).cast("long")
    rows = counts.select("n", "f").distinct().withColumn("k", F.explode(F.sequence(F.greatest(f - apart, F.lit(0).cast("long")), F.least(f + apart, n))))
    own = Window.partitionBy("n", "f")
    up = own.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ratio = F.when(k == F.min(k).over(own), 0.0).otherwise(F.ln((n - k + 1).cast("double") / k * (f.cast("double") / (n - f))))  # of an outcome to the one before
    rows = rows.withColumn("ratio", ratio).withColumn("log_p", F.sum("ratio").over(up))
    rows = rows.withColumn("p", F.exp(F.col("log_p") - F.max(F.when(k == f, F.col("log_p"))).over(own)))  # to the mean, which is the likeliest
    rows = rows.withColumn("below", F.sum("p").over(up) / F.sum("p").over(own))
    return rows.groupBy("n", "f").agg(F.min("k").alias("least"), F.transform(F.array_sort(F.collect_list(F.struct("k", "below"))), lambda x: x["below"]).alias("cdf"))


def outcome(least: Column, cdf: Column, u: Column) -> Column:
    """The outcome at which a distribution passes u: a binary search."""
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(cdf) + 1)).cast("int"))

    def half(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        go = F.coalesce(F.get(cdf, mid) <= u, F.lit(False))
        open_ = s["lo"] < s["hi"]
        return F.struct(F.when(open_ & go, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(open_ & ~go, mid).otherwise(s["hi"]).alias("hi"))

    found = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(cdf).alias("hi")), half, lambda s: s["lo"])
    return least + F.least(found, F.size(cdf) - 1)


def resampled(rows: DataFrame, times: str, *key: Column | str | int) -> DataFrame:
    """Each row with columns n and f once for every element of the array ``times``, with the element's fields and hits.

    The key of a draw is followed by these fields.
    """
    fields = rows.schema[times].dataType.elementType.names
    dealt = rows.join(distributions(rows), ["n", "f"]).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # the rows are few, what follows is not
    with_u = F.transform(times, lambda t: F.struct(*[t[c].alias(c) for c in fields], uniform(*key, *[t[c] for c in fields]).alias("u")))
    drawn = F.transform(with_u, lambda t: F.struct(*[t[c].alias(c) for c in fields], outcome(F.col("least"), F.col("cdf"), t["u"]).alias("hits")))
    return dealt.select(*[c for c in rows.columns if c != times], F.inline(drawn))


def occupation_stats(labelled: DataFrame, cells: DataFrame) -> DataFrame:
    """model_tag, cell, stereotype, occupation, n, f over usable texts of coded occupations."""
    counts = labelled.filter("usable and stereotype <> 'balanced'").groupBy("model_tag", "split", "template_split", "stereotype", "occupation").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("gender") == "female").cast("long")).alias("f"))
    return counts.join(F.broadcast(cells), ["split", "template_split"]).groupBy("model_tag", "cell", "stereotype", "occupation").agg(F.sum("n").alias("n"), F.sum("f").alias("f"))  # cells: a dozen rows


def point_gaps(stats: DataFrame, by: list[str]) -> DataFrame:
    side = lambda s, c: F.sum(F.when(F.col("stereotype") == s, F.col(c)))
    k = lambda s: F.count(F.when(F.col("stereotype") == s, 1))
    out = stats.groupBy(*by).agg(side("female", "f").alias("ff"), side("female", "n").alias("n_female_coded"), side("male", "f").alias("mf"), side("male", "n").alias("n_male_coded"), k("female").alias("k_female"), k("male").alias("k_male"))
    return out.withColumn("gap", F.col("ff") / F.col("n_female_coded") - F.col("mf") / F.col("n_male_coded")).drop("ff", "mf")


def flat(stats: DataFrame, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """Texts resampled on each side. Limits are order statistics int(.025 B) and int(.975 B) - 1, not interpolated."""
    stats = held(stats)
    sides = stats.groupBy("model_tag", "cell", "stereotype").agg(F.sum("n").alias("n"), F.sum("f").alias("f"))
    reps = sides.withColumn("times", F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), lambda r: F.struct(r.alias("rep"))))
    drawn = resampled(reps, "times", seed, "flat", F.col("model_tag"), F.col("cell"), F.col("stereotype"))
    side = lambda s, c: F.sum(F.when(F.col("stereotype") == s, F.col(c)))
    gaps = drawn.groupBy("model_tag", "cell", "rep").agg((side("female", "hits") / side("female", "n") - side("male", "hits") / side("male", "n")).alias("g"))
    ordered = F.array_sort(F.collect_list("g"))  # replicates of them at most
    low, high = int(0.025 * replicates), int(0.975 * replicates) - 1
    full = F.size(ordered) == replicates
    limits = gaps.groupBy("model_tag", "cell").agg(F.when(full, F.get(ordered, F.lit(low))).alias("ci_low"), F.when(full, F.get(ordered, F.lit(high))).alias("ci_high"))
    return point_gaps(stats, ["model_tag", "cell"]).select("model_tag", "cell", "gap", "n_female_coded", "n_male_coded").join(limits, ["model_tag", "cell"], "left")


def replicate_gaps(stats: DataFrame, replicates: int, seed: int) -> DataFrame:
    """unit, model_tag, cell, rep, gap: occupations drawn for each unit and cell, then texts within each drawn copy.

    The draw of occupations doesn't know the model, so the models of a unit share it; an occupation that a model
    lacks adds nothing to it.
    """
    of = ["unit", "cell", "stereotype"]
    known = stats.select(*of, "occupation").distinct()
    known = known.withColumns({"k": F.row_number().over(Window.partitionBy(*of).orderBy("occupation")) - 1, "size": F.count(F.lit(1)).over(Window.partitionBy(*of))})
    slots = known.select(*of, "size").distinct().withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)))
    picks = slots.withColumn("k", (draw(seed, "pick", F.col("cell"), F.col("stereotype"), F.col("rep"), F.col("slot")) % F.col("size")).cast("int")).drop("size")
    picked = picks.groupBy(*of, "k").agg(F.collect_list(F.struct("rep", "slot")).alias("times"))  # replicates times occupations at most
    drawn = picked.join(known.drop("size"), [*of, "k"]).join(stats, [*of, "occupation"]).drop("k", "occupation")
    drawn = resampled(drawn, "times", seed, "text", F.col("model_tag"), F.col("cell"), F.col("stereotype"))
    side = lambda s, c: F.sum(F.when(F.col("stereotype") == s, F.col(c)))
    return drawn.groupBy("unit", "model_tag", "cell", "rep").agg((side("female", "hits") / side("female", "n") - side("male", "hits") / side("male", "n")).alias("gap"))


def contrasts(stats: DataFrame, units: DataFrame, replicates: int = 2000, seed: int = 42) -> DataFrame:
    """unit, cell, diff, ci_low, ci_high, n_replicates of sums of models' gaps.

    units: unit, model_tag, coef. Replicates in which a model has an empty side are dropped. Limits are
    interpolated percentiles; they are null unless every model has two occupations on each side.
    """
    own = held(stats.join(F.broadcast(units), "model_tag"))  # a few rows for each comparison
    size = units.groupBy("unit").agg(F.count(F.lit(1)).alias("models"))
    points = point_gaps(own, ["unit", "model_tag", "coef", "cell"])
    whole = points.groupBy("unit", "cell").agg(F.sum(F.col("coef") * F.col("gap")).alias("diff"), F.count("gap").alias("found"), F.min(F.least("k_female", "k_male")).alias("k"), F.min(F.least("n_female_coded", "n_male_coded")).alias("least"))
    reps = replicate_gaps(own.drop("coef"), replicates, seed).join(F.broadcast(units), ["unit", "model_tag"])
    sums = reps.groupBy("unit", "cell", "rep").agg(F.sum(F.col("coef") * F.col("gap")).alias("v"), F.count("gap").alias("found")).join(F.broadcast(size), "unit").filter("found = models")
    limits = sums.groupBy("unit", "cell").agg(F.percentile("v", F.array(F.lit(0.025), F.lit(0.975))).alias("ci"), F.count(F.lit(1)).alias("n_replicates"))
    out = whole.join(F.broadcast(size), "unit").join(limits, ["unit", "cell"], "left")
    ok = (F.col("found") == F.col("models")) & (F.col("k") >= 2)
    return out.select("unit", "cell", F.when(F.col("found") == F.col("models"), F.col("diff")).alias("diff"), F.when(ok, F.col("ci")[0]).alias("ci_low"), F.when(ok, F.col("ci")[1]).alias("ci_high"), F.coalesce(F.col("least") >= LEAST_TEXTS, F.lit(False)).alias("interpretable"))


def units_of(spark: SparkSession, rows: list[tuple[str, str, float]]) -> DataFrame:
    return spark.createDataFrame(rows, "unit string, model_tag string, coef double")


def cluster(spark: SparkSession, labelled: DataFrame, tags: tuple[str, ...], replicates: int = 2000, seed: int = 42, cells=(*dims.CELLS, ("all", None, None))) -> DataFrame:
    """The gap of each model and cell."""
    return contrasts(occupation_stats(labelled, dims.cells(spark, cells)), units_of(spark, [(t, t, 1.0) for t in tags]), replicates, seed)


def paired(spark: SparkSession, labelled: DataFrame, pairs: tuple[tuple[str, str], ...], replicates: int = 2000, seed: int = 42, cells=dims.PAIRED_CELLS) -> DataFrame:
    """The gap of the second model less that of the first."""
    rows = [r for a, b in pairs for r in ((f"{b}-{a}", b, 1.0), (f"{b}-{a}", a, -1.0))]
    return contrasts(occupation_stats(labelled, dims.cells(spark, cells)), units_of(spark, rows), replicates, seed)


def trajectory(spark: SparkSession, labelled: DataFrame, tags: tuple[str, ...], replicates: int = 2000, seed: int = 42) -> DataFrame:
    """step, cell, gap, its limits and whether to interpret it, of the tags that are training steps; empty gaps are left out."""
    out = cluster(spark, labelled, tuple(t for t in tags if not t.endswith("_4bit")), replicates, seed)
    return out.filter("diff is not null").select(tx.tag_step(F.col("unit")).alias("step"), "cell", F.col("diff").alias("gap"), "ci_low", "ci_high", "interpretable").filter("step is not null")


def interaction(spark: SparkSession, labelled: DataFrame, base: str, selected: str, base_4bit: str, selected_4bit: str, replicates: int = 2000, seed: int = 42) -> DataFrame:
    """(selected_4bit - selected) - (base_4bit - base), train occupations, all templates; null where a side is empty."""
    rows = [("interaction", selected_4bit, 1.0), ("interaction", selected, -1.0), ("interaction", base_4bit, -1.0), ("interaction", base, 1.0)]
    cells = (("train_occ|all_tmpl", "train", None),)
    return contrasts(occupation_stats(labelled, dims.cells(spark, cells)), units_of(spark, rows), replicates, seed)
