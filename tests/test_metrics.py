import math

import pytest
from pyspark.sql import functions as F

from ratelens.operators import bootstrap, dims, legacy, metrics, pairs, review, training

ROWS = [("nurse", "female", 18, 2), ("teacher", "female", 16, 4), ("engineer", "male", 2, 18), ("plumber", "male", 4, 16)]


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(tag, o, s, "train", "train", 0, i, "female" if i < f else "male", True) for tag in ("base", "step10") for o, s, f, m in ROWS for i in range(f + m)]
    return spark.createDataFrame(rows, "model_tag string, occupation string, stereotype string, split string, template_split string, template_id int, sample_id int, gender string, usable boolean").cache()


def test_gap_and_parity(spark, labelled):
    grid = {(r["model_tag"], r["cell"]): r for r in metrics.gap_grid(labelled).collect()}
    assert grid["base", "train_occ|train_tmpl"]["gap"] == pytest.approx(34 / 40 - 6 / 40)
    assert grid["base", "all"]["n_female_coded"] == 40
    parity = metrics.parity_distance(labelled).first()
    assert parity["parity_distance"] == pytest.approx(0.35) and parity["n_occupations"] == 4


def test_published_cell_counts_give_the_published_gap(spark):
    rows = [("base", "x", s, "train", "train", "female" if i < f else "male", True) for s, n, f in (("female", 140, 120), ("male", 153, 38)) for i in range(n)]
    df = spark.createDataFrame(rows, "model_tag string, occupation string, stereotype string, split string, template_split string, gender string, usable boolean")
    got = metrics.gap_grid(df).filter("cell = 'all'").first()
    assert got["gap"] == pytest.approx(0.6087768440709617) and (got["n_female_coded"], got["n_male_coded"]) == (140, 153)


def test_empty_side_is_null(spark, labelled):
    assert metrics.gap_grid(labelled.filter("stereotype = 'male'")).first()["gap"] is None


def test_flat_and_cluster_intervals_hold_the_gap(spark, labelled):
    cells = (("all", None, None),)
    stats = bootstrap.occupation_stats(labelled, dims.cells(spark, cells))
    flat = bootstrap.flat(stats, 100).filter("model_tag = 'base'").first()
    assert flat["gap"] == pytest.approx(0.7) and flat["ci_low"] < 0.7 < flat["ci_high"]
    cluster = bootstrap.cluster(spark, labelled, ("base",), 100, cells=cells).first()
    assert cluster["ci_low"] <= 0.7 <= cluster["ci_high"] and cluster["interpretable"]


def test_same_models_differ_by_nothing(spark, labelled):
    got = bootstrap.paired(spark, labelled, (("base", "step10"),), 100, cells=(("all", None, None),)).first()
    assert got["diff"] == pytest.approx(0) and got["ci_low"] < 0 < got["ci_high"]


def test_one_occupation_on_a_side_has_no_interval(spark, labelled):
    got = bootstrap.cluster(spark, labelled.filter("occupation <> 'nurse'"), ("base",), 50, cells=(("all", None, None),)).first()
    assert got["diff"] is not None and got["ci_low"] is None


@pytest.mark.parametrize("n", [50, 5000])
def test_binomial_has_the_right_mean(spark, n):
    f = n // 5
    rows = spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(f).cast("long").alias("f"), F.transform(F.sequence(F.lit(0), F.lit(399)), lambda i: F.struct(i.alias("id"))).alias("times"))
    got = bootstrap.resampled(rows, "times", 1).agg(F.avg("hits"), F.stddev("hits")).first()
    sd = math.sqrt(n * 0.2 * 0.8)
    assert abs(got[0] - f) < 5 * sd / 20 and 0.8 * sd < got[1] < 1.2 * sd


def test_calibration_decisions(spark):
    rows = spark.createDataFrame([(11, 0), (20, 12), (20, 2), (20, 18), (100, 70), (0, None)], "n int, f int").withColumn("p", F.when(F.col("n") > 0, F.col("f") / F.col("n")))
    got = [r[0] for r in rows.select(pairs.decision(F.col("n"), F.col("p"))).collect()]
    assert got == ["too_few_usable", "near_parity", "targeted", "targeted", "targeted", "too_few_usable"]


def test_calibration_has_occupations_without_texts(spark, labelled):
    got = {r["occupation"]: r for r in pairs.calibration(spark, labelled.filter("model_tag = 'base'"), 100).collect()}
    assert len(got) == sum(o[2] == "train" for o in dims.OCCUPATIONS)
    assert got["CEO"]["n"] == 0 and got["CEO"]["p_female"] is None and got["CEO"]["decision"] == "too_few_usable"
    assert got["nurse"]["target_gender"] == "male" and got["engineer"]["target_gender"] == "female"


def test_names_are_picked_evenly_and_never_the_current(spark):
    pool = spark.createDataFrame([("male", "Robert", 9), ("male", "James", 3), ("male", "David", 2), ("male", "Carlos", 1)], "gender string, name string, n long")
    arrays = pairs.pool_arrays(pool)
    got = spark.range(2000).crossJoin(F.broadcast(arrays)).select(pairs.pick_name(F.col("frequent"), F.col("every"), F.lit("David"), 1, F.col("id")).alias("name")).groupBy("name").count().collect()
    counts = {r["name"]: r["count"] for r in got}
    assert set(counts) == {"Robert", "James"} and all(800 < c < 1200 for c in counts.values())


def test_selection(spark):
    def pick(rows):
        return training.select_checkpoint(spark.createDataFrame(rows, "model_tag string, usable_rate double, gap double")).first()[0]

    base = ("base", 0.57, 0.6)
    assert pick([base, ("step10", 0.58, 0.4), ("step20", 0.5, -0.1), ("step40", 0.2, 0.0)]) == "step20"
    assert pick([base, ("step10", 0.2, 0.0), ("step20", 0.6, None)]) is None
    assert pick([base, ("step20", 0.6, -0.2), ("step10", 0.6, 0.2)]) == "step10"


def test_split_sizes(spark):
    rows = spark.createDataFrame([(o, i) for o, n in (("a", 20), ("b", 6), ("c", 3)) for i in range(n)], "occupation string, i int")
    one = training.stratified_split(rows, ["i"]).filter("part = 'eval'")
    assert {r["occupation"]: r["count"] for r in one.groupBy("occupation").count().collect()} == {"a": 2, "b": 1}
    again = training.stratified_split(rows.repartition(3), ["i"]).filter("part = 'eval'")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, again.collect()))


def test_early_stop(spark):
    log = spark.createDataFrame([(0, 0.6), (10, 0.55), (20, 0.4), (30, 0.55), (40, 0.45), (50, 0.3), (60, 0.2)], "step int, usable_rate double")
    got = {r["step"]: (r["strike"], r["stop"]) for r in training.early_stop(log).collect()}
    assert [s for s in got if got[s][0]] == [20, 40, 50, 60] and [s for s in got if got[s][1]] == [50]


def test_costs_and_perplexity(spark):
    rows = spark.createDataFrame([("a", 1000, 10.0, 0.001, 5), ("b", 0, 0.0, 0.0, 0)], "m string, tokens long, seconds double, kwh double, usable long")
    got = {r["m"]: r for r in training.costs(rows, ["m"]).collect()}
    assert got["a"]["tokens_per_s"] == 100 and got["a"]["wh_per_1k_tokens"] == pytest.approx(1.0) and got["b"]["wh_per_1k_tokens"] is None
    p = spark.createDataFrame([(1.0, 3.0), (2.0, 1.0)], "l double, k double").agg(training.pooled_perplexity(F.col("l"), F.col("k"))).first()[0]
    assert p == pytest.approx(math.exp(5 / 4))


def test_legacy_matching(spark):
    rows = [("nurse", "female", "train", 0, i, t, False) for i, t in enumerate(["he took his bag " + "x" * 10, "she took her bag " + "x" * 10, "she took her bag " + "x" * 200, "he took his bag " + "x" * 210, "he took his bag " + "x" * 900])]
    df = spark.createDataFrame(rows, "occupation string, stereotype string, split string, template_id int, sample_id int, completion string, truncated boolean")
    own = legacy.labelled(df)
    got = legacy.matched(own, max_pairs=5).collect()
    assert {(r["chosen_sample_id"], r["rejected_sample_id"]) for r in got} == {(0, 1), (3, 2)}
    assert legacy.group_outcomes(own, max_pairs=5).first()["outcome"] == "paired"
    assert legacy.group_outcomes(own, max_ratio=0.5).first().asDict().items() >= {"outcome": "length_mismatch_only", "n_pairs": 0}.items()


def test_audit_rates(spark):
    sheet = spark.createDataFrame([("y", "n", "y", "Y"), ("n", "y", "y", None)], "single_character_ok string, pronouns_refer_to_holder string, swap_correct string, chosen_fluent string")
    got = {r["verdict"]: (r["yes"], r["n"]) for r in review.audit_rates(sheet).collect()}
    assert got == {"single_character_ok": (1, 2), "pronouns_refer_to_holder": (1, 2), "swap_correct": (2, 2), "chosen_fluent": (1, 1)}


def test_large_binomials_are_exact(spark):
    """Draws of 9,001 trials, and of 401 with one hit, are where the exact distribution passes the keyed uniform."""
    import hashlib

    for n, f in ((9001, 3), (401, 1)):
        rows = spark.range(1).selectExpr(f"{n}L as n", f"{f}L as f", "transform(sequence(0, 499), i -> struct(i as id)) as times")
        got = {r["id"]: r["hits"] for r in bootstrap.resampled(rows, "times", 1).collect()}
        chance = [math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(f / n) + (n - k) * math.log1p(-f / n)) for k in range(60)]
        for i, hits in got.items():
            u = int(hashlib.md5(f"1|{i}".encode()).hexdigest()[:13], 16) / 2**52
            k, total = 0, chance[0]
            while total <= u:
                k += 1
                total += chance[k]
            assert hits == k
