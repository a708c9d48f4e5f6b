import pytest
from pyspark.sql import functions as F

from ratelens.functions import text as tx
from ratelens.functions.rng import draw
from ratelens.operators import funnel


def label(spark, rows, **options):
    df = spark.createDataFrame([(i, t, trunc) for i, (t, trunc) in enumerate(rows)], "id int, completion string, truncated boolean")
    return {r["id"]: r for r in funnel.labelled_by_text(df, **options).collect()}


def test_reasons_in_order(spark):
    got = label(spark, [
        ("Omar fixed his car before she took her tools.", False),
        ("As an AI language model, he and his kind refuse.", False),
        ("Marie Curie wrote her notes and she slept.", False),
        ("Lena took her coat and she left.", True),
        ("Omar closed his shop.", False),
        ("Omar closed his shop before he went home.", False),
        ("   \n", None),
        (None, None),
        ("I saw how he lost his hat.", False),
    ])
    assert [got[i]["reason"] for i in range(9)] == ["mixed", "refusal", "real_person", "truncated", "no_signal", None, "empty", "empty", "first_person"]
    assert got[5]["gender"] == "male" and got[0]["gender"] is None


def test_first_person_outside_quotes_only(spark):
    got = label(spark, [('"I am late," Lena said, and she took her bag.', False), ("I know that she took her bag.", False), ("My friend took her bag as she left.", False)])
    assert [got[i]["reason"] for i in range(3)] == [None, "first_person", "first_person"]


def test_blocklist_takes_whole_words(spark):
    got = label(spark, [("Mechanic Jack made his tea before he left.", False), ("Jack Ma drank his tea before he left.", False)])
    assert got[0]["reason"] is None and got[1]["reason"] == "real_person"
    old = label(spark, [("Mechanic Jack made his tea before he left.", False)], legacy=True)
    assert old[0]["reason"] == "real_person"


def test_small_functions(spark):
    row = spark.range(1).select(
        tx.highlighted(F.lit("He took his bag")).alias("h"), tx.prompt_prefix(F.lit("Tell a tale. Begin now")).alias("p"), tx.match_case(F.lit("HE"), F.lit("she")).alias("a"), tx.match_case(F.lit("He"), F.lit("she")).alias("b"), tx.match_case(F.lit("he"), F.lit("she")).alias("c"),
        tx.tag_step(F.lit("step40")).alias("s"), tx.tag_step(F.lit("step40_4bit")).alias("q"), tx.variant(F.lit("step5_4bit_merged")).alias("v"), tx.length_ratio(F.lit(""), F.lit("abcd")).alias("l"), draw(F.lit(4), "x").alias("d"), tx.article_for(F.lit("engineer")).alias("an"),
    ).first()
    assert row["h"] == "[[He]] took [[his]] bag" and row["p"] == "Tell a tale"
    assert (row["a"], row["b"], row["c"]) == ("SHE", "She", "she")
    assert row["s"] == 40 and row["q"] is None and row["l"] == 4 and row["an"] == "an"
    assert tuple(row["v"]) == ("step5", True, True)
    import hashlib

    assert row["d"] == int(hashlib.md5(b"4|x").hexdigest()[:8], 16)


def test_unknown_variant_is_an_error(spark):
    with pytest.raises(Exception, match="not a model variant"):
        spark.range(1).select(tx.variant(F.lit("step5_8bit"))).collect()
