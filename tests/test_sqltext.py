"""The functions for SQL text against the column forms of the same rules, and their plans."""

import random

import pytest
from pyspark.sql import functions as F
from tests.test_annotate import PEOPLE, REFUSED, SWAPS

from ratelens.functions import sqltext
from ratelens.functions import text as tx
from ratelens.operators import funnel, swap
from ratelens.operators import lexicon as lx
from ratelens.operators import words as wd

#: Pieces that texts of all kinds are put together from: names, titles, quotes, pronouns, signs, verbs of two objects.
PARTS = ("Emily", "Robert", "Jordan", "Zorblat", "Smith", "Chen", "Helen", "Mr.", "Mrs", "Dr.", "Miss", "he", "She", "HER", "his", "hers", "him", "himself", "I", "my", "the bag", "to-do", "long", "quickly", "gave", "took", "closed", ".", ",", "and", '"', "“", "”", "'s", "woman", "chairman", "Elon Musk", "I'm sorry", "Привет", "3", "\n", "-", "Will", "Hope")


@pytest.fixture(scope="module")
def texts(spark):
    sqltext.register(spark)
    draw = random.Random(3)
    made = [" ".join(draw.choice(PARTS) for _ in range(draw.randint(0, 14))) for _ in range(600)]
    rows = [t for t, _ in PEOPLE] + [s[0] for s in SWAPS] + [r[0] for r in REFUSED] + made + [None, " ", "word " * 3000 + "Emily Chen took her bag as she left."]
    df = spark.createDataFrame([(i, t, i % 11 == 0, ("male", "female", None)[i % 5 % 3], "Robert" if i % 2 else "Linda") for i, t in enumerate(rows)], "id int, completion string, truncated boolean, target string, new string").repartition(8).cache()
    yield df
    df.unpersist()


def test_names(spark, texts):
    rows = spark.sql("SELECT t.id, p.* FROM {texts} t, LATERAL names_of(completion) p", texts=texts).collect()
    found = wd.with_people(texts, F.col("completion")).select("id", "who.*").collect()
    by = {}
    for r in rows:
        by.setdefault(r["id"], []).append(r)
    assert len(rows) > 300
    for r in found:
        own = by.get(r["id"], [])
        assert len(own) == (r["n"] or 0) == len({x["name"] for x in own})
        if r["n"] == 1:
            assert (own[0]["name"], own[0]["gender"], own[0]["titled"]) == (r["name"], r["gender"], r["titled"])
    parts = wd.name_parts(wd.token_table(texts, ["id"], "completion"), ["id"], lx.names_table(spark))
    table = wd.people_table(wd.span_table(parts, ["id"]), ["id"]).collect()
    key = lambda r: (r["id"], r["name"], r["gender"], r["titled"])
    assert {key(r) for r in rows} == {key(r) for r in table}
    lists = spark.sql("SELECT id, name_list(completion) AS n FROM {texts}", texts=texts).collect()
    assert {(r["id"], *x) for r in lists for x in r["n"] or ()} == {key(r) for r in rows}
    assert [r["id"] for r in lists if r["n"] is None] == [r["id"] for r in texts.filter("completion is null").collect()]


def test_annotations(spark, texts):
    got = {r["id"]: r for r in spark.sql("SELECT id, a.*, first, g FROM (SELECT id, annotate_text(completion, truncated) AS a, exclusion_reason(completion, truncated) AS first, pronoun_gender(completion) AS g FROM {texts})", texts=texts).collect()}
    want = {r["id"]: r for r in funnel.labelled(texts).collect()}
    first = {r["id"]: r["reason"] for r in funnel.labelled_by_text(texts).collect()}
    gender = {r["id"]: r["g"] for r in texts.select("id", tx.pronoun_gender(F.coalesce("completion", F.lit(""))).alias("g")).collect()}
    for i, w in want.items():
        assert all(got[i][c] == w[c] for c in ("reason", "gender", "name", "name_gender", "usable")), w["completion"]
        assert got[i]["first"] == first[i] and got[i]["g"] == gender[i]
    assert len({w["reason"] for w in want.values()}) >= 10


def test_swaps(spark, texts):
    got = {r["id"]: r["s"] for r in spark.sql("SELECT id, swap_gender(completion, target, new) AS s FROM {texts}", texts=texts).collect()}
    want = {r["id"]: r["swap"] for r in swap.swapped(texts, F.col("completion"), F.col("target"), F.col("new")).collect()}
    text = {r["id"]: r["completion"] for r in texts.collect()}
    for i, w in want.items():
        g = got[i]
        assert (g and g["text"], g and g["fail"], g and g["log"]) == (w["text"], w["fail"], w["log"]), (text[i], g, w)
    assert len({w["fail"] for w in want.values()}) >= 6 and sum(w["text"] is not None for w in want.values()) >= 20


def test_known_swaps(spark):
    sqltext.register(spark)
    df = spark.createDataFrame([(i, *s) for i, s in enumerate(SWAPS)], "id int, t string, g string, n string, want string")
    assert [r["x"] for r in spark.sql("SELECT swap_gender(t, g, n).text AS x FROM {df} ORDER BY id", df=df).collect()] == [s[3] for s in SWAPS]


def test_a_dictionary_of_ones_own(spark):
    try:
        sqltext.register(spark, {"Zorblat": "female", "O'Neill": "male"})
        got = spark.sql("SELECT p.* FROM VALUES ('Zorblat closed her bag.') AS t(x), LATERAL names_of(x) p").collect()
        assert [tuple(r) for r in got] == [("Zorblat", "female", False)]
    finally:
        sqltext.register(spark)


def test_plans_stay_in_the_jvm(spark):
    from contextlib import redirect_stdout
    from io import StringIO

    sqltext.register(spark)
    texts = spark.range(9).selectExpr("id", "concat('Emily ', id) AS completion", "id > 4 AS truncated")
    for q in ("SELECT t.id, p.name FROM {texts} t, LATERAL names_of(completion) p", "SELECT id, annotate_text(completion, truncated) AS a FROM {texts}"):
        out = StringIO()
        with redirect_stdout(out):
            spark.sql(q, texts=texts).explain()
        assert not any(x in out.getvalue() for x in ("Join", "Exchange", "ArrowEval", "BatchEvalPython"))
