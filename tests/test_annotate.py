import pytest
from pyspark.sql import functions as F

from ratelens.operators import funnel, swap
from ratelens.operators import lexicon as lx
from ratelens.operators import words as wd

PEOPLE = [
    ("Nurse Emily Chen closed her bag.", {"Emily": "female"}),
    ("Mr. Thomas Reed closed his bag.", {"Thomas": "male"}),
    ("Emily met Robert at noon.", {"Emily": "female", "Robert": "male"}),
    ("Jordan closed the bag.", {"Jordan": "unisex"}),
    ("Emily closed her bag.", {"Emily": "female"}),
    ("Hope filled the room at last.", {}),
    ("Mrs. Smith closed her bag.", {"Smith": "female"}),
    ('The sign said "Always Robert" in red.', {}),
    ('Elisabeth "Betty" Rogers closed her bag.', {"Elisabeth": "female"}),
    ("The engineer closed the bag.", {}),
    ("**Dr. Thomas Reed** closed his bag.", {"Thomas": "male"}),
    ("Zorblat opened his shop as he was late.", {"Zorblat": None}),
    ("Emily, Robert and Linda's friend.", {"Emily": "female", "Robert": "male", "Linda": "female"}),
    ("He met Mr Smith. Later Smith left.", {"Smith": "male"}),
    ("An unclosed “Robert and Emily", {}),
    ("", {}),
    ("They saw Grace and Emily Rose Chen there.", {"Grace": "female", "Emily": "female"}),
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t, t) for i, (t, _) in enumerate(PEOPLE)] + [(99, None, None)], "id int, text string, word string")


def test_names_in_rows_and_as_rows_are_the_same(spark, texts):
    got = {r["id"]: r["who"] for r in wd.with_people(texts, F.col("text")).collect()}
    assert got[99] is None
    for i, (t, want) in enumerate(PEOPLE):
        assert got[i]["n"] == len(want), t
        if len(want) == 1:
            assert (got[i]["name"], got[i]["gender"]) == next(iter(want.items())), t
    parts = wd.name_parts(wd.token_table(texts, ["id"]), ["id"], lx.names_table(spark))
    rows = wd.people_table(wd.span_table(parts, ["id"]), ["id"]).collect()
    assert {(r["id"], r["name"], r["gender"]) for r in rows} == {(i, n, g) for i, (_, want) in enumerate(PEOPLE) for n, g in want.items()}


def test_large_dictionaries_are_joined_by_a_shuffle(spark, texts, monkeypatch):
    monkeypatch.setattr(wd, "BROADCAST_NAMES", 0)
    names = spark.createDataFrame([("Zorblat", "female"), ("Emily", "male"), ("Emily", "male")], "name string, name_gender string")
    parts = wd.name_parts(wd.token_table(texts, ["id"]), ["id"], names)
    got = {(r["id"], r["name"]): r["gender"] for r in wd.people_table(wd.span_table(parts, ["id"]), ["id"]).collect()}
    assert got[11, "Zorblat"] == "female" and got[0, "Emily"] == "male" and (0, "Chen") not in got


def test_spans_and_quoted_words(spark, texts):
    tokens = wd.token_table(texts, ["id"])
    spans = wd.span_table(wd.name_parts(tokens, ["id"], lx.names_table(spark)), ["id"])
    got = {(r["id"], r["span"]) for r in spans.collect()}
    assert {(0, "Emily Chen"), (1, "Mr. Thomas Reed"), (8, "Elisabeth Rogers"), (10, "Dr. Thomas Reed"), (16, "Grace"), (16, "Emily Rose Chen")} <= got
    assert {(r["id"], r["word"]) for r in tokens.filter("quoted").collect()} == {(7, "Always"), (7, "Robert"), (8, "Betty"), (14, "Robert"), (14, "and"), (14, "Emily")}


SWAPS = [
    ("Emily closed her bag before she left. The bag was hers.", "male", "Robert", "Robert closed his bag before he left. The bag was his."),
    ("Robert closed his bag. They thanked him.", "female", "Emily", "Emily closed her bag. They thanked her."),
    ("They thanked her. Emily took her last break.", "male", "Robert", "They thanked him. Robert took his last break."),
    ("Robert Chen, a chairman, took his seat.", "female", "Emily", "Emily Chen, a chairwoman, took her seat."),
    ("Jordan took his seat.", "female", "Emily", "Jordan took her seat."),
    ("Mr. Smith took his seat.", "female", "Emily", "Ms. Smith took her seat."),
    ("**Emily** took HER seat.", "male", "Robert", "**Robert** took HIS seat."),
    ("It was on her to-do list, and Emily's bag was hers.", "male", "Robert", "It was on his to-do list, and Robert's bag was his."),
    ("Emily Helen Chen took her seat.", "male", "Robert", "Robert Chen took his seat."),
    ("The bag was his, said Robert himself.  ", "female", "Emily", "The bag was hers, said Emily herself.  "),
]
REFUSED = [
    ("Emily met Robert and she left.", "male", "not_single_name"),
    ("Zorblat opened his shop as he was late.", "female", "unknown_name"),
    ("Emily, a kind woman, took her seat.", "male", "person_noun"),
    ("The boss gave her time. Emily smiled.", "male", "ambiguous_her"),
    ("Emily thanked Mr. Smith as she left.", "male", "not_single_name"),
    ("The shop was hers.", "male", "not_single_name"),
]


def ask(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, text string, target string, new string")
    return [r["swap"] for r in swap.swapped(df, F.col("text"), F.col("target"), F.col("new")).orderBy("id").collect()]


def test_swap(spark):
    got = ask(spark, [s[:3] for s in SWAPS])
    for (text, _, _, want), r in zip(SWAPS, got, strict=True):
        assert r["fail"] is None and r["text"] == want and r["log"], text


def test_swap_refused(spark):
    rows = [(t, g, "Robert" if g == "male" else "Emily") for t, g, _ in REFUSED] + [(None, "male", "Robert"), ("Emily took her seat.", None, "Robert")]
    got = ask(spark, rows)
    assert [r["fail"] for r in got[: len(REFUSED)]] == [c for _, _, c in REFUSED]
    assert all(r["text"] is None and r["fail"] is None for r in got[-2:])


def test_swap_log_says_what_was_put_for_what(spark):
    (row,) = ask(spark, [("Emily Helen Chen took her seat.", "male", "Robert")])
    assert [tuple(e) for e in row["log"]] == [("Helen", ""), ("Emily", "Robert"), ("her", "his")]


def test_forms_of_two_object_verbs():
    forms = swap.two_object_forms()
    assert {"give", "gave", "giving", "gives", "showed", "denied", "hands", "offered"} <= set(forms)


def test_name_level_reasons(spark):
    texts = ["Emily closed her bag as she left.", "Emily closed his bag as he left.", "Emily met Linda as she took her bag.", "The nurse closed her bag as she left.", "Jordan closed his bag as he left.", "   "]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, completion string").selectExpr("*", "false as truncated")
    got = {r["id"]: r for r in funnel.labelled(df).collect()}
    assert [got[i]["reason"] for i in range(6)] == [None, "name_pronoun_mismatch", "multi_person", "no_name", None, "empty"]
    assert got[0]["name"] == "Emily" and got[1]["name_gender"] == "female" and got[2]["name"] is None and got[5]["gender"] is None


def test_dictionary(spark):
    one = lambda names: spark.createDataFrame([(n,) for n in names], "name string")
    got = {r["name"]: r["name_gender"] for r in lx.dictionary_table(one(["A", "B", "A"]), one(["B", "C"])).collect()}
    assert got == {"A": "male", "B": "unisex", "C": "female"} == lx.dictionary({"A", "B"}, {"B", "C"})
