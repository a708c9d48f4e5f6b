"""Queries on the completions read whole documents: against brute force on small tables."""

import re

import numpy as np
import pytest

from ratelens.functions import text as tx
from ratelens.operators import bootstrap
from ratelens.plans import catalog
from ratelens.plans import completions as data

LONG = "The shop was quiet and the bag lay there. " * 4
ENDS = ("", "He told him.", "She took hers.", "I was late.", "As an AI, no.", "Elon Musk came.", "Привет.", '"I am late," it said.', "A friend of his came.", "éhe hé ΩI", "He_ she2 his")


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("whole"))
    rows = [(i, LONG + ENDS[i % len(ENDS)]) for i in range(225)] + [(225, None), (226, "")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{at}/documents.parquet")
    return at, dict(rows)


def count(g, text):
    return len(re.findall(rf"(?i)\b({tx.ALTERNATION[g]})\b", text))


def reason(text, truncated):
    male, female = count("male", text), count("female", text)
    if not text.strip():
        return "empty"
    if truncated:
        return "truncated"
    if re.search(r"(?i)\b(" + "|".join(tx.REAL_PEOPLE) + r")\b", text):
        return "real_person"
    if re.search(r"(?i)\b(" + "|".join(tx.REFUSALS) + r")\b", text):
        return "refusal"
    if re.search(r"\bI\b|\b(?i:my|me|myself)\b", re.sub(tx.QUOTED, " ", text)):
        return "first_person"
    return "no_signal" if male + female < 2 else "mixed" if male and female else None


def test_whole_text_reaches_the_predicates(spark, small):
    at, texts = small
    made = data.completions(spark, at).collect()
    key = lambda r: tuple(r[c] for c in catalog.KEY)
    for r in made:
        text = texts[r["sample_id"] * 100 + data.TEMPLATE_IDS.index(r["template_id"]) * 25 + r["occ_ordinal"]] or ""
        assert r["completion"].endswith(text) or len(r["completion"]) < 50  # variants without a document
    assert sum(len(r["completion"]) > 160 for r in made) > 900
    want = {key(r): reason(r["completion"], r["truncated"]) for r in made}
    got = {key(r): r["reason"] for r in catalog.queries()["text_analysis"](spark, at).collect()}
    assert got == want
    rate = {r["model_tag"]: r["non_latin_rate"] for r in catalog.queries()["quality_by_model"](spark, at).collect()}
    assert rate["base"] == pytest.approx(sum(bool(re.search(tx.NON_LATIN, r["completion"])) for r in made if r["model_tag"] == "base") / len(texts))


def test_words_in_any_script(spark):
    texts = ["he Him HIS, himself", "she(her)hers herself.", "éhe heé Ωhe he_ 2his", "", "the sheriff's hero"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(tx.pronoun_count(df.t, "male"), tx.pronoun_count(df.t, "female")).collect()
    assert [tuple(r) for r in got] == [(count("male", t), count("female", t)) for t in texts] == [(4, 0), (0, 4), (0, 0), (0, 0), (0, 0)]
    for words in (tx.REAL_PEOPLE, tx.REFUSALS, tx.OTHER_PEOPLE, tx.MALE_PRONOUNS):
        assert all(re.fullmatch(tx.one_of(words), w) for w in words) and not re.fullmatch(tx.one_of(words), words[0][:-1])


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("many"))
    spark.range(1350).selectExpr("id as doc_id", "'The shop was quiet.' as text").write.parquet(f"{at}/documents.parquet")
    return at


def test_tables_take_all_samples(spark, many):
    usable = data.labelled(spark, many).filter("usable").collect()
    ask = lambda name: catalog.queries()[name](spark, many).collect()
    shown = {(r["model_tag"], r["occupation"]): r["shown"] for r in ask("occupation_table")}
    for (tag, occupation), text in shown.items():
        own = [r["gender"] == "female" for r in usable if (r["model_tag"], r["occupation"]) == (tag, occupation)]
        assert abs(float(text) - sum(own) / len(own)) <= 0.005 + 1e-9
    assert len(ask("highlighted_texts")) == len(usable)
    half = [r for r in usable if r["model_tag"] == "base" and r["split"] == r["template_split"] == "train" and r["sample_id"] < 8]
    got = {r["occupation"]: r["n"] for r in ask("calibration")}
    assert max(r["sample_id"] for r in usable) == 13 and sum(got.values()) == len(half)
    assert all(n == sum(r["occupation"] == o for r in half) for o, n in got.items())


def test_binomials_are_exact_at_every_size(spark):
    import math

    pairs = [(1, 0), (1, 1), (7, 3), (401, 1), (500, 3), (1000, 500), (5_000_000, 3), (5_000_000, 2_000_000)]
    got = {(r["n"], r["f"]): r for r in bootstrap.distributions(spark.createDataFrame(pairs, "n long, f long")).collect()}
    for n, f in pairs:
        r = got[n, f]
        k = np.arange(r["least"], r["least"] + len(r["cdf"]))
        if 0 < f < n:
            log_p = [math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) + x * math.log(f / n) + (n - x) * math.log1p(-f / n) for x in k.tolist()]
            assert np.allclose(np.diff(r["cdf"], prepend=0), np.exp(log_p), rtol=1e-6, atol=1e-12) and r["cdf"][-1] == pytest.approx(1, abs=1e-12)
        else:
            assert k.tolist() == [f]
    rows = spark.createDataFrame([(401, 1, "a"), (1000, 500, "b")], "n long, f long, side string").selectExpr("*", "transform(sequence(0, 1999), r -> struct(r as rep)) as times")
    drawn = bootstrap.resampled(rows, "times", 42, "x", rows.side)
    hits = {s: np.array([r["hits"] for r in drawn.filter(f"side = '{s}'").collect()]) for s in "ab"}
    assert len(hits["a"]) == len(hits["b"]) == 2000
    assert abs(hits["a"].mean() - 1) < 0.1 and abs(hits["b"].mean() - 500) < 2 and abs(hits["b"].std() - math.sqrt(250)) < 1


def test_bootstraps_run_the_operators_replicates(spark, many, monkeypatch):
    seen = []
    plain_sequence = bootstrap.F.sequence
    monkeypatch.setattr(bootstrap.F, "sequence", lambda lo, hi, *step: seen.append(str(hi)) or plain_sequence(lo, hi, *step))
    for name, last in (("boot_flat", 999), ("boot_cluster", 1999), ("boot_paired", 1999), ("boot_interaction", 1999)):
        seen.clear()
        catalog.queries()[name](spark, many)
        assert f"Column<'{last}'>" in seen
