"""Forms without hot groups against plain ones: matching, splits, numbers; and the sources of this round."""

import json
import os
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ratelens.operators import legacy, metrics, pairs, report, training
from ratelens.sources import files, folders, logs


# --- matching ---------------------------------------------------------------------------


def plain_matches(counters, stereo, max_pairs, max_ratio):
    """Each (sample, length) in turn takes the nearest of what is left, looked for among all."""
    free, out, too_far = sorted(stereo), [], 0
    for k, (sample, length) in enumerate(counters):
        if len(out) >= max_pairs or not free:
            break
        ratio, other, size = min((max(length, n) / min(length, n), s, n) for s, n in free)
        if ratio > max_ratio:
            too_far += 1
            continue
        free.remove((other, size))
        out.append((k, sample, other, ratio))
    return out, too_far


def test_greedy_matching_is_the_plain_rule():
    rng = random.Random(1)
    for _ in range(2000):
        top = rng.choice([5, 30, 400])
        counters = [(i, rng.randint(1, top)) for i in range(rng.randint(0, 30))]
        stereo = [(i, rng.randint(1, top)) for i in rng.sample(range(100), rng.randint(0, 30))]
        most = rng.choice([1, 2, 5, 100])
        free = legacy.Free([n for _, n in stereo], [s for s, _ in stereo])
        assert legacy.greedy(counters, free, most, 1.6) == plain_matches(counters, stereo, most, 1.6)[0]


def test_a_large_group_is_matched_in_order_n_log_n():
    rng = random.Random(2)
    n = 200_000
    stereo, counters = ([(i, rng.randint(1, 1 << 30)) for i in range(n)] for _ in range(2))
    began = time.process_time()
    out = legacy.greedy(counters, legacy.Free([x for _, x in stereo], list(range(n))), n, 1.6)
    assert len(out) > 0.99 * n and time.process_time() - began < 20


@pytest.mark.parametrize("most", [1, 2, 7])
def test_cuts_before_matching_lose_nothing(spark, most):
    rng = random.Random(most)
    rows = [(f"o{rng.randrange(3)}", rng.randrange(2), i, rng.choice(["counter", "stereo"]), "x" * rng.choice([1, 2, 3, 5, 5, 5, 9, 20, 60]), "eligible") for i in range(300)]
    rows += [("o9", 0, i, "counter", "x" * 5, "eligible") for i in range(5)] + [("o8", 0, i, "stereo", "x" * 5, "eligible") for i in range(5)] + [("o0", 0, 1000, "mixed", "x", "mixed")]
    df = spark.createDataFrame(rows, "occupation string, template_id int, sample_id long, class string, completion string, step string")
    draws = {(r["occupation"], r["template_id"], r["sample_id"]): r["h"] for r in legacy._candidates(df, 42).collect()}
    want, counts = set(), {}
    for o, t in {(r[0], r[1]) for r in rows if r[5] == "eligible"}:
        own = [r for r in rows if r[:2] == (o, t) and r[5] == "eligible"]
        counters = sorted(((draws[o, t, r[2]], r[2], len(r[4])) for r in own if r[3] == "counter"))
        got, too_far = plain_matches([c[1:] for c in counters], [(r[2], len(r[4])) for r in own if r[3] == "stereo"], most, 1.6)
        want |= {(o, t, s, other, ratio) for _, s, other, ratio in got}
        counts[o, t] = (len(got), too_far)
    assert {tuple(r) for r in legacy.matched(df, most).collect()} == want
    assert {(r["occupation"], r["template_id"]): (r["n_pairs"], r["too_far"]) for r in legacy.group_outcomes(df, most).collect()} == counts


# --- splits and numbers -----------------------------------------------------------------


@pytest.mark.parametrize("bits", [1, 4, 12])
def test_split_is_the_ranked_one(spark, bits):
    rng = random.Random(bits)
    rows = [(rng.choice(["a", "a", "a", "b", "c", None]), i) for i in range(400)] + [("few", i) for i in range(1000, 1003)] + [("five", i) for i in range(2000, 2005)]
    df = spark.createDataFrame(rows, "occupation string, i long")
    from ratelens.functions.rng import draw

    h = {r["i"]: r["h"] for r in df.select("i", draw(42, "split", F.col("i")).alias("h")).collect()}
    want = set()
    for s in {r[0] for r in rows}:
        own = sorted((h[i], i) for o, i in rows if o == s)
        k = round(0.1 * len(own))
        want |= {i for _, i in own[: 1 if k == 0 and len(own) >= 5 else k]}
    got = training.stratified_split(df, ["i"], bits=bits)
    assert got.count() == len(rows) and {r["i"] for r in got.filter("part = 'eval'").collect()} == want
    assert training.stratified_split(df, ["i"], fraction=0.0).filter("part = 'eval'").count() == 0
    assert training.stratified_split(df.filter("false"), ["i"]).count() == 0


def test_pair_ids_are_dense_in_the_order_of_keys(spark):
    rows = [(o, 0, s, "paired" if (o + s) % 4 else "swap_failed", None) for o in range(3) for s in range(200)] + [(0, 1, 5, "paired", None)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "occ_ordinal int, template_id int, sample_id int, outcome string, swap_failure string").repartition(5)
    got = pairs.numbered(df, partitions=7).orderBy("pair_id").collect()
    keys = [(r["occ_ordinal"], r["template_id"], r["sample_id"]) for r in got]
    assert [r["pair_id"] for r in got] == list(range(len(keys))) and keys == sorted(r[:3] for r in rows if r[3] == "paired")
    assert pairs.numbered(df.filter("false")).count() == 0


def test_statistics_of_one_pass(spark):
    rows = [("paired", None, "male", "female", "nurse"), ("paired", None, "male", "female", "cook"), ("swap_failed", "person_noun", "male", "female", "cook"), ("already_target_gender", None, "female", "female", "nurse")]
    df = spark.createDataFrame(rows, "outcome string, swap_failure string, rejected_gender string, chosen_gender string, occupation string")
    got = {(r["metric"], r["key"]): r["n"] for r in pairs.statistics(df).collect()}
    assert got == {("outcome", "paired"): 2, ("outcome", "swap_failed"): 1, ("outcome", "already_target_gender"): 1, ("swap_failure", "person_noun"): 1, ("direction", "male->female"): 2, ("occupation", "nurse"): 1, ("occupation", "cook"): 1}


# --- sources ----------------------------------------------------------------------------

ROW = "model_tag string, occupation string, template_id int, sample_id long, completion string, truncated boolean, reason string"


def test_model_folders_as_a_source(spark, tmp_path):
    folders.register(spark)
    root = f"{tmp_path}/run"
    rows = [(t, "nurse", 0, i, f"Text {i} é x", i % 2 == 0, None if i % 3 else "mixed") for t in ("base", "step10", "step20") for i in range(20)]
    df = spark.createDataFrame(rows, ROW).repartition(3)
    df.write.format("model_folders").mode("append").save(root)
    assert not [f for f in os.listdir(root) if f.startswith("_")]
    for t in ("base", "step10"):
        (tmp_path / "run" / t / "metrics.json").write_text("{}")
    os.makedirs(f"{root}/empty")
    read = spark.read.format("model_folders").load(root)
    assert Counter((r["model_tag"], r["sample_id"], r["completion"], r["usable"]) for r in read.collect()) == Counter((r[0], r[3], r[4], r[6] is None) for r in rows if r[0] != "step20")
    one = read.filter("model_tag = 'base' and sample_id < 5")
    assert one.count() == 5 and one.rdd.getNumPartitions() <= 3
    left = [line for line in one._jdf.queryExecution().executedPlan().toString().split("\n") if " Filter " in line]
    assert left and all("sample_id" in line and "= base" not in line for line in left)  # the tag's filter is the source's own
    assert read.filter("model_tag in ('step10', 'nobody')").count() == 20 and read.filter("model_tag = 'nobody'").count() == 0
    assert spark.read.format("model_folders").option("unfinished", "true").load(root).count() == 60
    assert spark.read.format("model_folders").option("tags", "base").load(root).count() == 20
    df.filter("model_tag = 'base' and sample_id < 2").write.format("model_folders").mode("overwrite").save(root)
    assert spark.read.format("model_folders").load(root).groupBy("model_tag").count().orderBy("model_tag").collect() == [("base", 2), ("step10", 20)]
    with pytest.raises(Exception, match="not a folder's name"):
        spark.createDataFrame([("../x", "a", 0, 1, "t", False, None)], ROW).write.format("model_folders").mode("append").save(root)
    assert not [f for f in os.listdir(root) if f.startswith("_")]


def test_reports_of_unlike_entries(spark, tmp_path):
    docs = [
        {"run": 1, "log_history": [{"step": 1, "loss": 0.9}, {"step": 3, "eval_loss": 0.5, "note": "x"}, {"step": "4", "eval_loss": "0.25"}, {"eval_loss": {"a": 1}}, "text"], "carbon": {"actual": 1.5, "pred": "2.5", "early_stop": 1, "components": [1]}},
        {"run": 2, "log_history": []},
        {"run": 3},
    ]
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, docs)))
    reports = logs.read_reports(spark, str(tmp_path))
    run = logs.field(F.col("report"), "$.run", "long").alias("run")
    entries = logs.entries(reports, run)
    assert {tuple(r) for r in logs.evaluations(entries, "run").collect()} == {(1, 3, 0.5), (1, 4, 0.25)} and entries.count() == 5
    assert {tuple(r) for r in logs.carbon(reports, run).collect()} == {(1, "actual", 1.5), (1, "pred", 2.5), (1, "components", None)}
    assert "eval_loss" in logs.entry_schema(entries)


def test_broken_lines_of_an_audit_sheet(spark, tmp_path):
    rows = ["pair_id,occupation,direction,single_character_ok,pronouns_refer_to_holder,swap_correct,chosen_fluent,notes,reviewer", '1,nurse,a->b,y,n,y,y,"a, b",A', '"2,cook,a->b,y,y,n,y,""said, so"",A";', ";;3,cook,a->b,n,y,n,y,,A;", "not a row", ""]
    (tmp_path / "sheet.csv").write_text("\n".join(rows))
    got = {r["pair_id"]: (r["notes"], r["swap_correct"], r["rescued"]) for r in files.read_whole_audit(spark, str(tmp_path)).collect()}
    assert got == {1: ("a, b", "y", False), 2: ("said, so", "n", True), 3: (None, "n", True)}


def test_only_missing_parts_are_made(spark, tmp_path):
    path, asked = f"{tmp_path}/t", []

    def make(missing):
        asked.append(sorted(missing))
        return spark.createDataFrame([(t, i) for t in ("a", "b", "c") for i in range(3)], "tag string, i int")

    assert files.materialised_by(spark, path, "tag", ["a"], make).count() == 3
    before = {f: os.stat(f"{path}/tag=a/{f}").st_mtime_ns for f in os.listdir(f"{path}/tag=a")}
    assert files.materialised_by(spark, path, "tag", ["a", "b"], make).count() == 6
    assert files.materialised_by(spark, path, "tag", ["b"], make).count() == 3
    assert asked == [["a"], ["b"]] and not os.path.exists(f"{path}/tag=c")
    assert before == {f: os.stat(f"{path}/tag=a/{f}").st_mtime_ns for f in os.listdir(f"{path}/tag=a")}


def test_nested_documents_of_models(spark, tmp_path):
    rows = [("base", "nurse", "female", "train", "train", "female", True)] * 3 + [("base", "smith", "male", "train", "train", "female", True), ("base", "smith", "male", "train", "train", "male", True), ("base", "smith", "male", "train", "train", "male", False), ("step1", "cook", "balanced", "heldout", "train", "male", True)]
    df = spark.createDataFrame(rows, "model_tag string, occupation string, stereotype string, split string, template_split string, gender string, usable boolean")
    files.write_documents(metrics.documents(df), f"{tmp_path}/m", "model_tag")
    got = {r["model_tag"]: r.asDict(recursive=True) for r in spark.read.schema(f"{metrics.DOCUMENT}, model_tag string").json(f"{tmp_path}/m").collect()}
    assert got["base"]["cells"] == {"female|train|train": {"n": 3, "p_female": 1.0}, "male|train|train": {"n": 2, "p_female": 0.5}}
    assert got["base"]["gap"]["all"] == {"gap": 0.5, "n_female_coded": 3, "n_male_coded": 2} and got["base"]["gap"]["train_occ|train_tmpl"]["gap"] == 0.5
    assert got["step1"]["gap"]["all"] == {"gap": None, "n_female_coded": None, "n_male_coded": None} and got["step1"]["per_occupation"]["cook"]["p_female"] == 0.0


def test_number_texts(spark):
    one = lambda *x: spark.createDataFrame([x], "p double, l double, h double, ok boolean").select(report.interval_text(*map(F.col, ("p", "l", "h", "ok")))).first()[0]
    assert one(0.6088, 0.519, 0.6986, True) == "+0.61 [+0.52, +0.70]" and one(None, None, None, True) == "n/a" and one(0.5, None, None, False) == "(+0.50)" and one(-0.001, -0.5, 0.5, True) == "+0.00 [-0.50, +0.50]"


# --- the monitor as a stream ------------------------------------------------------------


@pytest.mark.parametrize("per_trigger", [1, 4])
def test_stream_of_parts_out_of_order_gives_the_table_s_verdicts(spark, tmp_path, per_trigger):
    from datetime import datetime, timedelta

    from ratelens.streaming import monitor

    rng = random.Random(per_trigger)
    start = datetime(2024, 1, 1)
    rates = {"a": [0.9, 0.85, 0.5, 0.9, 0.4, 0.3, 0.2], "b": [0.5, 0.5, 0.1, 0.1]}
    rows = [(run, start + timedelta(days=d, minutes=rng.randrange(1440)), i < 20 * rate) for run, rs in rates.items() for d, rate in enumerate(rs) for i in range(20)]
    rng.shuffle(rows)
    cuts = [rows[i::5] for i in range(5)]
    for n, part in enumerate([*cuts[:3], cuts[3] + cuts[4] + [("end", start + timedelta(days=99), True)]]):
        spark.createDataFrame(part, "run string, at timestamp, usable boolean").coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
        if n in (1, 3):  # what is there so far, and then the rest from where the first call left off
            read = spark.readStream.schema("run string, at timestamp, usable boolean").option("maxFilesPerTrigger", per_trigger).parquet(f"{tmp_path}/in")
            found = monitor.run_to_table(monitor.early_stop_by_time(read, "30 days"), f"{tmp_path}/out", f"{tmp_path}/state")
            assert n == 3 or found.count() == 0
    day = (start - datetime(1970, 1, 1)).days
    log = spark.createDataFrame([(run, day + d, rate) for run, rs in rates.items() for d, rate in enumerate(rs)], "run string, step int, usable_rate double")
    want = {tuple(r) for r in training.early_stop(log, by=["run"]).select("run", "step", "usable_rate", "strike", "stop").collect()}
    assert {tuple(r) for r in found.collect()} == want and sum(r[4] for r in want) == 2
