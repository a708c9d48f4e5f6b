import json

from ratelens.sources import files
from ratelens.streaming import monitor


def test_models_without_metrics_are_skipped(spark, tmp_path):
    for tag, done in (("base", True), ("step10", False), ("step20", True)):
        (tmp_path / tag).mkdir()
        (tmp_path / tag / "completions.jsonl").write_text(json.dumps({"occupation": "nurse", "completion": tag, "sample_id": 1}) + "\n")
        if done:
            (tmp_path / tag / "metrics.json").write_text("{}")
    got = files.read_models(spark, str(tmp_path))
    assert sorted((r["model_tag"], r["completion"], r["truncated"]) for r in got.collect()) == [("base", "base", None), ("step20", "step20", None)]
    assert files.read_models(spark, str(tmp_path), ["base", "step10"]).count() == 1


def test_audit_sheet_with_broken_lines(spark, tmp_path):
    head = files.AUDIT.replace(" long", "").replace(" string", "").replace(", ", ",")
    (tmp_path / "a.csv").write_text(f'{head}\n1,nurse,male->female,y,y,n,y,,me\n"2,nurse,male->female,y,y,y,y,,me";\n')
    good, bad = files.read_audit(spark, str(tmp_path / "a.csv"))
    assert [r["pair_id"] for r in good.collect()] == [1] and bad.count() == 1


def test_documents_tables_and_words(spark, tmp_path):
    df = spark.createDataFrame([("a", None, 0.5)], "x string, y int, z double")
    files.write_document(df, str(tmp_path / "d"))
    assert files.read_json(spark, str(tmp_path / "d")).first()["x"] == "a"
    assert files.markdown(df) == "| x | y | z |\n|---|---|---|\n| a | n/a | 0.50 |"
    (tmp_path / "w.txt").write_text("# note\nAnna\nBob  Carl\nAnna\n")
    assert sorted(r[0] for r in files.read_words(spark, str(tmp_path / "w.txt")).collect()) == ["Anna", "Bob", "Carl"]
    made = []
    make = lambda: made.append(1) or df
    assert files.materialised(spark, str(tmp_path / "m"), make).count() == files.materialised(spark, str(tmp_path / "m"), make).count() == 1
    assert made == [1]


def test_checkpoints_and_formats():
    folders = ["x/checkpoint-10", "x/checkpoint-153", "x/checkpoint-20", "x/other"]
    assert files.checkpoints(folders, [10, 30]) == [(10, "x/checkpoint-10"), (153, "x/checkpoint-153")]
    assert files.fmt_interval(0.6088, 0.519, 0.6986) == "+0.61 [+0.52, +0.70]" and files.fmt_interval(0.5, None, None, False) == "(+0.50)" and files.fmt(None) == "n/a"


def test_monitor_stream(spark, tmp_path):
    src = tmp_path / "log"
    src.mkdir()
    rates = [(0, 0.6), (10, 0.4), (20, 0.55), (30, 0.4), (40, 0.3), (50, 0.2)]
    query = monitor.early_stop(monitor.read_log(spark, str(src))).writeStream.format("memory").queryName("monitor_test").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        for k in (0, 3):  # the state outlives a micro-batch
            (src / f"{k}.json").write_text("".join(json.dumps({"run": "r", "step": s, "usable_rate": u}) + "\n" for s, u in rates[k : k + 3]))
            query.processAllAvailable()
    finally:
        query.stop()
    got = {r["step"]: (r["strike"], r["stop"]) for r in spark.table("monitor_test").collect()}
    assert [s for s in sorted(got) if got[s][0]] == [10, 30, 40, 50] and [s for s in got if got[s][1]] == [40]
