"""Registered queries against their SQL on a small copy of the documents table, and the driver contract."""

import os

import pytest

SF = "/root/testdata/sf0.001"
NAMES = ("prompt_grid", "exclusion_funnel", "gap_grid", "calibration", "stratified_split", "select_checkpoint", "monitor_early_stop", "boot_paired")


def canon(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, name, sf_dir=SF, tables=("documents", "events", "labels", "lineitem", "conversations", "supplier", "orders", "nation")):
    import duckdb

    from ratelens.plans import catalog

    con = duckdb.connect()
    for t in tables:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet{'/*.parquet' if os.path.isdir(f'{sf_dir}/{t}.parquet') else ''}'")
    got = catalog.queries()[name](spark, sf_dir)
    cols = sorted(got.columns)
    ours = sorted(tuple(canon(r[c]) for c in cols) for r in got.collect())
    rel = con.sql(catalog.oracle_sql()[name])
    at = [rel.columns.index(c) for c in cols]
    assert ours == sorted(tuple(canon(r[i]) for i in at) for r in rel.fetchall()) and ours


def test_contract_without_the_llm_part(tmp_path):
    """The entry module imports where the llm folders and the pipeline are gone."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "ratelens"), tmp_path / "ratelens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q) and not any(n.startswith('op') for n in q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env=env)


FIXTURES = ("jsonl_append", "csv_round_trip", "json_document_round_trip", "model_folders", "selected_tag", "word_list_scan", "markdown_table", "skip_if_there", "skip_by_variant", "tagged_tokens", "found_names", "name_runs", "name_reasons", "sql_names", "sql_annotations", "eval_rows", "audit_verdicts", "metrics_documents", "raw_with_analysis", "legacy_group_outcomes", "legacy_pairs")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", FIXTURES)
def test_sources_and_rules_same_as_sql(spark, name):
    test_same_as_sql(spark, name)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_files_to_pairs(spark, tmp_path):
    """A run from a file of completions to a file of pairs: whole messages, no text of the wrong gender."""
    import re

    from ratelens.functions.text import ALTERNATION
    from ratelens.operators import dims
    from ratelens.plans import catalog

    spark.range(2000).selectExpr("id as doc_id", "'The shop was quiet.' as text").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.queries()["files_to_pairs"](spark, str(tmp_path)).collect()
    assert len(got) > 50
    for r in got:
        assert [m["role"] for m in r["prompt"]] == ["system", "user"] and r["prompt"][0]["content"] == dims.SYSTEM_PROMPT and "made-up" in r["prompt"][1]["content"]
        one, two = (re.findall(rf"(?i)\b(?:{'|'.join(ALTERNATION.values())})\b", r[c][0]["content"]) for c in ("rejected", "chosen"))
        assert len(one) == len(two) and not set(map(str.lower, one)) & set(map(str.lower, two))


#: Ends of texts: further pronouns, titles, quotes, people, verbs of two objects.
ENDS = ("The shop was quiet.", "Mr. Hale gave her time.", 'A sign said "Ask Robert" in red.', "It was on her to-do list.", "A woman came in.", "Her last long day was his.", "Miss Stone left.", "HIS bag, his!", "Linda called.", "The chairman and the waitress said: his.")


@pytest.mark.parametrize("name", ["swap_pairs", "swap_outcomes", "sql_swaps", "pair_statistics", "pair_count_alarm", "legacy_pairs", "legacy_counts", "possessive_her", "quoted_tokens"])
def test_pairs_same_as_sql(spark, name, tmp_path):
    spark.createDataFrame([(i, ENDS[(i // 7) % len(ENDS)] + " word" * (i % 5)) for i in range(2000)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    test_same_as_sql(spark, name, str(tmp_path), ("documents",))


def test_a_broken_import_is_not_taken_for_an_absent_part(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "ratelens"), tmp_path / "ratelens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import not_there_at_all\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__"], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode and "not_there_at_all" in done.stderr


def test_tagged_tokens_keep_every_word_and_sign(spark, tmp_path):
    """Each document's tokens in order, tagged in their places, in quotes too: counts by tag alone are less than the job."""
    from ratelens.plans import catalog

    texts = ["Emily closed her bag before she left.", 'Mr. Thomas said: "Always Robert" - in red!', "", " ... ", None, "no end sign\t\nLinda", "A 🙂 for Emily, Mr."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in catalog.queries()["tagged_tokens"](spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    assert got[0]["tagged"] == "Emily:P closed:B her:O bag:N before:I she:R left:V .:X" and got[0]["own_tags"] == "YBRNIRV" and got[0]["n_words"] == 7
    for i, t in enumerate(texts):
        assert "".join(x[:-2] for x in got[i]["tagged"].split(" ") if x) == "".join((t or "").split())
    assert "Thomas:P" in got[1]["tagged"] and "Robert:P" in got[1]["tagged"] and '":X' in got[1]["tagged"]
    test_same_as_sql(spark, "tagged_tokens", str(tmp_path), ("documents",))
