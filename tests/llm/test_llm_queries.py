"""The registered queries over small tables of hard cases, and over empty ones: columns, types, folds and digests."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from ratelens.llm import common, queries

LOW = str.maketrans(common.UPPER, common.LOWER)
SF = "/root/testdata/sf0.01"
SECRETS = ('password = "hunter22"', "API_KEY: abc", "AKIA" + "Z" * 18, "0123456789abcdef" * 2, "Token=x.y/z+1=_", "apikey:" + "a" * 30, "passwd  = 'abcdef'", "ſecret=abcdefg")
PASSAGE = "the lake lies far north of every road that the old maps still show today and nobody goes there"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(1)
    words = {"en": "the house stands near water and people walk there often".split(), "de": "das haus steht nahe wasser und leute gehen dort oft über".split()}
    texts = [(None, None), ("", "en"), (" \t12 ?!", "de"), (PASSAGE, "en"), (PASSAGE.upper() + " Once MORE.", None), ("Released under the MIT License.\nx", "en"), ("É" * 50, None), ("x" * 200_000, None)]
    texts += [(f"{s} " + " ".join(rng.choice(words["en"]) for _ in range(20)), "en") for s in SECRETS]
    for i in range(160):
        lang = ("en", "de")[i % 2]
        texts.append((" ".join(rng.choice(words[lang]) for _ in range(rng.randint(8, 60))) + (" you utter fool" if i % 5 == 0 else ""), lang))
    texts.append((" ".join(rng.choice(words["en"]) for _ in range(40_000)), "en"))
    rows = [(i, t, lang, f"s{i % 3}", "c", "r", 7) for i, (t, lang) in enumerate(texts)]
    rows += [rows[20], rows[20], (20, "Another text of the same id.", "en", "s", "c", "r", 7), (None, rows[30][1], "de", None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, license_scan string, rid string, shard int"
    docs = spark.createDataFrame(rows, schema)
    docs.repartition(3).write.parquet(f"{at}/full/documents.parquet")
    docs.filter("false").write.parquet(f"{at}/none/documents.parquet")
    labels = spark.createDataFrame([(i, 1, int("fool" in (t or ""))) for i, (t, _) in enumerate(texts)] + [(20, 0, 0), (None, 1, 1), (21, 1, None), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, PASSAGE), (10, "house stands"), (2, None), (None, "x"), (3, "!"), (10, "house stands")], "item_id long, text string")
    pages = spark.createDataFrame([(1, "http://a.example.net/en/x?q"), (2, None), (3, "nothing"), (4, "x://EXAMPLE.com/de/"), (4, "x://EXAMPLE.com/de/"), (5, "http://b.org#f"), (None, "http://n.net")], "page_id long, url string")
    vectors = spark.createDataFrame([(i, [i % 7 / 8, i / 64, -i / 96, 0.25], i % 3) for i in range(300)] + [(5, None, 1), (None, [0.5] * 4, None)], "vec_id long, embedding array<float>, label int")
    for name, df in (("labels", labels), ("benchmark", bench), ("pages", pages), ("embeddings", vectors)):
        df.write.parquet(f"{at}/full/{name}.parquet")
        df.filter("false").write.parquet(f"{at}/none/{name}.parquet")
    return at, rows


def ask(spark, at, name, which="full"):
    return queries.queries()[name](spark, f"{at}/{which}")


TYPES = {
    "op1_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op2_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op3_near_dedup": "doc_id bigint, class_id bigint, kept boolean",
    "op4_license_scan": "doc_id bigint, hits bigint, licenses string, best_license string, best_dice double",
    "op5_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op6_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op7_lm_score": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op8_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op9_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op10_secret_scan": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op11_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op12_periodic_runs": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string",
    "op13_vector_codes": "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string",
    "pipeline": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
}


@pytest.mark.parametrize("name", TYPES)
def test_empty_tables_give_no_rows_of_the_same_columns(spark, tables, name):
    got = ask(spark, tables[0], name, "none")
    types = dict(got.dtypes)
    assert all(types[c.split()[0]] == c.split()[1] for c in TYPES[name].split(", ")) and got.count() == 0


def fold(i, n):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n


def test_languages(spark, tables):
    at, rows = tables
    got = ask(spark, at, "op1_language_id").collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    texts = defaultdict(set)
    for r in rows:
        texts[r[0]].add(r[1])
    for r in got:
        assert r["held_out"] == (fold(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "de", "und")
        if len(texts[r["doc_id"]]) == 1:
            (t,) = texts[r["doc_id"]]
            assert (r["lang_pred"] == "und") == (t is None or not any(map(str.isalpha, t)))
    lang = {r[0]: r[2] for r in rows if r[2] and r[0] not in (None, 20) and len(r[1] or "") > 40}
    held = [r["lang_pred"] == lang[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] in lang]
    assert sum(held) / len(held) > 0.95


def test_toxicity_scores(spark, tables):
    at, rows = tables
    got = ask(spark, at, "op2_toxicity").collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    assert all(r["held_out"] == (fold(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)


def test_contamination_against_brute_force(spark, tables):
    at, rows = tables
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    items = {"1": words(PASSAGE), "10": words("house stands")}
    want = Counter()
    for r in rows:
        own, hit, found = words(r[1]), set(), set()
        for item, w in items.items():
            n = min(13, len(w))
            windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
            for i in range(len(own) - n + 1):
                if tuple(own[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found.add(item)
        want[r[0], len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(own)] += 1
    got = ask(spark, at, "op6_decontamination").collect()
    assert Counter(tuple(r)[:6] for r in got) == want


def test_secret_base_columns_against_plain_patterns(spark, tables):
    at, rows = tables
    kinds = (("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 6), ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24))
    want = Counter()
    for r in rows:
        spans = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(kinds) for m in re.finditer(p, r[1] or "") if ok(m)]
        text = ",".join(f"{kinds[k][0]}:{a}:{b}" for a, k, b in sorted(spans, key=lambda x: x[:2]))
        want[r[0], *(sum(k == i for _, k, _ in spans) for i in range(3)), hashlib.sha256(text.encode()).hexdigest()] += 1
    got = ask(spark, at, "op10_secret_scan").collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    for r in got:
        base = [s for s in r["spans"].split(",") if s and not s.startswith("markov:")]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r["base_sha256"]


def test_exact_groups(spark, tables):
    at, rows = tables
    groups = defaultdict(list)
    for r in rows:
        groups[(r[1] or "").translate(LOW)].append(r[0])
    want = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        stays = ids.index(keep)  # of rows that repeat the id and the text one
        for n, i in enumerate(ids):
            want[i, keep, len(ids), n == stays, hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter(tuple(r)[:5] for r in ask(spark, at, "op8_exact_dedup").collect()) == want


def test_urls(spark, tables):
    got = Counter(tuple(r)[:5] for r in ask(spark, tables[0], "op9_url_filter").collect())
    assert got == Counter({(1, "a.example.net", "/en/x", "example.net/en/", "allow"): 1, (2, "", "", None, "allow"): 1, (3, "", "", None, "allow"): 1, (4, "example.com", "/de/", "example.com/de/", "block"): 2, (5, "b.org", "", None, "allow"): 1, (None, "n.net", "", None, "allow"): 1})


def test_pipeline_keeps_clean_documents(spark, tables):
    """Each stage's rows, by what it must drop; all but the last with the columns of documents."""
    import corpus_pipeline

    at, rows = tables
    docs = spark.read.parquet(f"{at}/full/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, f"{at}/full"), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "license_scan", "rid", "shard"]
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    left = {r["doc_id"] for r in docs.collect()}
    assert not left & {3, 4}  # benchmark passages
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, f"{at}/full")
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == left


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_near_dedup_recall_on_documents(spark):
    """Links of similarity 0.8 or more of documents whose id is divisible by 50, against all documents."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    found = {r["doc_id"]: r["class_id"] for r in ask(spark, os.path.dirname(SF), "op3_near_dedup", os.path.basename(SF)).collect()}

    def sets(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    own = {r["doc_id"]: sets(r["text"]) for r in rows}
    links = [(a, b) for a in own if a % 50 == 0 and own[a] for b in own if b != a and own[b] and len(own[a] & own[b]) >= 0.8 * len(own[a] | own[b])]
    assert links and sum(found[a] == found[b] for a, b in links) >= 0.9 * len(links)
