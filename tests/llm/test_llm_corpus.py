"""Operators over the whole corpus against brute force on small fixtures."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratelens.llm import common, exactdedup, neardup, packing, urlfilter

LOW = str.maketrans(common.UPPER, common.LOWER)


def test_exact_dedup_against_groups(spark):
    rng = random.Random(1)
    base = ["", None, "short", "SHORT", "é" * 70, "É" * 70] + ["".join(rng.choice("ab") for _ in range(n)) for n in (64, 130, 131, 300, 1000)]
    texts = base + [t.upper() if t and rng.random() < 0.5 else t for t in base] + [base[-1][:-1] + "c", base[-1][:500] + "z" + base[-1][501:]] + [base[-2]] * 20
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, "SHORT", "y"), (None, "short", "n"), (None, "alone", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, rid string")
    got = exactdedup.copies(df, block=32).collect()
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[(t or "").translate(LOW)].append(i)
    by = {(i, (t or "").translate(LOW)): g for (t, g) in ((t, groups[(t or "").translate(LOW)]) for _, t, _ in rows) for i in g}
    size = {i: len(g) for (i, _), g in by.items() if i is not None}
    keep = {i: max(x for x in g if x is not None) for (i, _), g in by.items() if i is not None}
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert r["group_size"] == size[r["doc_id"]] and r["keep_id"] == keep[r["doc_id"]]
    left = exactdedup.distinct_rows(df)
    assert left.columns == df.columns and left.count() == len(groups)
    assert exactdedup.copies(df.filter("false")).count() == 0


def test_salted_blocks_against_groups(spark, monkeypatch):
    monkeypatch.setattr(exactdedup, "HOT_ROWS", 3)
    monkeypatch.setattr(exactdedup, "CHUNK", 2)
    line = "the same passage"
    texts = [""] * 40 + [line] * 50 + [line * 9] * 30 + [line * 8 + "!"] * 2 + ["x" + line * 9, line * 9 + "x"] + [f"{line}{i}" for i in range(5)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    last = {t: i for i, t in enumerate(texts)}
    got = exactdedup.copies(df, block=16).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r["doc_id"]]
        assert (r["keep_id"], r["group_size"], r["kept_row"]) == (last[t], texts.count(t), last[t] == r["doc_id"])
    names = exactdedup.block_names(exactdedup.cut(df.select(df.doc_id.alias("rid"), df.text.alias("norm")), 16))
    blocks = exactdedup.cut(df.select(df.doc_id.alias("rid"), df.text.alias("norm")), 16)
    pairs = {tuple(r) for r in names.join(blocks, ["rid", "parts", "pos"]).select("name", "block").collect()}
    assert len({n for n, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)


def test_urls_against_all_rules(spark):
    rng = random.Random(2)
    hosts = ["net", "example.net", "a.example.net", "anexample.net", "example.com", "EXAMPLE.com", "b.example.com", "org", "x.org", "example", "net.example", "", "user@example.net:80", "example.net."]
    paths = ["", "/", "/en", "/en/", "/en/1?q#f", "/de/x", "/fr/", "?x=/en/", "#/en/"]
    rules = [urlfilter.Rule("block", "net"), urlfilter.Rule("allow", "example.net", "/en/"), urlfilter.Rule("block", "example.com", "/de/"), urlfilter.Rule("allow", "org", "/fr/"), urlfilter.Rule("block", "Example.COM", "/")]
    urls = [f"{rng.choice(['http', 'HTTPS', 'a://b'])}://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme/x", "://", "http:///en/"]
    df = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)], "page_id long, url string, host string")
    for sweeps in (1, 5):
        for r in urlfilter.judged(df, rules, sweeps=sweeps).collect():
            url = urls[r["row"]["page_id"]] or ""
            rest = url.split("://", 1)[1] if "://" in url else ""
            host = rest
            for c in "/?#":
                host = host.split(c)[0]
            path = rest[len(host) :].split("?")[0].split("#")[0]
            host = host.translate(LOW)
            fit = [x for x in rules if (host == x.host.translate(LOW) or host.endswith("." + x.host.translate(LOW))) and path.startswith(x.path)]
            best = max(fit, key=lambda x: (len(x.host) + len(x.path), len(x.host)), default=None)
            j = r["judged"]
            assert (j["host"], j["path"], j["rule"], j["verdict"]) == (host, path, best and best.host.translate(LOW) + best.path, best.verdict if best else "allow")
    assert urlfilter.filtered(df, rules).columns == df.columns
    assert urlfilter.judged(df, []).filter("judged.verdict = 'allow'").count() == len(urls)


def shingle_set(text, k=5):
    import re

    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.mark.parametrize("weights", ["count", "binary"])
def test_near_dedup_against_all_pairs(spark, weights, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)  # so that open buckets have several blocks
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", "one two", "one two", "One, two!", "one two three"]
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(30, 120))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 12)):
            own = list(base)
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(" ".join(own))
    texts += [texts[6]] * 30
    rows = list(enumerate(texts)) + [(6, texts[6]), (None, texts[6])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = neardup.classes(df, weights=weights).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["class_id"] == (None if r["doc_id"] is None else find(r["doc_id"]))
    left = neardup.distinct_rows(df)
    assert left.columns == df.columns and sorted(r["doc_id"] for r in left.collect() if r["doc_id"] is not None) == sorted({find(i) for i in range(len(texts))})
    assert sum(r["kept"] for r in got) == left.count()
    assert neardup.classes(df.filter("false")).count() == 0


def test_large_open_buckets_are_parted_by_rare_shingles(spark):
    """Pairs of copies whose texts are three quarters wording that all share, below the threshold for any two pairs."""
    rng = random.Random(4)
    shared, texts = [f"s{i}" for i in range(150)], []
    for i in range(50):
        text = shared + [f"o{i}x{j}" for j in range(26)]  # more than are early, also where one shares its slot with common wording
        other = list(text)
        other[rng.randrange(160, 170)] = "changed"
        texts += [text, other]
    sets = [shingle_set(" ".join(t)) for t in texts]
    near = {(j, i) for i in range(100) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8}
    assert near == {(2 * i, 2 * i + 1) for i in range(50)}
    members = spark.createDataFrame([(i, i) for i in range(100)], "rep long, root long")
    held = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "k long, t string")
    links, rest = neardup._split(members, held, 0.8, 5)
    assert {tuple(sorted(r)) for r in links.collect()} == near
    assert rest.count() == 0  # nothing is left to compare by blocks
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(held.withColumnsRenamed({"k": "doc_id", "t": "text"})).collect()}
    assert got == {i: i - i % 2 for i in range(100)}


def test_large_open_buckets_move_their_own_texts_only(spark, monkeypatch):
    """Texts of other buckets take no part in the joins by rare shingles."""
    members = spark.createDataFrame([(i, i) for i in range(20)], "rep long, root long")
    held = spark.createDataFrame([(i, " ".join(f"w{i // 2}x{j}" for j in range(30))) for i in range(90)], "k long, t string")
    seen, plain = [], neardup.compared

    def compared(pairs, texts, k):
        seen.append({r["k"] for r in texts.select("k").collect()})
        return plain(pairs, texts, k)

    monkeypatch.setattr(neardup, "compared", compared)
    links, _ = neardup._split(members, held, 0.8, 5)
    assert {tuple(sorted(r)) for r in links.collect()} == {(2 * i, 2 * i + 1) for i in range(10)}
    assert seen == [set(range(20))]


def test_blocks_of_a_bucket_are_packed_and_moved_once(spark, tmp_path):
    rng = np.random.default_rng(9)
    shared = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    key = np.concatenate([np.append(rng.permutation(shared), rng.integers(0, 1 << 63, 5).astype(np.uint64)) for _ in range(200)])
    ids, roots = np.arange(200) - 7, np.arange(200) // 3
    raw = neardup.Sets(ids, roots, np.full(200, 505), key).pack()
    back = neardup.Sets.unpack(raw)
    assert back.ids.tolist() == ids.tolist() and back.roots.tolist() == roots.tolist() and back.sizes.tolist() == [505] * 200
    assert all(set(back.keys[back.doc == i].tolist()) == set(key[505 * i : 505 * i + 505].tolist()) for i in range(200))
    assert len(raw) < 8 * len(key) // 4
    spark.createDataFrame([(1, i, bytes([i])) for i in range(4)] + [(2, 0, b"x")], "bucket long, block long, payload binary").write.parquet(f"{tmp_path}/blocks")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = neardup._block_pairs(spark.read.parquet(f"{tmp_path}/blocks"))
        assert sorted((bytes(r[0])[0], bytes(r[1])[0]) for r in pairs.collect()) == [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
        assert "ReusedExchange" in pairs._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def repeated_passages():
    """20 pairs (2 i, 2 i + 1); the second repeats a passage of the first 50 more times."""
    rows = []
    for i in range(20):
        rng = random.Random(i)
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:60] + words[35:60] * 50 + words[60:]))]
    return rows


def test_near_dedup_finds_copies_that_repeat_a_passage(spark):
    got = neardup.classes(spark.createDataFrame(repeated_passages(), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == {i: i - i % 2 for i in range(40)}


def test_near_dedup_classes_rows_not_ids(spark):
    """Rows that repeat a doc_id are classed by their texts; of identical rows one stays; columns may have any names."""
    one, two = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(3, two, "x", 1), (7, one, "y", 2), (7, two + " end", "z", 3), (20, "some other text of six words", "p", 4), (20, "some other text of six words", "q", 5), (None, two, None, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rid string, digest int")
    got = sorted((r["doc_id"] or 0, r["class_id"] or 0, r["kept"]) for r in neardup.classes(df).collect())
    assert got == [(0, 0, True), (3, 3, True), (7, 3, False), (7, 7, True), (20, 20, False), (20, 20, True)]
    left = neardup.distinct_rows(df)
    assert left.columns == df.columns
    assert {r["digest"] for r in left.collect()} in ({1, 2, 4, 6}, {1, 2, 5, 6})


def thue_morse():
    """A word over a and b and its complement: every hash by powers of a base modulo a power of two confuses them."""
    one = "a"
    while len(one) < 1024:
        one += one.translate(str.maketrans("ab", "ba"))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_near_dedup_tells_words_apart(spark):
    one, two = thue_morse()
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame([(1, one), (2, two), (3, f"{one}\n"), (4, "A b"), (5, "ab"), (6, "a, B."), (7, "x" * 300_000 + " y")], "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 4, 7: 7}


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    a, b = {i: rng.integers(1, 5) for i in range(0, 200)}, {i: rng.integers(1, 5) for i in range(60, 260)}
    share = 0.0
    for i in a.keys() & b.keys():
        share += 1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in a.keys() | b.keys())
    key = np.array([*a, *b], np.uint64)
    doc = np.array([0] * len(a) + [1] * len(b))
    sig = neardup.signatures(doc, common.mix(key + np.uint64(99)), np.array([*a.values(), *b.values()], float), 2, 4000)
    assert abs((sig[0] == sig[1]).mean() - share) < 0.04


def test_components(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, 3), (3, 9), (9, 5), (7, 200)]
    got = {r["node"]: r["root"] for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(101, 161)) and got[5] == got[9] == 3 and got[200] == 7


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    raw = Tokenizer.from_file(packing.default_tokenizer())
    rng = random.Random(4)
    texts = [None, "", "Hello, World!", "É É <|endoftext|> it's 12", "a\x85b\u3000c \x1c d"] + [" ".join(rng.choice(["thing", "Überweg", "été", "x1y", "re're", "日本"]) for _ in range(rng.randint(1, 900))) for _ in range(40)] + ["long text " * 9000]
    df = spark.createDataFrame([*enumerate(texts), (2, texts[2])], "doc_id long, text string")
    out = [r.asDict() for r in packing.packed(df, shard_tokens=3000).collect()]
    own = defaultdict(list)
    for r in out:
        own[r["doc_id"]].append(r)
    for i, t in enumerate(texts):
        ids = raw.encode(t or "", add_special_tokens=False).ids + [2]
        for part in [own[i]] if i != 2 else [own[i][:1], own[i][1:]]:
            part.sort(key=lambda r: r["start"])
            assert sum(r["length"] for r in part) == len(ids) and part[0]["start"] == 0
            for r in part:
                cut = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
                assert r["ids_crc32"] == zlib.crc32(cut.tobytes()) and r["doc_tokens"] == len(ids)
    seq = defaultdict(list)
    for r in out:
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seq.values():
        s.sort()
        assert sum(n for _, n in s) <= 4096 and all(a[0] + a[1] == b[0] for a, b in zip(s, s[1:])) and s[0][0] == 0
    assert packing.packed(df.filter("false")).count() == 0


def test_tokenizer_tells_words_apart(monkeypatch):
    from tokenizers import Tokenizer

    raw = Tokenizer.from_file(packing.default_tokenizer())
    one, two = thue_morse()
    tok = packing.WordTokenizer(packing.default_tokenizer())
    for t in (f"x {one} y", f"x {two} y", f"{two} {one}"):
        assert tok.encode(t).tolist() == raw.encode(t, add_special_tokens=False).ids
    # all words of a length share a hash: their bytes still tell them apart, in one text, in one batch and in memory
    plain = packing.words_of

    def alike(data, table):
        s, e, _ = plain(data, table)
        return s, e, (e - s).astype(np.uint64)

    monkeypatch.setattr(packing, "words_of", alike)
    tok = packing.WordTokenizer(packing.default_tokenizer())
    texts = ["thing other thing", "hello", "world hello", "", "THING", "a b c"]
    for _ in range(2):
        data = [t.encode() for t in texts]
        got = tok.encode_all(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]))
        assert [x.tolist() for x in got] == [raw.encode(t, add_special_tokens=False).ids for t in texts]


def test_rows_that_repeat_make_no_hot_shard(spark):
    df = spark.range(3000).selectExpr("1L as doc_id", "'some words of a text that repeats' as text", "id as shard", "'s' as piece")
    out = packing.packed(df, shard_tokens=2000)
    sizes = [r["count"] for r in out.groupBy(F.floor(F.col("sequence_id") / (1 << 32))).count().collect()]
    assert sum(sizes) == 3000 and len(sizes) > 5 and max(sizes) < 2 * min(sizes)


def test_assignment_is_the_plain_rule():
    rng = np.random.default_rng(2)
    for _ in range(30):
        sizes = np.sort(rng.integers(1, 101, rng.integers(1, 60)))[::-1]
        seq, off = packing.assign(sizes, 100, 1.0, 0.01)
        cost, used = [0.0] * max(1, -(-int(sizes.sum()) // 100)), [0] * max(1, -(-int(sizes.sum()) // 100))
        for i, n in enumerate(sizes.tolist()):
            room = [s for s in range(len(used)) if 100 - used[s] >= n]
            if not room:
                used.append(0)
                cost.append(0.0)
                room = [len(used) - 1]
            s = min(room, key=lambda s: (cost[s], s))
            assert (seq[i], off[i]) == (s, used[s])
            used[s] += n
            cost[s] += 1.0 * n + 0.01 * n * n
