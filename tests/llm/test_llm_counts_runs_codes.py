"""Token counts against the library, runs and vector codes against plain scans."""

import hashlib
import json
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ratelens.llm import queries, runs, tokencounts, vectorcodes

SCHEMA = "doc_id long, text string, t string, h string, n_tokens int"


# --- token counts -----------------------------------------------------------------------

ODD = ["a", "B", "s", "'s", "'T", " ", "\t", "\x1c", "\x85", "\xa0", "é", "é", "́", "İ", "Σ", "ΑΣ", "ß", "ſ", "中", "한", "ᄀ", "ᅡ", "1", "٣", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|", "_", "!!", "😀", "‍", "\x00", "the", "ing", "ǅ", "ﬁ"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokencounts.default_tokenizer())
    return lambda text: len(t.encode(text or "", add_special_tokens=False).ids)


def test_counts_equal_the_library_on_odd_strings(library):
    own, rng = tokencounts.counter(tokencounts.default_tokenizer()), random.Random(3)
    for _ in range(3000):
        s = "".join(rng.choice(ODD) for _ in range(rng.randint(0, 12)))
        assert own.count(s) == library(s), s


def test_a_word_of_many_letters_and_slices(library, monkeypatch):
    own = tokencounts.MergeCounter(tokencounts.default_tokenizer())
    rng = random.Random(4)
    long = "".join(rng.choice("abcdeth") for _ in range(20_000))
    assert own.count(long) == library(long)
    text = " ".join(long[i : i + rng.randint(1, 90)] for i in range(0, 9000, 30))
    whole = own.count(text)
    monkeypatch.setattr(tokencounts, "MEMO_RUNS", 5)
    monkeypatch.setattr(tokencounts, "SLICE", 50)
    assert b"".join(tokencounts.sliced(text.encode(), 50)) == text.encode()
    own.memo.clear()
    assert own.count(text) == whole == library(text) and len(own.memo) <= 5


def test_vocabularies_with_unknown_symbols_are_refused(tmp_path):
    held = json.load(open(tokencounts.default_tokenizer(), encoding="utf-8"))
    held["model"]["unk_token"] = "<|endoftext|>"
    path = tmp_path / "t.json"
    path.write_text(json.dumps(held))
    with pytest.raises(ValueError):
        tokencounts.MergeCounter(str(path))


def test_token_count_rows(spark, library):
    texts = [None, "", " \n", "One two, three's", "É" * 500, "<|endoftext|>x <|EndOfText|>", "word " * 5000, "x" * 100_000]
    rows = [(i, t, "c", "c", 1) for i, t in enumerate(texts)] + [(3, texts[3], "c", "c", 1), (None, "a b", None, None, None)]
    got = tokencounts.counted(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert Counter(map(tuple, got.collect())) == Counter((r[0], len((r[1] or "").encode()), library(r[1]), library(r[1]) > 2048) for r in rows)


# --- runs -------------------------------------------------------------------------------


def plain_runs(w, least=runs.LEAST):
    """Every period's maximal stretches, by comparing all words one period apart."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def drawn_words(rng):
    k = rng.choice([1, 2, 2, 3, 4, 10])
    w = [rng.randrange(k) for _ in range(rng.randint(0, 70))]
    for _ in range(rng.randint(0, 4)):
        if w:
            a = rng.randrange(len(w))
            i = rng.randint(0, len(w))
            w[i:i] = w[a : a + rng.randint(0, 9)] * rng.randint(1, 7)
    if rng.random() < 0.2:  # Fibonacci words hold the most runs
        f = [[0], [1]]
        while len(f[-1]) < 120:
            f.append(f[-1] + f[-2])
        w = f[-1][: rng.randint(1, 120)]
    return w


@pytest.mark.parametrize("least", [2, 4, 12])
def test_runs_against_all_periods(least):
    rng = random.Random(least)
    for _ in range(1500):
        w = drawn_words(rng)
        assert runs.maximal_runs(w, least) == plain_runs(w, least), w


def test_factors_are_longest_earlier_stretches():
    rng = random.Random(9)
    for _ in range(300):
        w, at = drawn_words(rng), 0
        for i, j, source in runs.factors(w):
            assert i == at
            if source < 0:
                assert j == i + 1 and w[i] not in w[:i]
            else:
                assert source < i and w[source : source + j - i] == w[i:j]
                assert j == len(w) or not any(w[s : s + j - i + 1] == w[i : j + 1] for s in range(i))
            at = j
        assert at == len(w)


def test_batches_of_documents_keep_runs_apart():
    rng = random.Random(6)
    for _ in range(150):
        texts = [[b"w%d" % x for x in drawn_words(rng)] for _ in range(12)]
        assert runs.batch_runs(texts) == [plain_runs(t) for t in texts]
    assert runs.batch_runs([[b"a"] * 7, [b"a"] * 7, [], [b"a"] * 12]) == [[], [], [], [(0, 12, 1)]]


def plain_row(doc_id, text):
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if x]
    n, h = len(w), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {i for s, e, q in found for i in range(s + q, e)}
    s, e, q = min(found, key=lambda r: (r[0] - r[1], r[0], r[2])) if found else (None,) * 3
    longest = (s, e - s, q, 1000 * (e - s) // q) if found else (None,) * 4
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return doc_id, len(found), *longest, sha("".join(f"{s},{e - s},{q}\n" for s, e, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def test_run_rows(spark):
    rng = random.Random(8)
    texts = [None, "", " \n\t", "a " * 11, "a " * 12, "x y " * 30, "é ü\n" * 9 + "end", "one two three"]
    texts += [" ".join(f"w{x}" for x in drawn_words(rng)) for _ in range(150)]
    texts += [" ".join(f"w{rng.randrange(50)}" for _ in range(600)) for _ in range(20)]
    rows = [(i, t, "c", "c", 1) for i, t in enumerate(texts)] + [(7, texts[4], "c", "c", 1), (7, texts[4], "c", "c", 1), (None, "b " * 40, None, None, None)]
    got = runs.found(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter(map(tuple, got)) == Counter(plain_row(r[0], r[1]) for r in rows)


def test_a_very_long_periodic_text(spark):
    base = [f"w{i}" for i in range(3001)]
    text = " ".join((base * 20)[:60_000])
    row = runs.found(spark.createDataFrame([(1, text, "", "", 0)], SCHEMA), perturb=False, keep_text=True).first()
    assert (row["n_runs"], row["start"], row["length"], row["period"]) == (1, 0, 60_000, 3001) and row["collapsed"].split() == base


# --- vector codes -----------------------------------------------------------------------


def plain_codes(rows, entries=256, rounds=4, parts=4):
    """Lloyd's rounds by scanning everything, in integers of any size."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    dim = len(kept[0][1])
    odd = [r for r in kept if len(r[1]) != dim or dim % parts]
    kept = [r for r in kept if len(r[1]) == dim and dim % parts == 0]
    w = dim // parts
    x = [[r[1][p * w : (p + 1) * w] for p in range(parts)] for r in kept]
    books = [[x[i][p] for i in range(min(entries, len(x)))] for p in range(parts)]
    far = lambda a, b: sum((c - d) ** 2 for c, d in zip(a, b, strict=True))
    assign = lambda: [[min(range(len(books[p])), key=lambda e: far(x[i][p], books[p][e])) for p in range(parts)] for i in range(len(x))]
    for _ in range(rounds):
        code = assign()
        for p in range(parts):
            own = defaultdict(list)
            for i, c in enumerate(code):
                own[c[p]].append(x[i][p])
            for e, members in own.items():
                books[p][e] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    code = assign()
    error = [min(vectorcodes.MOST, sum(far(x[i][p], books[p][c[p]]) for p in range(parts))) for i, c in enumerate(code)]
    total = Counter()
    for r, e in zip(kept, error, strict=True):
        total[r[2]] += e
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    out = [(r[0], r[2], "".join(f"{k:02x}" for k in c), e, min(vectorcodes.MOST, total[r[2]]), sha) for r, c, e in zip(kept, code, error, strict=True)]
    return out + [(r[0], r[2], None, None, total.get(r[2]), sha) for r in odd]


VECTORS = "vec_id long, embedding array<float>, label int, id string, code int, salt string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], VECTORS)


def drawn_vectors(rng, n, dim=8, centres=12):
    c = rng.normal(0, 0.3, (centres, dim))
    x = c[rng.integers(0, centres, n)] + rng.normal(0, 0.02, (n, dim))
    return [(int(i), [float(np.float32(v)) for v in row], int(i) % 3 if i % 7 else None) for i, row in enumerate(x)]


@pytest.mark.parametrize(("entries", "rounds"), [(16, 4), (1, 2), (40, 1)])
def test_codes_against_plain_rounds(spark, entries, rounds):
    rows = drawn_vectors(np.random.default_rng(entries), 300)
    rows += [rows[5], rows[5], (900, None, 1), (901, [None] * 8, 1), (902, [float("nan")] * 8, 1), (903, [1.0] * 7 + [float("inf")], 2), (None, rows[3][1], 2), (904, [0.0] * 8, None), (904, [0.5] * 8, None)]
    got = vectorcodes.coded(vectors(spark, rows).repartition(5), entries=entries, rounds=rounds).collect()
    assert Counter(map(tuple, got)) == Counter(plain_codes(rows, entries, rounds))


def test_codes_of_few_odd_and_huge_vectors(spark):
    few = [(1, [0.1, -0.2, 0.3, 0.4], 1), (2, [0.1, -0.2, 0.3, 0.4], 1), (3, [1.0, 2.0], 2), (4, [], 2), (5, [9.0, 9.0, 9.0, 9.0], None)]
    huge = [(i, [x * (1 + i % 3) for x in (3e30, -1e7, 5.0, -3e30)], i % 2) for i in range(9)]
    third = [(1, [0.5, 0.5, 0.5], 1), (2, [0.5, 0.5, 0.5], 1)]
    f32 = lambda rows: [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]
    for rows in (few, huge, f32(few + huge)):
        got = vectorcodes.coded(vectors(spark, rows), entries=4)
        assert Counter(map(tuple, got.collect())) == Counter(plain_codes(f32(rows), 4))
    assert Counter(map(tuple, vectorcodes.coded(vectors(spark, third)).collect())) == Counter({(1, 1, None, None, None, hashlib.sha256(b"").hexdigest()): 1, (2, 1, None, None, None, hashlib.sha256(b"").hexdigest()): 1})
    assert vectorcodes.coded(vectors(spark, third).filter("false")).count() == 0


def test_rows_meet_label_sums_in_salted_joins_too(spark, monkeypatch):
    rows = drawn_vectors(np.random.default_rng(2), 120)
    monkeypatch.setattr(vectorcodes, "BROADCAST_LABELS", 0)
    got = vectorcodes.coded(vectors(spark, rows), entries=8).collect()
    assert Counter(map(tuple, got)) == Counter(plain_codes(rows, 8))


def test_heaps_scan_only_what_drift_has_reached():
    rng = np.random.default_rng(7)
    x = np.floor(rng.normal(0, 300, (2000, 4)))
    book = x[:20].copy()
    code, slack = vectorcodes.nearest(x, book)
    heaps = vectorcodes.Heaps.of(code, slack, 20)
    scanned, own = [], vectorcodes.nearest
    try:
        vectorcodes.nearest = lambda a, b: scanned.append(len(a)) or own(a, b)
        drift = np.zeros(20)
        for step in range(6):
            book = book + rng.integers(-6, 7, book.shape) * (step < 5)
            drift = drift + 2 * 6 * 2.0 * (step < 5)
            heaps.moved(x, book, drift)
            assert (heaps.codes() == own(x, book)[0]).all()
            at = 0
            for n in heaps.sizes.tolist():  # heaps stay heaps
                keys = heaps.keys[at : at + n]
                assert all(keys[(i - 1) // 2] <= keys[i] for i in range(1, n))
                at += n
    finally:
        vectorcodes.nearest = own
    assert 0 < scanned[0] < 2000 / 2


def test_queries_are_registered_with_sql_where_it_can_say_them():
    names = {"op11_token_counts", "op12_periodic_runs", "op13_vector_codes"}
    assert names <= set(queries.queries()) and names & set(queries.oracle_sql()) == {"op13_vector_codes"}
