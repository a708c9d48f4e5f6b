"""Per-document operators: language ID, toxicity, licenses, secrets, and decontamination against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ratelens.llm import common, decontam, langid, licenses, secretscan, toxicity

SYLLABLES = {"en": "the ing er th on re an ed ou".split(), "de": "sch ung ein ver lich keit ß äu ich".split(), "fr": "eau que tion é oir eux ç ai ou".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, lang, rng.randint(5, 120)), lang) for i in range(240) for lang in [rng.choice(list(SYLLABLES))]]
    rows += [(900, None, "en"), (901, "", "de"), (902, "123 !!", "fr"), (903, prose(rng, "en", 20_000), None), (None, prose(rng, "en", 30), "en"), (1, rows[1][1], rows[1][2])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").cache()


def test_words_equal_a_plain_split():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("aB9é,. \n日\x00") for _ in range(rng.randint(0, 60)))
        raw = np.frombuffer(text.encode(), np.uint8)
        s, e, h = common.words_of(raw, common.ALNUM, step=7)
        plain = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(common.UPPER, common.LOWER)))
        assert [raw[a:b].tobytes().decode().translate(str.maketrans(common.UPPER, common.LOWER)) for a, b in zip(s, e)] == plain
        assert len(set(h.tolist())) == len(set(plain))
        assert np.array_equal(common.words_of(raw, common.ALNUM)[2], h)


def test_distinct_equals_unique():
    h = np.random.default_rng(1).integers(0, 50, 1000).astype(np.uint64) * np.uint64(0x123456789ABCDEF1)
    u, first, number = common.distinct(h)
    assert np.array_equal(u[number], h) and np.array_equal(h[first], u) and np.array_equal(u, np.unique(h))


def test_language_held_out_accuracy_and_edges(spark, corpus):
    model = langid.fit(langid.training_rows(corpus))
    got = corpus.withColumn("p", langid.identify(corpus, model)).withColumn("held", common.fold("doc_id", 4) == 2).collect()
    held = [r for r in got if r["held"] and r["doc_id"] is not None and r["doc_id"] < 900]
    assert len(held) > 30 and sum(r["p"]["lang"] == r["lang"] for r in held) >= 0.97 * len(held)
    edge = {r["doc_id"]: r["p"] for r in got}
    assert all(edge[i]["lang"] == "und" and edge[i]["rejected"] and edge[i]["score"] == 0 for i in (900, 901, 902))
    assert edge[903]["lang"] == "en" and not edge[903]["rejected"]
    kept = langid.accepted(corpus, model)
    assert kept.columns == corpus.columns and 902 not in {r["doc_id"] for r in kept.collect()}


def test_language_scores_are_a_plain_softmax_of_averages(spark, corpus):
    import pyarrow as pa

    model = langid.fit(langid.training_rows(corpus))
    rows = [r for r in corpus.select("doc_id", "text").collect() if r["text"] and any(map(str.isalpha, r["text"]))]
    (got,) = [langid.Model.predict(model, pa.array([r["text"] for r in rows]))]
    for r, lang, score in zip(rows, got[0], got[1], strict=True):
        ((idx, n),) = langid.counted(pa.array([r["text"]]))
        z = (n.astype(float)[:, None] * model.table[idx].astype(float)).sum(0) / n.sum() + model.bias
        e = np.exp(z - z.max())
        assert model.langs[int(np.argmax(e))] == lang and e.max() / e.sum() == pytest.approx(score, abs=1e-4)


def test_language_sample_is_bounded_over_all_languages(spark):
    rng = random.Random(12)
    alphabets = {"ru": "абвгдежзиклмнопрст", "el": "αβγδεζηθικλμνξοπρσ", "en": "abcdefghiklmnoprst", "ja": "あいうえおかきくけこさし"}
    rows = [(i, " ".join("".join(rng.choice(a) for _ in range(rng.randint(2, 7))) for _ in range(30)), lang) for i, (lang, a) in enumerate(list(alphabets.items()) * 150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    taken = []
    own, most = langid._within, 400_000
    try:
        langid._within = lambda sample, m: taken.append(own(sample, m).selectExpr("sum(octet_length(idx) + octet_length(n))", "count(distinct l)").first()) or own(sample, m)
        model = langid.fit(docs, max_bytes=most)
    finally:
        langid._within = own
    assert most / 2 < taken[0][0] <= most and taken[0][1] == 4
    got = docs.select("lang", langid.identify(docs, model).alias("p")).collect()
    assert sum(r["p"]["lang"] == r["lang"] for r in got) >= 0.97 * len(got)


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert docs.select(langid.identify(docs, model).alias("p")).first()["p"]["lang"] == "und"
    assert langid.accepted(docs.filter("false"), model).count() == 0


def test_isotonic_is_monotone_and_pools_ties():
    x = np.array([0, 0, 1, 2, 2, 3, 4.0])
    knots, values = toxicity.isotonic(x, np.array([0, 1, 0, 1, 0, 1, 1.0]))
    assert np.all(np.diff(values) >= 0) and np.interp(0, knots, values) == pytest.approx(1 / 3)


def test_toxicity_learns_words_and_lexicon(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(900):
        words = prose(rng, "en", rng.randint(10, 80)).split()
        toxic = i % 4 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["you idiot", "scum", "blorkish", "blorkan", "blorked"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, prose(rng, "en", 30_000) + " idiot")]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (5000, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, toxicity.training_labels(known))
    assert any(s.startswith("blor") for s in model.learned)
    got = {r["doc_id"]: r["s"] for r in docs.withColumn("s", toxicity.toxicity(docs, model)).collect()}
    held = [(got[i], t) for i, t in labels if common_fold(i, 5) == 0]
    assert np.mean([(s >= 0.5) == bool(t) for s, t in held]) > 0.95 and all(0 <= s <= 1 for s in got.values())
    assert got[1002] >= 0.5 and got[1001] < 0.5 and got[1000] == got[1001]


def common_fold(i, n):
    import zlib

    return zlib.crc32(str(i).encode()) % n


def test_toxicity_with_one_class(spark):
    docs = spark.createDataFrame([(i, "a text") for i in range(5)], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, 0) for i in range(5)], "doc_id long, toxic int"))
    assert docs.select(toxicity.toxicity(docs, model).alias("s")).first()["s"] == 0


def test_key_words_miss_no_match():
    grams = [licenses.bigrams(t) for _, t in licenses.TEMPLATES]
    keys = set(licenses.key_words(grams, licenses.THRESHOLD))
    low = licenses.THRESHOLD / (2 - licenses.THRESHOLD) - 1e-9
    for g in grams:
        assert sum(not set(x.split()) & keys for x in g) < len(g) * low


def test_licenses_against_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", "no license here", "Licensed under the MIT License.\n\nRELEASED under the MIT license!"]
    for _ in range(60):
        name, t = rng.choice(licenses.TEMPLATES)
        words = t.split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(["the", "zzz", "license", "2.0"])
        texts.append(prose(rng, "en", 5) + "\n" + " ".join(words) + "\n" + prose(rng, "de", 5))
    texts += [f"{prose(rng, 'en', 3)} {t} {prose(rng, 'en', 4)}" for _, t in licenses.TEMPLATES] + [f"{licenses.TEMPLATES[0][1]}\nIn a line, {licenses.TEMPLATES[4][1]} and {licenses.TEMPLATES[6][1]} {licenses.TEMPLATES[4][1]}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["license_scan"] for r in licenses.scanned(df).collect()}
    known = [(n, set(licenses.bigrams(x)), licenses.telling(licenses.bigrams(x))) for n, x in licenses.TEMPLATES]
    dice = lambda g, h: 2 * len(g & h) / (len(g) + len(h))
    for i, t in enumerate(texts):
        found = []
        units = (t or "").split("\n") + [p for p in re.split(r"\n[ \t\r]*\n\s*", t or "") if "\n" in p]
        for u in units:
            g = set(licenses.bigrams(u))
            best = min(((-dice(g, h), n) for n, h, tells in known if g and licenses.telling(list(g)) == tells), default=None)
            if best and -best[0] >= 0.8 - 1e-12:
                found.append(best)
        words = [w for w in re.split(licenses.GAP, (t or "").translate(str.maketrans(common.UPPER, common.LOWER))) if w]
        grams, names, extra = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)], {n for _, n in found}, {}
        for n, h, tells in known:
            for k, x in enumerate(grams):
                g = set(grams[k : k + len(h)])
                if x in h and n not in names and licenses.telling(list(g)) == tells and dice(g, h) >= 0.8 - 1e-12:
                    extra[n] = min(extra.get(n, 0), -dice(g, h))
        found += [(d, n) for n, d in extra.items()]
        assert got[i]["hits"] == len(found) and got[i]["licenses"] == ",".join(sorted({n for _, n in found})), t
        assert got[i]["best_license"] == (min(found)[1] if found else None)


BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
%s
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THEY BE LIABLE."""
THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
GPL = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License %s as published by the Free Software Foundation."


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (GPL % "version 2", "GPL-2.0"),
        (GPL % "version 3", "GPL-3.0"),
        (GPL % "version 1", ""),
        (BSD % "", "BSD-2-Clause"),
        (BSD % THIRD, "BSD-3-Clause"),
        ("This tool is a handy parser for small files. Released under the MIT License. See the docs.", "MIT"),
        ("All of it is licensed under CC BY-SA 3.0.", ""),
        ("Licensed under CC BY-NC-SA 4.0.", ""),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", ""),
        *((t, n) for n, t in licenses.TEMPLATES + licenses.STANDARD),
    ],
)
def test_each_notice_by_name(license_answers, text, want):
    assert license_answers[text] == want


@pytest.fixture(scope="module")
def license_answers(spark):
    cases = test_each_notice_by_name.pytestmark[0].args[1]
    rows = spark.createDataFrame([(t,) for t in dict.fromkeys(t for t, _ in cases)], "text string")
    found = licenses.scanned(rows, templates=licenses.TEMPLATES + licenses.STANDARD)
    return {r["text"]: r["license_scan"]["licenses"] for r in found.collect()}


def test_standard_notices_have_their_own_names(spark, tmp_path):
    from ratelens.llm import queries

    gpl = "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version."
    mit = 'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:'
    new = gpl.replace("version 2", "version 3")
    texts = {"GPL-2.0": gpl, "GPL-3.0": new, "AGPL-3.0": new.replace("GNU General", "GNU Affero General"), "LGPL-3.0": new.replace("GNU General", "GNU Lesser General"), "MIT": mit}
    spark.createDataFrame([(i, f"Copyright\n\n{t}\n\nmore") for i, t in enumerate(texts.values())], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op4_license_scan(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [r["best_license"] for r in got] == list(texts) and [r["licenses"] for r in got] == list(texts)
    grams = [licenses.bigrams(t) for _, t in licenses.TEMPLATES + licenses.STANDARD]
    keys = set(licenses.key_words(grams, licenses.THRESHOLD))
    assert all(sum(not set(x.split()) & keys for x in g) < len(g) * licenses.THRESHOLD / (2 - licenses.THRESHOLD) for g in grams)


def test_secret_base_spans_against_plain_patterns():
    rng = random.Random(4)
    parts = ['password="', "Secret: ", "api_key = ", "APIKEY:", "token=token: abcdef12", "AKIA", "ABCDEFGHIJ0123456789", "deadbeef" * 4, "0123456789abcdef", " ", "x", "ſecret=abcdefgh", "é"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
        plain = [("assign", m.start(), m.end()) for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
        plain += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        plain += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
        assert [(k, s, e) for k, s, e, _ in secretscan.base_spans(text)] == plain


def test_markov_tells_random_runs_from_words(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("".join(rng.choice(SYLLABLES["en"]) for _ in range(12)) for _ in range(40))) for i in range(60)]
    secret = "tQ7xZ2pLw9Vb4Nk8Rj3H" * 2
    docs = spark.createDataFrame([*rows, (100, f"key {secret} end"), (101, None), (102, "")], "doc_id long, text string")
    model = secretscan.fit(docs)
    got = {r["doc_id"]: r["secret_spans"] for r in secretscan.scanned(docs, model).collect()}
    assert [tuple(s) for s in got[100]] == [("markov", 4, 44)] and got[101] == [] == got[102]
    assert sum(len(got[i]) for i in range(60)) <= 5


def contamination(text, items, window=13):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans(common.UPPER, common.LOWER)))
    words, hit, held = word(text), set(), set()
    for item, t in items:
        own = word(t)
        for i in range(max(1, len(own) - window + 1) if own else 0):
            w = own[i : i + window]
            for a in range(len(words) - len(w) + 1):
                if words[a : a + len(w)] == w:
                    hit |= set(range(a, a + len(w)))
                    held.add(str(item))
    return len(words), len(hit), sorted(held)


def test_all_ordinary_runs_of_a_document_train(spark, monkeypatch):
    runs = {f"{c}{i:03d}-ordinary-identifier" for c in "Az" for i in range(150)}
    seen = []
    monkeypatch.setattr(secretscan, "train", lambda random, ordinary: seen.extend(ordinary))
    secretscan.fit(spark.createDataFrame([(1, " ".join(sorted(runs)))], "doc_id long, text string"))
    assert set(seen) == runs


@pytest.mark.parametrize("block", [500_000, 40])  # one block, and many
def test_decontamination_against_brute_force(spark, block):
    rng = random.Random(7)
    word = lambda: rng.choice("aa bb cc dd".split())
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 3, 5, 13, 20, 40])))) for i in range(12)] + [(50, None), (51, "..."), (52, "É! "), (None, "aa bb")]
    texts = [None, "", "...", "é"] + [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(30)] + ["Zz " + rng.choice(items[:12])[1].upper() + " zz" for _ in range(10)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(5, texts[5])], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.judged(docs, bench, block_words=block).collect()
    assert len(got) == len(texts) + 1
    known = [(i, t) for i, t in items if i is not None]
    for r in got:
        assert (r["decontam"]["n_words"], r["decontam"]["n_hit"], r["decontam"]["items"]) == contamination(texts[r["doc_id"]], known)
    assert decontam.items_digest([]) == hashlib.sha256(b"").hexdigest()
    assert decontam.judged(docs, bench.filter("false")).filter(decontam.contaminated()).count() == 0
    assert decontam.clean_rows(docs, bench).columns == docs.columns
