import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sparkfolio.llm import language_id, mixing, quality_model, toxicity

LANGS = {"en": ["the", "house", "of", "and", "window", "thing"], "de": ["der", "und", "schön", "über", "haus", "gegen"], "fr": ["les", "être", "avec", "où", "maison", "été"], "ru": ["дом", "улица", "окно"]}


@pytest.fixture(scope="module")
def language_model(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(LANGS[lang]) for _ in range(40)), lang) for i in range(200) for lang in LANGS]
    return language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_spans_of_mixed_text(spark, language_model):
    text = "the house of window and thing the house, der und schön über haus gegen der und. дом улица"
    row = language_id.identify(spark.createDataFrame([(text,)], "text string"), language_model).head()
    assert [(s.lang, text[s.begin : s.end]) for s in row.lang_spans] == [("en", "the house of window and thing the house"), ("de", "der und schön über haus gegen der und"), ("ru", "дом улица")]
    assert row.lang_pred == "en" and 0 < row.lang_score < 1


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(4)
    score = rng.normal(0, 3, (40, 3)).astype(np.float32)
    first, n = np.array([0, 9, 9, 25]), np.array([9, 0, 16, 15])
    path = language_id._viterbi(score, first, n, 2.0)
    value = lambda own, p: sum(own[i, x] for i, x in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))
    for a, m in zip(first, n):
        own, best = score[a : a + m], {}
        for i in range(m):
            best = {x: own[i, x] + (max(v - 2.0 * (y != x) for y, v in best.items()) if best else 0) for x in range(3)}
        if m:
            assert abs(value(own, path[a : a + m]) - max(best.values())) < 1e-3


def test_language_of_odd_documents(odd_docs, no_docs, language_model):
    got = language_id.identify(odd_docs, language_model, prefix="p_")
    assert got.columns[: len(odd_docs.columns)] == odd_docs.columns
    for r in got.collect():
        assert (r.p_lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    assert language_id.op9(no_docs).count() == 0
    assert {r.lang_pred for r in language_id.op9(odd_docs.drop("lang").selectExpr("*", "cast(null as string) lang")).collect()} == {"und"}


def brute_rake(cells, targets):
    fit = {c: float(m) for c, m in cells.items()}
    total = sum(fit.values())
    for _ in range(200):
        for side in range(3):
            sums = Counter()
            for c, x in fit.items():
                sums[c[side]] += x
            fit = {c: x * targets[side][c[side]] * total / sums[c[side]] for c, x in fit.items()}
    return fit


def test_raking_equals_brute_force(spark):
    rng = random.Random(6)
    cells = {(s, g, t): rng.randint(1, 1000) for s in "abc" for g in "xy" for t in "pq" if rng.random() < 0.9}
    targets = [{"a": 0.2, "b": 0.3, "c": 0.5}, {"x": 0.4, "y": 0.6}, {"p": 0.7, "q": 0.3}]
    frame = spark.createDataFrame([(*c, m) for c, m in cells.items()], "source string, lang string, topic string, mass long")
    got = {(r.source, r.lang, r.topic): r.fitted for r in mixing.rake(frame, dict(zip(mixing.SIDES, targets)), rounds=60, close=1e-10).collect()}
    assert all(abs(got[c] - x) < 1e-4 * x for c, x in brute_rake(cells, targets).items())


def test_sample_follows_chances(spark, odd_docs, no_docs):
    rng = random.Random(7)
    rows = [(i, "w " * rng.randint(1, 60), rng.choice(["en", "en", "fr"]), rng.choice("aaab")) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mix(docs, fraction=0.5).collect()
    assert abs(sum(r.probability * r.tokens for r in got) / sum(r.tokens for r in got) - 0.5) < 1e-6
    assert abs(sum(r.sampled for r in got) / sum(r.probability for r in got) - 1) < 0.06
    assert {r.doc_id for r in mixing.sampled_rows(docs, fraction=0.5).collect()} == {r.doc_id for r in got if r.sampled}
    assert mixing.mix(odd_docs).count() == odd_docs.count() and mixing.mix(no_docs).count() == 0
    assert mixing.sampled_rows(odd_docs).columns == odd_docs.columns


def brute_kneser_ney(trusted, texts, order):
    clean = lambda t: quality_model.PAD * (order - 1) + re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    grams = lambda t: [clean(t)[i - order + 1 : i + 1] for i in range(order - 1, len(clean(t)))]
    table = {order: Counter(g for t in trusted for g in grams(t))}
    for k in range(order - 1, 0, -1):
        table[k] = Counter(g[1:] for g in table[k + 1])
    letters = len({g[-1] for t in texts for g in grams(t)}) + 1
    cut = {k: quality_model.discounts({f"n{i}": sum(c == i for c in own.values()) for i in range(1, 5)}) for k, own in table.items()}

    def p(g):
        k = len(g)
        if not k:
            return 1 / letters
        row = {x: c for x, c in table[k].items() if x[:-1] == g[:-1]}
        if not row:
            return p(g[1:])
        off = lambda c: cut[k][min(c, 3) - 1]
        c = row.get(g, 0)
        return ((c - off(c)) if c else 0) / sum(row.values()) + sum(map(off, row.values())) / sum(row.values()) * p(g[1:])

    return [math.exp(-sum(math.log(p(g)) for g in grams(t)) / len(grams(t))) if grams(t) else None for t in texts]


@pytest.mark.parametrize("shard_rows", [5, 1_000_000])
def test_perplexity_equals_brute_force(spark, shard_rows):
    trusted = ["abab cab", "abc", "aab  ca", "cc", None, "b", "abcabcaab"]
    texts = ["abcab", "zab", "", "a b c", *trusted]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.perplexity for r in quality_model.perplexities(docs, spark.createDataFrame([(t,) for t in trusted], "text string"), 4, shard_rows).collect()}
    for i, want in enumerate(brute_kneser_ney(trusted, texts, 4)):
        assert got[i] is None and want is None or abs(got[i] - want) < 1e-4 * want


def test_quality_of_odd_documents(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(5, 1, 0), (5, 1, 0), (4, 0, 1), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    got = quality_model.judged(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and not any(r.kept for r in got if not r.chars)
    assert quality_model.judged(no_docs, labels).count() == 0
    assert all(r.kept for r in quality_model.judged(odd_docs, labels.limit(0)).collect() if r.chars)


def toxic_docs(n=600):
    rng = random.Random(8)
    plain, bad = [f"{a}{b}" for a in "bcdfgh" for b in ("alo", "emi", "uri", "oko")], ["grob", "grobling", "nastig"]
    rows = []
    for i in range(n):
        toxic = i % 5 == 0
        w = [rng.choice(plain) for _ in range(30)] + ([rng.choice(bad) for _ in range(3)] if toxic else [])
        rng.shuffle(w)
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_toxic_documents_are_found(spark, odd_docs, no_docs):
    rows = toxic_docs()
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows] + [(0, 0), (None, 1), (1, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.op7(docs, labels).collect()}
    assert all(got[d].predicted == y for d, _, y in rows)
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d in got)
    assert all(0 <= r.score <= 1 for r in got.values())
    odd = toxicity.op7(odd_docs, labels).collect()
    assert len(odd) == odd_docs.count() and not any(r.predicted for r in odd)
    assert toxicity.op7(no_docs, labels).count() == 0


def test_no_labels_and_text_without_words(spark):
    docs = spark.createDataFrame([(1, "grob"), (2, None), (3, "1 2 3")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.op7(docs, labels).collect()] == [0.0, 0.0, 0.0]


def test_vector_of_marked_and_other_words():
    make = toxicity.Vectors({"grob": (0, 2.0), "nast*": (1, 3.0)})
    raw = [(1 + math.log(2)) * 2.0, 3.0, toxicity.BACKGROUND * math.sqrt((1 + math.log(3)) ** 2 + 1)]
    norm = math.sqrt(sum(x * x for x in raw))
    got = make("Grob, a grob! nastig a a b")
    assert [p for p, _ in got] == [0, 1, 2] and np.allclose([x for _, x in got], [x / norm for x in raw])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="the driver's tables are not here")
def test_toxic_recall_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rated = toxicity.op7(docs, labels).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    toxic, found = rated[rated.toxic > 0], rated[rated.predicted > 0]
    assert (toxic.predicted > 0).mean() >= 0.9 and (found.toxic > 0).mean() >= 0.9
    assert toxic.groupby("lang").predicted.mean().min() >= 0.8


def test_nearest_is_exact():
    rng = np.random.default_rng(9)
    dense = rng.random((500, 40)) * (rng.random((500, 40)) < 0.15)
    dense /= np.maximum(1e-12, np.sqrt((dense**2).sum(1, keepdims=True)))
    vectors = [tuple((int(p), float(row[p])) for p in np.flatnonzero(row)) for row in dense]
    index = toxicity.BlockMaxIndex(vectors, rng.integers(0, 2, 500).astype(float), np.arange(500))
    for i in range(0, 500, 7):
        places, sims = index.nearest(vectors[i], 10)
        want = dense @ dense[i]
        assert np.allclose(sims, np.sort(want)[::-1][: len(sims)]) and np.allclose(sims, want[index.doc_ids[places]])
