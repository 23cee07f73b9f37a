import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkfolio.llm import ngram_join, suffix_dedup
from sparkfolio.llm.components import components
from sparkfolio.llm.ngram_join import link_counts, similarity_classes
from sparkfolio.llm.suffix_dedup import blind_trie_order, deep_shallow_order, extents, without_repeats


def word_sets(rows, k):
    out = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def brute_components(rows, k, num, den):
    sets, parent = word_sets(rows, k), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * n >= num * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    by = {}
    for i, (d, _) in enumerate(rows):
        by.setdefault(find(i), []).append(d)
    least = {c: min((d for d in own if d is not None), default=None) for c, own in by.items()}
    return [(d, len(sets[i]), least[find(i)] if least[find(i)] is not None else d) for i, (d, _) in enumerate(rows)]


def near_copies(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    bases = [[rng.choice(words) for _ in range(rng.randint(1, 90))] for _ in range(8)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i * 7 % 1000, " ".join(w).title() if i % 5 == 0 else " ".join(w)))
    return rows + [(5000, None), (5001, ""), (5002, "a b"), (5003, "A  B")]


@pytest.mark.parametrize(("k", "num", "den"), [(3, 90, 100), (5, 4, 5), (2, 1, 2)])
def test_components_equal_brute_force(spark, k, num, den):
    rows = near_copies(k)
    got = similarity_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), k, num, den, rounds=2).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(brute_components(rows, k, num, den))


def test_every_link_of_a_component_is_counted(spark):
    rng, words = random.Random(5), [f"w{i}" for i in range(300)]
    base, rows = [rng.choice(words) for _ in range(150)], []
    for i in range(60):  # a star and what lies between its points: copies of one text, each changed in up to three places
        own = list(base)
        for _ in range(i % 4):
            own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((i, " ".join(own)))
    rows += [(100 + i, f"{rows[i][1]}") for i in range(3)] + [(200, "alone here with words"), (201, None)]
    sets = word_sets(rows, 3)
    classes = {frozenset(s) for s in sets if s}
    links = {x: sum(x != y and 100 * len(x & y) >= 90 * len(x | y) for y in classes) for x in classes}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.n_links for r in similarity_classes(docs, 3, 90, 100).collect()}
    assert got == {d: links.get(frozenset(s), 0) for (d, _), s in zip(rows, sets)}
    # The same in blocks of seven sets.
    keyed = [(i, np.fromiter({abs(hash(w)) for w in x}, np.uint64)) for i, x in enumerate(links)]
    frame = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in keyed], "cid long, items binary")
    labels = spark.createDataFrame([(i, 0) for i, _ in keyed], "node long, label long")
    counted = {r.cid: r.n_links for r in link_counts(frame, labels, 90, 100, most=7).collect()}
    assert counted == dict(enumerate(links.values()))


def longer_copies(seed, k, added):
    """Texts of common words, and copies with rare words appended, put in front or inserted; those sort before all others."""
    rng, rows = random.Random(seed), []
    for at, n in enumerate(added):
        words, rare = [f"w{rng.randrange(80)}" for _ in range(99 + k)], [f"rare{at}x{i}" for i in range(n)]
        cut = (len(words), 0, rng.randrange(len(words)))[at % 3]
        rows += [(2 * at, " ".join(words)), (2 * at + 1, " ".join(words[:cut] + rare + words[cut:]))]
    return rows


@pytest.mark.parametrize(("k", "num", "den", "stars"), [(3, 90, 100, 2), (3, 90, 100, 0), (5, 4, 5, 2), (5, 4, 5, 0)])
def test_copies_with_more_words_link(spark, k, num, den, stars):
    most = 100 * (den - num) // num
    rows = longer_copies(k, k, [most - 4 + i % 7 for i in range(30)])
    want = Counter(brute_components(rows, k, num, den))
    assert sum(d != c for d, _, c in want) > 9
    got = similarity_classes(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), k, num, den, rounds=stars).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


def large_groups(n=150):
    """Near copies of one text, of which many are unlike each other, and texts that share one long passage."""
    rng = random.Random(21)
    base, passage = [f"b{i}" for i in range(120)], [f"p{i}" for i in range(60)]
    rows = []
    for i in range(n):
        w = list(base)
        for at in rng.sample(range(120), rng.randint(0, 5)):
            w[at] = f"x{i}y{at}"
        rows.append((2 * i, " ".join(w)))
        rows.append((2 * i + 1, " ".join([*passage, *[f"o{i}z{k}" for k in range(rng.choice([6, 30, 60]))]])))
    return rows


@pytest.mark.parametrize("rounds", [0, 6])
def test_large_groups_equal_brute_force(spark, rounds):
    rows = large_groups()
    got = similarity_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 5, 4, 5, rounds=rounds).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(brute_components(rows, 5, 4, 5))


def test_shingles_are_frequent_that_a_task_meets_in_several_batches(spark):
    docs = spark.createDataFrame([(f"own{i} words{i} here{i} the same three",) for i in range(12)], "text string").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        found = ngram_join.frequent(docs, 3)[0]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found.tolist() == ngram_join.shingles("the same three", 3, ngram_join.WordHashes()).tolist()


def test_a_pair_makes_one_row_in_wide_buckets(spark):
    r = random.Random(5)
    most, rows, want = ngram_join.BEFORE, [], {}
    for pair in range(60):
        longest = most if pair < 40 else 3 * most
        sides, matches = [sorted(r.sample(range(longest + 4), r.randrange(1, longest))) for _ in range(2)], r.randrange(1, 9)
        common = sorted(set(sides[0]) & set(sides[1]))
        want[pair] = common[matches - 1] if len(common) >= matches else None
        rows += [(pair, side, t, i, own[max(0, i - most) : i], matches) for side, own in enumerate(sides) for i, t in enumerate(own)]
    one = spark.createDataFrame(rows, "pair int, side int, token long, w int, before array<long>, matches int")
    met = one.where("side = 0").alias("x").join(one.where("side = 1").alias("y"), F.expr(f"x.pair = y.pair and x.token = y.token and {ngram_join._asked_for()}"))
    got = {}
    for x in met.select("x.pair", "x.token").collect():
        got.setdefault(x.pair, set()).add(x.token)
    for pair, token in want.items():
        own = got.get(pair, set())
        assert own == ({token} if token is not None else set()) if pair < 40 else token is None or token in own


def test_join_of_odd_documents(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = similarity_classes(odd_docs, 3, 90, 100).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(brute_components(rows, 3, 90, 100))
    assert similarity_classes(no_docs).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100)], "a long, b long")
    got = {r.node: r.label for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_deep_shallow_order():
    rng = random.Random(1)
    for _ in range(200):
        strings = [b"x" * rng.choice([0, 8, 70]) + bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 60))]
        assert [strings[i] for i in deep_shallow_order(strings, 16)] == sorted(strings)
        assert [strings[i] for i in blind_trie_order(strings, list(range(len(strings))), 0)] == sorted(strings)


def test_extents_equal_all_pairs():
    from sparkfolio.llm.suffix_dedup import common_prefix

    rng = random.Random(2)
    for _ in range(100):
        n = rng.randint(2, 25)
        left, right = ([bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(n)] for _ in range(2))
        most_l, most_r = extents(left, right, 6)
        for i in range(n):
            met = [(a, b) for j in range(n) if j != i for a, b in [(common_prefix(left[i], left[j]), common_prefix(right[i], right[j]))] if a + b >= 6]
            assert (most_l[i], most_r[i]) == (max((a for a, _ in met), default=0), max((b for _, b in met), default=0))


def brute_removal(rows, window):
    data, seen, out = [(d, (t or "").encode()) for d, t in rows], Counter(), Counter()
    for _, b in data:
        seen.update(b[s : s + window] for s in range(len(b) - window + 1))
    for d, b in data:
        gone = bytearray(len(b))
        for s in range(len(b) - window + 1):
            if seen[b[s : s + window]] > 1:
                gone[s : s + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d, len(b), sum(gone), sum(gone[i] and not (i and gone[i - 1]) for i in range(len(b))), hashlib.sha256(kept).hexdigest()] += 1
    return out


def passages(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    shared = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(6)]

    def part():
        p, r = rng.choice(shared), rng.random()
        if r < 0.5:
            a = rng.randint(0, len(p) // 2)
            return p[a : a + rng.randint(20, len(p))]
        return rng.choice(words) * rng.randint(1, 60) if r < 0.6 else " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))

    rows = [(i, " é".join(part() for _ in range(rng.randint(0, 8)))) for i in range(100)]
    return rows + [(900, None), (901, ""), (902, "z" * 500), (903, "z" * 40), (904, rows[3][1]), (None, rows[3][1])]


@pytest.mark.parametrize(("window", "gram", "local"), [(48, 8, 50_000), (48, 8, 5), (64, 16, 50_000)])
def test_removal_equals_brute_force(spark, window, gram, local):
    rows = passages(window)
    got = without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache(), window, gram, local).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_removal(rows, window)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)


@pytest.mark.parametrize("local", [50_000, 20])
def test_removal_of_very_common_passages(spark, local):
    """One gram, one context, one half and one window in a third of all texts and more."""
    rng = random.Random(9)
    common = "".join(rng.choice("abcdefgh") for _ in range(120))
    rows = [(i, "".join(rng.choice("klmnop") for _ in range(rng.randint(0, 90))) + (common if i % 3 else common[:60]) + "".join(rng.choice("qrstuv") for _ in range(rng.randint(0, 90)))) for i in range(150)]
    rows += [(1000 + i, common * 2 + "the same") for i in range(100)]
    got = without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache(), 48, 8, local).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_removal(rows, 48)


def test_common_keys_are_met_in_parts(spark):
    rows = spark.range(3000).selectExpr("id row_at", "cast(id % 7 as int) pos", "if(id % 3 = 0, 0, id) k", "if(id % 5 = 0, null, id % 2) other")
    keys = suffix_dedup.stored(rows.groupBy("k").count(), "keys")
    plan = suffix_dedup.met(rows, keys, ["k"], "count")
    assert plan.count() == 3000 and Counter(r.k for r in plan.collect())[0] == 1000
    assert suffix_dedup.met(rows, keys.where("false"), ["k"], "count").count() == 0
    others = suffix_dedup.stored(rows.where("other is not null").groupBy("other").count(), "others")
    left = suffix_dedup.met(rows, others, ["other"], "count", "left")
    assert left.count() == 3000 and left.where("count is null").count() == 600


def test_removal_of_odd_documents(odd_docs):
    docs = odd_docs.cache()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = without_repeats(docs).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_removal(rows, 400)


def test_removal_of_no_documents(no_docs):
    assert without_repeats(no_docs).count() == 0
