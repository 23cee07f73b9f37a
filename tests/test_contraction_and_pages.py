"""Components by contraction of stars, and the pivot index, against brute force."""

import random

import pytest

from sparkfolio.operators import align, contraction, known_pages


def found(spark, rows, schema="p int, a long, b long", rounds=None):
    got = contraction.components(spark.createDataFrame(rows, schema), ["p"], rounds).collect()
    assert len(got) == len({(r.p, r.node) for r in got})
    return {(r.p, r.node): r.component for r in got}


def least(rows):
    low = {}
    for p, a, b in rows:
        if a is not None and b is not None and a != b:
            low.setdefault((p, a), a), low.setdefault((p, b), b)
    changed = True
    while changed:
        changed = False
        for p, a, b in rows:
            if (p, a) in low and (p, b) in low and low[p, a] != low[p, b]:
                low[p, a] = low[p, b] = min(low[p, a], low[p, b])
                changed = True
    return low


def test_components_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(3), rng.randrange(60), rng.randrange(60)) for _ in range(110)] + [(0, 7, 7), (1, None, 3), (1, 3, None), (2, 500, 501), (2, 501, 500)]
    assert found(spark, rows) == least(rows)
    assert found(spark, []) == {}


@pytest.mark.parametrize("shuffled", [False, True])
def test_a_chain_ends_in_few_rounds(spark, shuffled):
    names = list(range(1000))
    if shuffled:
        random.Random(2).shuffle(names)
    rounds = []
    got = found(spark, [(1, a, b) for a, b in zip(names, names[1:], strict=False)], rounds=rounds)
    assert set(got.values()) == {0} and len(got) == 1000
    assert rounds[0] <= 13


def test_a_star_of_many_leaves(spark):
    assert set(found(spark, [(1, 5000, k) for k in range(1, 3000)]).values()) == {1}


def test_steps_numbered_beyond_a_thousand_stay_apart(spark):
    edges = spark.createDataFrame([(1, 0, 1000, 2, 0, 500000), (1, 1, 0, 2, 1, 400000)], "problem int, s1 int, i int, s2 int, j int, score long")
    got = {(tuple(r.node), tuple(r.component)) for r in align.components(edges).collect()}
    assert got == {((0, 1000), (0, 1000)), ((2, 0), (0, 1000)), ((1, 0), (1, 0)), ((2, 1), (1, 0))}
    assert {(tuple(r.component), r.solver, r.idx, r.best) for r in align.members(edges).collect()} == {((0, 1000), 0, 1000, 500000), ((0, 1000), 2, 0, 500000), ((1, 0), 1, 0, 400000), ((1, 0), 2, 1, 400000)}


PAGE = "width int, height int, thumb array<int>"


def nearest(uploads, known):
    out = {}
    for i, w, h, t in uploads:
        best = None
        for page, w2, h2, t2 in sorted(known, key=lambda x: x[0]):
            if None in (w, h, w2, h2) or not t or not t2 or len(t) != len(t2):
                continue
            same = (w, h) == (w2, h2)
            off = sum(abs(x - y) for x, y in zip(t, t2, strict=True)) / len(t)
            if (same or abs(w / max(h, 1) - w2 / max(h2, 1)) <= 0.005) and off <= (0.35 if same else 0.20) and (best is None or off < best[1]):
                best = (page, off, same)
        if best:
            out[i] = best
    return out


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(11)
    base = [[rng.randrange(256) for _ in range(40)] for _ in range(60)]
    base += [[min(255, x + (rng.random() < 0.1)) for x in base[0]] for _ in range(15)]
    sizes = [(1240, 1754), (1241, 1754), (2480, 3508), (1000, 1754), (1240, 0)]
    known = [(k, *rng.choice(sizes), list(t)) for k, t in enumerate(base)] + [(900 + k, *sizes[0], list(base[k])) for k in range(10)]
    uploads = [(k, *rng.choice(sizes), [min(255, x + (rng.random() < rng.choice((0, 0.1, 0.3)))) for x in base[k % len(base)]]) for k in range(120)]
    known += [(990, None, 5, base[0]), (991, 1240, 1754, []), (992, 1240, 1754, None), (993, 1240, 1754, base[0][:20])]
    uploads += [(500, None, None, None), (501, 1240, 1754, base[1][:20]), (502, 1240, 1754, []), (503, *uploads[3][1:]), (504, 1240, 1754, base[0][:20])]
    return uploads, known


def test_nearest_pages_equal_brute_force(spark, pages):
    uploads, known = pages
    got = known_pages.nearest_pages(spark.createDataFrame(uploads, f"id int, {PAGE}"), spark.createDataFrame(known, f"page_id int, {PAGE}"))
    assert {r.id: (r.page_id, r.off, r.same_size) for r in got.collect()} == nearest(uploads, known)
    assert len(nearest(uploads, known)) > 40


def test_the_index_compares_few_pairs(spark, pages):
    uploads, known = pages
    looks = lambda rows, name: known_pages.looks_of(spark.createDataFrame(rows, f"{name} int, {PAGE}").where("width is not null and size(thumb) > 0"), name)
    mine, theirs = looks(uploads, "id"), looks(known, "page_id")
    assert 0 < known_pages.compared(mine, theirs).count() < mine.count() * theirs.count() / 20


def test_no_known_pages(spark, pages):
    none = spark.createDataFrame([], f"page_id int, {PAGE}")
    assert known_pages.nearest_pages(spark.createDataFrame(pages[0], f"id int, {PAGE}"), none).count() == 0
    assert known_pages.nearest_pages(none.withColumnRenamed("page_id", "id"), spark.createDataFrame(pages[1], f"page_id int, {PAGE}")).count() == 0
