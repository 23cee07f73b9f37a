"""Questions of a page's columns against a plain rendering of the rules, on generated columns."""

import random
import re

import pytest

from sparkfolio.operators import layout, solve

SCHEMA = "page long, ord long, kind string, x1 int, y1 int, x2 int, y2 int, txt string, col int"


def number(text, fuzzy=True):
    text = text.strip()
    for rule in [r"(\d{1,3})\s*[.):]", *([r"[^\d]{0,3}(\d{1,3})\s*[.):]"] if fuzzy else []), r"(\d{1,3})$", r"#*\s*(\d{1,3})$"]:
        if m := re.match(rule, text):
            return int(m[1])
    lines = [m[1] for line in text.split("\n") if (m := re.fullmatch(r"#*\s*(\d{1,3})", line.strip()))]
    return int(lines[0]) if lines else None


def cut_at_gaps(own, parts):
    own = sorted(own, key=lambda b: (b["y1"], b["x1"], b["ord"]))
    if parts <= 1 or len(own) < parts:
        return [own]
    widest = sorted(range(1, len(own)), key=lambda i: (own[i - 1]["y2"] - own[i]["y1"], i))[: parts - 1]
    ends = [0, *sorted(widest), len(own)]
    return [own[a:b] for a, b in zip(ends, ends[1:])]


def questions(column):
    """{ord: (anchor_ord, qnum)} of one column's blocks."""
    column = sorted(column, key=lambda b: (b["y1"], b["x1"], b["ord"]))
    heads = [(b, n) for b in column if b["kind"] in ("text", "sub_title", "equation") and (n := number(b["txt"]))]
    if not heads:
        texts = [b for b in column if b["kind"] in ("text", "sub_title") and b["txt"]]
        if not texts:
            return {}
        n = number(texts[0]["txt"], fuzzy=False)
        heads = [(column[0], 1)] if n is None else [(texts[0], n)]
    marked = {b["ord"] for b, _ in heads}
    found = {b["ord"]: (b["ord"], n) for b, n in heads}
    subs = sum(b["kind"] == "sub_title" for b, _ in heads)
    free = [b for b in column if b["ord"] not in marked]
    for k, (head, n) in enumerate(heads):
        end = heads[k + 1][0]["y1"] if k + 1 < len(heads) else 10**9
        own = [b for b in free if head["y1"] - 8 <= b["y1"] < end + 8 and b["ord"] not in found]
        missing = heads[k + 1][1] - n if k + 1 < len(heads) else 1
        parts = cut_at_gaps(own, missing) if missing > 1 and len(own) >= 2 and (subs <= 1 or subs < len(heads) // 2) else [own]
        for i, part in enumerate(parts):
            found |= {b["ord"]: (head["ord"] if i == 0 else part[0]["ord"], n + i) for b in part}
    head, n = heads[0]
    above = [b for b in free if b["y1"] < head["y1"] - 8]
    if n > 1 and above:
        for i, part in enumerate(cut_at_gaps(above, n - 1)):
            found |= {b["ord"]: (part[0]["ord"], i + 1) for b in part}
    return found


def column_of(rng, page):
    texts = ["plain words", "more of them", "", "x", "##", "a 0 b", "0."]
    rows, n = [], rng.choice([0, 1, 2, 5])
    for i in range(rng.randint(1, 14)):
        if rng.random() < 0.3 and n:
            txt, n = rng.choice([f"{n}. first", f"## {n}", f"{n}", f"({n}) x", f"word\n{n}\nword"]), n + rng.choice([1, 1, 2, 3])
        else:
            txt = rng.choice(texts)
        y = rng.randrange(300)
        rows.append({"page": page, "ord": i, "kind": rng.choice(["text", "text", "sub_title", "equation", "image"]), "x1": rng.randrange(9), "y1": y, "x2": 20, "y2": y + rng.randrange(5, 40), "txt": txt, "col": 0})
    return rows


def test_questions_equal_the_rules(spark):
    rng = random.Random(4)
    pages = [column_of(rng, p) for p in range(400)]
    got = {}
    for r in layout.grouped(spark.createDataFrame([b for p in pages for b in p], SCHEMA)).collect():
        assert (r.page, r.ord) not in got
        got[r.page, r.ord] = (r.anchor_ord, r.qnum)
    want = {(p, o): x for p, blocks in enumerate(pages) for o, x in questions(blocks).items()}
    assert got == want


def test_wide_digits_and_contours(spark):
    rows = [(1, 1, "text", 10, 500, 90, 560, "７．　무엇", 0), (1, 2, "text", 10, 700, 90, 760, "words", 0)]
    blocks = spark.createDataFrame(rows, SCHEMA).drop("col")
    found = layout.problems(blocks, 2480, 3508).collect()
    assert [r.qnum for r in found] == [7]
    contours = spark.createDataFrame([(1, 10, 8, 10, 690, 60, 698), (1, 11, 9, 12, 505, 60, 550)], "page long, ord long, num int, x1 int, y1 int, x2 int, y2 int")
    assert sorted(r.qnum for r in layout.problems(blocks, 2480, 3508, contours=contours).collect()) == [7, 8]


@pytest.mark.parametrize("contours", [False, True])
def test_boxes_begin_at_the_top_cut(spark, contours):
    """A problem's margin would reach above the page's cut; in SAT mode it may."""
    rows = [(1, 1, "header", 10, 100, 900, 380, "head", 0), (1, 2, "text", 10, 378, 900, 2378, "1. what", 0), (2, 1, "text", 10, 300, 900, 2300, "plain", 0)]
    none = spark.createDataFrame([], "page long, ord long, num int, x1 int, y1 int, x2 int, y2 int") if contours else None
    got = {r.page: r.by1 for r in layout.problems(spark.createDataFrame(rows, SCHEMA).drop("col"), 2480, 3508, ratio=0.05, contours=none).collect()}
    assert got == ({1: 278, 2: 200} if contours else {1: 360, 2: 280})


def test_tags_of_several_boxes(spark):
    raw = "<|ref|>text<|/ref|><|det|>[1, 2, 3, 4]<|/det|>\none<|ref|>text<|/ref|><|det|>[[1, 2, 3, 4], [5, 6, 7]]<|/det|>\ntwo<|ref|>image<|/ref|><|det|>[[9, 9, 9, 9]]<|/det|>\nthree<|ref|>text<|/ref|><|det|>[[]]<|/det|>"
    rows = spark.createDataFrame([(1, raw), (2, ""), (3, None)], "page long, raw string")
    got = [(r.page, r.ord, r.kind, r.x1, r.y2, r.txt) for r in solve.blocks(rows).orderBy("page", "ord").collect()]
    assert got == [(1, 0, "text", 1, 4, "one"), (1, 1, "text", 1, 4, "two"), (1, 2, "image", 9, 9, "")]


@pytest.mark.parametrize(("x", "y", "quadrant"), [(399, 499, 1), (399, 500, 2), (400, 399, 3), (400, 400, 4), (400, 499, 4)])
def test_quadrants(spark, x, y, quadrant):
    raw = f"<|ref|>text<|/ref|><|det|>[[{x}, {y}, 999, 999]]<|/det|>\n words \n{solve.SAVED}\n<|ref|>text<|/ref|><|det|>[[1, 1, 2, 2]]<|/det|>\nlate"
    got = {r.quadrant: r.txt for r in solve.by_quadrant(spark.createDataFrame([(1, raw)], "page long, raw string")).collect()}
    assert len(got) == 4 and got[quadrant] == f"<|ref|>text<|/ref|><|det|>[[{x}, {y}, 999, 999]]<|/det|>\nwords"
    assert not any(t for q, t in got.items() if q != quadrant)


@pytest.mark.parametrize("chain", [lambda b: layout.problems(b, 1000, 1400), lambda b: layout.grouped(layout.columns(b.repartition("page"), 1000))])
def test_a_page_is_shuffled_once(spark, chain):
    rows = spark.createDataFrame([(1, 1, "text", 10, 200, 90, 240, "1. one"), (1, 2, "text", 10, 300, 90, 340, "more of it")], "page long, ord long, kind string, x1 int, y1 int, x2 int, y2 int, txt string")
    plan = chain(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
