import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkfolio.functions import text as T
from sparkfolio.operators import layout as L
from sparkfolio.operators import solve as S


def one(spark, values, column, kind="string"):
    """The column's value for each of some values of v."""
    return [r.x for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", column(F.col("v")).alias("x")).orderBy("i").collect()]


def test_normalize_and_tokens(spark):
    assert one(spark, [r"The \frac{1}{2} OF  x-y!", "", "방정식을 풀이"], T.normalize_text) == ["the 1 2 of x y", "", "방정식을 풀이"]
    assert one(spark, ["The sum of a and x", "은 는 값"], T.tokens) == [["sum", "x"], ["값"]]
    assert one(spark, ["ab c", "a", ""], T.char_ngrams) == [["ab", "bc"], ["a"], []]


def test_math_tokens(spark):
    got = one(spark, [r"\frac{1}{2} + x^{2} = 3.5", "sin(x) 코사인 한x y |a|"], T.math_tokens)
    assert set(got[0]) >= {"latex:frac", "num:1", "num:2", "op:+", "pattern:power", "rel:=", "num:3.5", "var:x^{2"}
    assert got[0].count("latex:frac") == 2
    assert set(got[1]) >= {"kw:sin", "kw:코사인", "kw:사인", "expr:abs", "struct:(", "var:x", "var:y"}


@pytest.mark.parametrize(("text", "number"), [("7. text", 7), ("(12) text", 12), ("3.14", 3), ("## 19", 19), ("text", None), ("12", 12), ("0. x", None), ("abcd 5. x", None), ("line\n## 8\nmore", 8)])
def test_anchors(spark, text, number):
    assert one(spark, [text], L.anchor) == [number]


def test_answers(spark):
    assert one(spark, ["'\\boxed{5}'", " x ", '"a"'], T.strip_answer_decorations) == ["5", "x", "a"]
    assert one(spark, ["1,234 Apples!", "x - 1/2"], T.normalize_answer) == ["1234apples", "x-1/2"]
    text = "Which of the following?\nA) 4\nB) 5\nA) 6\nC) 7"
    final = lambda v: T.final_answer(v, F.lit(True), F.lit(text))
    assert one(spark, ["2", "4", "6", "b.", "choice 3", "8"], final) == ["B", "D", "A", "B", "C", "8"]
    assert one(spark, ["2"], lambda v: T.final_answer(v, F.lit(False), F.lit(text))) == ["2"]
    assert one(spark, ["2"], lambda v: T.final_answer(v, F.lit(True), F.lit("Find x."))) == ["2"]


def test_small_rules(spark):
    assert one(spark, ["a b/c.png", "___", "x"], T.slug) == ["a_b_c.png", "unknown", "x"]
    assert one(spark, ["a\r\nb\n", None], T.one_line) == ["a b", ""]
    assert one(spark, ["<a href='x'>&\""], T.html_escape) == ["&lt;a href=&#39;x&#39;&gt;&amp;&quot;"]
    assert one(spark, ["a", "foobar"], T.fnv1a) == [0xE40C292C, 0xBF9CF968]
    assert one(spark, ["<|ref|>text<|/ref|><|det|>[[1, 2, 3, 4]]<|/det|>\nbody"], T.strip_tags) == ["body"]
    assert one(spark, [" ", "x", None], T.display_answer) == ["—", "x", "—"]


def test_chunks_join_to_the_text(spark):
    texts = ["", "a", "b" * 120, "c" * 121, "é😀" * 200]
    got = one(spark, texts, T.chunked)
    assert ["".join(x) for x in got] == texts and all(len(p) <= 120 for x in got for p in x)


def test_repair():
    assert S.repaired('```json\n{"a": 1,}\n```') == {"a": 1}
    assert S.repaired('text {"final_answer": "\\alpha"} more')["final_answer"] == "\\alpha"
    assert S.repaired('{"final_answer": "\\frac"}')["final_answer"] == "\frac"
    assert S.repaired('{"final_answer": "\\frac"}', keep_latex=True)["final_answer"] == "\\frac"
    assert S.repaired('[{"final_answer": "1"}]') == {"final_answer": "1"}
    cut = S.repaired('{"steps": [{"step_idx": 2, "title": "t", "content": "c"}], "final_answer": "7", "ratio')
    assert (cut["final_answer"], cut["confidence"], cut["steps"]) == ("7", "low", [{"step_idx": 2, "title": "t", "content": "c"}])
    assert S.repaired(None)["confidence"] == "low"


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text(max_size=5), st.text(max_size=20), max_size=3))
def test_repair_leaves_valid_json_alone(value):
    value.pop("```", None)
    text = json.dumps(value)
    if "`" not in text:
        assert S.repaired(text) == value


def test_fifth_option(spark):
    fix = lambda raw: (lambda v: S.fix_fifth_option(v, F.lit(raw)))
    assert one(spark, ["ends ⑤", "ends ⑤ $6$", "ends ⑤ $7$", "no"], fix("⑤ 6")) == ["ends ⑤ $6$", "ends ⑤ $6$", "ends ⑤ $6$", "no"]
    assert one(spark, ["⑤"], fix("72 5")) == ["⑤ $72$"] and one(spark, ["⑤"], fix("")) == ["⑤"]


def test_cleaning():
    assert S.cleaned(" ＡＢ①​ ﬁ ") == "AB① fi"


def test_blocks(spark):
    raw = "<|ref|>text<|/ref|><|det|>[[1, 2, 3, 4]]<|/det|>\nfirst\n12\nsecond\n<|ref|>image<|/ref|><|det|>[[5, 6, 7, 8]]<|/det|>\nlost<|ref|>text<|/ref|><|det|>[[1,2,3,4],[5,6,7,8]]<|/det|>two boxes"
    rows = spark.createDataFrame([("p", raw)], "page string, raw string")
    first = [("text", 1, "first"), ("text", 1, "12"), ("text", 1, "second"), ("image", 5, "")]
    shown = lambda found: [(r.kind, r.x1, r.txt) for r in found.orderBy("ord", "piece").collect()]
    assert shown(S.blocks(rows, several=False)) == first
    assert shown(S.blocks(rows)) == [*first, ("text", 1, "two boxes"), ("text", 5, "two boxes")]
    quarters = {r.quadrant: r.txt for r in S.by_quadrant(rows).collect()}
    tags = [t.strip() for t in raw.replace("<|ref|>", "\u0001<|ref|>").split("\u0001") if t]
    assert quarters == {1: "\n\n".join(tags), 2: "", 3: "", 4: ""}


def test_lines_are_measured_from_their_first_block(spark):
    rows = [(1, i, "text", 0, y, 5, y + 5, f"t{y}") for i, y in enumerate((0, 10, 20, 40))]
    got = L.merged_lines(spark.createDataFrame(rows, "page long, ord int, kind string, x1 int, y1 int, x2 int, y2 int, txt string"), ["page"]).head()
    assert (got.n_lines, got.merged) == (3, "t0 t10\nt20\nt40")


def test_score_labels(spark):
    text = "문제 [3점] 12"
    assert one(spark, [text], L.clean_merged) == ["문제 [3점]"]
    assert one(spark, [text], lambda v: L.clean_merged(v, keep_points=False)) == ["문제 [4점]"]
    assert one(spark, ["보기 ① 12", "보기 ①12", "끝 12"], L.clean_merged) == ["보기 ① 12", "보기 ①12", "끝"]


def test_gaps_and_suppression(spark):
    schema = "page long, ord int, kind string, x1 int, y1 int, x2 int, y2 int, txt string"
    ys = [0, 15, 65, 115, 130]
    rows = [(1, i, "text", 0, y, 5, y + 10, "t") for i, y in enumerate(ys)]
    got = {r.ord: r.segment for r in L.gap_segments(spark.createDataFrame(rows, schema), 3, ["page"]).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 2, 4: 2}
    rng = random.Random(3)
    boxes = [(1, i, "text", x, y, x + rng.randint(5, 60), y + rng.randint(5, 60), "t") for i in range(30) for x, y in [(rng.randint(0, 100), rng.randint(0, 100))]]
    area = lambda b: (b[5] - b[3]) * (b[6] - b[4])
    kept = []
    for b in sorted(boxes, key=lambda b: (-area(b), b[4], b[3], b[5], b[6], b[1])):
        cover = lambda a: max(0, min(a[5], b[5]) - max(a[3], b[3])) * max(0, min(a[6], b[6]) - max(a[4], b[4]))  # noqa: E731, B023
        if len(kept) < 6 and not any(cover(a) > 0.5 * min(area(a), area(b)) for a in kept):
            kept.append(b)
    assert {r.ord for r in L.suppressed(spark.createDataFrame(boxes, schema)).collect()} == {b[1] for b in kept}


def test_a_slug_reads_its_text_once(spark):
    rows = spark.createDataFrame([("._a b._",), ("--.__",), ("",), (None,), ("x" + "-" * 200_000 + "y.",)], "text string").select(T.slug(F.col("text")).alias("s"))
    assert [r.s for r in rows.collect()] == ["a_b", "unknown", "unknown", None, "x" + "-" * 200_000 + "y"]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("[^A-Za-z0-9._-]+") == 1
