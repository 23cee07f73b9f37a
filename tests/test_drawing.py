"""Properties of the drawing and of clusters that the queries' data do not show."""

from collections import defaultdict

import pytest

from sparkfolio.operators import drawing, exchange

STEPS = [
    (1, 10, 0, "Start", "a b"), (1, 10, 1, "Then", "c"), (1, 10, 2, "", "the end"), (1, 20, 0, "Start", "a b"), (1, 20, 1, "Other", "x"), (1, 30, 5, "Late", "z"),
    (2, 10, 0, "Only", "one"),
]
MEMBERS = [(1, "a", 10, 0), (1, "a", 20, 0), (1, "b", 10, 1), (1, "b", 10, 2)]
RESULTS = [(1, 10, "p/x", "12"), (1, 20, "q/y", " 12 "), (1, 30, "r/z", None), (2, 10, "p/x", "5")]


@pytest.fixture(scope="module")
def clusters(spark):
    steps = spark.createDataFrame(STEPS, "problem long, solver long, idx long, title string, body string")
    return exchange.clusters(steps, spark.createDataFrame(MEMBERS, "problem long, component string, solver long, idx long")).cache()


def test_a_cluster_of_one_solver_is_not_shared(clusters):
    got = {r.key: r for r in clusters.where("problem = 1").collect()}
    assert got["shared:a"].shared and got["shared:a"].title == "Start" and got["shared:a"].models == [10, 20]
    assert not got["shared:b"].shared and got["shared:b"].solvers == 1 and got["shared:b"].mean_idx == 1.5 and got["shared:b"].mean_solver == 10
    assert [tuple(m) for m in got["shared:b"].members] == [(10, 1), (10, 2)]
    assert [r.key for r in sorted(got.values(), key=lambda r: r.place)] == ["shared:a", "solo:20:1", "shared:b", "solo:30:5"]


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_every_model_has_one_way_from_problem_to_answer(spark, clusters, depth):
    results = spark.createDataFrame(RESULTS, "problem long, solver long, model string, answer string")
    nodes, edges = (df.collect() for df in drawing.drawn(results, clusters, depth))
    there = {(n.problem, n.node) for n in nodes}
    assert len(there) == len(nodes)
    ways = defaultdict(list)
    for e in sorted(edges, key=lambda e: e.at):
        ways[e.problem, e.model].append(e)
    assert ways.keys() == {(r[0], r[2]) for r in RESULTS}
    for (problem, model), way in ways.items():
        assert [e.at for e in way] == list(range(len(way)))
        assert way[0].from_node == "problem" and way[0].to_node == f"model-{model}" and way[-1].to_node.startswith("answer-")
        assert all(a.to_node == b.from_node for a, b in zip(way, way[1:], strict=False))
        assert {(problem, x) for e in way for x in (e.from_node, e.to_node)} <= there
    low = max(n.y + n.height for n in nodes if n.problem == 1 and n.kind != "answer")
    answers = {n.node: n for n in nodes if n.problem == 1 and n.kind == "answer"}
    assert answers.keys() == {"answer-12", "answer-(empty)"} and all(n.y == low + 170 for n in answers.values())
    assert answers["answer-(empty)"].x - answers["answer-12"].x == 270
    assert {n.kind for n in nodes} == {"problem", "model", "answer"} | ({"strategy", "step"} if depth > 1 else set())


def test_answers_share_a_node_and_wide_problems_grow(spark, clusters):
    many = spark.createDataFrame([(9, k, f"m{k}", str(k % 3)) for k in range(12)], "problem long, solver long, model string, answer string")
    nodes, _ = drawing.drawn(many, clusters, 2)
    rows = {n.node: n for n in nodes.where("problem = 9").collect()}
    assert len([n for n in rows if n.startswith("answer-")]) == 3
    assert rows["model-m11"].x == 34 + 11 * 192 and rows["problem"].x == (68 + 12 * 176 + 11 * 16 - 320) / 2
