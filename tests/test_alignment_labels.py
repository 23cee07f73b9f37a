"""Numbers of a problem's groups: the order of their labels is the SQL's, letter by letter."""

import pytest

from sparkfolio.functions import text as T
from sparkfolio.operators import align as A

TITLES = ("stras", "straße", "strat", "Éa", "eb", "Ez", "øre", "zeta")


def test_groups_are_numbered_by_plain_letters(spark):
    """A sharp s has no accent, so it comes after z and not with ss."""
    steps = [(1, solver, idx, title, "") for solver in (0, 1) for idx, title in enumerate(TITLES)]
    df = spark.createDataFrame(steps, "problem long, solver long, idx long, title string, body string")
    found = spark.createDataFrame([(1, 0, i, 1, i, 900_000) for i in range(len(TITLES))], "problem long, s1 long, i long, s2 long, j long, score long")
    got = [r.label for r in sorted(A.labels(found, df).collect(), key=lambda r: r.group_no)]
    duck = pytest.importorskip("duckdb").connect()
    want = duck.execute("select lower(t) from (select unnest(?::varchar[]) t) order by lower(strip_accents(lower(t))), lower(t)", [list(TITLES)]).fetchall()
    assert got == [r[0] for r in want]
    assert got.index("strat") < got.index("straße")


def test_members_without_words(spark):
    steps = [(1, 0, 0, "the", ""), (1, 1, 0, "", "of"), (1, 0, 1, "root", ""), (1, 1, 1, "", "the square root of all")]
    df = spark.createDataFrame(steps, "problem long, solver long, idx long, title string, body string")
    found = spark.createDataFrame([(1, 0, 0, 1, 0, 900_000), (1, 0, 1, 1, 1, 900_000)], "problem long, s1 long, i long, s2 long, j long, score long")
    got = {(r.component.idx, r.group_no, r.label, r.solvers) for r in A.labels(found, df).collect()}
    assert got == {(0, 2, "Step-Layer", 2), (1, 1, "root square", 2)}


def test_accents(spark):
    texts = ["Éé ß ø ı", "", None, "é", "한글", "가", "plain", "ąłż İ"]
    duck = pytest.importorskip("duckdb").connect()
    want = [r[0] for r in duck.execute("select strip_accents(t) from (select unnest(?::varchar[]) t)", [texts]).fetchall()]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.without_accents("t")).collect()] == want
