"""Page selection: every request gets a page."""

from sparkfolio.operators import app

PAGES = [("csat", "2023", "002"), ("csat", "2023", "010"), ("csat", "2025", "003"), ("csat", "999", "1"), ("sat", "12", "7"), ("sat", "4", "10"), ("sat", "4", "9"), ("draft", "1", "1")]
ASKED = [
    (1, "csat", "2023", "010"), (2, "csat", "2023", "777"), (3, "csat", "1900", "777"), (4, "csat", "1900", "003"), (5, "sat", None, None), (6, "sat", "12", "9"),
    (7, "sat", "sat", "4_10"), (8, "sat", "sat", "12_7"), (9, "sat", "sat", "5_1"), (10, "draft", "1", "1"), (11, None, None, None), (12, "csat", None, "003"), (13, "sat", "sat", "9"),
]
SCHEMA = "id int, grp string, year string, page string"


def selected(spark, pages):
    got = app.selected(spark.createDataFrame(pages, "grp string, year string, page string"), spark.createDataFrame(ASKED, SCHEMA)).collect()
    assert len(got) == len(ASKED)
    return {r.id: (r.grp, r.year, r.page) for r in got}


def test_what_is_not_there_falls_back(spark):
    assert selected(spark, PAGES) == {
        1: ("csat", "2023", "010"), 2: ("csat", "2023", "002"), 3: ("csat", "2025", "003"), 4: ("csat", "2025", "003"), 5: ("sat", "4", "9"), 6: ("sat", "12", "7"),
        7: ("sat", "4", "10"), 8: ("sat", "12", "7"), 9: ("sat", "4", "9"), 10: ("csat", "2025", "003"), 11: ("csat", "2025", "003"), 12: ("csat", "2025", "003"), 13: ("sat", "4", "9"),
    }


def test_a_group_that_is_missing_is_the_other_one(spark):
    got = selected(spark, [p for p in PAGES if p[0] == "sat"])
    assert got[1] == ("sat", "4", "9") and got[7] == ("sat", "4", "10")


def test_constants_where_nothing_is_there(spark):
    got = selected(spark, [])
    assert got[1] == ("csat", "2025", "001") and got[5] == ("sat", "8", "001") and got[11] == ("csat", "2025", "001")


def test_collated_order(spark):
    from sparkfolio.operators.records import collated_key

    want = ["2 a", "10 a", "Abend 9", "abend 10", "Ébauche", "étape 2 b", "Etape 2 c", "etape 10", "page 123456789012345678901", "page 123456789012345678902", "Zug"]
    rows = spark.createDataFrame([(t,) for t in want[::-1]], "t string")
    assert [r.t for r in rows.orderBy(collated_key(rows.t), "t").collect()] == want
