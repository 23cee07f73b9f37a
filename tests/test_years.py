"""A data folder by year: which files are read, which rows stay, which image is found."""

import base64

import pytest

from sparkfolio.sources import years

B64 = base64.b64encode(b"img").decode()


def put(path, text="x"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "work" / "data"
    put(d / "2022_math_odd.tsv", "prob_id\tprob_desc\na\told\na\tnew\nz\tno image\n")
    for name in ("a.png", "b.png", "a_crop1.png", "c.jpg", "below/d.png"):
        put(d / "2022_math_odd" / name)
    put(d / "2026_math_odd.tsv", 'prob_id\tprob_img_path\tprob_desc\np1\timages/x.png\tone\np2\timages/y.png\t"two\nlines"\np3\t\tthree\np4\tgone.png\tfour\np5\timages/w.png\tfive\n')
    for name in ("data/images/x.png", "data/x.png", "data/crop_image/y.png", "y.png", "crop_image/w.png"):
        put(tmp_path / "work" / name)
    put(d / "2024_math_odd_dla.csv", f"prob_id,prob_base64\nq1,{B64}\nq2,\nq3,!!!\nq4,\"data:image/png;base64,{B64}\"\n")
    put(d / "2024_math_odd.csv", "prob_id,prob_desc\nq1,first\n")
    put(d / "2025_math_odd_dla.csv", f"prob_id,prob_base64\nq1,{B64}\n")
    return d


def read(spark, d, *which):
    rows = years.problems(spark, str(d), list(which), str(d.parent)).collect()
    tail = lambda p: p and p.split("/work/")[1]
    return sorted((r.year, r.prob_id, tail(r.image), bytes(r.content) if r.content is not None else None, r.ground_truth) for r in rows)


def test_years_are_read_from_what_is_there(spark, folder):
    assert read(spark, folder, 2021, 2022, 2023, 2024, 2025, 2026) == [
        (2022, "a", "data/2022_math_odd/a.png", None, "new"), (2022, "b", "data/2022_math_odd/b.png", None, ""),
        (2024, "q1", None, b"img", "first"), (2024, "q4", None, b"img", ""),
        (2026, "p1", "data/images/x.png", None, "one"), (2026, "p2", "data/crop_image/y.png", None, "two\nlines"), (2026, "p3", None, None, "three"), (2026, "p4", None, None, "four"), (2026, "p5", "crop_image/w.png", None, "five"),
    ]


def test_the_fallbacks_of_2023(spark, folder):
    put(folder / "2023_math_odd.tsv", "prob_id\tprob_img_path\nt1\timages/x.png\n")
    assert read(spark, folder, 2023) == []
    put(folder / "2023_math_odd.csv", "prob_id,prob_desc\nt1,by table\n")
    assert read(spark, folder, 2023) == [(2023, "t1", "data/images/x.png", None, "by table")]
    put(folder / "2023_math_odd.csv", f"prob_id,prob_desc,prob_base64\nt1,by bytes,{B64}\nt2,none,\n")
    assert read(spark, folder, 2023) == [(2023, "t1", None, b"img", "by bytes")]
    put(folder / "2023_math_odd_dla.csv", f"prob_id,prob_base64\nt3,{B64}\n")
    assert read(spark, folder, 2023) == [(2023, "t3", None, b"img", "")]


def test_places_in_order(spark):
    rows = spark.createDataFrame([("p", "a/b.png"), ("q", "/abs/c.png"), ("r", None)], "prob_id string, prob_img_path string")
    got = years.candidates(rows, "/w/data", "/w/data/2026_math_odd.tsv", "/w").orderBy("prob_id", "rank").collect()
    assert [r.path for r in got if r.prob_id == "p"] == ["/w/data/a/b.png", "/w/data/b.png", "/w/data/crop_image/b.png", "/w/data/2026_math_odd/b.png", "/w/a/b.png", "/w/b.png", "/w/crop_image/b.png", "/w/data/a/b.png", "/w/data/b.png", "/w/data/crop_image/b.png"]
    assert {r.path for r in got if r.prob_id == "q"} >= {"/abs/c.png"} and not [r for r in got if r.prob_id == "r"]
