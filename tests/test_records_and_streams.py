import pandas as pd
from pyspark.sql import functions as F

from sparkfolio.operators import align as A
from sparkfolio.operators import network as N
from sparkfolio.operators import records as R
from sparkfolio.sources import files
from sparkfolio.streaming import fold


def test_page_ids(spark):
    ids = ["sat_math_odd_page_3_7", "2024_math_odd_page_12", "2024_math_odd_page_1234", "x", None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(ids)], "i int, v string").withColumn("s", R.page_spec(F.col("v")))
    got = rows.select("i", "s.*", R.detection_id(F.col("s"), F.lit("25")).alias("d"), R.detection_id(F.col("s"), F.lit("9")).alias("e")).orderBy("i").collect()
    assert [r.stored_page_key for r in got] == ["3_007", "012", "1234", None, None]
    assert [r.d for r in got] == ["sat_3_007_25", "2024_odd_probability_25", "2024_math_odd_page_1234_25", None, None]
    assert [r.e for r in got][:2] == ["sat_3_007_9", "2024_odd_common_9"]


def test_votes_and_status(spark):
    answers = [(30, 0, "200"), (30, 1, "125"), (30, 2, " 125 "), (30, 3, "200"), (30, 4, "100"), (30, 5, "—"), (1, 0, "x = 12")]
    df = spark.createDataFrame(answers, "problem int, solver int, answer string")
    assert [(r.answer_key, r.votes) for r in N.answer_votes(df).where("problem = 30").orderBy("place").collect()] == [("200", 2), ("125", 2), ("100", 1)]
    models = [(1, "a", "done"), (1, "b", "streaming"), (2, "a", "done"), (2, "b", "error"), (3, "a", "done"), (4, "a", "idle"), (4, "b", "done")]
    got = {r.problem: r.status for r in N.problem_status(spark.createDataFrame(models, "problem int, model string, status string")).collect()}
    assert got == {1: "streaming", 2: "error", 3: "done", 4: "idle"}


def test_badges(spark):
    spans = [(1, "a", 0, 100, "done"), (1, "b", 0, 104, "done"), (1, "c", 0, 200, "done"), (1, "d", 0, 150, "done"), (1, "e", 0, 900, "error"), (1, "f", 5, None, "streaming")]
    got = {r.model: r.badge for r in N.latency_badges(spark.createDataFrame(spans, "problem int, model string, started long, finished long, status string")).collect()}
    assert got == {"a": "fastest", "b": "fastest", "c": "20/10x", "d": "15/10x", "e": None, "f": None}


def test_alignment_of_two_solvers(spark):
    steps = [(1, 0, 0, "식 정리", r"\(x f(x)-f(x)=(x-1)f(x)\)로 정리한다."), (1, 1, 0, "방정식 변형", r"\(x f(x)-f(x)\)를 묶어 \(x-1)f(x)\)를 얻는다."), (1, 1, 1, "other", "nothing alike")]
    df = spark.createDataFrame(steps, "problem long, solver long, idx long, title string, body string")
    edges = A.edges(A.scores(df), 0.2)
    assert [(r.i, r.j) for r in edges.collect()] == [(0, 0)]
    assert {(r.solver, r.idx) for r in A.members(edges).collect()} == {(0, 0), (1, 0)}
    (label,) = A.labels(edges, df).collect()
    assert label.group_no == 1 and label.solvers == 2 and len(label.label.split()) == 2


def test_priority_and_positions(spark):
    rows = [("p", 1, "b", 0), ("p", 2, "a", 9), ("q", 2, "a", 3)]
    df = spark.createDataFrame(rows, "page string, priority int, path string, questions int")
    assert {(r.page, r.path) for r in R.by_priority(df, ["page"], "questions > 0").collect()} == {("q", "a")}
    q = spark.createDataFrame([("p", ["a", "b"])], "page string, questions array<string>")
    t = spark.createDataFrame([("p", 2, "stored"), ("p", 1, "")], "page string, number int, text string")
    assert [r.text for r in R.stored_texts(q, t).orderBy("pos").collect()] == ["a", "stored"]


CHUNKS = [
    (1, 0, 1, "event", "start", None, 10), (1, 0, 2, "text", None, "ab", 11), (1, 0, 3, "event", "start", None, 12), (1, 0, 4, "text", None, "c", 13),
    (2, 0, 1, "event", "start", None, 10), (2, 0, 2, "event", "stop", None, 11), (2, 0, 3, "text", None, "late", 12), (2, 0, 4, "event", "done", None, 13),
    (3, 0, 1, "event", "error", None, 9), (3, 1, 1, "event", "start", None, 1), (3, 1, 2, "text", None, "x", 2), (3, 1, 3, "event", "what", None, 3), (3, 1, 4, "event", "done", None, 4),
]
SCHEMA = "problem long, model long, seq long, kind string, event string, text string, at long"
FOLDED = {(1, 0): ("streaming", "abc", 12, None), (2, 0): ("stopped", "", 10, 11), (3, 0): ("error", "", None, 9), (3, 1): ("done", "x", 1, 4)}


def test_fold_in_batch_and_by_stream(spark, tmp_path):
    rows = lambda df: {(r.problem, r.model): (r.status, r.text, r.started, r.finished) for r in df.collect()}
    batch = spark.createDataFrame(CHUNKS, SCHEMA)
    assert rows(fold.fold_batch(batch)) == FOLDED
    # Two files, a file a trigger: state is carried from one to the next.
    for k, part in enumerate((CHUNKS[:3] + CHUNKS[4:5], CHUNKS[3:4] + CHUNKS[5:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    assert rows(fold.run_available(stream, str(tmp_path))) == FOLDED
    assert [(r.problem, r.models, r.done) for r in fold.barrier(fold.fold_batch(batch)).orderBy("problem").collect()] == [(2, 1, 0), (3, 2, 1)]


def test_advance_ignores_what_follows_a_stop():
    frame = pd.DataFrame([(2, "text", None, "x", 5), (1, "event", "stop", None, 4)], columns=["seq", "kind", "event", "text", "at"])
    assert fold.advance(("streaming", "a", 1, None), frame) == ("stopped", "a", 1, 4)


def test_files_round_trip(spark, tmp_path):
    rows = [tuple(f"{c}\tx\r\ny" if c == "prob_desc" else f'{c} "q"' for c in files.PROBLEM_COLUMNS)]
    files.write_problems(spark.createDataFrame(rows, list(files.PROBLEM_COLUMNS)), f"{tmp_path}/p")
    (got,) = files.delimited(spark, f"{tmp_path}/p", files.PROBLEM_COLUMNS, "\t").collect()
    assert got.prob_desc == "prob_desc x\ny" and got.answer == 'answer "q"'
    files.write_chunks(spark.createDataFrame([("p", "m", "text", "abc")], "problemId string, modelId string, kind string, text string"), f"{tmp_path}/c")
    assert [(r.kind, r.text, r.event) for r in files.chunks(spark, f"{tmp_path}/c").collect()] == [("text", "abc", None)]
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages/a.json").write_text('{"page_image": "i.png", "questions": [{"qid": "1", "merged_text": "t", "bbox": [1, 2, 30, 40]}, {"qid": "", "bbox": [1, 2, 3, 4]}]}')
    (page,) = files.pages(spark, f"{tmp_path}/pages").collect()
    assert (page.qid, page.width, page.height, page.x2) == ("1", 30, 40, 30)
    (tmp_path / "logs").mkdir()
    for name, text in (("p__1.txt", "old"), ("p__2.txt", "new"), ("q__1.txt", "one")):
        (tmp_path / "logs" / name).write_text(text)
    assert {r.page: r.raw for r in files.raw_logs(spark, f"{tmp_path}/logs").collect()} == {"p": "new", "q": "one"}
    (tmp_path / "img").mkdir()
    for name in ("a.png", "b.JPG", "c.webp"):
        (tmp_path / "img" / name).write_bytes(b"x")
    assert {r.page_id for r in files.images(spark, f"{tmp_path}/img").collect()} == {"a", "b"}
    bad = spark.createDataFrame([("data:image/png;base64,aGk=",), ("aGk=",), ("!",), (None,)], "prob_base64 string").select(files.decoded().alias("b")).collect()
    assert [bytes(r.b) if r.b else None for r in bad] == [b"hi", b"hi", None, None]
