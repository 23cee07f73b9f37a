"""Sinks that are exact under repeated batches, ordered files, and the keyed store, each against what was written."""

import random

import pytest
from pyspark.sql import functions as F

from sparkfolio.sources import sinks
from sparkfolio.sources.keyed import KeyedTable

ROWS = "prob_id string, ground_truth string, prob_desc_deepseek string, prob_desc_deepseek2 string, prob_desc_qwen string, prob_desc_paddle string, raw_deepseek_ocr string, raw_deepseek_ocr2 string"
CELL = ' two\r\nlines, "quoted"\n\n\\ and\ttabs '


def row(k, raw=None):
    return (f"p{k}", " a\nb ", CELL, None, "", f"x{k}", raw, None)


def result(k):
    return (f"p{k}", "a b", 'two lines, "quoted"  \\ and\ttabs', "", "", f"x{k}")


def table(df):
    return sorted(tuple(r)[:-1] for r in df.collect())


def test_a_repeated_batch_counts_once(spark, tmp_path):
    write, (results, raw) = sinks.results_writer(str(tmp_path)), sinks.result_sinks(str(tmp_path))
    batch = lambda *rows: spark.createDataFrame(list(rows), ROWS)
    assert results.read(spark).count() == 0
    write(batch(row(1, CELL), row(2)), 0)
    write(batch(row(3, "raw")), 1)
    write(batch(row(3, "raw")), 1)
    write(batch(row(1, CELL), row(2)), 0)
    assert table(results.read(spark)) == [result(1), result(2), result(3)]
    assert table(raw.read(spark)) == [("p1", CELL, ""), ("p3", "raw", "")]
    assert results.vacuum(spark) == 2 and results.vacuum(spark) == 0
    assert table(results.read(spark)) == [result(1), result(2), result(3)]


def test_what_never_was_committed_is_not_read(spark, tmp_path):
    write, (results, _) = sinks.results_writer(str(tmp_path)), sinks.result_sinks(str(tmp_path))
    write(spark.createDataFrame([row(1)], ROWS), 0)
    spark.createDataFrame([result(9)], list(sinks.RESULT_COLUMNS)).write.options(**sinks.CSV).csv(f"{results.path}/data/attempt=aborted")
    assert table(results.read(spark)) == [result(1)]


def test_a_dry_run_writes_ids_and_truth(spark, tmp_path):
    sinks.results_writer(str(tmp_path), dry_run=True)(spark.createDataFrame([row(1, "raw")], ROWS), 0)
    results, raw = sinks.result_sinks(str(tmp_path))
    assert table(results.read(spark)) == [("p1", "a b", "", "", "", "")] and raw.read(spark).count() == 0


def test_a_stream_that_dies_after_a_write_repeats_it(spark, tmp_path):
    write, (results, _) = sinks.results_writer(f"{tmp_path}/out"), sinks.result_sinks(f"{tmp_path}/out")
    died = []

    def once_dying(batch, n):
        write(batch, n)
        if n == 1 and not died:
            died.append(n)
            raise RuntimeError("the driver died")

    def more(k):
        spark.createDataFrame([row(k)], ROWS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    stream = lambda: spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    more(1)
    sinks.run_available(stream(), once_dying, f"{tmp_path}/ck")
    more(2)
    with pytest.raises(Exception, match="driver died"):
        sinks.run_available(stream(), once_dying, f"{tmp_path}/ck")
    more(3)
    sinks.run_available(stream(), once_dying, f"{tmp_path}/ck")
    assert table(results.read(spark)) == [result(1), result(2), result(3)]


def test_lines_of_json(spark, tmp_path):
    sink = sinks.Sink(str(tmp_path), ("a", "b"), "json")
    sink.write(spark.createDataFrame([("x\ny", None), ("é", '"')], "a string, b string"), 0)
    assert sorted(map(tuple, sink.read(spark).select("a", "b").collect()), key=repr) == sorted([("x\ny", None), ("é", '"')], key=repr)


def test_files_read_by_name_are_in_order(spark, tmp_path):
    names = [f"p{k}" for k in range(200)]
    random.Random(1).shuffle(names)
    df = spark.createDataFrame([(n, f' "{n}"\r\n ') for n in names], "name string, text string").repartition(7)
    number = F.regexp_extract("name", r"\d+", 0).cast("int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_ordered(df, str(tmp_path / "t"), [number], ("name", "kind", "text", "empty"), {"kind": "k"}, sep="\t")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = sinks.read_ordered(spark, str(tmp_path / "t"), ("name", "kind", "text", "empty"), sep="\t")
    assert rows.select("file").distinct().count() > 1
    got = sinks.numbered(rows).orderBy("row_no").collect()
    assert [(r.name, r.kind, r.text, r.empty, r.row_no) for r in got] == [(f"p{k}", "k", f' "p{k}"\r\n ', "", k + 1) for k in range(200)]


def test_the_store_equals_a_dictionary(spark, tmp_path):
    store, held, rng = KeyedTable(f"{tmp_path}/s", ("key",), "entry string", "key long", 8), {}, random.Random(3)
    frame = lambda rows: spark.createDataFrame(rows, "key long, entry string, written long")
    for turn in range(4):
        rows = [(rng.randrange(40), f"e{turn}-{k}", rng.randrange(100) * 1000 + turn * 100 + k) for k in range(25)]
        store.upsert(frame(rows))
        for key, entry, written in rows:
            if written >= held.get(key, ("", -1))[1]:
                held[key] = (entry, written)
        gone = [(k, 40_000) for k in range(turn, 40, 7)]
        store.clear(spark.createDataFrame(gone, "key long, written long"))
        for key, written in gone:
            if held.get(key, ("", -1))[1] <= written:
                held[key] = (None, written)
        assert {r.key: (r.entry, r.written) for r in store.read(spark).collect()} == {k: v for k, v in held.items() if v[0] is not None}
    store.insert_missing(frame([(k, "new", 10**6) for k in range(45)]))
    live = {k: v for k, v in held.items() if v[0] is not None}
    assert {r.key: r.entry for r in store.read(spark).collect()} == {k: live.get(k, ("new",))[0] for k in range(45)}
    assert {r.key for r in store.lookup(spark.createDataFrame([(1,), (99,)], "key long")).collect()} == {1}
    store.clear_all(spark)
    assert store.read(spark).count() == 0


def test_a_write_leaves_other_buckets_alone(spark, tmp_path):
    store = KeyedTable(f"{tmp_path}/s", ("key",), "entry string", "key long", 16)
    store.upsert(spark.range(500).select(F.col("id").alias("key"), F.lit("a").alias("entry"), F.lit(1).cast("long").alias("written")))
    files = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "s").rglob("part-*.parquet")}
    before = files()
    store.upsert(spark.createDataFrame([(7, "b", 2)], "key long, entry string, written long"))
    changed = {p.split("bucket=")[1].split("/")[0] for p, _ in set(before.items()) ^ set(files().items())}
    assert len(changed) == 1 and store.read(spark).where("entry = 'b'").count() == 1 and store.read(spark).count() == 500
