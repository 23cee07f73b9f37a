"""Raw files as a data source, in batch and as a stream, against the parse of the same texts."""

from sparkfolio.operators import solve
from sparkfolio.sources import raw_pages

TEXTS = {
    "p1__20240101.txt": "<|ref|>title<|/ref|><|det|>[[1, 2, 30, 40]]<|/det|>\nHead\n\n<|ref|>text<|/ref|><|det|>[[5, 6, 7, 8], [9, 10, 11, 12]]<|/det|>\nabove\n7\nbelow",
    "p1__20240102.txt": "<|ref|>image<|/ref|><|det|>[[1, 1, 2, 2]]<|/det|>\n",
    "한글__x.txt": "<|ref|>text<|/ref|><|det|>[[3, 3, 4, 4]]<|/det|>\n한글 ①",
    "empty__1.txt": "",
}


def filled(folder):
    folder.mkdir(exist_ok=True)
    for name, text in TEXTS.items():
        (folder / name).write_text(text)
    (folder / "other.txt").write_text("x")
    (folder / "below").mkdir()
    (folder / "below" / "q__1.txt").write_text("x")
    return str(folder)


def parsed(spark, names):
    rows = [(n.removesuffix(".txt"), TEXTS[n]) for n in names]
    return sorted(map(tuple, solve.blocks(spark.createDataFrame(rows, "page string, raw string")).collect()))


def test_a_folder_reads_as_blocks(spark, tmp_path):
    folder = filled(tmp_path / "raw")
    got = raw_pages.page_blocks(spark, folder)
    assert sorted(map(tuple, got.collect())) == parsed(spark, TEXTS) and len(parsed(spark, TEXTS)) > 4
    raw = spark.read.format("raw_pages").load(folder)
    assert raw.count() == len(TEXTS) and raw.rdd.getNumPartitions() == len(TEXTS)
    assert spark.read.format("raw_pages").load(str(tmp_path / "none")).count() == 0


def test_a_stream_takes_each_file_once(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    seen = []

    def run():
        raw_pages.page_blocks(spark, str(folder), streaming=True).writeStream.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).foreachBatch(lambda df, n: seen.extend(map(tuple, df.collect()))).start().awaitTermination()

    names = sorted(TEXTS)
    for k, name in enumerate(names):
        (folder / name).write_text(TEXTS[name])
        if k % 2:
            run()
    run()
    assert sorted(seen) == parsed(spark, names)
