import random

import corpus_pipeline
from sparkfolio.llm.common import stored


def rows():
    rng = random.Random(12)
    words = [a + b + c for a in ("th", "er", "on") for b in ("an", "ou", "ing") for c in ("", "ed", "st")]
    texts = [" ".join(rng.choice(words) + rng.choice("abc") for _ in range(rng.randint(20, 120))) for _ in range(60)]
    near = [t + " more" for t in texts[:6]]
    out = [(i, t, "en", "ab"[i % 2], len(t)) for i, t in enumerate(texts + near + texts[10:20])]
    return out + [(900, None, None, None, None), (901, "12 34", None, "a", 5), (902, "x " * 5000, None, "b", 10000)]


def test_stages_keep_what_they_should(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    columns, docs = docs.columns, stored(docs, "documents")
    ids = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, ""), name)
        assert docs.columns == columns
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
    language, exact, near, mixed = ids
    assert language == {r[0] for r in rows()} - {900, 901}
    assert exact == language - set(range(66, 76))
    assert near == exact - set(range(60, 66))
    assert mixed < near and len(mixed) > len(near) / 3
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r.doc_id for r in pieces} == mixed


def test_empty_table_and_more_columns(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    none = spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0
    names = ["label", "cid", "token", "sig", "_folio_lang_pred", "row_at"]
    docs = spark.createDataFrame([(*r, *[7] * len(names)) for r in rows()], schema + "".join(f", {n} long" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(docs, "documents")
        kept = stage(spark, docs, "")
        assert kept.columns == docs.columns and kept.where("label = 7 and row_at = 7").count() == kept.count()
        docs = kept
    assert corpus_pipeline.STAGES[-1][1](spark, stored(docs, "documents"), "").count() > 0


def test_whole_run(spark, tmp_path):
    spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
