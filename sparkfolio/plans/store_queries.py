"""Queries over sinks and stores that are written and read back, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import records as R
from ..sources import sinks
from ..sources.keyed import KeyedTable
from ..sources.shared import shared_dir
from ..sources.tables import read, stream


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def incremental_results(spark: SparkSession, d: str) -> DataFrame:
    """Documents as a stream into the table of results, on one line each, and the table of raw texts; both read back whole."""
    folder = _fresh(spark, "results")
    third = F.when(F.col("doc_id") % 3 == 0, F.col("text"))
    rows = stream(spark, d, "documents").select(F.col("doc_id").cast("string").alias("prob_id"), F.col("lang").alias("ground_truth"), *(F.col("text").alias(c) if c == "prob_desc_qwen" else F.lit(None).cast("string").alias(c) for c in sinks.RESULT_COLUMNS[2:]), third.alias("raw_deepseek_ocr"), F.lit(None).cast("string").alias("raw_deepseek_ocr2"))
    sinks.run_available(rows, sinks.results_writer(folder), f"{folder}/checkpoint")
    results, raw = (s.read(spark) for s in sinks.result_sinks(folder))
    md5 = lambda c: F.md5(F.col(c).cast("binary"))
    kept = raw.select(F.col("prob_id").alias("_id"), md5("raw_deepseek_ocr").alias("raw_md5"))
    return results.join(kept, F.col("prob_id") == F.col("_id"), "left").select(F.col("prob_id").cast("long").alias("doc_id"), "ground_truth", md5("prob_desc_qwen").alias("line_md5"), "raw_md5")


def ndjson_results(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations as lines of JSON, written by a stream and read back."""
    folder = _fresh(spark, "lines")
    sink = sinks.Sink(folder, ("problemId", "modelId", "text"), "json")
    rows = stream(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("problemId"), F.concat_ws("-", F.col("turn").cast("string"), "role").alias("modelId"), "text")
    sinks.run_available(rows, sink.write, f"{folder}/checkpoint")
    return sink.read(spark).select("problemId", "modelId", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def ordered_export(spark: SparkSession, d: str) -> DataFrame:
    """Parts in natural order of a made label as text files; each row's number in the files read by name."""
    p = read(spark, d, "part").withColumn("label", F.concat(F.lit("p"), (F.col("p_partkey") * 7919 % 100_003).cast("string")))
    path = _fresh(spark, "export")
    sinks.write_ordered(p, path, [*R.natural_key(F.col("label")), F.col("p_partkey")], ("p_partkey", "label", "kind", "p_name", "note"), {"kind": "part"})
    back = sinks.numbered(sinks.read_ordered(spark, path, ("p_partkey", "label", "kind", "p_name", "note")))
    return back.select(F.col("p_partkey").cast("long").alias("p_partkey"), "label", "kind", "p_name", "note", F.col("row_no").cast("long").alias("row_no"))


def keyed_store(spark: SparkSession, d: str) -> DataFrame:
    """Orders as writes of a cache by customer: two rounds of writes, what is cleared between, what is put in only if absent."""
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("entry"), F.col("o_orderkey").alias("written"))
    store = KeyedTable(_fresh(spark, "cache"), ("key",), "entry string", "key long")
    top = o.agg(F.max("written")).first()[0] or 0
    store.upsert(o.where("written % 3 = 0"))
    store.clear(o.where("key % 5 = 0").select("key", F.lit(top // 2).cast("long").alias("written")).distinct())
    store.upsert(o.where("written % 3 = 1"))
    store.insert_missing(o.where("written % 3 = 2").withColumn("entry", F.concat(F.lit("late "), "entry")))
    return store.read(spark)


QUERIES = {f.__name__: f for f in (incremental_results, ndjson_results, ordered_export, keyed_store)}

ORACLES = {
    "incremental_results": r"""select doc_id, coalesce(trim(regexp_replace(lang, '\r\n|\r|\n', ' ', 'g')), '') ground_truth, md5(coalesce(trim(regexp_replace(text, '\r\n|\r|\n', ' ', 'g')), '')) line_md5,
        case when doc_id % 3 = 0 and text is not null then md5(text) end raw_md5 from documents""",
    "ndjson_results": "select conv_id::varchar problemId, concat_ws('-', turn::varchar, role) modelId, md5(text) text_md5 from conversations",
    "ordered_export": "with p as (select p_partkey, 'p' || (p_partkey * 7919 % 100003) as label, p_name from part) select p_partkey, label, 'part' kind, p_name, '' note, row_number() over (order by substr(label, 2)::bigint, p_partkey) row_no from p",
    "keyed_store": """with o as (select o_custkey as key, o_orderpriority entry, o_orderkey written from orders), t as (select max(written) // 2 at_ from o),
        early as (select key, arg_max(entry, written) entry, max(written) written from o where written % 3 = 0 group by key),
        left_ as (select * from early, t where not (key % 5 = 0 and written <= at_)),
        more as (select key, arg_max(entry, written) entry, max(written) written from o where written % 3 = 1 group by key),
        live as (select m.* from more m left join (select distinct key from o where key % 5 = 0) c on m.key = c.key, t where c.key is null or m.written > at_),
        both_ as (select key, entry, written from left_ union all select key, entry, written from live), now_ as (select key, arg_max(entry, written) entry, max(written) written from both_ group by key),
        late as (select key, arg_max('late ' || entry, written) entry, max(written) written from o where written % 3 = 2 and key not in (select key from now_) group by key)
        select * from now_ union all select l.* from late l left join (select distinct key from o where key % 5 = 0) c on l.key = c.key, t where c.key is null or l.written > at_""",
}
