"""Queries over caches, selections and drawings, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import app as A
from ..operators import models
from ..sources.tables import read
from .text_queries import _flat, _low, sql_members


def cache_split(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    key = A.solve_key(F.col("o_custkey").cast("string"), F.col("o_orderstatus"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"), (F.col("o_custkey") % 7).cast("string"))
    requests = o.where("o_orderkey % 2 = 0").select("o_orderkey", key.alias("key"))
    cache = o.where("o_orderkey % 2 = 1").select(key.alias("key"), F.col("o_orderkey").alias("written"), F.col("o_orderkey").alias("entry"), (F.col("o_orderkey") % 5).alias("n_results"), (F.col("o_orderkey") % 3 > 0).alias("has_groups"))
    hit, run = A.split_by_cache(requests, cache)
    return hit.withColumn("answered", F.lit(True)).unionByName(run.withColumn("answered", F.lit(False)))


def latest_cached_text(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return A.latest_texts(e.select(F.concat(F.lit("k"), (F.col("user_id") % 40).cast("string")).alias("key"), (F.col("event_id") % 100).alias("modified"), F.col("event_id").alias("path"), F.col("event_type").alias("text")))


def math_segments(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id").cast("string")
    text = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("a $x_"), n, F.lit("$ b \\[y\\] c"))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("$$z"), n, F.lit("$$"))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("\\(p\\)\\(q"), n, F.lit("\\) end"))).otherwise("plain")
    rows = read(spark, d, "documents").select("doc_id", F.posexplode(A.math_segments(text)).alias("pos", "s"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "s.kind", "s.body")


def drawn_nodes(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import align

    return _flat(A.drawn(align.members(_low(spark, d))), "component")


def drawn_chains(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import align

    return _flat(A.chains(align.members(_low(spark, d))), "from_component", "to_component")


def upload_sizes(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    s = A.upload_size(F.col("p_partkey") * 37 % 9000 + 1, F.col("p_partkey") * 53 % 9000 + 1, F.col("p_partkey") * 1_000_003 % 16_000_000)
    return p.select("p_partkey", s.alias("s")).select("p_partkey", "s.width", "s.height")


def model_replies(spark: SparkSession, d: str) -> DataFrame:
    """Requests answered by the stub, which gives back what is stored."""
    c = read(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("stored"))
    return models.apply_model(c, "no such model").select("conv_id", "turn", "reply", "error")


QUERIES = {f.__name__: f for f in (cache_split, latest_cached_text, math_segments, drawn_nodes, drawn_chains, upload_sizes, model_replies)}

ORACLES = {
    "cache_split": """with k as (select o_orderkey, o_custkey || '_' || o_orderstatus || '_' || (o_custkey % 7) as key from orders), c as (select * from k where o_orderkey % 2 = 1 qualify row_number() over (partition by key order by o_orderkey desc) = 1),
        g as (select key from c where o_orderkey % 5 > 0 and o_orderkey % 3 > 0) select o_orderkey, key, key in (select key from g) answered from k where o_orderkey % 2 = 0""",
    "latest_cached_text": "select 'k' || (user_id % 40) as key, arg_max(event_type, event_id % 100 * 1000000000 + event_id) as text from events group by 1",
    "math_segments": r"""with r as (select doc_id, case doc_id % 4 when 0 then [('text', 'a '), ('inline', 'x_' || doc_id), ('text', ' b '), ('display', 'y'), ('text', ' c')] when 1 then [('display', 'z' || doc_id)]
            when 2 then [('inline', 'p'), ('inline', 'q' || doc_id), ('text', ' end')] else [('text', 'plain')] end s from documents), e as (select doc_id, unnest(s) x, generate_subscripts(s, 1) - 1 pos from r)
        select doc_id, pos, x[1] kind, x[2] body from e""",
    "drawn_nodes": f"{sql_members()}, nodes as (select problem, component, floor(avg(idx) + 0.5)::bigint stage, avg(solver) ms from members group by problem, component), rws as (select *, row_number() over (partition by problem, stage order by ms, component) - 1 row_no from nodes) select problem, component.solver component_solver, component.idx component_idx, stage, row_no, stage * 260 + 60 x, row_no * 120 + 60 y from rws",
    "drawn_chains": f"{sql_members()} select problem, solver, lag(component.solver) over w from_component_solver, lag(component.idx) over w from_component_idx, component.solver to_component_solver, component.idx to_component_idx from members window w as (partition by problem, solver order by idx)",
    "upload_sizes": """with p as (select p_partkey, p_partkey * 37 % 9000 + 1 w, p_partkey * 53 % 9000 + 1 h, p_partkey * 1000003 % 16000000 b from part)
        select p_partkey, case when b < 8388608 then w else floor(w * least(1.0::double, 4200.0::double / greatest(w, h)) + 0.5) end::bigint width, case when b < 8388608 then h else floor(h * least(1.0::double, 4200.0::double / greatest(w, h)) + 0.5) end::bigint height from p""",
    "model_replies": "select conv_id, turn, text reply, null::varchar error from conversations where role = 'assistant'",
}
