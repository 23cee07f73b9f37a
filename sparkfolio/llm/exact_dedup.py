"""Exact duplicates by content-defined chunk recipes (native: DataFrame operations only).

A text is normalised (each white-space run becomes one space) and cut where its own content says so: at the
first sentence end past `CHUNK_MIN` characters, at `CHUNK_MAX` at the latest. A chunk is identified by two
64-bit hashes; one job sends each distinct chunk over the network once and verifies that no two different
chunks share an identifier. Were some to collide, their documents get the chunk's rank among those that do as
a further part of the recipe. From then on only recipes (16 bytes a chunk) are compared, never texts.

Defined cases: null text is empty; all empty texts are equal (an empty recipe). Rows that repeat a doc_id are
rows of their own: in a group the row with the smallest doc_id stays, of several such rows the first read. A
null doc_id sorts first. A very long text is a long recipe; no chunk exceeds CHUNK_MAX. docs must give the same rows when
read again (kept_rows reads them twice), as a table does. Columns besides doc_id and text are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, stored, text_or_empty, unused

CHUNK_MIN, CHUNK_MAX = 512, 4096


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, " ")


def chunks(text: Column, least: int = CHUNK_MIN, most: int = CHUNK_MAX) -> Column:
    """Content-defined pieces of text, in order; joined they give the text again."""
    rule = rf"(?s).{{{least},{most - 1}}}?(?:(?<=[.!?;|。！？] )|\z)|.{{1,{most}}}"
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.regexp_extract_all(text, F.lit(rule), F.lit(0)))


def identifier(chunk: Column, bits: int) -> tuple[Column, Column]:
    """Two hashes, seeded differently, of which the lowest `bits` bits are kept (64 but in tests)."""
    pair = F.xxhash64(chunk), F.xxhash64(F.lit(7), chunk)
    return pair if bits >= 64 else tuple(F.pmod(x, F.lit(1 << bits)) for x in pair)


def recipes(docs: DataFrame, bits: int = 64, least: int = CHUNK_MIN, most: int = CHUNK_MAX) -> DataFrame:
    """(doc_id, row_at, text_sha256, recipe): recipe lists verified chunk identifiers in order."""
    base = docs.select("doc_id", F.monotonically_increasing_id().alias("row_at"), normalised(text_or_empty()).alias("norm"))
    ids = lambda c: F.array(*identifier(c, bits))
    found = stored(base.select("doc_id", "row_at", F.sha2("norm", 256).alias("text_sha256"), F.flatten(F.transform(chunks(F.col("norm"), least, most), ids)).alias("recipe")), "recipes")

    rows = base.select("row_at", F.posexplode(chunks(F.col("norm"), least, most)).alias("at", "chunk"))
    h1, h2 = identifier(F.col("chunk"), bits)
    rows = rows.withColumns({"h1": h1, "h2": h2})
    distinct = rows.groupBy("h1", "h2", "chunk").agg(F.count(F.lit(1)).alias("uses"))
    clashes = stored(distinct.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1"), "clashes")
    if clashes.isEmpty():
        return found
    # Different chunks with one identifier: tell them apart by their text, only for the identifiers concerned.
    said = rows.join(clashes, ["h1", "h2"], "left_semi")
    kinds = said.select("h1", "h2", "chunk").distinct()
    below = kinds.alias("a").join(kinds.alias("b"), (F.col("a.h1") == F.col("b.h1")) & (F.col("a.h2") == F.col("b.h2")) & (F.col("b.chunk") < F.col("a.chunk")), "left")
    ranks = below.groupBy("a.h1", "a.h2", "a.chunk").agg(F.count("b.chunk").alias("rank"))
    told = said.join(ranks, ["h1", "h2", "chunk"]).groupBy("row_at").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "rank"))), lambda x: F.array(x["at"].cast("long"), x["rank"]))).alias("told"))
    return found.join(told, "row_at", "left").withColumn("recipe", F.concat("recipe", F.array(F.lit(-1).cast("long")), F.coalesce("told", F.array().cast("array<long>")))).drop("told")


def exact_dedup(docs: DataFrame, bits: int = 64, least: int = CHUNK_MIN, most: int = CHUNK_MAX) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, row_at.

    Groups are counted before they are shuffled, and each group of several rows comes back as one row of a stored
    table; the join with it stands alone in its stage, so the planner can split the partition of a large group.
    """
    found = recipes(docs, bits, least, most)
    groups = found.groupBy("recipe").agg(F.min(F.struct("doc_id", "row_at")).alias("first"), F.count(F.lit(1)).alias("group_size"))
    groups = stored(groups.where("group_size > 1"), "groups")
    alone = F.col("group_size").isNull()
    return found.join(groups, "recipe", "left").select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row_at") == F.col("first.row_at"))).alias("kept"), "text_sha256", "row_at",
    )


def kept_rows(docs: DataFrame) -> DataFrame:
    """docs without the rows that repeat an earlier text; all columns stay as they are."""
    at = unused(docs, "_folio_row_at")
    stay = exact_dedup(docs).where("kept").select(F.col("row_at").alias(at))
    return docs.withColumn(at, F.monotonically_increasing_id()).join(stay, at, "left_semi").drop(at)
