"""Repeated lines by range-partitioned hashes and streams of first occurrences (native: DataFrame operations only).

A line's key is the line without white space at its ends, A-Z lower-cased; two 64-bit hashes stand for it (that two
of n different keys agree in all 128 bits has a chance of about n * n / 2**129). Only hashes travel: they are dealt by
ranges of hash and sorted within by document, largest first, and position, so each key's lines pass by as one run. The
first document of a run keeps its lines; the others lose theirs if the run has at least `least_docs` documents. What
goes back to a document is its keep bitmap, run-length coded, and no text.

A run lies in one task, so the keys that hold `HOT_SHARE` of all lines or more are told beforehand by frequent-item
sketches (of a fixed size, merged in two steps; at most 1 / HOT_SHARE keys) and decided apart: their distinct documents
are counted by (key, document), which no single key makes uneven, and the decision, a row a key, is joined to their
lines where these lie. The sketch only decides who is counted in which way, never the result.

Defined cases: a null or empty text is one empty line. Rows that repeat a doc_id are one document when documents are counted, and
rows of their own otherwise: each with the largest doc_id of a key keeps its lines. Rows without a doc_id are one
document that is smaller than all others. A very long text is many lines; only its own dropped positions are ever gathered. docs
must give the same rows when read again (they are read twice), as a table does. Columns besides doc_id and text are not
read by `keep_bitmaps` and kept by `cleaned`. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_or_empty, unused

LEAST_CHARS, LEAST_DOCS = 20, 3
#: White space of the contract, as the characters that a trim removes.
ENDS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "".join(map(chr, range(0x41, 0x5B))), "".join(map(chr, range(0x61, 0x7B)))
#: A key with this share of all lines is decided apart; a sketch that tracks four times as many items finds all of them.
HOT_SHARE = 1 / 2048
TRACKED, SKETCHES = 16384, 32
#: Past the last line of any text.
OPEN = (1 << 31) - 1


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(ENDS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def hashed_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, row_at, pos, h1, h2): the lines whose keys are long enough."""
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row_at"), text_or_empty().alias("text"))
    each = rows.select("doc_id", "row_at", F.posexplode(split_lines(F.col("text"))).alias("pos", "line")).withColumn("key", line_key(F.col("line")))
    return each.where(F.char_length("key") >= least_chars).select("doc_id", "row_at", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(11), "key").alias("h2"))


def frequent(lines: DataFrame) -> list[int]:
    """First hashes of the keys that hold HOT_SHARE of all lines, and maybe of a few that hold little less."""
    most = int(1 / HOT_SHARE)
    parts = lines.groupBy((F.spark_partition_id() % SKETCHES).alias("part")).agg(F.expr(f"approx_top_k_accumulate(h1, {TRACKED})").alias("sketch"), F.count(F.lit(1)).alias("n"))
    # Grouped by a constant: a task without sketches then makes no group, where it would fail on an empty state.
    merged = parts.groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(sketch, {TRACKED}), {most})").alias("top"), F.sum("n").alias("n"))
    return [x["item"] for row in merged.collect() for x in row["top"] if x["count"] >= row["n"] * HOT_SHARE]


def dropped_lines(lines: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(row_at, pos) of the lines that go. lines: a stored table of hashed_lines()."""
    hot = F.col("h1").isin(frequent(lines))
    # The window's partitioning and order are those that the two calls before it make: nothing is shuffled or sorted again.
    dealt = lines.where(~hot).repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", F.desc_nulls_last("doc_id"), "row_at", "pos")
    run = Window.partitionBy("h1", "h2")
    ranked = dealt.withColumn("doc_rank", F.dense_rank().over(run.orderBy(F.desc_nulls_last("doc_id"))))
    streamed = ranked.withColumn("docs", F.max("doc_rank").over(run)).where((F.col("doc_rank") > 1) & (F.col("docs") >= least_docs))
    # At most 1 / HOT_SHARE keys: the decisions' size is bounded whatever the table's is.
    decided = lines.where(hot).select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2").agg(F.max("doc_id").alias("stays"), F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= least_docs)
    apart = lines.where(hot).join(F.broadcast(decided), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("stays")))
    return streamed.select("row_at", "pos").unionByName(apart.select("row_at", "pos"))


def keep_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(row_at, n_dropped, keep) of the documents that lose lines; row_at is their monotonically_increasing_id().

    keep is the bitmap of the lines that stay, coded as its runs of ones: [first, past), ascending; the last run is open.
    """
    lines = stored(hashed_lines(docs, least_chars), "lines")
    gone = dropped_lines(lines, least_docs).groupBy("row_at").agg(F.array_sort(F.collect_list("pos")).alias("p"))
    starts = F.filter("p", lambda x, i: (i == 0) | (F.get("p", i - 1) < x - 1))
    ends = F.filter("p", lambda x, i: (i == F.size("p") - 1) | (F.get("p", i + 1) > x + 1))
    runs = gone.select("row_at", F.size("p").cast("long").alias("n_dropped"), F.concat(F.array(F.lit(0)), F.transform(ends, lambda x: x + 1)).alias("firsts"), F.concat(starts, F.array(F.lit(OPEN))).alias("pasts"))
    zipped = F.zip_with("firsts", "pasts", lambda a, b: F.struct(a.alias("first"), b.alias("past")))
    return runs.select("row_at", "n_dropped", F.filter(zipped, lambda r: r["first"] < r["past"]).alias("keep"))


def kept_text(text: Column, keep: Column) -> Column:
    """The lines of text under the bitmap, joined again."""
    lines = split_lines(text)
    return F.array_join(F.flatten(F.transform(keep, lambda r: F.slice(lines, r["first"] + 1, r["past"] - r["first"]))), "\n")


def cleaned(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """docs with n_lines, n_dropped and kept (the text that stays) behind its columns, under names that are not taken.

    The names get an underscore more until they are free; a text without dropped lines stays as it is (null: empty).
    """
    key = unused(docs, "_folio_row_at")
    names = [unused(docs, n) for n in ("n_lines", "n_dropped", "kept")]
    maps = keep_bitmaps(docs, least_chars, least_docs).select(F.col("row_at").alias(key), F.col("n_dropped").alias(f"{key}_n"), F.col("keep").alias(f"{key}_keep"))
    # Bitmaps are the side that is hashed; texts are shuffled once and not sorted.
    both = docs.withColumn(key, F.monotonically_increasing_id()).join(maps.hint("shuffle_hash"), key, "left")
    text = text_or_empty()
    kept = F.when(F.col(f"{key}_keep").isNull(), text).otherwise(kept_text(text, F.col(f"{key}_keep")))
    values = F.size(split_lines(text)).cast("long"), F.coalesce(f"{key}_n", F.lit(0).cast("long")), kept
    return both.select(*docs.columns, *(v.alias(n) for v, n in zip(values, names, strict=True)))
