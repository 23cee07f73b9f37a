"""Importance resampling towards a target's distribution of hashed words and word pairs, by a vectorised byte automaton.

A task takes the bytes of an Arrow batch as they lie in its buffer. One lookup table classifies every byte (a word byte's
lower case, or 0), words begin and end where neighbours differ or a text ends, and one table-driven CRC step a
position advances all words at once: first every word on its own, then every word once more from the state of the
word before it and a space, which gives the pairs. Counts of the buckets come from all documents; they and the
gains have a fixed size (`BUCKETS`). A document's weight is the floored mean of its features' gains, and a hashed Gumbel
number added to it turns the highest scores into a draw without replacement in proportion to exp(weight).

Ranks come from ranges of (score, doc_id), stored with the number of their partition: a row's rank is the number of rows
in partitions before its own plus its place in it. What is gathered is one number a partition.

Defined cases: a null or empty text, or one without a word byte, has no features and weight 0. Rows that repeat a doc_id are documents of
their own with equal scores if their texts are equal; ties in score and doc_id go by the order of reading. A null doc_id is hashed as
empty text and comes last among equal scores. Texts are worked on in pieces of about `PIECE` bytes, cut between words, so
a very long text needs no more memory than its bytes; a word longer than `STEPS` bytes is finished by itself.
Columns besides doc_id and text are not read. With an empty table nothing is drawn; with an empty target all gains favour
rare buckets, as the formula says.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, stored, tidy

BUCKETS, PERCENT, LEAST_WORDS, SEED = 10_000, 25, 20, "7"
#: Positions that all words of a piece take together; what is longer is rare and goes on by itself.
STEPS = 48
#: Bytes of text that are worked on at a time.
PIECE = 1 << 20
SPACE_BYTE = 0x20
ONES = 0xFFFFFFFF


def byte_classes() -> np.ndarray:
    """A word byte's lower case, else 0: digits, letters and all bytes of characters outside ASCII are word bytes."""
    kind = np.zeros(256, np.uint8)
    for first, last in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        kind[first : last + 1] = np.arange(first, last + 1)
    kind[0x41:0x5B] = kind[0x61:0x7B]
    return kind


def crc_table() -> np.ndarray:
    """The CRC-32 of each single byte's effect on a state."""
    state = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        state = np.where(state & 1, (state >> 1) ^ np.uint32(0xEDB88320), state >> 1).astype(np.uint32)
    return state


CLASSES, TABLE = byte_classes(), crc_table()


def stepped(state: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    return TABLE[(state ^ byte) & 0xFF] ^ (state >> np.uint32(8))


def advanced(state: np.ndarray, low: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """state after the bytes low[start : start + length] of each word. Words come longest first, so those still going are a head."""
    state = state.copy()
    going = np.searchsorted(-lengths, -np.arange(min(int(lengths[0]), STEPS)), side="left")
    for k, n in enumerate(going):
        state[:n] = stepped(state[:n], low[starts[:n] + k])
    for i in range(int(np.searchsorted(-lengths, -STEPS, side="left"))):
        rest = low[starts[i] + STEPS : starts[i] + lengths[i]].tobytes()
        state[i] = zlib.crc32(rest, int(state[i]) ^ ONES) ^ ONES
    return state


def pieces(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of data in pieces of about PIECE bytes, each at a byte that is no part of a word or at the end of a text."""
    at = 0
    while at < len(data):
        to, reach = at + PIECE, PIECE
        while to < len(data):
            stops = np.flatnonzero(CLASSES[data[to : to + reach]] == 0)
            text_end = ends[np.searchsorted(ends, to)]
            found = min(to + int(stops[0]) if len(stops) else len(data), int(text_end))
            if found <= to + reach:
                to = found
                break
            to += reach
        yield at, min(to, len(data))
        at = min(to, len(data))


def words_of(low: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the words in low; a word ends where its text does (ends, within low)."""
    inside = low != 0
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    cut = ends[(ends > 0) & (ends < len(low))]
    begin[cut] |= inside[cut]
    end[cut - 1] |= inside[cut - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1 - starts


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and where each ends; nulls are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    held = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return held, at[1:] - at[0]


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Piece by piece (document, CRC of the word, CRC of the word before it and the word; -1 for a text's first word)."""
    data, ends = buffer_of(texts)
    last_doc, last_state = -1, 0
    for a, b in pieces(data, ends):
        low = CLASSES[data[a:b]]
        starts, lengths = words_of(low, ends - a)
        if not len(starts):
            continue
        doc = np.searchsorted(ends, starts + a, side="right")
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        one = np.empty(len(order), np.uint32)
        one[order] = advanced(np.full(len(order), ONES, np.uint32), low, starts, lengths)
        before = np.concatenate([np.array([last_state], np.uint32), one[:-1]])
        first = doc != np.concatenate([[last_doc], doc[:-1]])
        two = np.empty(len(order), np.uint32)
        two[order] = advanced(stepped(before, SPACE_BYTE)[order], low, starts, lengths)
        yield doc, (one ^ np.uint32(ONES)).astype(np.int64), np.where(first, -1, (two ^ np.uint32(ONES)).astype(np.int64))
        last_doc, last_state = int(doc[-1]), int(one[-1])


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how often the features of all texts fall into each bucket. A task hands on at most `buckets` rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, one, two in features(batch.column(0)):
                total += np.bincount(one % buckets, minlength=buckets)
                total += np.bincount(two[two >= 0] % buckets, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    arrow_rows(docs.sparkSession)
    return docs.select("text").mapInArrow(tidy(count), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 * ln) of each bucket's smoothed share in target over that in docs: `buckets` numbers, whatever the tables' sizes."""
    spark = docs.sparkSession
    ours, theirs = (bucket_counts(x, buckets).withColumnRenamed("n", n) for x, n in ((docs, "s"), (target, "t")))
    held = spark.range(buckets).withColumnRenamed("id", "bucket").join(ours, "bucket", "left").join(theirs, "bucket", "left").select("bucket", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("s", "t"))).toPandas()
    s, t = (held.sort_values("bucket")[c].to_numpy(np.float64) for c in ("s", "t"))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean of the gains of a document's features."""
    buckets, schema = len(gain), "doc_id long, n_words long, n_features long, weight long"

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            words, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for doc, one, two in features(batch.column(1)):
                words += np.bincount(doc, minlength=n)
                gained = gain[one % buckets] + np.where(two >= 0, gain[two % buckets], 0)
                np.add.at(total, doc, gained)
            many = words + np.maximum(words - 1, 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(many), pa.array(total // np.maximum(many, 1))], ["doc_id", "n_words", "n_features", "weight"])

    arrow_rows(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(weigh), schema)


def gumbel(seed: str = SEED) -> Column:
    """floor(-1000 * ln(-ln(u))) with u from the first 8 hex digits of sha256 of `<seed>:<doc_id>`."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def ranked(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """rows (doc_id, score, ...) with rank: 1, 2, 3 ... by falling score, then doc_id, for the highest `percent` % of them, else null."""
    order = F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("read_at")
    dealt = stored(rows.withColumn("read_at", F.monotonically_increasing_id()).repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranked")
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # One row a partition: its size is bounded by the number of partitions.
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = sizes.select("part", (F.sum("n").over(every) - F.col("n")).alias("before"), F.floor(F.sum("n").over(Window.partitionBy()) * percent / 100).alias("draw"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    found = dealt.join(F.broadcast(before), "part").withColumn("place", place)
    return found.withColumn("rank", F.when(F.col("place") <= F.col("draw"), F.col("place"))).drop("part", "read_at", "before", "draw", "place")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED, buckets: int = BUCKETS) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_features, weight, score, rank (null: not drawn). Documents of fewer than
    `least_words` words are scored and never drawn.
    """
    scored = stored(weights(docs, gains(docs, target, buckets)).withColumn("score", F.col("weight") + gumbel(seed)), "scored")
    short = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked(scored.where(F.col("n_words") >= least_words), percent).unionByName(short)
