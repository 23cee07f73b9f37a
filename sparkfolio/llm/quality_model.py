"""Quality by an interpolated modified Kneser-Ney model over characters.

The model is trained on trusted text. Each task counts its own distinct ORDER-grams before they are shuffled; from
their totals follow, by joins sharded on the grams, the continuation counts, the discounts and the interpolated
probabilities of every order, and the log probability of each gram that occurs in any text. These travel to the
scoring tasks in shards of at most SHARD_ROWS grams (24 MB), as many as it takes; a document's log likelihood is the
sum over shards. Its perplexity per character is judged by quantiles of the trusted documents' of its language: text
that is odd is above the upper one, text that repeats itself below the lower one.

Texts begin with ORDER - 1 pads; each white-space run counts as one space.

Defined cases: null and empty texts have no perplexity (null) and are not kept; a null language is "und"; a language
without trusted documents takes the quantiles of all; without trusted text nothing is judged and all with text are
kept; of several labels of a document the worst counts; rows that repeat a doc_id are scored once each; very
long texts are counted and scored whole, one batch of distinct grams at a time; extra columns
are not read; an empty table gives an empty result. docs must give the same rows when read again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, filtered_joins, held_out, stored, tidy

ORDER, SHARD_ROWS, PAD = 4, 2_000_000, "\x02"
LOWER, UPPER = 0.005, 0.995
RUN = re.compile(r"[\x20\x09-\x0D]+")


def _grams(texts: list[str | None], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct grams (rows of code points) of the texts, for each place the gram that ends there, and the texts' lengths."""
    texts = [RUN.sub(" ", t) if t else "" for t in texts]
    pad = PAD * (order - 1)
    codes = np.frombuffer((pad + pad.join([*texts, ""])).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t) for t in texts], np.int64)
    present = np.flatnonzero(np.bincount(codes)) if len(codes) else np.zeros(0, np.int64)
    small = np.searchsorted(present, np.arange(present[-1] + 1 if len(present) else 1))[codes].astype(np.int64)
    n = len(small) - order + 1
    if n <= 0 or not lengths.sum():
        return np.zeros((0, order), np.uint32), np.zeros(0, np.int64), lengths
    starts = np.cumsum(lengths + order - 1) - lengths - (order - 1)
    at = np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
    key = small[:n]
    for j in range(1, order):
        if int(key.max()) * len(present) >= 1 << 61:
            key = pd.factorize(key)[0]
        key = key * len(present) + small[j : n + j]
    of, kinds = pd.factorize(key[at])
    first = np.zeros(len(kinds), np.int64)
    first[of[::-1]] = at[::-1]
    return codes[first[:, None] + np.arange(order)], of, lengths


def _strings(grams: np.ndarray, order: int) -> list[str]:
    text = np.ascontiguousarray(grams).tobytes().decode("utf-32-le", "surrogatepass")
    return [text[i : i + order] for i in range(0, len(text), order)]


def _hashes(grams: np.ndarray) -> np.ndarray:
    h = np.zeros(len(grams), np.uint64)
    for c in grams.T:
        h = (h + c) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def counted(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(g, c): the grams of all texts and how often each occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}
        for batch in batches:
            grams, of, _ = _grams(batch["text"].to_pylist(), order)
            for g, n in zip(_strings(grams, order), np.bincount(of, minlength=len(grams)).tolist()):
                total[g] = total.get(g, 0) + n
            if len(total) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["g", "c"])
                total = {}
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["g", "c"])

    return docs.select("text").mapInArrow(tidy(count), "g string, c long").groupBy("g").agg(F.sum("c").alias("c"))


def discounts(row) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of grams seen once, twice, three and four times; 0.5 where there are too few."""
    n1, n2, n3, n4 = (row[f"n{i}"] or 0 for i in range(1, 5))
    if not (n1 and n2 and n3):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    clip = lambda d, most: min(max(d, 0.05), most)
    return clip(1 - 2 * y * n2 / n1, 0.95), clip(2 - 3 * y * n3 / n2, 1.95), clip(3 - 4 * y * n4 / n3, 2.95)


def kneser_ney(grams: DataFrame, asked: DataFrame, order: int = ORDER) -> DataFrame:
    """(g, logp) for every gram of asked (g), under the model that the counts grams (g, c) make."""
    tables = {order: stored(grams, f"grams-{order}")}
    for k in range(order - 1, 0, -1):
        tables[k] = stored(tables[k + 1].groupBy(F.substring("g", 2, k).alias("g")).agg(F.count(F.lit(1)).alias("c")), f"grams-{k}")
    wanted = {order: stored(asked.select("g").distinct(), f"asked-{order}")}
    for k in range(order - 1, 0, -1):
        wanted[k] = stored(wanted[k + 1].select(F.substring("g", 2, k).alias("g")).distinct(), f"asked-{k}")
    letters = wanted[1].count() + 1
    seen = asked_p = None
    for k in range(1, order + 1):
        own = tables[k]
        d = discounts(own.agg(*[F.sum(F.when(F.col("c") == i, 1).otherwise(0)).alias(f"n{i}") for i in range(1, 5)]).head())
        off = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        context = F.substring("g", 1, k - 1).alias("h") if k > 1 else F.lit("").alias("h")
        own = own.select("g", "c", context, (F.substring("g", 2, k - 1) if k > 1 else F.lit("")).alias("s"), off.alias("off"))
        per = stored(own.groupBy("h").agg(F.sum("c").alias("total"), (F.sum("off") / F.sum("c")).alias("gamma")), f"contexts-{k}")
        joined = own.join(per, "h")
        want = wanted[k].select("g", context, (F.substring("g", 2, k - 1) if k > 1 else F.lit("")).alias("s"))
        if k == 1:
            joined, want = joined.withColumn("below", F.lit(1.0 / letters)), want.withColumn("below", F.lit(1.0 / letters))
        else:
            joined, want = (x.join(y.select(F.col("g").alias("s"), F.col("p").alias("below")), "s", "left") for x, y in ((joined, seen), (want, asked_p)))
        seen = stored(joined.select("g", ((F.col("c") - F.col("off")) / F.col("total") + F.col("gamma") * F.col("below")).alias("p")), f"seen-{k}")
        want = want.join(seen, "g", "left").join(per.select("h", "gamma"), "h", "left")
        asked_p = stored(want.select("g", F.coalesce("p", F.coalesce("gamma", F.lit(1.0)) * F.col("below")).alias("p")), f"probabilities-{k}")
    return asked_p.select("g", F.ln("p").alias("logp"))


def _scored(docs: DataFrame, shard: tuple[np.ndarray, np.ndarray], order: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(shard)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, logs = shared.value
        for batch in batches:
            grams, of, lengths = _grams(batch["text"].to_pylist(), order)
            h = _hashes(grams)
            at = np.minimum(np.searchsorted(hashes, h), max(0, len(hashes) - 1))
            value = np.where(hashes[at] == h, logs[at], 0.0) if len(hashes) else np.zeros(len(h))
            sums = np.concatenate([[0.0], np.cumsum(value[of])])
            ends = np.cumsum(lengths)
            yield pa.RecordBatch.from_arrays([batch["row_at"], batch["doc_id"], batch["lang"], pa.array(lengths), pa.array(sums[ends] - sums[ends - lengths])], names=["row_at", "doc_id", "lang", "chars", "logp"])

    return docs.mapInArrow(tidy(score), "row_at long, doc_id long, lang string, chars long, logp double")


def perplexities(docs: DataFrame, trusted: DataFrame, order: int = ORDER, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """row_at, doc_id, lang, chars, perplexity of every row of docs, under a model of the texts of trusted (text)."""
    arrow_rows(docs.sparkSession, 1024)
    rows = docs.select(F.monotonically_increasing_id().alias("row_at"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    with filtered_joins(docs.sparkSession):
        counts = stored(counted(trusted, order), "counts")
    if counts.isEmpty():
        return rows.select("row_at", "doc_id", "lang", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"), F.lit(None).cast("double").alias("perplexity"))
    table = stored(kneser_ney(counts, counted(rows, order), order), "logp")
    shards = max(1, -(-table.count() // shard_rows))
    passes = []
    for k in range(shards):
        # One shard at a time on the driver: about shard_rows rows, whatever the size of the table.
        part = table.where(F.pmod(F.xxhash64("g"), F.lit(shards)) == k).toArrow()
        grams = np.frombuffer("".join(part["g"].to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, order)
        h, logs = _hashes(grams), part["logp"].to_numpy()
        by = np.argsort(h)
        passes.append(_scored(rows, (h[by], logs[by].astype(np.float32)), order))
    found = passes[0]
    for more in passes[1:]:
        found = found.unionByName(more)
    if shards > 1:
        found = found.groupBy("row_at", "doc_id", "lang", "chars").agg(F.sum("logp").alias("logp"))
    return found.select("row_at", "doc_id", "lang", "chars", F.when(F.col("chars") > 0, F.exp(-F.col("logp") / F.col("chars"))).alias("perplexity"))


def judged(docs: DataFrame, labels: DataFrame, lower: float = LOWER, upper: float = UPPER, order: int = ORDER, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, lang, chars, perplexity, least, most, kept. Trusted are documents with quality 1 that are not held out.

    Every other of them, by crc32 of doc_id, trains the model; the rest show it text it has not seen. Text is kept
    within the quantiles of either half, so that neither known nor new text of their kind is turned away.
    """
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where((F.col("quality") == 1) & ~held_out())
    good = stored(good.select("doc_id", "quality", half.alias("half")), "trusted")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(good.where("quality = 1 and half = 0"), "doc_id", "left_semi")
    scored = stored(perplexities(docs, texts, order, shard_rows), "perplexities")
    ref = scored.where("perplexity is not null").join(good, "doc_id")
    cut = lambda q: F.percentile_approx("perplexity", q, 10000)
    bounds = lambda keys: ref.groupBy(*keys, "half").agg(cut(lower).alias("a"), cut(upper).alias("b")).groupBy(*keys).agg(F.min("a").alias("least"), F.max("b").alias("most"))
    every = bounds([]).head()
    out = scored.join(stored(bounds(["lang"]), "cuts"), "lang", "left")
    out = out.withColumns({k: F.coalesce(k, F.lit(every[k] if every else None).cast("double")) for k in ("least", "most")})
    inside = F.when(F.col("chars") == 0, False).otherwise(F.coalesce(F.col("perplexity").between(F.col("least"), F.col("most")), F.lit(True)))
    return out.select("doc_id", "lang", "chars", "perplexity", "least", "most", inside.alias("kept"))
