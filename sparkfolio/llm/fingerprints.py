"""Document fingerprints by consistent weighted sampling.

A document's weighted terms are its words (white-space runs part them; A-Z count as a-z), each weighing its
occurrences times its length in characters. For each of SAMPLES samples a term draws r, c ~ Gamma(2, 1) and
b ~ U(0, 1) from its own hash; with t = floor(ln w / r + b) and ln a = ln c - r (t - b) - r, the sample is the (term, t) of
the least ln a. Two documents agree in a sample with the probability of their generalised Jaccard similarity
sum(min) / sum(max), so the share of equal samples estimates how much of their text is common.
A fingerprint is 4 hex digits a sample. A document without words has the fingerprint of no terms, all zeros, which
is like that of any other document without words and of none with words.

edited() sends each text over the network once: documents go to ranges of doc_id whose bounds are sampled, and
each range's first document is sent to the range before it too, as the successor of its last.

Defined cases: null text is empty; ties of doc_id are ordered by text; null doc_ids come first; a single document is
its own successor; repeated rows and equal texts have equal fingerprints, each row one of its own; texts are processed whole, a batch being split where it exceeds BATCH_WORDS words; other columns
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, tidy

SAMPLES, BATCH_WORDS, BLOCK = 64, 60_000, 4096


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _unit(h: np.ndarray, shift: int, bits: int) -> np.ndarray:
    """Uniform in (0, 1) from some bits of h."""
    part = ((h >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.float32)
    return (part + np.float32(0.5)) * np.float32(1 / (1 << bits))


def draws(terms: np.ndarray, weights: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray]:
    """For each (term, weight) and sample: ln a and t."""
    loga, level = np.empty((len(terms), samples), np.float32), np.empty((len(terms), samples), np.float32)
    logw = np.log(weights.astype(np.float32))[:, None]
    seeds = _seeds(samples)
    for i in range(0, len(terms), BLOCK):
        h = _mix(terms[i : i + BLOCK, None] ^ seeds)
        r = -np.log(_unit(h, 0, 23) * _unit(h, 23, 23))
        b = _unit(h, 46, 18)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        t = np.floor(logw[i : i + BLOCK] / r + b)
        level[i : i + BLOCK] = t
        t -= b
        t += 1
        t *= r
        c = np.log(_unit(h, 0, 23) * _unit(h, 23, 23))
        np.log(np.negative(c, out=c), out=c)
        np.subtract(c, t, out=loga[i : i + BLOCK])
    return loga, level


def _seeds(samples: int) -> np.ndarray:
    return _mix(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _codes(terms: np.ndarray, level: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """16 bits, never all zero, that stand for (term, t)."""
    h = _mix(terms ^ seeds ^ (level.astype(np.int64) + 1).view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return (h >> np.uint64(48)).astype(np.uint16) | np.uint16(1)


class TermHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _terms(text: str, known: TermHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and weights of the distinct words."""
    words = Counter(text.encode("utf-8", "surrogatepass").lower().split())
    n = len(words)
    weights = np.fromiter(words.values(), np.uint64, n) * np.fromiter(map(len, words), np.uint64, n)
    return np.fromiter(map(known.__getitem__, words), np.uint64, n), weights


def fingerprints(texts: list[str], samples: int = SAMPLES) -> np.ndarray:
    """A row of samples (uint16) for each text; equal texts have equal rows, wherever they stand."""
    out = np.zeros((len(texts), samples), np.uint16)
    known = TermHashes()
    seeds, begin = _seeds(samples), 0
    while begin < len(texts):
        lists, n, end = [], 0, begin
        while end < len(texts) and (end == begin or n < BATCH_WORDS):
            lists.append(_terms(texts[end], known))
            n += len(lists[-1][0])
            end += 1
        terms, weights = (np.concatenate(x) for x in zip(*lists))
        pairs, inverse = np.unique(terms ^ _mix(weights), return_inverse=True)
        first = np.zeros(len(pairs), np.int64)
        first[inverse] = np.arange(len(inverse))
        loga, level = draws(terms[first], weights[first], samples)
        at, column = 0, np.arange(samples)
        for d, (own, _) in enumerate(lists, begin):
            if len(own):
                rows = inverse[at : at + len(own)]
                mine = loga[rows]
                best = mine.argmin(0)
                won = rows[best]
                out[d] = _codes(terms[first[won]], level[won, column], seeds)
                tied = (mine == mine[best, column]).sum(0) > 1
                for k in np.flatnonzero(tied):  # the order of a document's terms must not matter: the least code wins
                    same = rows[mine[:, k] == mine[best[k], k]]
                    out[d, k] = _codes(terms[first[same]], level[same, k], seeds[k]).min()
                at += len(own)
        begin = end
    return out


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    return float((x == y).mean())


def with_fingerprints(docs: DataFrame, samples: int = SAMPLES, name: str = "fingerprint") -> DataFrame:
    """docs with a fingerprint column: the operator itself, one narrow stage."""
    schema = docs.select("*", F.lit("").alias(name)).schema

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = fingerprints([t or "" for t in batch["text"].to_pylist()], samples)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.astype(">u2").tobytes().hex() for r in rows], pa.string())], names=[f.name for f in schema])

    arrow_rows(docs.sparkSession)
    return docs.mapInArrow(tidy(sign), schema)


def ranges(docs: DataFrame, parts: int) -> tuple[list[int], list[int]]:
    """Bounds that part doc_id into about `parts` ranges, and for each range with rows, in order, its number."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    bounds = sorted({int(x) for x in ids.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts)}) if parts > 1 else []
    got = ids.select(_range(bounds).alias("part")).distinct().collect()
    return bounds, sorted(r["part"] for r in got)


def _range(bounds: list[int]):
    """How many of the sorted bounds are at most doc_id; 0 for null."""
    if not bounds:
        return F.lit(0)
    place = F.array_position(F.array(*map(F.lit, bounds)), F.col("doc_id"))  # unused where doc_id is no bound
    below = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("doc_id")))
    return F.coalesce(F.when(place > 0, place.cast("int")).otherwise(below), F.lit(0))


def compared(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """op1's columns for every document: its fingerprint, that of its edited text, and how like they and the next document's are."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = min(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), 4000)
    bounds, full = ranges(docs, parts)
    if not full:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    before = {part: full[i - 1] for i, part in enumerate(full)}  # the first range's head goes round to the last
    part = docs.withColumn("part", _range(bounds))
    heads = part.groupBy("part").agg(F.min(F.struct("doc_id", F.xxhash64("text").alias("h"))).alias("head"))
    # A head is the first of its range by (doc_id, text): one row a range, as many rows as ranges, at most 4000.
    heads = {r["part"]: r["head"] for r in heads.collect()}
    first_ids = F.create_map(*[F.lit(x) for p, h in heads.items() for x in (p, h["doc_id"])])
    is_head = F.col("doc_id").eqNullSafe(F.element_at(first_ids, F.col("part")))
    back = F.element_at(F.create_map(*[F.lit(x) for p, q in before.items() for x in (p, q)]), F.col("part"))
    own = F.struct(F.col("part").alias("to"), F.lit(False).alias("guest"))
    guest = F.struct(back.alias("to"), F.lit(True).alias("guest"))
    sent = part.withColumn("sent", F.explode(F.when(is_head, F.array(own, guest)).otherwise(F.array(own)))).select("doc_id", "text", "sent.to", "sent.guest")
    sent = sent.repartition(parts, "to").sortWithinPartitions("to", "guest", "doc_id", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            rows = list(zip(*(batch[c].to_pylist() for c in ("to", "guest", "doc_id", "text"))))
            rows = ([last] if last else []) + rows
            # A range's rows, then its guests: the first guest is the successor of the range's last row.
            pairs = [(x, y) for x, y in zip(rows, rows[1:]) if not x[1] and x[0] == y[0]]
            last = rows[-1] if rows else None
            edited, halves = [], []
            for x, y in pairs:
                half = len(x[3]) // 2
                halves.append(half)
                edited.append(x[3][: len(x[3]) - half] + y[3][:half])
            signed = fingerprints([p[0][3] for p in pairs] + edited + [p[1][3] for p in pairs[-1:]], samples)
            n = len(pairs)
            following = [i + 1 if i + 1 < n and pairs[i][1] is pairs[i + 1][0] else None for i in range(n)]
            missing = [i for i in range(n - 1) if following[i] is None]
            extra = fingerprints([pairs[i][1][3] for i in missing], samples)
            other = {i: extra[k] for k, i in enumerate(missing)}
            out = []
            for i, (x, _) in enumerate(pairs):
                after = signed[following[i]] if following[i] is not None else other[i] if i in other else signed[2 * n]
                out.append((x[2], len(x[3]), hashlib.sha256(edited[i].encode("utf-8", "surrogatepass")).hexdigest(), _hex(signed[i]), _hex(signed[n + i]), likeness(signed[i], signed[n + i]), likeness(signed[i], after)))
            columns = list(zip(*out)) if out else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    arrow_rows(spark)
    return sent.mapInArrow(tidy(compare), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _hex(row: np.ndarray) -> str:
    return row.astype(">u2").tobytes().hex()
