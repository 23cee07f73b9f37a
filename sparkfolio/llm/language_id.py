"""Language identification: script ranges narrow the candidates, Viterbi labels spans.

A word is a run of letters. Its script (fixed ranges below) admits the languages that were seen in that script;
each of them scores the word by the log likelihood of its letter trigrams, word edges included. Viterbi over a
text's words, with a penalty for each switch of language, labels spans; the language with the most letters is the
text's. The model is a table of BUCKETS hashed trigrams for each of at most MAX_LANGS languages (the most
frequent; ties by name), so what is broadcast is at most 4 * BUCKETS * MAX_LANGS = 17 MB whatever the input.
Counts cover every training row.

Defined cases: null, empty and letterless texts are `und` with score 0; so is every text if nothing was learned.
Rows are independent, so repeats get equal results. Very long texts are processed whole, one at a time.
An empty table gives an empty result; other columns are carried on, result columns take a prefix no column has.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, held_out, tidy

BUCKETS, MAX_LANGS, PENALTY, BATCH_CHARS = 1 << 16, 64, 12.0, 1_000_000
#: Unicode block ranges by script; letters elsewhere count as script 0.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x3134F)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7A3)],
}
#: A language may be meant by a script that holds at least this share of the letters it was learned from.
SCRIPT_SHARE = 0.001


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: its lower-case form if it is a letter, else 0; its script."""
    lower = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            small = c.lower()
            lower[i] = ord(small) if len(small) == 1 else i
    script = np.zeros(0x110000, np.uint8)
    for k, ranges in enumerate(SCRIPTS.values(), 1):
        for a, b in ranges:
            script[a : b + 1] = k
    return lower, script


def _features(texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: where each begins, the places of letters, each one's bucket, which letters begin words, the words' scripts."""
    lower, script = _tables()
    codes = np.frombuffer("\n".join([*(t or "" for t in texts), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = np.cumsum([0, *(len(t or "") + 1 for t in texts)])
    c = np.zeros(len(codes) + 2, np.uint32)
    c[1:-1] = lower[codes]
    at = np.flatnonzero(c[1:-1])
    left, mid, right = c[at], c[at + 1], c[at + 2]
    h = left * np.uint32(0x9E3779B1) + mid * np.uint32(0x85EBCA77) + right * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return begins, at, (h >> np.uint32(16)) & np.uint32(BUCKETS - 1), np.flatnonzero(left == 0), script[codes[at[left == 0]]]


def _parts(texts: list[str | None]) -> Iterator[slice]:
    """Runs of texts of BATCH_CHARS characters, or one longer text."""
    begin, n = 0, 0
    for i, t in enumerate(texts):
        if i > begin and n + len(t or "") > BATCH_CHARS:
            yield slice(begin, i)
            begin, n = i, 0
        n += len(t or "")
    if texts:
        yield slice(begin, len(texts))


def train(docs: DataFrame) -> dict:
    """Trigram and script counts of every row of docs (text, lang) with a lang, as a table of log likelihoods."""
    docs = docs.where("lang is not null").select("text", "lang")
    counts = docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS).collect()
    langs = sorted(r["lang"] for r in counts)
    width = BUCKETS + len(SCRIPTS) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, total = {x: i for i, x in enumerate(langs)}, np.zeros((len(langs), width), np.int64)
        for batch in batches:
            texts, of = batch["text"].to_pylist(), np.array([place.get(x, -1) for x in batch["lang"].to_pylist()])
            for k in range(len(langs)):
                own = [t for t, x in zip(texts, of) if x == k]
                for part in _parts(own):
                    _, at, h, starts, scripts = _features(own[part])
                    total[k, :BUCKETS] += np.bincount(h, minlength=BUCKETS)
                    total[k, BUCKETS:] += np.bincount(scripts, np.diff([*starts, len(at)]) if len(starts) else None, minlength=len(SCRIPTS) + 1).astype(np.int64)
        k, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(b, pa.int32()), pa.array(total[k, b])], names=["k", "b", "n"])

    arrow_rows(docs.sparkSession, 2048)
    found = docs.where(F.col("lang").isin(langs)).mapInArrow(tidy(count), "k int, b int, n long").groupBy("k", "b").agg(F.sum("n").alias("n")).toArrow() if langs else None
    total = np.zeros((len(langs), width))
    if found is not None:
        total[found["k"].to_numpy(), found["b"].to_numpy()] = found["n"].to_numpy()
    tri, scripts = total[:, :BUCKETS], total[:, BUCKETS:]
    logp = np.log((tri + 0.2) / (tri.sum(1, keepdims=True) + 0.2 * BUCKETS)).astype(np.float32) if langs else tri
    return {"langs": langs, "logp": logp, "allowed": scripts >= np.maximum(1, SCRIPT_SHARE * scripts.sum(1, keepdims=True))}


def _viterbi(score: np.ndarray, first: np.ndarray, n: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word. Texts advance together, the longest first, so that a step is one array operation."""
    order = np.argsort(-n, kind="stable")
    first, n, out = first[order], n[order], np.zeros(len(score), np.int64)
    steps = int(n[0]) if len(n) else 0
    active = len(n) - np.searchsorted(n[::-1], np.arange(1, steps + 1))
    come_from = np.zeros(score.shape, np.int8)
    own = np.arange(score.shape[1], dtype=np.int8)
    v = score[first[: active[0]]] if steps else None
    ends = []
    for t in range(1, steps):
        b = active[t]
        if b < len(v):
            ends.append(v[b:])
            v = v[:b]
        best = v.argmax(1)
        switch = v[np.arange(b), best][:, None] - penalty
        at = first[:b] + t
        come_from[at] = np.where(v >= switch, own, best[:, None])
        v = np.maximum(v, switch) + score[at]
    if steps:
        last = np.concatenate([v, *ends[::-1]]).argmax(1)
        out[first[: active[0]] + n[: active[0]] - 1] = last
        for t in range(steps - 1, 0, -1):
            at = first[: active[t]] + t
            out[at - 1] = come_from[at, out[at]]
    return out


def _label(texts: list[str | None], model: dict, penalty: float) -> list[tuple[str, float, list[dict]]]:
    langs, logp, allowed = model["langs"], model["logp"], model["allowed"]
    begins, at, h, starts, scripts = _features(texts)
    if not langs or not len(starts):
        return [("und", 0.0, [])] * len(texts)
    score = np.stack([np.add.reduceat(row[h], starts, dtype=np.float32) for row in logp], 1)
    open_ = allowed.T[scripts]
    none = ~open_.any(1)
    score[none] = 0  # a script no language was learned in tells nothing
    score[~open_ & ~none[:, None]] -= 1e4
    word_at, letters = at[starts], np.diff([*starts, len(at)])
    word_end = at[np.append(starts[1:], len(at)) - 1] + 1
    first = np.searchsorted(word_at, begins)
    path = _viterbi(score, first[:-1], np.diff(first), penalty)
    out = []
    for d, (a, b) in enumerate(zip(first[:-1], first[1:])):
        if a == b:
            out.append(("und", 0.0, []))
            continue
        per = np.bincount(path[a:b], letters[a:b], len(langs))
        k = int(per.argmax())
        cuts = [0, *(np.flatnonzero(np.diff(path[a:b])) + 1), b - a]
        spans = [{"begin": int(word_at[a + x] - begins[d]), "end": int(word_end[a + y - 1] - begins[d]), "lang": langs[path[a + x]]} for x, y in zip(cuts, cuts[1:])]
        out.append((langs[k], float(per[k] / per.sum()), spans))
    return out


def identify(docs: DataFrame, model: dict, penalty: float = PENALTY, prefix: str = "") -> DataFrame:
    """docs with `lang_pred`, `lang_score` and `lang_spans` (begin, end in code points; lang), their names after `prefix`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select("*", F.lit("").alias(prefix + "lang_pred"), F.lit(0.0).alias(prefix + "lang_score"), F.lit(None).cast("array<struct<begin:int,end:int,lang:string>>").alias(prefix + "lang_spans")).schema
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            said = [x for part in _parts(texts) for x in _label(texts[part], shared.value, penalty)]
            more = [pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64()), pa.array([x[2] for x in said], kind)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[f.name for f in schema])

    arrow_rows(docs.sparkSession, 2048)
    return docs.mapInArrow(tidy(label), schema)


def op9(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text", "lang")
    model = train(docs.where(~held_out()))
    found = identify(docs.select("doc_id", "text"), model).drop("text")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.size("lang_spans").cast("long").alias("n_spans"))
