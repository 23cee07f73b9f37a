"""Toxicity by the nearest labelled examples.

Texts are unit TF-IDF vectors. Words and word beginnings (4 and 5 letters) that mark toxic examples have coordinates of
their own: LIFT times as frequent among them as among all, beyond chance (chi-squared with continuity correction of at
least CHI2), the FEATURES clearest. All other words share one coordinate, the length of their term weights times
BACKGROUND, so a marking word weighs less in a long text than in a short one and every text with a word has a vector.
All examples, clean ones too, form an inverted index whose postings are cut into blocks of BLOCK examples with the
largest weight of each; a text reads the blocks with the highest bounds, then all others that can still hold a nearer
example, so the NEAREST examples by cosine are exact. They vote, weighted by 1 / (NEAR + distance); votes become scores
by the monotone curve that fits the examples' own leave-one-out votes, and the voters are the evidence.

The model is fitted on a sample of labelled rows of a bound given by FIT_ROWS (about; drawn by doc_id), so the index is
bounded whatever the input; within it counts are complete, and every text is scored whole.

Defined cases: a text without any word (null and empty too) scores the share of toxic examples among those without
one; without examples, or an empty labels table, all score 0; of several labels of a document the highest counts; ties
among examples go to the smaller doc_id; repeated rows get equal scores; a very long text is read whole, its vector has
FEATURES + 1 coordinates at most; an empty documents table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, filtered_joins, held_out, stored, tidy

FIT_ROWS, FEATURES, CHI2, LIFT, LEAST_DF, NEAREST, BLOCK, FIRST, EVIDENCE = 20_000, 2_000, 24.0, 3.0, 4, 15, 64, 4, 5
#: Weight of the words outside the vocabulary, which share one coordinate; distance that counts as near.
BACKGROUND, NEAR = 0.5, 0.05
WORD = re.compile(r"[^\W\d_]+")


def word_counts(text: str | None) -> Counter:
    return Counter(WORD.findall((text or "").lower()))


def terms_of(word: str) -> list[str]:
    """The word and, marked by a star, its beginnings; these stand for themselves at full length too."""
    return [word, *(word[:k] + "*" for k in (4, 5) if len(word) >= k)]


def sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(doc_id, text, toxic) of about `rows` labelled documents at most, drawn by doc_id alone."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    known = stored(known, "labelled")
    n = known.count()
    draw = F.xxhash64(F.lit(11), "doc_id").bitwiseAND((1 << 40) - 1)
    known = known.where(draw < int(min(1.0, rows / max(n, 1)) * (1 << 40)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with filtered_joins(docs.sparkSession):
        return stored(texts.join(known.where("toxic >= 0"), "doc_id"), "examples")


def vocabulary(examples: DataFrame, features: int) -> tuple[dict[str, tuple[int, float]], int]:
    """term -> (place, idf), and the number of examples."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
                for t in {t for w in word_counts(text) for t in terms_of(w)}:
                    own = total.get(t)
                    if own is None:
                        own = total[t] = [0, 0]
                    own[toxic > 0] += 1
            if len(total) > 400_000:
                yield _term_rows(total)
                total = {}
        yield _term_rows(total)

    clean, toxic = (examples.where(f"{x} (toxic > 0)").count() for x in ("not", ""))
    n = clean + toxic
    if not clean or not toxic:
        return {}, n
    found = examples.select("text", "toxic").mapInArrow(tidy(count), "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    df = F.col("c") + F.col("t")
    expected = df * (toxic / n)
    off = F.greatest(F.lit(0.0), F.col("t") - expected - 0.5)
    chi2 = off * off * F.lit(float(n)) / (expected * (clean / n) * (F.lit(float(n)) - df) + 1e-9)
    marks = (df >= LEAST_DF) & (F.col("t") >= LIFT * expected)
    best = found.where(marks).select("term", df.alias("df"), chi2.alias("chi2")).where(F.col("chi2") >= CHI2).orderBy(F.desc("chi2"), "term").limit(features).collect()
    return {r["term"]: (i, math.log((1 + n) / (1 + r["df"])) + 1) for i, r in enumerate(best)}, n


def _term_rows(total: dict[str, list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v[0] for v in total.values()], pa.int64()), pa.array([v[1] for v in total.values()], pa.int64())], names=["term", "clean", "toxic"])


class Vectors:
    """Unit TF-IDF vectors as sorted tuples of (place, weight); the last place is that of all other words."""

    def __init__(self, terms: dict[str, tuple[int, float]]) -> None:
        self.terms, self.known = terms, {}

    def __call__(self, text: str | None) -> tuple[tuple[int, float], ...]:
        tf: dict[int, int] = {}
        idf: dict[int, float] = {}
        rest = 0.0
        for word, n in word_counts(text).items():
            own = self.known.get(word)
            if own is None:
                if len(self.known) > 500_000:
                    self.known.clear()
                own = self.known[word] = tuple(self.terms[t] for t in terms_of(word) if t in self.terms)
            if not own:
                rest += (1 + math.log(n)) ** 2
            for place, weight in own:
                tf[place] = tf.get(place, 0) + n
                idf[place] = weight
        v = {p: (1 + math.log(n)) * idf[p] for p, n in tf.items()}
        if rest:
            v[len(self.terms)] = BACKGROUND * math.sqrt(rest)
        norm = math.sqrt(sum(x * x for x in v.values()))
        return tuple(sorted((p, x / norm) for p, x in v.items()))


class BlockMaxIndex:
    """Exact nearest vectors by inner product. Examples are numbered so that ties go to the smaller doc_id."""

    def __init__(self, vectors: list[tuple], toxic: np.ndarray, doc_ids: np.ndarray) -> None:
        full = [i for i in range(len(vectors)) if vectors[i]]
        full.sort(key=lambda i: (max(vectors[i], key=lambda x: x[1])[0], doc_ids[i]))  # like with like in a block
        self.toxic, self.doc_ids = toxic[full], doc_ids[full]
        self.blocks = -(-len(full) // BLOCK)
        lists: dict[int, list] = {}
        for at, i in enumerate(full):
            for p, x in vectors[i]:
                lists.setdefault(p, []).append((at, x))
        self.postings, self.maxima = {}, {}
        for p, own in lists.items():
            at, x = np.array([a for a, _ in own]), np.array([w for _, w in own])
            block, starts = np.unique(at // BLOCK, return_index=True)
            self.maxima[p] = (block, np.maximum.reduceat(x, starts))
            self.postings[p] = (at, x, at // BLOCK)

    def read(self, vector: tuple, blocks: np.ndarray) -> np.ndarray:
        """Inner products with the examples of the blocks that a mask picks; 0 for all others."""
        sims = np.zeros(self.blocks * BLOCK)
        for p, x in vector:
            if p in self.postings:
                at, w, block = self.postings[p]
                own = blocks[block]
                sims[at[own]] += x * w[own]
        return sims

    def nearest(self, vector: tuple, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples (but `without`), the nearest first; only cosines above 0."""
        bounds = np.zeros(self.blocks)
        for p, x in vector:
            if p in self.maxima:
                block, most = self.maxima[p]
                bounds[block] += x * most
        blocks = np.zeros(self.blocks, bool)
        blocks[np.argsort(-bounds, kind="stable")[:FIRST]] = True
        sims = self.read(vector, blocks & (bounds > 0))
        if without >= 0:
            sims[without] = 0
        least = np.partition(sims, -k)[-k] if len(sims) >= k else 0.0
        more = ~blocks & (bounds > 0) & (bounds >= least - 1e-9)
        if more.any():
            sims += self.read(vector, more)
            if without >= 0:
                sims[without] = 0
            least = np.partition(sims, -k)[-k] if len(sims) >= k else 0.0
        places = np.flatnonzero((sims > 0) & (sims >= least - 1e-9))
        top = np.lexsort((self.doc_ids[places], -np.round(sims[places], 9)))[:k]
        return places[top], sims[places[top]]

    def vote(self, vector: tuple, k: int = NEAREST, without: int = -1) -> tuple[float, np.ndarray]:
        """Share of toxic among the nearest, near ones weighing more; the voters."""
        places, sims = self.nearest(vector, k, without)
        w = 1 / (NEAR + np.maximum(0, 1 - sims))
        return float((w * self.toxic[places]).sum() / w.sum()) if len(places) else 0.0, self.doc_ids[places]


def monotone(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of the non-decreasing curve nearest to the points."""
    by = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b in zip(x[by], y[by]):
        pools.append([b, 1, a, a])
        while len(pools) > 1 and (pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1] or pools[-2][3] == pools[-1][2]):
            s, n, _, hi = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, pools[-1][2], hi]
    return np.array([v for p in pools for v in (p[2], p[3])]), np.array([p[0] / p[1] for p in pools for _ in (0, 1)])


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, features: int = FEATURES) -> dict:
    """The model: vocabulary, index, curve, and the score of texts without any term. Its size is bounded by rows and features."""
    arrow_rows(docs.sparkSession, 1024)
    examples = sample(docs, labels, rows)
    terms, n = vocabulary(examples, features)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Vectors(terms)
        for batch in batches:
            found = [make(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["toxic"].cast(pa.int64()), pa.array([[p for p, _ in v] for v in found], pa.list_(pa.int32())), pa.array([[x for _, x in v] for v in found], pa.list_(pa.float64()))], names=["doc_id", "toxic", "places", "weights"])

    kept = examples.mapInArrow(tidy(vectors), "doc_id long, toxic long, places array<int>, weights array<double>").toArrow().sort_by("doc_id").to_pydict()
    own = [tuple(zip(p, w)) for p, w in zip(kept["places"], kept["weights"])]
    toxic, ids = (np.array(kept["toxic"], np.int64) > 0).astype(np.float64), np.array(kept["doc_id"], np.int64)
    bare = np.array([not v for v in own], bool)
    index = BlockMaxIndex(own, toxic, ids)
    place = {int(d): i for i, d in enumerate(index.doc_ids)}
    plain: dict[tuple, float] = {}  # texts of other words only are all alike: one vote tells all of them

    def left_out(v: tuple, d: int) -> float:
        if len(v) > 1:
            return index.vote(v, without=place[d])[0]
        if v not in plain:
            plain[v] = index.vote(v, without=place[d])[0]
        return plain[v]

    votes = np.array([left_out(v, int(d)) for v, d in zip(own, ids) if v])
    curve = monotone(votes, toxic[~bare]) if len(votes) else (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    return {"terms": terms, "index": index, "curve": curve, "bare": float(toxic[bare].sum() / max(1, bare.sum()))}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score, evidence (doc_ids of the nearest examples) of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        make, seen = Vectors(model["terms"]), {(): (model["bare"], [])}
        for batch in batches:
            out = []
            for text in batch["text"].to_pylist():
                v = make(text)
                if v not in seen:
                    if len(seen) > 50_000:
                        seen = {(): seen[()]}
                    vote, who = model["index"].vote(v)
                    seen[v] = (float(np.interp(vote, *model["curve"])), who[:EVIDENCE].tolist())
                out.append(seen[v])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([x[0] for x in out], pa.float64()), pa.array([x[1] for x in out], pa.list_(pa.int64()))], names=["doc_id", "score", "evidence"])

    arrow_rows(docs.sparkSession, 1024)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(rate), "doc_id long, score double, evidence array<long>")


def op7(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rated = score(docs, fit(docs, labels))
    return rated.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), "evidence")
