"""Jaccard join over word shingles with adaptive multi-match prefixes.

Every text becomes its set of word shingles; equal sets form a class, of which one set goes on. Shingles have one
global order, rare ones first. If J(x, y) >= t, the first |x| - ceil(t|x|) + l shingles of x and those of y share at
least l, for any l. A class picks its own l: a longer prefix means more postings to read but more shared shingles to
ask for, so fewer pairs to verify; the estimated cost of both decides. A pair asks for the smaller l of the two, and
counts what both prefixes share at that level. What is left is verified on the whole sets.

Large groups of near copies are not expanded into pairs: before the join, star rounds verify each member of a
bucket against a few centres, drawn anew each time, and merge what links; the join then only meets pairs of different
components. Each such pair still is verified if its prefixes ask for it, so no link between components is lost. Links within
a component are counted at last: all its pairs are compared, whole blocks of its sets with one another.

The order puts first the shingles of rare words, last those that are frequent themselves. Words and shingles are counted
over all texts; of words those go by their counts that are frequent in some batch of ARROW_ROWS texts (at least FREQUENT
times), of shingles those that a task has met AGAIN times (counters of a fixed size, halved as they fill up), the HEAVY most
frequent of each kind. Any order is right; this one keeps phrases of common words and common
passages out of prefixes, and what is broadcast is at most 32 * HEAVY bytes.

Defined cases: null, empty and white-space texts have no shingles and no links; a text of fewer words than a shingle
is one shingle; equal texts link; a null doc_id takes part and gets the smallest id of its component, null if there is
none; columns besides doc_id and text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, dropped, filtered_joins, stored, swept, tidy
from .components import components

ARROW_ROWS, FREQUENT, HEAVY, MOST_MATCHES, NO_ID = 2048, 8, 1 << 16, 8, (1 << 63) - 1
#: Counters of shingles, a byte each, that a task has while it looks for frequent ones, and from which count on one is.
SLOTS, AGAIN = 1 << 24, 4
#: What decides costs and not links: star rounds after the first, classes of a bucket from which on they look at it, centres
#: of each, pairs tested for a link beyond which they end, shingles that the join looks back.
ROUNDS, WIDE, CENTRES, LEAST_YIELD, BEFORE = 6, 16, 4, 20, 32
BITS = [f"bits{i}" for i in range(4)]
#: A block of a component's sets: sets and shingles that it has on average at most; shingles compared at a time.
BLOCK_SETS, BLOCK_SHINGLES, COLUMNS = 1024, 1 << 20, 4096


class WordHashes(dict):
    """Hashes of words, in 56 bits, and in the lowest 8 how common each is; the words of the last texts are remembered."""

    def __init__(self, common: dict[int, int] | None = None) -> None:
        self.common = common or {}

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 250_000:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word) & ~255
        h |= self.common.get(h, 0)
        if len(word) <= 64:
            self[word] = h
        return h


def word_hashes(text: str | None, known: WordHashes) -> np.ndarray:
    """A-Z count as a-z; white space parts words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingled(words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the distinct k-word shingles, and how common their words are; fewer words than k are one shingle."""
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    common, words = words & np.uint64(255), words & ~np.uint64(255)
    n = min(k, len(words))
    h, c = np.full(len(words) - n + 1, n, np.uint64), np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[j : len(words) - n + 1 + j]
        c += common[j : len(words) - n + 1 + j]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h, first = np.unique(h, return_index=True)
    return h, c[first]


def shingles(text: str | None, k: int, known: WordHashes) -> np.ndarray:
    return shingled(word_hashes(text, known), k)[0]


def _least_overlap(n: int, num: int, den: int) -> int:
    return -(-num * n // den)


def bitmap(items: np.ndarray) -> tuple[int, ...]:
    """256 parity bits: two sets differ in at least as many items as their bitmaps do in bits."""
    odd = np.bincount((items & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return tuple(np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).tolist())


def frequent(docs: DataFrame, k: int) -> tuple[np.ndarray, dict[int, int]]:
    """Hashes of frequent shingles, the most frequent last; and of frequent words how common they are, from 1 to 255."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, met, held = WordHashes(), np.zeros(SLOTS, np.uint8), 0
        for batch in batches:
            words = [word_hashes(t, known) for t in batch["text"].to_pylist()]
            for kind, each in ((0, [shingled(w, k)[0] for w in words]), (1, words)):
                counts = pa.array(np.concatenate(each) if each else np.zeros(0, np.uint64)).value_counts()
                kinds, n = counts.field("values").to_numpy(zero_copy_only=False), counts.field("counts").to_numpy(zero_copy_only=False)
                often = n >= FREQUENT
                if kind == 0:  # what the task has met before counts, too
                    slots = kinds & np.uint64(SLOTS - 1)
                    so_far = met[slots] + n
                    met[slots], held, often = np.minimum(so_far, 255), held + len(kinds), so_far >= AGAIN
                    if held > SLOTS // 4:
                        met >>= 1
                        held //= 2
                yield pa.RecordBatch.from_arrays([pa.array(np.full(often.sum(), kind), pa.int32()), pa.array(kinds[often].view(np.int64)), pa.array(n[often])], names=["kind", "token", "n"])

    found = stored(docs.select("text").mapInArrow(tidy(count), "kind int, token long, n long").groupBy("kind", "token").agg(F.sum("n").alias("n")), "frequent")
    top = [found.where(f"kind = {kind}").orderBy(F.desc("n"), "token").limit(HEAVY).toArrow() for kind in (0, 1)]
    token = [t["token"].to_numpy().view(np.uint64) for t in top]
    common = np.minimum(255, 1 + 4 * np.log2(np.maximum(1, top[1]["n"].to_numpy()))).astype(int)
    return token[0][::-1].copy(), dict(zip(token[1].tolist(), common.tolist()))


def signatures(docs: DataFrame, heavy: np.ndarray, common: dict[int, int], k: int, num: int, den: int, most: int) -> DataFrame:
    """doc_id, said (hash of the text), n_shingles, sig (of the whole set), prefix: the first shingles in the global order; bits: bitmap()."""
    order = np.argsort(heavy, kind="stable")
    shared = docs.sparkSession.sparkContext.broadcast((heavy[order], order.astype(np.int64), common))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ranks, common = shared.value
        known = WordHashes(common)
        for batch in batches:
            sizes, sigs, prefixes, bits = [], [], [], []
            for text in batch["text"].to_pylist():
                s, c = shingled(word_hashes(text, known), k)
                sizes.append(len(s))
                sigs.append(xxhash.xxh3_128_digest(s.tobytes()))
                bits.append(bitmap(s))
                if len(s):
                    rank = np.full(len(s), -1, np.int64)
                    if len(hashes):
                        at = np.minimum(np.searchsorted(hashes, s), len(hashes) - 1)
                        rank = np.where(hashes[at] == s, ranks[at], -1)
                    s = s[np.lexsort((s, c, rank))]
                prefixes.append(s[: len(s) - _least_overlap(len(s), num, den) + most].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["said"], pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))], names=["doc_id", "said", "n_shingles", "sig", "prefix", "bits"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("said"), "text").mapInArrow(tidy(sign), "doc_id long, said long, n_shingles long, sig binary, prefix array<long>, bits array<long>")


def whole_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(cid, items): the whole set of each class of wanted (cid, first_id, said, sig), from one of its texts."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            rows = []
            for text, cid, sig in zip(*(batch[c].to_pylist() for c in ("text", "cid", "sig"))):
                s = shingles(text, k, known).tobytes()
                if xxhash.xxh3_128_digest(s) == sig:
                    rows.append((cid, s))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["cid", "items"])

    key = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(NO_ID)).alias("key")
    # By id and text, so that rows without an id, or with one id, do not all meet.
    hit = docs.select(key("doc_id"), F.xxhash64("text").alias("said"), "text").join(wanted.where("n > 0").select(key("first_id"), "said", "cid", "sig"), ["key", "said"])
    return hit.select("text", "cid", "sig").mapInArrow(tidy(fill), "cid long, items binary")


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) with den * |intersection| >= num * |union|."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"], batch["y"]):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(den * shared >= num * (len(x) + len(y) - shared))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["a"].filter(mask), batch["b"].filter(mask)], names=["a", "b"])

    # Of the sets only those travel that a pair names; where pairs are small, they go to the sets.
    rows = pairs.join(sets.select(F.col("cid").alias("b"), F.col("items").alias("y")), "b")
    named = pairs.select("a").distinct().join(sets.select(F.col("cid").alias("a"), F.col("items").alias("x")), "a")
    rows = rows.join(named, "a")
    return rows.select("a", "b", "x", "y").mapInArrow(tidy(test), "a long, b long")


def shared_counts(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """How many items each of xs has in common with each of ys; a set has an item once."""
    items = np.concatenate([*xs, *ys])
    rows = np.repeat(np.arange(len(xs) + len(ys)), [len(s) for s in (*xs, *ys)])
    order = np.argsort(items, kind="stable")
    items, rows = items[order], rows[order]
    first = np.concatenate([[True], items[1:] != items[:-1]])
    several = ~(first & np.concatenate([first[1:], [True]]))
    rows, ids = rows[several], np.cumsum(first[several]) - 1
    out = np.zeros((len(xs), len(ys)))
    for low in range(0, int(ids[-1]) + 1 if len(ids) else 0, COLUMNS):
        part = slice(*np.searchsorted(ids, (low, low + COLUMNS)))
        held = np.zeros((len(xs) + len(ys), COLUMNS), np.float32)
        held[rows[part], ids[part] - low] = 1
        out += held[: len(xs)] @ held[len(xs) :].T
    return out


def link_counts(sets: DataFrame, labels: DataFrame, num: int, den: int, most: int = BLOCK_SETS) -> DataFrame:
    """(cid, n_links): with how many other sets (cid, items) of its component (node, label) each one links.

    A component's sets are dealt in blocks of a bounded size, and each two blocks meet in a group of their own, so that a
    large component is neither gathered nor expanded into rows of pairs; the number of groups is the square of the blocks'.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(group: list[tuple]) -> list[tuple[int, int]]:
            sides = [[(cid, np.frombuffer(x, np.uint64)) for *_, own, cid, x in group if own == side] for side in dict.fromkeys(group[0][1:3])]
            xs, ys = sides[0], sides[-1]
            if not xs or not ys:
                return []
            n, m = (np.array([len(x) for _, x in s]) for s in (xs, ys))
            shared = shared_counts([x for _, x in xs], [y for _, y in ys])
            linked = den * shared >= num * (n[:, None] + m[None, :] - shared)
            if xs is ys:
                np.fill_diagonal(linked, False)
            out = list(zip((cid for cid, _ in xs), linked.sum(axis=1).tolist()))
            return out if xs is ys else out + list(zip((cid for cid, _ in ys), linked.sum(axis=0).tolist()))

        def told(rows: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(2)], names=["cid", "n"])

        group: list[tuple] = []
        for batch in batches:
            out = []
            for row in zip(*(batch[c].to_pylist() for c in ("label", "i", "j", "own", "cid", "items"))):
                if group and group[0][:3] != row[:3]:
                    out += done(group)
                    group = []
                group.append(row)
            yield told(out)
        if group:
            yield told(done(group))

    own = labels.select(F.col("node").alias("cid"), "label").join(sets, "cid")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / most, F.sum(F.length("items")) / (8 * BLOCK_SHINGLES)))
    dealt = own.join(own.groupBy("label").agg(blocks.alias("blocks")), "label").withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select("label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cid", "items")
    met = met.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j")
    return met.mapInArrow(tidy(count), "cid long, n long").groupBy("cid").agg(F.sum("n").alias("n_links"))


def _level(n: str, num: int, den: int) -> Column:
    """The level of a prefix's place `at`: the least number of matches whose prefix holds it."""
    return F.expr(f"cast(greatest(1, at - ({n} - ({num} * {n} + {den - 1}) div {den}) + 1) as int)")


def _matches(hits: DataFrame, classes: DataFrame, most: int, num: int, den: int) -> DataFrame:
    """For each class of hits (cid, n, token, at, df): how many matches it asks for, and how many of its shingles
    are open, that is, not in its prefix or in another class's prefix, too.

    A shingle that is not open can still be in another class, behind that one's prefix. But of two classes the one whose
    prefix ends first in the global order has none of its prefix behind the other's, so what the two share is at most
    its open shingles; and similar classes have enough shingles in both prefixes for each to stay at ceil(t * n).
    """
    # Places beyond those of level 1 have levels of their own; the class's own n says where they begin.
    last = F.expr(f"n - ({num} * n + {den - 1}) div {den}")
    reads = [F.sum(F.when(F.col("at") < last + m, F.col("df") - 1).otherwise(0)) for m in range(1, most + 1)]
    least = F.expr(f"({num} * n + {den - 1}) div {den}")
    cost = F.array(*[F.when((least >= m) | F.lit(m == 1), r * (1 + F.col("n") / F.lit(16.0 * m))) for m, r in enumerate(reads, 1)])
    # A level that adds no postings costs no more than the one before it, but asks for one more match.
    cost = F.transform(cost, lambda c, i: c - i * F.lit(1e-6))
    per = hits.groupBy("cid", "n").agg(cost.alias("cost"), F.count(F.lit(1)).alias("shared"))
    prefix = F.least(F.col("n"), F.col("n") - least + most)
    per = per.select("cid", F.array_position("cost", F.array_min("cost")).cast("int").alias("matches"), (F.col("n") - prefix + F.col("shared")).alias("open"))
    # With too few shingles in common with any other class's prefix, nothing can be similar enough.
    return classes.join(per, "cid").where(f"{den} * open >= {num} * n")


def _fits(num: int, den: int) -> str:
    """Tests of classes x and y that cost no verification: by size, by open shingles (of the one that has more: which
    prefix ends first is not known here), by the difference of bitmaps.
    """
    shared = "least(x.n, y.n, greatest(x.open, y.open))"
    differ = " + ".join(f"bit_count(x.{b} ^ y.{b})" for b in BITS)
    return f"{den} * {shared} >= {num} * (x.n + y.n - {shared}) and {den + num} * ({differ}) <= {den - num} * (x.n + y.n)"


#: How many wide shingles two prefixes share before a common one: those known at least, and those that may be beyond BEFORE.
SHARED = "size(array_intersect(x.before, y.before))"
BEYOND = f"(greatest(x.w - {BEFORE}, 0) + greatest(y.w - {BEFORE}, 0))"


def _asked_for() -> str:
    """Whether the common shingle may be the last one that a pair is asked for."""
    return f"least(x.matches, y.matches) - 1 between {SHARED} and {SHARED} + {BEYOND}"


def _enough(num: int, den: int) -> str:
    """Whether classes x and y can be similar, by where their prefixes hold a common shingle: `at` shingles come before
    it, `w` of them wide. Shared are at most all those behind it, itself, and before it the wide ones that are known to
    be shared or may be, and the others.
    """
    shared = f"(least(x.w, y.w, {SHARED} + {BEYOND}) + least(x.at - x.w, y.at - y.w) + least(x.n - x.at, y.n - y.at))"
    return f"{den + num} * {shared} >= {num} * (x.n + y.n)"


class _Links:
    """What the rounds share: links found, labels of their components, pairs tested, sets read."""

    def __init__(self, docs: DataFrame, chosen: DataFrame, k: int, num: int, den: int) -> None:
        self.docs, self.chosen, self.k, self.num, self.den = docs, chosen, k, num, den
        self.edges: list[DataFrame] = []
        self.tested: list[DataFrame] = []
        self.sets: list[DataFrame] = []
        self.labels: DataFrame | None = None

    def labelled(self, hits: DataFrame) -> DataFrame:
        if self.labels is None:
            return hits.withColumn("label", F.col("cid"))
        return hits.join(self.labels.select(F.col("node").alias("cid"), F.col("label").alias("found")), "cid", "left").withColumn("label", F.coalesce("found", "cid")).drop("found")

    def new(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs that no round has tested."""
        if self.tested:
            pairs = pairs.join(_all(self.tested), ["a", "b"], "left_anti")
        return stored(pairs, name)

    def read_sets(self, cids: DataFrame) -> None:
        wanted = self.chosen.select("cid", "n", "first_id", "said", "sig").join(cids, "cid", "left_semi")
        if self.sets:
            wanted = wanted.join(_all(self.sets).select("cid"), "cid", "left_anti")
        wanted = stored(wanted, "wanted")
        if not wanted.isEmpty():
            with filtered_joins(self.docs.sparkSession):
                self.sets.append(stored(whole_sets(self.docs, wanted, self.k), "sets"))
        dropped(wanted)

    def test(self, pairs: DataFrame) -> int:
        """Verifies pairs; the number of links among them."""
        self.read_sets(pairs.select(F.explode(F.array("a", "b")).alias("cid")))
        self.tested.append(pairs)
        if not self.sets:  # no pairs so far
            self.edges.append(pairs)
            return 0
        found = stored(verified(pairs, _all(self.sets), self.num, self.den), "links")
        self.edges.append(found)
        n = found.count()
        if n:
            old, self.labels = self.labels, components(_all(self.edges))
            if old is not None:
                dropped(old)
        return n

    def counts(self, labels: DataFrame) -> DataFrame:
        """(cid, n_links) of the classes in components (node, label)."""
        self.read_sets(labels.select(F.col("node").alias("cid")))
        if not self.sets:  # no component
            return labels.select(F.col("node").alias("cid"), F.lit(0).cast("long").alias("n_links"))
        return link_counts(_all(self.sets), labels, self.num, self.den)

    def done(self) -> None:
        for frame in (*self.tested, *self.sets):
            dropped(frame)


def similarity_classes(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, most: int = MOST_MATCHES, rounds: int = ROUNDS, count_links: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links: documents that chains of links with J >= num / den reach have one component_id.

    n_links is the number of other classes that the document's class links with, 0 if only copies link; without count_links
    it is left out, and so is the comparison of all pairs of a component.
    """
    spark = docs.sparkSession
    arrow_rows(spark, ARROW_ROWS)
    heavy, common = frequent(docs, k)
    signed = stored(signatures(docs, heavy, common, k, num, den, most).withColumn("row_at", F.monotonically_increasing_id()), "signed")
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "said", "row_at"))
    classes = signed.where("n_shingles > 0").groupBy("sig").agg(first.alias("one"), F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"))
    classes = stored(classes.select("sig", F.col("one.row_at").alias("cid"), F.col("one.said").alias("said"), F.when(F.col("one.id") != NO_ID, F.col("one.id")).alias("first_id"), F.col("first_id").alias("least_id"), "copies", "n"), "classes")
    again = stored(signed.select("row_at", "sig").join(classes.where("copies > 1").select("sig", "cid"), "sig").where("row_at <> cid").select("row_at"), "again")
    own = signed.where("n_shingles > 0").join(again, "row_at", "left_anti")
    rows = own.select(F.col("row_at").alias("cid"), F.col("n_shingles").alias("n"), F.posexplode("prefix").alias("at", "token"))
    often = stored(rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "often")
    swept(spark)
    every = stored(rows.join(often, "token"), "hits")
    dropped(again)
    dropped(often)
    swept(spark)
    able = _matches(every, classes, most, num, den)
    chosen = stored(able.join(signed.select(F.col("row_at").alias("cid"), *(F.col("bits")[i].alias(b) for i, b in enumerate(BITS))), "cid"), "chosen")
    hits = every.drop("n", "df").join(chosen.select("cid", "n", "matches", "open", *BITS), "cid").withColumn("level", _level("n", num, den)).where("level <= matches")
    hits = stored(hits, "matched")
    dropped(every)
    # From here on prefixes are read from hits alone.
    whole, signed = signed, stored(signed.select("doc_id", "n_shingles", "sig"), "ids")
    dropped(whole)
    swept(spark)

    fits, told = _fits(num, den), ("cid", "n", "label", "open", *BITS)
    links = _Links(docs, chosen, k, num, den)

    def against(now: DataFrame, centres: DataFrame) -> DataFrame:
        """Pairs of the classes of a bucket with its centres (token, c)."""
        centres = centres.select("token", *(F.col(f"c.{x}").alias(x) for x in told))
        met = now.alias("x").join(centres.alias("y"), F.expr(f"x.token = y.token and x.cid <> y.cid and x.label <> y.label and {fits}"))
        return met.select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")).distinct()

    # The first round: the first class of each bucket.
    now = links.labelled(hits)
    pairs = links.new(against(now, now.groupBy("token").agg(F.min(F.struct(*told)).alias("c"))), "stars")
    many = stored(hits.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where(f"df >= {WIDE}").select("token"), "many")
    wide = stored(hits.join(many, "token"), "wide")
    links.test(pairs)
    swept(spark)
    # Further ones, in wide buckets: CENTRES classes drawn anew each time.
    for k_ in range(rounds):
        now = links.labelled(wide)
        drawn = [F.min(F.struct(F.xxhash64(F.lit(k_ * CENTRES + i), "cid").alias("draw"), *told)) for i in range(CENTRES)]
        centres = now.groupBy("token").agg(F.min("label").alias("lead"), F.max("label").alias("last"), F.array(*drawn).alias("cs")).where("lead <> last")
        pairs = links.new(against(now, centres.select("token", F.explode(F.array_distinct("cs")).alias("c"))), "stars")
        n = pairs.count()
        if not n or links.test(pairs) * LEAST_YIELD < n:
            break
    swept(spark)

    # The join: pairs of classes of different components. Common shingles in narrow buckets are counted. In wide ones a
    # pair makes a row at the common shingle that is the last one it is asked for, told by those before it in both prefixes
    # (the BEFORE last ones are kept; where there are more, any row that may be it). Pairs that can reach what is asked of
    # them with wide ones only in part go on with fewer counted. So no similar pair is lost, and near copies, which share
    # long runs, make one row or a few and not one a shingle.
    own = Window.partitionBy("cid").orderBy("at")
    wides = wide.withColumns({"before": F.collect_list("token").over(own.rowsBetween(-BEFORE, -1)), "w": F.row_number().over(own) - 1, "wide": F.lit(True)})
    one = wides.unionByName(hits.join(many, "token", "left_anti").withColumns({"before": F.array().cast("array<long>"), "w": F.lit(0), "wide": F.lit(False)}))
    one = links.labelled(one)
    one = one.join(wide.groupBy("cid").agg(F.count(F.lit(1)).alias("wides")), "cid", "left").withColumn("wides", F.coalesce("wides", F.lit(0)))
    mixed = one.groupBy("token").agg(F.min("label").alias("lead"), F.max("label").alias("last")).where("lead <> last").select("token")
    one = stored(one.join(mixed, "token"), "mixed")
    apart = "x.token = y.token and x.cid < y.cid and x.label <> y.label and greatest(x.level, y.level) <= least(x.matches, y.matches)"
    met = one.alias("x").join(one.alias("y"), F.expr(f"{apart} and {fits} and (not x.wide or {_asked_for()}) and {_enough(num, den)}"))
    asked = "least(x.matches, y.matches)"
    met = met.select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b"), F.expr(f"if(x.wide, {asked}, 1)").alias("k"), F.expr(f"if(x.wide, {asked}, {asked} - least({asked} - 1, x.wides, y.wides))").alias("least"))
    pairs = met.groupBy("a", "b").agg(F.sum("k").alias("k"), F.min("least").alias("least")).where("k >= least").select("a", "b")
    pairs = links.new(pairs, "pairs")
    for frame in (one, hits, many, wide):
        dropped(frame)
    swept(spark)
    if not pairs.isEmpty():
        links.test(pairs)
    labels = links.labels if links.labels is not None else components(_all(links.edges))
    degree = stored(links.counts(labels) if count_links else labels.select(F.col("node").alias("cid"), F.lit(0).cast("long").alias("n_links")), "degrees")
    links.done()

    ids = classes.select("cid", "sig", F.col("least_id").alias("first_id"), "copies")
    linked = ids.join(labels.withColumnRenamed("node", "cid"), "cid")
    least = linked.groupBy("label").agg(F.min("first_id").alias("component_id"))
    linked = linked.join(least, "label").join(degree, "cid", "left").select("sig", "component_id", "n_links")
    alone = ids.where("copies > 1").join(labels.select(F.col("node").alias("cid")), "cid", "left_anti").select("sig", F.col("first_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    said = stored(linked.unionByName(alone), "said")
    for done in (classes, chosen, degree, labels, *links.edges):
        dropped(done)
    swept(spark)
    out = signed.select("doc_id", "n_shingles", "sig").join(said, "sig", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    return out if count_links else out.drop("n_links")


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out
