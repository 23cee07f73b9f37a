"""Removal of repeated byte strings with sparse suffix arrays, sorted deep and shallow.

Every byte that some WINDOW-byte string covers which also starts elsewhere is to go. Of all suffixes only those at
anchors are sorted: an anchor is the least hash of GRAM bytes in some run of WINDOW bytes, so two equal windows
have an anchor at the same place, and one byte in about 185 is one. Around an anchor at p, two occurrences agree over L
bytes to the left and R to the right; they share windows that hold the anchor if L + R >= WINDOW, and these
cover [p - L, p + R).

1. Each anchor gives hashes of its gram, its halves (the WINDOW // 2 bytes on either side) and its whole context, all
   windows that hold it. Only grams that occur twice go on. Contexts that occur twice are settled at once: all they hold
   is repeated. Of the others those go on that share a half with another context, as any match must.
2. Their bytes meet by gram: right and left contexts are each ordered by deep-shallow sorting (multikey
   quicksort over 8-byte words down to SHALLOW bytes, blind tries below). Joining the right order's neighbours
   from the longest common prefix down, each context meets its neighbours in the left order, which gives the
   largest L and R of any partner in n log n comparisons.
3. A gram with more than LOCAL different contexts is not gathered in one task: its windows are hashed, counted by
   offset and hash across the cluster, and give the same L and R.

No join gathers the rows of a common gram, context, half or window either: met() deals such keys in parts.

Defined cases: null text is empty; very long texts are processed whole, one at a time; texts under WINDOW bytes keep everything unless they repeat inside; rows that repeat
a doc_id are documents of their own; columns besides doc_id and text are not read; an empty table gives an empty
result. docs must give the same rows when read again, as a table does.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, filtered_joins, stored, tidy

WINDOW, GRAM, SHALLOW, LOCAL, BATCH_BYTES = 400, 32, 64, 50_000, 2_000_000
#: A key with 1/COMMON of all repeated keys' rows or more, of which there are COMMON at most, is joined in PARTS parts.
COMMON, PARTS = 2048, 64
BYTES = np.random.Generator(np.random.PCG64(20240501)).integers(1, 2**63, 256, dtype=np.uint64)


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash (uint32) of the gram bytes from each place on; gram is a power of two."""
    h, span = BYTES[data], 1
    while span < gram:
        h = h[:-span] * np.uint64(0x9E3779B97F4A7C15 + 2 * span) + h[span:]
        span *= 2
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32)


def _sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over each run of `width` entries, by doubling."""
    span = 1
    while 2 * span <= width:
        x = pick(x[:-span], x[span:])
        span *= 2
    return pick(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def anchors(data: np.ndarray, ends: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Places of anchors in texts laid end to end, the text k ending before ends[k]."""
    if len(data) < window:
        return np.zeros(0, np.int64)
    h = _gram_hashes(data, gram)
    for e in ends[:-1]:  # no gram runs over the end of a text
        h[max(0, e - gram + 1) : e] = 0xFFFFFFFF
    width = window - gram + 1
    least = _sliding(h, width, np.minimum)
    padded = np.concatenate([np.zeros(width - 1, np.uint32), least, np.zeros(width - 1, np.uint32)])
    return np.flatnonzero((_sliding(padded, width, np.maximum) == h) & (h != 0xFFFFFFFF))


ANCHORS = "row_at long, pos int, gram long, a long, b long, ctx long, n int, left int, right int"


def _scan(window: int, gram: int):
    def signed(x: int) -> int:
        return x - (1 << 64) if x >> 63 else x

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, half = xxhash.xxh3_64_intdigest, window // 2
        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch["text"].to_pylist()]
            ids = batch["row_at"].to_pylist()
            at = 0
            while at < len(texts):
                n, end = 0, at
                while end < len(texts) and (end == at or n + len(texts[end]) <= BATCH_BYTES):
                    n += len(texts[end])
                    end += 1
                part, rows = texts[at:end], []
                blob = b"".join(part)
                ends = np.cumsum([len(t) for t in part])
                places = anchors(np.frombuffer(blob, np.uint8), ends, window, gram)
                owner = np.searchsorted(ends, places, side="right")
                bounds = np.searchsorted(owner, np.arange(len(part) + 1))
                for k, text in enumerate(part):
                    size, begin, row_at = len(text), int(ends[k]) - len(text), ids[at + k]
                    if size < window:
                        continue
                    seen: dict[int, list] = {}
                    repeated: list[list[int]] = []
                    for p in (places[bounds[k] : bounds[k + 1]] - begin).tolist():
                        left, right = min(p, window - gram), min(size - p, window)
                        if right < gram or left + right < window:
                            continue
                        ctx = digest(text[p - left : p + right], left)
                        if ctx in seen:
                            own = seen[ctx]
                            own[6] += 1
                            if own[6] == 2:
                                repeated.append([own[1] - left, own[1] + right])
                            if repeated[-1][0] <= p - left <= repeated[-1][1]:
                                repeated[-1][1] = p + right
                            else:
                                repeated.append([p - left, p + right])
                            continue
                        a = digest(text[p : p + half], 1) if right >= half else None
                        b = digest(text[p - half : p + gram], 2) if left >= half else None
                        seen[ctx] = [row_at, p, signed(digest(text[p : p + gram])), a if a is None else signed(a), b if b is None else signed(b), signed(ctx), 1, left, right]
                    rows += seen.values()
                    # What repeats within the text is settled here: rows without a gram, from pos on over right bytes.
                    rows += [[row_at, x, None, None, None, None, 0, 0, y - x] for x, y in repeated]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate([pa.int64(), pa.int32(), *[pa.int64()] * 4, *[pa.int32()] * 3])], names=["row_at", "pos", "gram", "a", "b", "ctx", "n", "left", "right"])
                at = end

    return find


def common_prefix(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y))
    x, y = x[:n], y[:n]
    if x == y:
        return n
    return n - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8


def blind_trie_order(strings: list[bytes], own: list[int], depth: int) -> list[int]:
    """own, ordered by their strings, which agree up to depth. A node is [place, {byte: node or leaf}]; a leaf lists equal strings."""
    at = lambda s, d: s[d] if d < len(s) else -1
    root: list = []
    for i in own:
        s = strings[i]
        if not root:
            root.append([i])
            continue
        node, path = root[0], []
        while isinstance(node[-1], dict):  # blind: only branching bytes are looked at
            path.append(node)
            node = node[1].get(at(s, node[0])) or next(iter(node[1].values()))
        other = strings[node[0]]
        same = depth + common_prefix(s[depth:], other[depth:])
        if same == len(s) == len(other):
            node.append(i)
            continue
        above = None
        for step in path:
            if step[0] >= same:
                break
            above = step
        below = root[0] if above is None else above[1].get(at(s, above[0]))
        if isinstance(below[-1], dict) and below[0] == same:
            below[1][at(s, same)] = [i]
            continue
        new = [same, {at(s, same): [i], at(other, same): below}]
        if above is None:
            root[0] = new
        else:
            above[1][at(s, above[0])] = new
    out, stack = [], list(root)
    while stack:
        node = stack.pop()
        if isinstance(node[-1], dict):
            stack += [node[1][c] for c in sorted(node[1], reverse=True)]
        else:
            out += node
    return out


def deep_shallow_order(strings: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """Places of strings in their order: multikey quicksort by words of 8 bytes, from `shallow` on blind tries."""
    out: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        own, d = stack.pop()
        if len(own) < 2 or d < 0:
            out += own
            continue
        if d >= shallow:
            out += blind_trie_order(strings, own, d)
            continue
        words = [strings[i][d : d + 8] for i in own]
        pivot = sorted((words[0], words[len(words) // 2], words[-1]))[1]
        less, same, more = [], [], []
        for i, w in zip(own, words):
            (less if w < pivot else same if w == pivot else more).append(i)
        stack.append((more, d))
        stack.append((same, d + 8 if len(pivot) == 8 else -1))  # strings that end in a word are equal
        stack.append((less, d))
    return out


def extents(lefts: list[bytes], rights: list[bytes], window: int) -> tuple[list[int], list[int]]:
    """For each context the largest L and the largest R of any partner with L + R >= window; 0 and 0 without one. lefts are reversed."""
    n = len(rights)
    most_l, most_r = [0] * n, [0] * n

    def meet(i: int, j: int, r: int) -> None:
        left = common_prefix(lefts[i], lefts[j])
        if left + r >= window:
            for k in (i, j):
                most_l[k] = max(most_l[k], left)
                most_r[k] = max(most_r[k], r)

    if n == 2:
        meet(0, 1, common_prefix(rights[0], rights[1]))
        return most_l, most_r
    by_right, by_left = deep_shallow_order(rights), deep_shallow_order(lefts)
    rank = [0] * n
    for k, i in enumerate(by_left):
        rank[i] = k
    near = [common_prefix(rights[i], rights[j]) for i, j in zip(by_right, by_right[1:])]
    parent, members = list(range(n)), [[rank[i]] for i in by_right]  # by place in by_right
    for k in sorted(range(n - 1), key=near.__getitem__, reverse=True):
        x, y = k, k + 1
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if len(members[x]) < len(members[y]):
            x, y = y, x
        large, r = members[x], near[k]
        for m in members[y]:
            at = bisect_left(large, m)
            if at:
                meet(by_left[m], by_left[large[at - 1]], r)
            if at < len(large):
                meet(by_left[m], by_left[large[at]], r)
            large.insert(at, m)
        members[y], parent[y] = [], x
    return most_l, most_r


def met(rows: DataFrame, keys: DataFrame, by: list[str], uses: str, how: str = "inner") -> DataFrame:
    """rows (with row_at and pos) joined by `by` with keys, a stored frame of distinct keys that says in `uses` how many rows each has.

    The common keys are broadcast, COMMON at most, so that their rows know to be dealt in parts by row_at and pos; on
    the other side such a key is repeated once a part.
    """
    often = F.col(uses) * COMMON >= keys.agg(F.sum(uses)).head()[0] if not keys.isEmpty() else F.lit(False)
    common = F.broadcast(keys.where(often).select(*by, F.lit(True).alias("common")))
    part = F.when(F.col("common"), F.pmod(F.xxhash64("row_at", "pos"), F.lit(PARTS))).otherwise(F.lit(0)).cast("int")
    dealt = rows.join(common, by, "left").withColumn("part", part).drop("common")
    parts = F.explode(F.when(often, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0))))
    return dealt.join(keys.withColumn("part", parts), [*by, "part"], how).drop("part")


def _settle(window: int):
    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(group: list[tuple]) -> list[tuple]:
            if len(group) < 2:
                return []
            most_l, most_r = extents([g[3][::-1] for g in group], [g[4] for g in group], window)
            return [(g[1], g[2] - x, g[2] + y) for g, x, y in zip(group, most_l, most_r) if x + y and g[5] == 1]

        group: list[tuple] = []
        for batch in batches:
            out = []
            for row in zip(*(batch[c].to_pylist() for c in ("gram", "row_at", "pos", "lhs", "rhs", "n"))):
                if group and group[0][0] != row[0]:
                    out += done(group)
                    group = []
                group.append(row)
            yield _spans(out)
        yield _spans(done(group))

    return settle


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.int32()))], names=["row_at", "begin", "end"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for row_at, text, wanted in zip(*(batch[c].to_pylist() for c in ("row_at", "text", "wanted"))):
            data = (text or "").encode("utf-8", "surrogatepass")
            rows += [(w["gram"], row_at, w["pos"], data[w["pos"] - w["left"] : w["pos"]], data[w["pos"] : w["pos"] + w["right"]], w["n"], w["hot"]) for w in wanted]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()))], names=["gram", "row_at", "pos", "lhs", "rhs", "n", "hot"])


def _windows(window: int):
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gram, row_at, pos, lhs, rhs, n in zip(*(batch[c].to_pylist() for c in ("gram", "row_at", "pos", "lhs", "rhs", "n"))):
                data = lhs + rhs
                rows = [(gram, row_at, pos, len(lhs) - s, xxhash.xxh3_64_intdigest(data[s : s + window], 0) >> 1, n) for s in range(len(data) - window + 1)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], names=["gram", "row_at", "pos", "before", "hash", "n"])

    return hashes


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, local: int = LOCAL) -> DataFrame:
    """(row_at, spans): for each text with repeated strings the byte runs that they cover, overlapping still."""
    spark = docs.sparkSession
    arrow_rows(spark)
    texts = docs.select(F.monotonically_increasing_id().alias("row_at"), "text")
    found = texts.mapInArrow(tidy(_scan(window, gram)), ANCHORS)
    often = stored(found.where("gram is not null").groupBy("gram").agg(F.sum("n").alias("uses")).where("uses > 1"), "often")
    inside = stored(found.where("gram is null").select("row_at", F.col("pos").alias("begin"), (F.col("pos") + F.col("right")).alias("end")), "inside")
    hits = stored(met(found.where("gram is not null"), often, ["gram"], "uses").drop("uses"), "anchors")
    classes = hits.groupBy("gram", "ctx").agg(F.sum("n").alias("n"), F.min(F.struct("row_at", "pos", "left", "right", "a", "b")).alias("one"))
    classes = stored(classes.select("gram", "ctx", "n", "one.*"), "contexts")
    twice = classes.where("n > 1").select("gram", "ctx", F.col("n").alias("uses"))
    settled = met(hits, twice, ["gram", "ctx"], "uses").select("row_at", (F.col("pos") - F.col("left")).alias("begin"), (F.col("pos") + F.col("right")).alias("end"))

    shared = lambda x: stored(classes.where(F.col(x).isNotNull()).groupBy("gram", x).agg(F.count(F.lit(1)).alias(f"{x}s")).where(f"{x}s > 1"), "halves")
    open_ = met(met(classes, shared("a"), ["gram", "a"], "as", "left"), shared("b"), ["gram", "b"], "bs", "left").where("`as` is not null or bs is not null")
    open_ = stored(open_.select("gram", "n", "row_at", "pos", "left", "right"), "open")
    sizes = stored(open_.groupBy("gram").agg(F.count(F.lit(1)).alias("members"), F.min("n").alias("least")).where("members > 1 and least = 1"), "sizes")
    wanted = met(open_, sizes, ["gram"], "members").withColumn("hot", F.col("members") > local)
    wanted = wanted.groupBy("row_at").agg(F.collect_list(F.struct("gram", "n", "pos", "left", "right", "hot")).alias("wanted"), F.max("hot").alias("any_hot"))
    wanted = stored(wanted, "wanted")
    bytes_ = texts.join(wanted.where("row_at >= 0"), "row_at").select("row_at", "text", "wanted").mapInArrow(tidy(_contexts), "gram long, row_at long, pos int, lhs binary, rhs binary, n long, hot boolean")
    spans = "row_at long, begin int, end int"
    some_hot = not wanted.where("any_hot").isEmpty()
    if some_hot:
        bytes_ = stored(bytes_, "bytes")
    matched = bytes_.where("not hot").repartition("gram").sortWithinPartitions("gram").mapInArrow(tidy(_settle(window)), spans)
    if some_hot:
        each = stored(bytes_.where("hot").mapInArrow(tidy(_windows(window)), "gram long, row_at long, pos int, before int, hash long, n long"), "windows")
        same = stored(each.groupBy("gram", "before", "hash").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "same")
        reach = met(each, same, ["gram", "before", "hash"], "k").where("n = 1").groupBy("row_at", "pos").agg(F.max("before").alias("l"), F.min("before").alias("r"))
        matched = matched.unionByName(reach.select("row_at", F.expr("pos - l").cast("int").alias("begin"), F.expr(f"pos + {window} - r").cast("int").alias("end")))
    every = inside.unionByName(settled).unionByName(matched)
    with filtered_joins(spark):
        return stored(every.groupBy("row_at").agg(F.collect_list(F.struct("begin", "end")).alias("spans")), "spans")


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, local: int = LOCAL) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left) for every row of docs."""
    spans = repeated_spans(docs, window, gram, local)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, own in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "spans"))):
                data = (text or "").encode("utf-8", "surrogatepass")
                kept, at, runs, removed = [], 0, 0, 0
                last = -1
                for begin, end in sorted((s["begin"], s["end"]) for s in own or ()):
                    if begin > last:
                        runs += 1
                        kept.append(data[at:begin])
                        removed += end - begin
                        at = last = end
                    elif end > last:
                        removed += end - last
                        at = last = end
                kept = b"".join([*kept, data[at:]])
                out.append((doc_id, len(data), removed, runs, hashlib.sha256(kept).hexdigest(), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    rows = docs.select(F.monotonically_increasing_id().alias("row_at"), F.col("doc_id").cast("long").alias("doc_id"), "text").join(spans, "row_at", "left")
    return rows.select("doc_id", "text", "spans").mapInArrow(tidy(cut), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
