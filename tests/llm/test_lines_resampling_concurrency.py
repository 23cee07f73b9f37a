"""Line dedup, importance resampling and the concurrency sweep, each against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkfolio.llm import concurrency, importance, line_dedup

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def without_lines(rows, least_chars=20, least_docs=3):
    """(doc_id, n_lines, n_dropped, kept) of each row (doc_id, text)."""
    key = lambda line: re.sub(r"[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    order = lambda d: (d is not None, d or 0)
    held = defaultdict(set)
    for d, text in rows:
        for line in (text or "").split("\n"):
            held[key(line)].add(d)
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(key(x)) < least_chars or len(held[key(x)]) < least_docs or d == max(held[key(x)], key=order)]
        out.append((d, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def cleaned(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in line_dedup.cleaned(df).collect()), key=repr)


@pytest.mark.parametrize("share", [1 / 2048, 0.02, 1.0])
def test_lines_equal_brute_force_whichever_keys_count_as_hot(spark, monkeypatch, share):
    monkeypatch.setattr(line_dedup, "HOT_SHARE", share)
    rng = random.Random(4)
    pool = ["All rights reserved by the author", "  ALL RIGHTS reserved by the author\t", "Zwölf Boxkämpfer jagen ÄÖÜ quer", "zwölf boxkämpfer jagen ÄÖÜ quer", "short", "", "x" * 19, "x" * 20, "漢" * 20]
    pool += [f"a line of its own, number {k}" for k in range(12)]
    rows = [(k, "\n".join(rng.choice(pool[:2] if rng.random() < 0.4 else pool) for _ in range(rng.randrange(1, 9)))) for k in range(60)]
    rows += [(7, pool[0]), (None, pool[0] + "\n" + pool[9]), (None, pool[10]), (70, None), (71, ""), (72, "\n\n"), (73, "\n".join([pool[2]] * 5)), (74, "\r\n".join(pool))]
    assert cleaned(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == without_lines(rows)


def test_lines_of_odd_documents(spark, odd_docs, no_docs):
    assert cleaned(odd_docs) == without_lines([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert line_dedup.cleaned(no_docs).count() == 0
    clash = odd_docs.select("doc_id", "text", F.lit(1).alias("n_lines"), F.lit(2).alias("kept"))
    assert line_dedup.cleaned(clash).columns == ["doc_id", "text", "n_lines", "kept", "n_lines_", "n_dropped", "kept_"]


def test_a_long_text_of_many_lines(spark):
    long = "\n".join(f"line number {k % 5000} of a long text" for k in range(40_000))
    rows = [(1, long), (2, long), (3, "line number 17 of a long text\nline number 18 of a long text\nnew"), (4, long + "\nnot before")]
    assert cleaned(spark.createDataFrame(rows, "doc_id long, text string")) == without_lines(rows)


def test_bitmaps_are_runs(spark):
    text = "\n".join("keep me, I am alone %d" % k if k % 5 else "common line of all documents" for k in range(1, 11))
    rows = [(k, text.replace("alone", f"alone {k}")) for k in range(3)]
    got = line_dedup.keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.n_dropped for r in got) == [2, 2]
    assert all([tuple(x) for x in r.keep] == [(0, 4), (5, 9), (10, line_dedup.OPEN)] for r in got)


def brute_words(text):
    low = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in (text or "").encode())
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_features(text):
    w = brute_words(text)
    return w + [a + b" " + b for a, b in zip(w, w[1:], strict=False)]


def brute_resampled(rows, target, percent=25, least=20, buckets=10_000):
    count = lambda texts: Counter(zlib.crc32(f) % buckets for t in texts for f in brute_features(t))
    s, t = count(t for _, t in rows), count(target)
    S, T = sum(s.values()), sum(t.values())  # noqa: N806
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for d, text in rows:
        own = brute_features(text)
        weight = sum(gain(zlib.crc32(f) % buckets) for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(brute_words(text)) >= least])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(able, 1):
        r[4] = place if place <= percent * len(able) // 100 else None
    return sorted((tuple(r[:4]) + (r[4] or None,) for r in out), key=repr)


def resampled(spark, rows, target, **more):
    docs = rows if hasattr(rows, "columns") else spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = importance.resampled(docs, spark.createDataFrame([(t,) for t in target], "text string"), **more)
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()), key=repr)


TARGET = ["Alpha beta gamma, alpha beta.", "Größe der Straße 12 mal", None, ""]


def test_resampling_equals_brute_force(spark):
    rng = random.Random(8)
    words = ["alpha", "Beta", "gamma", "größe", "STRASSE", "x1", "漢字", "😀", "delta", "mal", "12"]
    rows = [(k, rng.choice((" ", ", ", "\n", "--")).join(rng.choice(words) for _ in range(rng.randrange(0, 60)))) for k in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "... --- ..."), (1003, "one"), (1004, "w" * 300 + " " + "w" * 299), (None, "alpha " * 30), (5, rows[5][1])]
    assert resampled(spark, rows, TARGET) == brute_resampled(rows, TARGET)
    assert resampled(spark, rows, []) == brute_resampled(rows, [])


def test_resampling_of_odd_documents(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert resampled(spark, odd_docs, TARGET) == brute_resampled(rows, TARGET)
    assert resampled(spark, no_docs, TARGET) == []


@pytest.mark.parametrize(("piece", "steps"), [(1 << 20, 48), (37, 5), (1, 1)])
def test_automaton_equals_a_search(monkeypatch, piece, steps):
    monkeypatch.setattr(importance, "PIECE", piece)
    monkeypatch.setattr(importance, "STEPS", steps)
    rng = random.Random(1)
    texts = [None, "", *("".join(rng.choice("abCZ09 ,.\né漢😀-_") for _ in range(rng.randint(0, 120))) for _ in range(80)), "x" * 500, "x" * 500]
    for held in (pa.array(texts, pa.string()), pa.array(["zz", *texts], pa.large_string())[1:], pa.array([], pa.string())):
        got = defaultdict(list)
        for doc, one, two in importance.features(held):
            for d, a, b in zip(doc, one, two, strict=True):
                got[int(d)].append((int(a), int(b)))
        for k, text in enumerate(held.to_pylist()):
            w = brute_words(text)
            assert got[k] == [(zlib.crc32(x), zlib.crc32(w[i - 1] + b" " + x) if i else -1) for i, x in enumerate(w)]


def test_crc_table_is_that_of_zlib():
    state = np.full(3, importance.ONES, np.uint32)
    for byte in b"123456789":
        state = importance.stepped(state, byte)
    assert set((state ^ np.uint32(importance.ONES)).tolist()) == {zlib.crc32(b"123456789")}


SPAN = "key int, s long, e long, cents long, extra string"


def brute_sweep(rows):
    change = defaultdict(lambda: [0, 0])
    for key, s, e, cents, *_ in rows:
        if key is None or s is None or (e is not None and e <= s):
            continue
        for at, sign in ((s, 1), (e, -1)):
            if at is not None:
                change[key, at][0] += sign
                change[key, at][1] += sign * (cents or 0)
    out = []
    for key in {k for k, _ in change}:
        moments = sorted(at for (k, at), v in change.items() if k == key and v != [0, 0])
        n = total = high = 0
        own = []
        for i, at in enumerate(moments):
            n, total = n + change[key, at][0], total + change[key, at][1]
            high = n if i == 0 else max(high, n)
            own.append((key, at, moments[i + 1] if i + 1 < len(moments) else None, n, total, high))
        out += [(*r, r[3] == max(x[3] for x in own)) for r in own]
    return sorted(out, key=repr)


def swept(spark, rows, unit=1):
    return sorted(map(tuple, concurrency.sweep(spark.createDataFrame(rows, SPAN), "key", "s", "e", "cents", unit).collect()), key=repr)


@pytest.mark.parametrize(("span", "unit"), [(40, 1), (5000, 60), (300_000, 1), (1 << 40, 1)])
def test_sweep_equals_brute_force(spark, span, unit):
    rng = random.Random(span)
    rows = []
    for _ in range(600):
        s = rng.randrange(-span, span)
        e = rng.choice((None, s, s - 3, s + 1 + rng.randrange(span // 2)))
        rows.append((rng.choice((1, 1, 2, None)), s * unit, None if e is None else e * unit, rng.choice((None, 0, 5, 1200)), "x"))
    rows += [(3, None, 5 * unit, 1, "x"), (4, 7 * unit, None, None, "x"), (1, rows[0][1], rows[0][2], rows[0][3], "y")]
    rows += [(5, 0, 10 * unit, 7, "x"), (5, 10 * unit, 20 * unit, 7, "x"), (6, 0, 10 * unit, 7, "x"), (6, 10 * unit, 20 * unit, 8, "x")]
    assert swept(spark, rows, unit) == brute_sweep(rows)


def test_sweep_of_nothing(spark):
    assert swept(spark, []) == []
    assert swept(spark, [(1, None, None, 1, "x"), (1, 5, 5, 1, "x")]) == []


@pytest.mark.parametrize("skip", [True, False])
def test_cells_of_a_tree(spark, skip):
    """A prefix is the disjoint union of its cells and, where odd numbers are skipped, of the one it ends at; one of its cells is a power of two."""
    got = spark.range(1, 65).select("id", concurrency.rounded(F.col("id"), True, 6, skip).alias("up"), concurrency.rounded(F.col("id"), False, 6, skip).alias("down")).collect()
    for i in got:
        assert sum(x & (x - 1) == 0 for x in i.down) == 1
        for j in got:
            alone = skip and i.id % 2 == 1 and i.id > 1 and i.id == j.id
            assert len(set(i.down) & set(j.up)) + alone == (j.id <= i.id)


def test_moments_of_sales(spark, tmp_path):
    """A sale without lines stays open, unknown clients are nation -1, times are rounded down before they are compared."""
    ts = "timestamp_ntz"
    spark.sql(f"""select * from values (1L, 1L, 10.004D, {ts} '2024-01-01 00:00:59'), (2L, 9L, null, {ts} '2024-01-01 00:01:00'), (3L, null, 1D, null), (4L, 1L, 2.5D, {ts} '2024-01-02 00:00:30'), (5L, 2L, 1D, {ts} '1969-12-31 23:59:30')
        as t(sale_id, client_id, total, sold_at)""").write.parquet(f"{tmp_path}/sales.parquet")
    spark.sql(f"select * from values (1L, {ts} '2024-01-01 10:00:01'), (1L, {ts} '2024-01-03 10:00:59'), (1L, null), (4L, {ts} '2023-12-26 00:00:45'), (2L, null), (null, {ts} '2025-01-01 00:00:00') as t(sale_id, shipped_at)").write.parquet(f"{tmp_path}/sale_lines.parquet")
    spark.sql("select * from values (1L, 5), (2L, null) as t(client_id, nation_id)").write.parquet(f"{tmp_path}/clients.parquet")
    got = {(r.nation_id, r.from_s, r.to_s, r.n_open, r.open_cents, r.high_open, r.is_peak) for r in concurrency.op13(spark, str(tmp_path)).collect()}
    day, end = 1_704_067_200, 1_704_067_200 + 9 * 86_400 + 36_000
    assert got == {
        (5, day, end, 1, 1000, 1, True), (5, end, None, 0, 0, 1, False),
        (-1, -60, day + 60, 1, 100, 1, False), (-1, day + 60, None, 2, 100, 2, True),
        (-2, -60, day, 1, 100, 1, False), (-2, day, day + 60, 2, 1100, 2, False), (-2, day + 60, end, 3, 1100, 3, True), (-2, end, None, 2, 100, 3, False),
    }
