import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from sparkfolio.llm.fingerprints import compared, fingerprints, with_fingerprints
from sparkfolio.llm.packing import CAPACITY, TOKENIZER, cuts, pack, pieces, tokenizer_path, word_ids


def likeness(x, y):
    a, b = Counter(), Counter()
    for own, text in ((a, x), (b, y)):
        for w in text.encode().lower().split():
            own[w] += len(w)
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_collision_rate_is_generalised_jaccard():
    rng = np.random.default_rng(3)
    words = [f"w{i}" * (i % 4 + 1) for i in range(300)]
    for share in (0.1, 0.5, 0.9):
        x = " ".join(rng.choice(words, 400))
        y = x[: int(len(x) * share)] + " " + " ".join(rng.choice(words, 150))
        a, b = fingerprints([x, y], 2048)
        assert abs((a == b).mean() - likeness(x, y)) < 0.05


def test_fingerprint_does_not_depend_on_the_batch():
    texts = ["a b c a", "", "b a a c", "zz " * 5000, "a b c a"]
    each = np.stack([fingerprints([t])[0] for t in texts])
    assert (fingerprints(texts) == each).all() and (each[0] == each[2]).all() and not each[1].any()


def test_edited_texts(spark, odd_docs, no_docs):
    rows = sorted(((r.doc_id, r.text or "") for r in odd_docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want = Counter()
    for (d, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        want[d, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()] += 1
    got = compared(odd_docs).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert compared(no_docs).count() == 0
    assert compared(odd_docs.where("doc_id = 5").limit(1)).head().near_next == 1
    assert with_fingerprints(odd_docs).count() == len(rows)


@given(st.integers(0, 20_000))
def test_cuts_keep_every_token(n):
    own = cuts(n)
    assert sum(own) == n and all(0 < x <= CAPACITY for x in own)


def check_packing(rows, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path(TOKENIZER))
    want = Counter()
    for d, t in docs:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        start = 0
        for n in cuts(len(ids)):
            want[d, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids)] += 1
            start += n
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= own[0].padded <= CAPACITY and (own[0].padded == CAPACITY or at == own[0].padded)
    return sum(r.length for r in rows) / sum(own[0].padded for own in by.values())


def test_packing_odd_documents(odd_docs, no_docs):
    check_packing(pack(odd_docs).collect(), [(r.doc_id, r.text) for r in odd_docs.collect()])
    assert pack(no_docs).count() == 0


def test_packing_pads_little(spark):
    rows = [(i, "some words to pack " * (1 + i * 37 % 400)) for i in range(400)]
    full = check_packing(pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect(), rows)
    assert full > 0.98


@pytest.mark.parametrize("text", ["it's don't I'M we'll' ''s, a.b.c 3.14abc", "İstanbul ΣΑΣ é ́x", "<|startoftext|> hi\x1c!\x1dyo \x85 a\xa0b", " \x0b\f ", "“quoted” naïve— ß ẞ ǅ ﬁ", "a" * 5000 + "., " + "9" * 100, "😀👍🏽 ١٢٣ ²x ª", "ok,%%% don't's. 'tis", ""])
def test_word_ids_equal_the_tokenizers(text):
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(tokenizer_path(TOKENIZER)).encode(text, add_special_tokens=False).ids
    assert list(np.frombuffer(list(word_ids(tokenizer_path(TOKENIZER))([text]))[0], "<u4")) == want


@pytest.mark.parametrize("text", ["\u0130, a\u0130.; \u0130stanbul! x", "A\u0130#% \u0130", "  lead\u2028\u0130|,\x1c."])
def test_letters_that_become_marks_go_with_the_symbols_behind_them(text):
    test_word_ids_equal_the_tokenizers(text)


def test_a_word_is_remembered_once_whatever_stands_behind_it():
    ids = word_ids(tokenizer_path(TOKENIZER))
    ids.known, ids.old = {}, {}
    found = list(ids(["Tree, tree. TREE!", None, "tree;tree tree"]))
    assert set(ids.known) == {"tree", "", ",", ".", "!", "tree;tree"} and found[1] == b"" and len(found[0]) == 24
    ids.known, ids.old = {}, {}


def test_workers_keep_no_words_between_tasks(spark):
    import pyarrow as pa

    docs = spark.createDataFrame([(i, " ".join(f"word{i}x{j}" for j in range(50))) for i in range(40)], "doc_id long, text string").repartition(4)
    pieces(docs).collect()
    path = tokenizer_path(TOKENIZER)

    def held(batches):
        for batch in batches:
            ids = word_ids(path)
            yield pa.RecordBatch.from_arrays([pa.array([len(ids.known) + len(ids.old)])], names=["n"])

    assert {r.n for r in docs.select("doc_id").mapInArrow(held, "n long").collect()} == {0}
