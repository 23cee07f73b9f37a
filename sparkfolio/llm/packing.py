"""Harmonic packing of token sequences.

A document is its token ids and END. It is cut into pieces: whole sequences first, then, while the rest is at least
CAPACITY // FINE long, the longest piece of a reciprocal length CAPACITY // k that fits (k up to FINE); what is left
is one more piece. All pieces of a class have one length, so a bin of class k takes exactly k = CAPACITY // length of
them, whichever they are: each task numbers its own pieces class by class, and a table of counts by task and class
turns those numbers into bins and offsets without any task seeing another's pieces. One bin a class at most stays
unfilled; the pieces of these, fewer than CAPACITY / length of each of the CAPACITY // FINE + FINE lengths at most (a
constant), are packed first-fit, the longest first.

Defined cases: null and empty texts are the single id END; repeated rows are packed once each; a null doc_id is kept
as null. Documents of any length are tokenised whole. No rows give no pieces. Other columns are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, stored, tidy

CAPACITY, FINE, END, TOKENIZER = 2048, 16, 1, "word_bpe_49k.json"
#: Parts of words whose ids a task remembers in each of two generations, and characters of a word that it remembers.
CACHE_WORDS, CACHE_CHARS = 100_000, 40

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task int, at long"


def cuts(n: int, capacity: int = CAPACITY, fine: int = FINE) -> list[int]:
    """Lengths of the pieces of a document of n tokens."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n >= capacity // fine:
        out.append(capacity // -(-capacity // n))
        n -= out[-1]
    return out + [n] * (n > 0)


class WordIds:
    """Token ids of texts as little-endian bytes. The tokenizer never joins anything across white space, so words
    are looked up one by one, each once a batch. A word of letters and symbols behind them is looked up in these two
    parts, A-Z in lower case; a part is tokenised once while it is remembered: those of the last two generations are,
    a generation being CACHE_WORDS parts. Texts with special tokens go to the tokenizer whole.
    """

    special = "<|"
    #: Symbols that the tokenizer parts from the letters before them.
    symbols = ".,;:!?|#%$&*)"
    #: The one letter that in lower case ends with a mark, which goes with symbols behind it.
    dotted = "\u0130"

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.old = Tokenizer.from_file(path), {}, {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True

    def encode(self, words: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def encode_letters(self, words: list[str]) -> list[bytes]:
        """As encode(), for words of letters: tokenised as one text, then parted where words end."""
        if not words:
            return []
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            return self.encode(words)
        blob, ends = ids.tobytes(), (4 * ends).tolist()
        return [blob[x:y] for x, y in zip([0, *ends], ends)]

    def looked_up(self, parts: pa.Array) -> pa.Array:
        """The ids of each part; very long parts are not remembered."""
        parts = parts.dictionary_encode()
        names, known, old = parts.dictionary.to_pylist(), self.known, self.old
        new = [w for w in names if w not in known]
        if old:
            known.update((w, old[w]) for w in new if w in old)
            new = [w for w in new if w not in old]
        letters = [w.isalpha() and len(w) <= CACHE_CHARS and self.dotted not in w for w in new]
        known.update(zip(own := [*compress(new, letters)], self.encode_letters(own)))
        other = [w for w, x in zip(new, letters) if not x]
        found = dict(zip(other, self.encode(other)))
        known.update((w, x) for w, x in found.items() if len(w) <= CACHE_CHARS)
        long = {w: x for w, x in found.items() if len(w) > CACHE_CHARS}
        blobs = [known[w] if w in known else long[w] for w in names] if long else [*map(known.__getitem__, names)]
        return pa.array(blobs, pa.large_binary()).take(parts.indices)

    def of_words(self, words: pa.Array) -> pa.Array:
        """The ids of each of distinct words."""
        cores = pc.ascii_rtrim(words, self.symbols)
        plain = pc.and_not(pc.utf8_is_alpha(cores), pc.match_substring(cores, self.dotted))
        plain = pc.and_(plain, pc.less_equal(pc.utf8_length(words), CACHE_CHARS))
        behind = pc.if_else(plain, pc.subtract(pc.binary_length(words), pc.binary_length(cores)), 0).to_numpy()
        cores = pc.if_else(pc.string_is_ascii(cores), pc.ascii_lower(cores), cores)
        at = np.flatnonzero(behind)
        tails = np.full(len(words), "", object)
        tails[at] = [w[-n:] for w, n in zip(words.take(pa.array(at)).to_pylist(), behind[at].tolist())]
        heads, tails = self.looked_up(pc.if_else(plain, cores, words)), self.looked_up(pa.array(tails, pa.string()))
        return pc.binary_join_element_wise(heads, tails, pa.scalar(b"", pa.large_binary()))

    def __call__(self, texts: list[str] | pa.Array) -> Iterator[bytes]:
        if len(self.known) > CACHE_WORDS:
            self.known, self.old = {}, self.known
        texts = pc.coalesce(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        whole = pc.match_substring(texts, self.special)
        split = pc.ascii_split_whitespace(pc.if_else(whole, "", texts))
        words = split.flatten().dictionary_encode()
        ids = self.of_words(words.dictionary).take(words.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1, 8 * ids.offset)[split.offsets.to_numpy()].tolist()
        data = memoryview(ids.buffers()[2] or b"")
        for i, (o, x, y) in enumerate(zip(whole.to_pylist(), ends, ends[1:])):
            yield self.encode([texts[i].as_py()])[0] if o else bytes(data[x:y])


@lru_cache(1)
def word_ids(path: str) -> WordIds:
    """One for each Python worker, kept from task to task; the words are not."""
    return WordIds(path)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, fine: int = FINE) -> DataFrame:
    """PIECES: `task` and `at` number the pieces of one length within the task that cut them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, task, seen = word_ids(tokenizer or tokenizer_path(TOKENIZER)), TaskContext.get().partitionId(), {}
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, blob in zip(batch["doc_id"].to_pylist(), ids(batch["text"])):
                blob += end
                start, total = 0, len(blob) // 4
                for n in cuts(total, capacity, fine):
                    rows.append((doc_id, start, n, zlib.crc32(blob[4 * start : 4 * (start + n)]), total, task, seen.get(n, 0)))
                    seen[n] = seen.get(n, 0) + 1
                    start += n
            kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "at"])
        ids.known, ids.old = {}, {}  # a worker outlives its task, and the tasks of other stages need the room

    arrow_rows(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(cut), PIECES)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, fine: int = FINE) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded (length of the sequence with padding)."""
    found = stored(pieces(docs, tokenizer, capacity, fine), "pieces")
    # Counts by length and task, then where each task's pieces begin in the numbering of their length.
    tasks = found.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    tasks = tasks.select("*", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    classes = tasks.groupBy("length").agg(F.sum("n").alias("total"))  # one row a length: capacity // fine + fine at most
    full = F.expr(f"total div ({capacity} div length)")
    classes = classes.select("length", full.alias("full"), (F.sum(full).over(Window.orderBy("length")) - full).alias("first_bin"))
    classes = classes.withColumn("bins", F.sum("full").over(Window.partitionBy()))
    numbered = found.join(stored(tasks.join(F.broadcast(classes), "length").drop("n"), "bins"), ["length", "task"])
    per, rank = F.expr(f"{capacity} div length"), F.col("at") + F.col("before")
    numbered = numbered.withColumns({"rank": rank, "per": per}).withColumn("bin", F.expr("rank div per"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    filled = numbered.where("bin < full").select(*columns, (F.col("first_bin") + F.col("bin")).alias("sequence_id"), F.expr("(rank % per) * length").alias("offset"), F.expr(f"{capacity} - {capacity} % length").alias("used"))

    def first_fit(rest: pd.DataFrame) -> pd.DataFrame:
        """The unfilled bins' pieces: fewer than capacity // length of a length, so their number is bounded."""
        rest = rest.sort_values(["length", "doc_id", "start"], ascending=[False, True, True])
        room: list[int] = []
        sequence, offset = [], []
        for n in rest["length"]:
            k = next((k for k, x in enumerate(room) if x >= n), len(room))
            if k == len(room):
                room.append(capacity)
            sequence.append(k)
            offset.append(capacity - room[k])
            room[k] -= n
        used = [capacity - room[k] for k in sequence]
        return rest.assign(sequence_id=np.array(sequence, "int64") + rest["bins"].to_numpy("int64"), offset=offset, used=used)[[*columns, "sequence_id", "offset", "used"]]

    rest = numbered.where("bin >= full").groupBy("bins").applyInPandas(first_fit, filled.schema)
    padded = F.when(F.col("used").cast("long").bitwiseAND(F.col("used").cast("long") - 1) == 0, F.col("used")).otherwise(F.lit(capacity))
    return filled.unionByName(rest).withColumn("padded", padded.cast("long")).drop("used")
