"""Evaluation texts leaking into training text: suffix arrays over shards of the corpus."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[a-z0-9]+")
HITS = "doc_id long, item_id long, n_words int, doc_word int, item_word int"
#: Words of corpus text per suffix array; test items per pass over the corpus. Neither limits what is found.
SHARD_WORDS, ITEMS_PER_PASS = 2_000_000, 20_000


class Items:
    """Word ids of a block of test passages, concatenated with a 0 behind each; the suffixes long enough to count."""

    def __init__(self, rows: Iterable[tuple[int, str]], least: int):
        self.least = least
        vocab: dict[str, int] = {}
        ids, owner, offset = [], [], []
        self.item_ids = []
        for item, text in rows:
            words = WORD.findall((text or "").lower())
            if len(words) < least:
                continue
            k = len(self.item_ids)
            self.item_ids.append(item)
            ids += [vocab.setdefault(w, len(vocab) + 1) for w in words] + [0]
            owner += [k] * (len(words) + 1)
            offset += range(len(words) + 1)
        self.vocab = vocab
        self.ids, self.owner, self.offset = np.array(ids, np.int32), np.array(owner, np.int32), np.array(offset, np.int32)
        self.starts = np.flatnonzero(_run_left(self.ids) >= least)


def _run_left(ids: np.ndarray) -> np.ndarray:
    """For each position, the number of non-zero ids from it to the next 0."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.int64)
    stop = np.where(ids == 0, np.arange(n), n)
    return np.minimum.accumulate(stop[::-1])[::-1] - np.arange(n)


def suffix_array(ids: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in lexicographic order, by prefix doubling."""
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    k = 1
    while n > 1 and k < n:
        second = np.zeros(n, np.int64)
        second[:-k] = rank[k:] + 1
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            break
        k *= 2
    return order


def _bound(text: np.ndarray, sa: np.ndarray, want: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of each row of ``want`` among the suffixes; ``text`` is padded by the width of ``want``."""
    lo, hi = np.zeros(len(want), np.int64), np.full(len(want), len(sa), np.int64)
    width = np.arange(want.shape[1])
    while (lo < hi).any():
        mid = (lo + hi) // 2
        live = lo < hi
        at = text[sa[np.minimum(mid, len(sa) - 1)][:, None] + width]
        diff = at != want
        some = diff.any(1)
        first = diff.argmax(1)
        rows = np.arange(len(want))
        less = some & (at[rows, first] < want[rows, first])
        go = (less | ~some) if right else less
        lo = np.where(live & go, mid + 1, lo)
        hi = np.where(live & ~go, mid, hi)
    return lo


def search_shard(ids: np.ndarray, docs: np.ndarray, offsets: np.ndarray, items: Items):
    """Left-maximal matches of every test suffix in one shard: (doc index, item, longest length, word in doc, in item)."""
    least = items.least
    keep = _run_left(ids)
    good = np.zeros(len(ids), bool)
    # only stretches of at least `least` known words can hold a match; the rest of the shard needs no suffix
    starts = np.flatnonzero((keep >= least) & (np.concatenate([[True], ids[:-1] == 0]) if len(ids) else np.zeros(0, bool)))
    pieces = [np.arange(s, s + keep[s] + 1) for s in starts]
    if not pieces or not len(items.starts):
        return [np.zeros(0, np.int64)] * 5
    where = np.concatenate(pieces)
    where[np.cumsum([len(p) for p in pieces]) - 1] = -1
    del good
    packed = np.where(where >= 0, ids[where], 0)
    left = _run_left(packed)
    sa = suffix_array(packed)
    sa = sa[left[sa] >= least]
    text = np.concatenate([packed, np.zeros(least + 1, packed.dtype)])
    t = items.starts
    want = items.ids[t[:, None] + np.arange(least)]
    lo, hi = _bound(text, sa, want, False), _bound(text, sa, want, True)
    count = hi - lo
    test = np.repeat(t, count)
    pos = sa[np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
    before_t = np.where(items.offset[test] > 0, items.ids[np.maximum(test - 1, 0)], 0)
    before_p = np.where(pos > 0, packed[np.maximum(pos - 1, 0)], 0)
    maximal = (before_t == 0) | (before_t != before_p)
    test, pos = test[maximal], pos[maximal]
    length = np.full(len(test), least, np.int64)
    grow = np.ones(len(test), bool)
    ti = np.concatenate([items.ids, [0]])
    while grow.any():
        a, b = ti[np.minimum(test + length, len(ti) - 1)], text[np.minimum(pos + length, len(text) - 1)]
        grow = grow & (a == b) & (a != 0)
        length += grow
    src = where[pos]
    return docs[src], items.owner[test], length, offsets[src], items.offset[test]


def _search(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "item_id", "n_words", "doc_word", "item_word"]
    get = items.vocab.get
    ids: list[int] = []
    doc_ids: list[int] = []
    spans: list[int] = []

    def flush():
        arr = np.array(ids, np.int32)
        lens = np.array(spans, np.int64)
        docs = np.repeat(np.arange(len(lens)), lens)
        offs = np.arange(len(arr)) - np.repeat(np.cumsum(lens) - lens, lens)
        d, k, n, dw, iw = search_shard(arr, docs, offs, items)
        real = np.array(items.item_ids, np.int64)
        out = pa.RecordBatch.from_arrays(
            [pa.array(np.array(doc_ids, np.int64)[d] if len(d) else [], pa.int64()), pa.array(real[k] if len(d) else [], pa.int64()), pa.array(n, pa.int32()), pa.array(dw, pa.int32()), pa.array(iw, pa.int32())], names=names)
        ids.clear(), doc_ids.clear(), spans.clear()
        return out

    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            words = [get(w, 0) for w in WORD.findall(text.lower())]
            words.append(0)
            ids += words
            doc_ids.append(doc)
            spans.append(len(words))
            if len(ids) >= SHARD_WORDS:
                yield flush()
    if ids:
        yield flush()


def leaked_passages(documents: DataFrame, items: DataFrame, least: int = 12, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage") -> DataFrame:
    """(doc_id, item_id, n_words, doc_word, item_word): every left-maximal verbatim match of at least ``least`` words.

    Each task turns its documents into shards, sorts the suffixes of a shard and looks every suffix of every test
    passage up by binary search; the longest match and both positions (in words) follow from the place found. Words
    that occur in no test passage separate stretches and need no suffix. Test material is read in passes of
    ``ITEMS_PER_PASS`` items, so neither side has to be small; the corpus is never shuffled. Null texts, null ids and
    passages shorter than ``least`` words give no rows; repeated rows give one row each match. A document longer than
    a shard gets a shard of its own size.
    """
    docs = documents.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    tests = items.where(F.col(item_id).isNotNull() & F.col(passage).isNotNull()).select(F.col(item_id).cast("long"), passage).distinct()
    out, block = None, []

    def one_pass(rows):
        known = Items(rows, least)
        return docs.mapInArrow(lambda batches: _search(batches, known), HITS)

    for r in tests.toLocalIterator():
        block.append((r[0], r[1]))
        if len(block) >= ITEMS_PER_PASS:
            out = one_pass(block) if out is None else out.unionByName(one_pass(block))
            block = []
    if block or out is None:
        out = one_pass(block) if out is None else out.unionByName(one_pass(block))
    return out.distinct()


def decontaminate(documents: DataFrame, hits: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents without any hit, in whole rows."""
    bad = hits.select(F.col("doc_id").alias("_bad")).distinct()
    return documents.join(bad, documents[doc_id] == bad["_bad"], "left_anti")
