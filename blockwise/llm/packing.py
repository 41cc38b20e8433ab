"""Filling fixed-capacity containers with items of varying length: large-item matching over the size histogram."""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwise.common import cut_lineage, weighted_rank

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits text before the merges of the byte-level vocabulary (fixed value of that vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load_tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _whole_characters(encoding, tokens: list[int], at: int) -> int:
    """The greatest cut <= at that does not split a character; ``at`` itself if there is none."""
    for cut in range(at, max(at - 4, 0), -1):
        if cut >= len(tokens) or encoding.decode_single_token_bytes(tokens[cut])[0] & 0xC0 != 0x80:
            return cut
    return at


def cut_tokens(encoding, text: str, capacity: int) -> list[tuple[int, int]]:
    """Token ranges of the pieces of a text: one if it fits, else full pieces, cut between characters, and a rest."""
    tokens = encoding.encode_ordinary(text)
    out, start = [], 0
    while len(tokens) - start > capacity:
        cut = _whole_characters(encoding, tokens, start + capacity)
        if cut <= start:
            cut = start + capacity
        out.append((start, cut))
        start = cut
    if len(tokens) > start:
        out.append((start, len(tokens)))
    return out


def pack_sizes(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Pack ``histogram[size]`` items of each size; gives (slots, number of containers).

    A slot (size, first, count, container) puts the items of that size with ranks first .. first + count - 1 into the
    containers container, container + 1, ... Sizes above a third of the capacity come first, largest first: each is
    matched with the largest other such item that fits, so that a container holds at most two of them. Smaller sizes,
    largest first, go to the containers with the least room that still takes them, then to new ones.
    Work and memory depend on the number of distinct sizes, at most ``capacity``, not on the number of items.
    """
    left = {s: n for s, n in histogram.items() if n > 0}
    if any(s <= 0 or s > capacity for s in left):
        raise ValueError("sizes must be between 1 and the capacity")
    used = dict.fromkeys(left, 0)
    slots: list[tuple[int, int, int, int]] = []
    rooms: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    made = 0

    def put(size: int, count: int, container: int) -> None:
        slots.append((size, used[size], count, container))
        used[size] += count
        left[size] -= count

    def free(room: int, container: int, count: int) -> None:
        if room > 0 and count > 0:
            if room not in rooms:
                rooms[room] = []
                insort(order, room)
            rooms[room].append((container, count))

    big = sorted(s for s in left if 3 * s > capacity)
    while big:
        a = big[-1]
        if left[a] == 0:
            big.pop()
            continue
        i = bisect_left(big, capacity - a + 1) - 1
        while i >= 0 and (left[big[i]] == 0 or (big[i] == a and left[a] < 2)):
            i -= 1
        if i < 0:
            n = left[a]
            put(a, n, made)
            free(capacity - a, made, n)
        else:
            b = big[i]
            n = left[a] // 2 if a == b else min(left[a], left[b])
            put(a, n, made)
            put(b, n, made)
            free(capacity - a - b, made, n)
        made += n
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[s]:
            i = bisect_left(order, s)
            if i == len(order):
                break
            room = order[i]
            container, count = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                order.pop(i)
            n = min(count, left[s])
            if n < count:
                free(room, container + n, count - n)
            put(s, n, container)
            free(room - s, container, n)
        if left[s]:
            each = capacity // s
            full = left[s] // each
            rest = left[s] - full * each
            for _ in range(each):
                if full:
                    put(s, full, made)
            free(capacity - each * s, made, full)
            made += full
            if rest:
                for _ in range(rest):
                    put(s, 1, made)
                free(capacity - rest * s, made, 1)
                made += 1
    return slots, made


def token_pieces(documents: DataFrame, capacity: int, tokenizer: str = TOKENIZER, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece_no, token_start, token_end): the items to pack. Null and empty texts and null ids have none."""
    docs = documents.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("long"), F.col(text))
    documents.sparkSession.sparkContext.addFile(tokenizer)  # the vocabulary is sent to the executors

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_tokenizer(SparkFiles.get(os.path.basename(tokenizer)))
        for b in batches:
            rows: list[tuple] = []
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows += [(doc, k, s, e) for k, (s, e) in enumerate(cut_tokens(encoding, t, capacity))]
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names=["doc_id", "piece_no", "token_start", "token_end"])

    return docs.mapInArrow(count, "doc_id long, piece_no int, token_start int, token_end int")


def fill_containers(documents: DataFrame, capacity: int = 2048, tokenizer: str = TOKENIZER, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece_no, token_start, token_end, n_tokens, container_id) for every document, whole.

    A text is cut only if it exceeds a container by itself. All containers together are one packing of the whole
    collection: the driver packs the histogram of sizes (at most ``capacity`` rows), then every item finds its place
    from its rank among the items of its size; ranks come from a range-partitioned sort with partition offsets, so a
    size shared by a third of all items is no single task. Ties in size go by id and piece. Repeated (id, text) rows
    count once; null or empty texts and null ids are no items; an empty table gives no rows.
    """
    docs = documents.select(doc_id, text).groupBy(doc_id, F.xxhash64(F.lit(1), text).alias("_h1"), F.xxhash64(F.lit(2), text).alias("_h2")).agg(F.first(text).alias(text)).select(doc_id, text)
    pieces = token_pieces(docs, capacity, tokenizer, doc_id, text)
    pieces = cut_lineage(pieces.select("*", (F.col("token_end") - F.col("token_start")).alias("n_tokens"), F.lit(1).alias("one"), F.struct("doc_id", "piece_no", "token_start", "token_end").alias("item")))
    histogram = {r["n_tokens"]: r["n"] for r in pieces.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    slots, _ = pack_sizes(histogram, capacity)
    ranked = weighted_rank(pieces.select("n_tokens", "item", "one"), ["n_tokens"], "item", "one", "rank").select("item.*", "n_tokens", "rank")
    by_size: dict[int, list] = {}
    for s, first, n, container in slots:
        by_size.setdefault(s, []).append((first, container))
    table = {s: (np.array([f for f, _ in sorted(v)]), np.array([c for _, c in sorted(v)])) for s, v in by_size.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column(4).to_numpy(zero_copy_only=False)
            rank = b.column(5).to_numpy(zero_copy_only=False)
            at = np.zeros(b.num_rows, np.int64)
            for s in np.unique(size):
                first, container = table[int(s)]
                rows = np.flatnonzero(size == s)
                k = np.searchsorted(first, rank[rows], "right") - 1
                at[rows] = container[k] + rank[rows] - first[k]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(at)], names=["doc_id", "piece_no", "token_start", "token_end", "n_tokens", "container_id"])

    return ranked.mapInArrow(place, "doc_id long, piece_no int, token_start int, token_end int, n_tokens int, container_id long")
