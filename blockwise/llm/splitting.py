"""Splitting oversized prompts at natural boundaries (dynamic programming over boundary positions)."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cost of ending a piece at a boundary of each level: between records, line end, sentence end, blank, anywhere.
LEVEL_COST = np.array([0.0, 4.0, 8.0, 20.0, 60.0])
LEVEL_NAME = ["record", "line", "sentence", "blank", "hard"]
#: Weight of the squared unused share of a piece, and the cost of each further piece.
IMBALANCE, PIECE = 1.0, 0.5
RECORD = re.compile(r"(?m)^\[record_index[ \t]+\d+\]")
_LINE, _SENTENCE, _BLANK = re.compile(r"\n+"), re.compile(r"[.!?。！？][\"')\]]*\s+"), re.compile(r"\s+")

PIECES = "request_id long, model string, piece_no int, n_pieces int, start int, end int, n_tokens int, first_record int, last_record int, repeated_records int, cut string, text string"


def _inner_boundaries(text: str, lo: int, hi: int, room: int) -> list[tuple[int, int]]:
    """Boundaries (position, level) strictly inside text[lo:hi], a stretch longer than the limit.

    Weaker levels are only opened where the stronger ones leave a stretch beyond ``room``.
    """
    found: dict[int, int] = {}

    def gaps() -> list[tuple[int, int]]:
        at = [lo, *sorted(found), hi]
        return [(a, b) for a, b in zip(at, at[1:]) if b - a > room]

    for level, pattern in ((1, _LINE), (2, _SENTENCE), (3, _BLANK)):
        for a, b in gaps():
            for m in pattern.finditer(text, a, b):
                if lo < m.end() < hi:
                    found.setdefault(m.end(), level)
    step = max(1, room - 1)  # one less, as a cut between \r and \n is moved
    for a, b in gaps():
        for p in range(a + step, b, step):
            if text[p - 1 : p + 1] == "\r\n":
                p += 1
            found.setdefault(p, 4)
    return sorted((p, lv) for p, lv in found.items() if lo < p < hi)


def split_text(text: str, limit_tokens: int, overlap: int) -> list[tuple[int, int, int]]:
    """Pieces (start, end, level of the cut at the end) of at most ``limit_tokens`` = floor(characters / 4).

    Pieces end between records unless a record alone exceeds the limit. The next piece begins ``overlap`` records
    before the cut; where these and the next record do not fit together, as many of them as fit are repeated.
    After a cut inside an oversized record the repeated units are lines or sentences of that record, at most a
    quarter of the limit; where these are longer, words or stretches of text, so that something is repeated. The chosen cuts minimise cut costs plus imbalance over all admissible cut sequences.
    """
    size, limit = len(text), 4 * max(0, limit_tokens) + 3
    if size <= limit:
        return [(0, size, 0)]
    starts = [m.start() for m in RECORD.finditer(text)]
    edges = sorted({0, *starts, size})
    at: list[int] = []
    level: list[int] = []
    for a, b in zip(edges, edges[1:]):
        if b - a > limit:
            for p, lv in _inner_boundaries(text, a, b, limit // 4 if overlap else limit // 2):
                at.append(p)
                level.append(lv)
        at.append(b)
        level.append(0)
    pos, lev = np.array([0, *at]), np.array([0, *level])
    n = len(pos)
    is_record = np.isin(pos, np.array(starts, dtype=pos.dtype)) if starts else np.zeros(n, dtype=bool)
    # where the next piece begins if this one ends at boundary i: as far back as the overlap and the room allow
    begin = pos.copy()
    for i in range(1, n - 1):
        nxt = pos[i + 1]
        if lev[i] == 0:
            back, j = 0, i - 1
            while j > 0 and back < overlap:
                if is_record[j]:
                    if nxt - pos[j] > limit:
                        break
                    begin[i] = pos[j]
                    back += 1
                elif lev[j] == 0:
                    break
                j -= 1
        else:
            back, j = 0, i - 1
            while j > 0 and back < overlap and pos[i] - pos[j] <= limit // 4 and nxt - pos[j] <= limit:
                begin[i] = pos[j]
                if lev[j] == 0:
                    break
                back += 1
                j -= 1
    best, prev = np.full(n, np.inf), np.full(n, -1)
    best[0] = 0.0
    cost = LEVEL_COST[lev]
    cost[-1] = 0.0
    lows = np.searchsorted(pos, pos - limit)  # earlier boundaries are out of reach
    for i in range(1, n):
        lo = int(lows[i])
        length = pos[i] - begin[lo:i]
        ok = (length <= limit) & np.isfinite(best[lo:i])
        if ok.any():
            total = np.where(ok, best[lo:i] + PIECE + IMBALANCE * ((limit - length) / limit) ** 2, np.inf)
            k = int(np.argmin(total))
            best[i], prev[i] = total[k] + cost[i], lo + k
    out = []
    i = n - 1
    while i > 0:
        k = int(prev[i])
        out.append((int(begin[k]), int(pos[i]), int(lev[i])))
        i = k
    return out[::-1]


def split_oversized(requests: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces of every prompt whose floor(characters / 4) exceeds its model's prompt_limit; other prompts are one piece.

    Result: one row per (request, piece), see ``PIECES``; offsets and lengths count Unicode code points, and
    repeated_records says how many records of the piece before stand in this one (fewer than specified where they and
    the next record do not fit together). Redelivered
    rows (same id, model and prompt) count once. A null prompt, a null model or a model without a limit gives no row;
    an empty prompt gives one empty piece; a null overlap counts as 0. Records are found by their heading, whatever
    stands between them. The limits table has one row per model and is joined by a hint-free equi join; the prompts of
    unequal size never meet in one task: each row is split by itself in Arrow batches.
    """
    lim = limits.groupBy("model").agg(F.min("prompt_limit").alias("_limit"), F.max(F.coalesce("overlap_records", F.lit(0))).alias("_overlap")).where("_limit is not null")
    q = requests.select("request_id", "model", "prompt").where("prompt is not null").groupBy("request_id", "model", F.xxhash64(F.lit(1), "prompt").alias("_h1"), F.xxhash64(F.lit(2), "prompt").alias("_h2")).agg(F.first("prompt").alias("prompt")).select("request_id", "model", "prompt").join(lim, "model")
    tokens = F.floor(F.length("prompt") / 4)
    small = q.where(tokens <= F.col("_limit")).select(
        "request_id", "model", F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start"), F.length("prompt").alias("end"), tokens.cast("int").alias("n_tokens"),
        F.lit(0).alias("first_record"), (F.regexp_count("prompt", F.lit(RECORD.pattern)) - 1).cast("int").alias("last_record"), F.lit(0).alias("repeated_records"), F.lit("record").alias("cut"), F.col("prompt").alias("text"))
    large = q.where(tokens > F.col("_limit")).mapInArrow(_split_batches, PIECES)
    return large.unionByName(small)


def _split_batches(batches):
    names = ["request_id", "model", "piece_no", "n_pieces", "start", "end", "n_tokens", "first_record", "last_record", "repeated_records", "cut", "text"]
    kinds = [pa.int64(), pa.string(), *[pa.int32()] * 8, pa.string(), pa.string()]
    for b in batches:
        rows: list[list] = [[] for _ in names]
        for r in b.to_pylist():
            pieces = split_text(r["prompt"], r["_limit"], r["_overlap"])
            heads = [m.start() for m in RECORD.finditer(r["prompt"])]
            before = 0
            for no, (s, e, lv) in enumerate(pieces):
                again = sum(s <= h < before for h in heads)
                before = e
                first = int(np.searchsorted(heads, s, "right") - 1) if heads else -1
                last = int(np.searchsorted(heads, e, "left") - 1) if heads else -1
                for col, v in zip(rows, (r["request_id"], r["model"], no, len(pieces), s, e, (e - s) // 4, max(first, 0), last, again, LEVEL_NAME[lv], r["prompt"][s:e])):
                    col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=names)
