"""Within-block similarity of papers: TF-IDF, Jaccard, neighbours, pair records and field separation.

Papers of a block are numbered (record_index from 0). All pairs of a block are compared tile by tile: a block is cut
into tiles of ``TILE`` papers, and each pair of tiles is one small group, so no task holds a block and no pair becomes
a row unless pair records are asked for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockwise.common import cut_lineage, numbered_within, release, weighted_rank
from blockwise.functions.fields import coauthor_set, organization_tokens, target_org
from blockwise.functions.text import clean_text, title_tokens, tokens

TILE = 512
#: Similarities are compared and ranked after rounding, so that sums taken in another order tie alike.
DIGITS = 9


def numbered(cards: DataFrame) -> DataFrame:
    """Papers of each block numbered from 0 by record_index."""
    return numbered_within(cards, ["name"], ["record_index", "paper_id"], "i")


def tfidf(docs: DataFrame, keys: list[str], doc: str = "i", terms: str = "terms") -> DataFrame:
    """(keys, doc, term, weight): tf * (ln((1 + N) / (1 + df)) + 1), each document scaled to length 1.

    N counts all documents under a key, empty ones too; a document without terms has no row.
    """
    n = docs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_docs"))
    tf = docs.select(*keys, doc, F.explode(terms).alias("term")).groupBy(*keys, doc, "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("df"))
    w = tf.join(df, [*keys, "term"]).join(n, keys).withColumn("w", F.col("tf") * (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1))
    norm = w.groupBy(*keys, doc).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, [*keys, doc]).select(*keys, doc, "term", (F.col("w") / F.col("norm")).alias("weight"))


def views(cards: DataFrame) -> DataFrame:
    """(name, view, i, available, terms, weights): title as TF-IDF vector, organization tokens and coauthors as sets.

    Terms are hashes; only papers that are equal in all of them, or share some, are told from others.
    """
    hashed = lambda c: F.transform(c, lambda w: F.xxhash64(w))
    c = cards.select("name", "paper_id", "record_index", (clean_text("title") != "").alias("available"), hashed(title_tokens("title")).alias("title"), F.array_sort(hashed(organization_tokens())).alias("organization"), F.array_sort(hashed(coauthor_set())).alias("coauthor"))
    p = cut_lineage(numbered(c).drop("paper_id", "record_index"))
    v = tfidf(p.select("name", "i", F.col("title").alias("terms")), ["name"]).groupBy("name", "i").agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("v"))
    none, empty = F.array().cast("array<bigint>"), F.array().cast("array<double>")
    out = p.select("name", F.lit("title").alias("view"), "i", "available").join(v, ["name", "i"], "left").select("name", "view", "i", "available", F.coalesce("v.term", none).alias("terms"), F.coalesce("v.weight", empty).alias("weights"))
    for view in ("organization", "coauthor"):
        out = out.unionByName(p.select("name", F.lit(view).alias("view"), "i", (F.size(view) > 0).alias("available"), F.col(view).alias("terms")).withColumn("weights", F.transform("terms", lambda x: F.lit(1.0))))
    return out


#: Most classes of equal papers that a task holds on either side of its comparisons; up to ``DENSE`` go through dense products.
CHUNK, DENSE = 1 << 15, 768
_PART_SCHEMA = "name string, view string, c int, own double, n long, total double, squares double, top array<struct<sim:double,j:int>>, members array<int>"


def _best(order: np.ndarray, sims: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The five best papers of the five best classes of each row: similarities and numbers, padded with -1."""
    js = np.where(order[:, :, None] >= 0, high[order], -1).reshape(len(order), -1)
    s = np.where(js >= 0, np.repeat(sims, high.shape[1], 1), -1.0)
    by = np.lexsort((-js, -s), axis=1)[:, :5]
    return np.take_along_axis(s, by, 1), np.take_along_axis(js, by, 1)


class _Classes:
    """The classes of one block and view in a task, the one with the greatest paper first: terms as codes, flat."""

    def __init__(self, jaccard: bool, sizes: np.ndarray, terms: np.ndarray, weights: np.ndarray, count: np.ndarray, high: np.ndarray, asks: np.ndarray, given: np.ndarray):
        self.jaccard, self.sizes, self.count = jaccard, sizes, count.astype(float)
        self.codes = np.unique(terms, return_inverse=True)[1] if len(terms) else terms
        self.weights = np.ones(len(terms)) if jaccard else weights
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.high, self.asks = high, np.flatnonzero(asks)
        self.refs = np.flatnonzero(given)
        self.place = np.full(len(sizes), -1)
        self.place[self.refs] = np.arange(len(self.refs))

    def _sums(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = self.count[self.refs]
        return s @ count, (s * s) @ count

    def dense(self):
        rows = np.repeat(np.arange(len(self.sizes)), self.sizes)
        seen = np.bincount(self.codes)
        code, keep = np.cumsum(seen > 1) - 1, seen[self.codes] > 1 if len(self.codes) else np.zeros(0, bool)
        m = np.zeros((len(self.sizes), int((seen > 1).sum())))
        m[rows[keep], code[self.codes[keep]]] = self.weights[keep]
        s = m[self.asks] @ m[self.refs].T
        if self.jaccard:
            s = s / np.maximum(1, self.sizes[self.asks][:, None] + self.sizes[self.refs][None, :] - s)
        s = np.round(s, DIGITS)
        at = self.place[self.asks]
        s[np.flatnonzero(at >= 0), at[at >= 0]] = self.sizes[self.asks][at >= 0] > 0
        total, squares = self._sums(s)
        order, sims, each = np.full((len(s), 5), -1), np.full((len(s), 5), -1.0), np.arange(len(s))
        for k in range(min(5, s.shape[1])):
            order[:, k] = s.argmax(1)
            sims[:, k] = s[each, order[:, k]]
            s[each, order[:, k]] = -1.0
        return total, squares, order, sims

    def sparse(self):
        """Class by class over the lists of the classes that hold a term."""
        n, least = len(self.refs), 0.5 * 10.0**-DIGITS  # what is below rounds to 0
        rows = np.repeat(self.place, self.sizes)
        keep = rows >= 0
        by = np.argsort(self.codes[keep], kind="stable")
        rows, values = rows[keep][by], self.weights[keep][by]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(self.codes[keep], minlength=int(self.codes.max(initial=-1)) + 1))])
        sizes, count = self.sizes[self.refs].astype(float), self.count[self.refs]
        padded = np.zeros(-(-n // 64) * 64)
        acc, parts = padded[:n], padded.reshape(-1, 64)
        total, squares = np.zeros(len(self.asks)), np.zeros(len(self.asks))
        order, sims = np.full((len(self.asks), 5), -1), np.full((len(self.asks), 5), -1.0)
        for q, c in enumerate(self.asks.tolist()):
            lo, hi = self.starts[c], self.starts[c + 1]
            own, itself = self.place[c], float(hi > lo)
            lists = [(bounds[t], bounds[t + 1], w) for t, w in zip(self.codes[lo:hi].tolist(), self.weights[lo:hi].tolist())]
            if sum(b - a for a, b, _ in lists) * 8 < n:
                at = np.concatenate([*[rows[a:b] for a, b, _ in lists], [own] if own >= 0 else []]).astype(np.int64)
                at, inverse = np.unique(at, return_inverse=True)
                s = np.bincount(inverse, np.concatenate([*[values[a:b] * w for a, b, w in lists], [0.0] if own >= 0 else []]), len(at))
                if self.jaccard:
                    s = s / np.maximum(1, (hi - lo) + sizes[at] - s)
                if own >= 0:
                    s[np.searchsorted(at, own)] = itself
                total[q], squares[q] = s @ count[at], (s * s) @ count[at]
                some = s >= least
                at, s = at[some], s[some]
            else:
                acc[:] = 0.0
                for a, b, w in lists:
                    acc[rows[a:b]] += values[a:b] * w
                if self.jaccard:
                    np.divide(acc, (hi - lo) + sizes - acc, out=acc)
                if own >= 0:
                    acc[own] = itself
                total[q], squares[q] = acc @ count, (acc * acc) @ count
                tops = parts.max(1)
                fifth = np.partition(tops, -5)[-5] if len(tops) >= 5 else 0.0
                at = np.flatnonzero(acc >= max(least, fifth - 2 * 10.0**-DIGITS))
                s = acc[at]
            s = np.round(s, DIGITS)
            first = np.argsort(-s, kind="stable")[:5]  # of equal ones the first has the greatest paper
            k = len(first)
            order[q, :k], sims[q, :k] = at[first], s[first]
            if k < 5:  # all that are above 0 are known then
                free = np.ones(min(n, len(at) + 5), bool)
                free[at[at < len(free)]] = False
                rest = np.flatnonzero(free)[: 5 - k]
                order[q, k : k + len(rest)], sims[q, k : k + len(rest)] = rest, 0.0
        return total, squares, order, sims

    def compared(self, dense: int):
        """(total, squares, similarities, numbers) of every class that asks."""
        total, squares, order, sims = self.dense() if len(self.refs) <= dense else self.sparse()
        return total, squares, *_best(order, sims, self.high[self.refs])


def _compare(table: pa.Table, dense: int) -> pa.Table:
    """The classes of a task that ask against those that are given, block by block and view by view."""
    table = table.append_column("_high", pc.list_element(table["high"], 0)).sort_by([("name", "ascending"), ("view", "ascending"), ("_high", "descending")])
    col = {c: table[c].combine_chunks() for c in table.column_names}
    number = lambda c: col[c].to_numpy(zero_copy_only=False)
    kind = pc.dictionary_encode(col["name"]).indices.to_numpy() * 4 + pc.dictionary_encode(col["view"]).indices.to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(kind)) + 1).tolist(), len(kind)]
    off, high_off, w_off = (col[c].offsets.to_numpy() for c in ("terms", "high", "weights"))
    terms, high, weights = (col[c].values.to_numpy(zero_copy_only=False) for c in ("terms", "high", "weights"))
    papers, asks, given = number("papers"), number("asks"), number("given")
    out: dict[str, list] = {k: [] for k in ("at", "n", "total", "squares", "sims", "js")}
    for lo, hi in zip(cuts, cuts[1:]):
        if lo == hi:
            continue
        jaccard = col["view"][lo].as_py() != "title"
        top = np.full((hi - lo, 5), -1, np.int64)
        sizes = np.diff(high_off[lo : hi + 1])
        top[np.repeat(np.arange(hi - lo), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = high[high_off[lo] : high_off[hi]]
        c = _Classes(jaccard, np.diff(off[lo : hi + 1]), terms[off[lo] : off[hi]], weights[w_off[lo] : w_off[hi]], papers[lo:hi], top, asks[lo:hi], given[lo:hi])
        if len(c.asks) and len(c.refs):
            total, squares, sims, js = c.compared(dense)
            for k, v in (("at", lo + c.asks), ("n", np.full(len(total), papers[lo:hi][c.refs].sum())), ("total", total), ("squares", squares), ("sims", sims), ("js", js)):
                out[k].append(v)
    if not out["at"]:
        return pa.schema(_part_fields()).empty_table()
    v = {k: np.concatenate(x) for k, x in out.items()}
    at = pa.array(v["at"])
    known = v["js"] >= 0
    ends = np.concatenate([[0], np.cumsum(known.sum(1))]).astype(np.int32)
    tops = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(v["sims"][known]), pa.array(v["js"][known].astype(np.int32))], ["sim", "j"]))
    own = np.diff(off)[v["at"]] > 0
    return pa.Table.from_arrays([col["name"].take(at), col["view"].take(at), col["c"].take(at), pa.array(own.astype(float)), pa.array(v["n"].astype(np.int64)), pa.array(v["total"]), pa.array(v["squares"]), tops, col["members"].take(at)], schema=pa.schema(_part_fields()))


def _part_fields() -> list[pa.Field]:
    top = pa.list_(pa.struct([("sim", pa.float64()), ("j", pa.int32())]))
    return [pa.field(n, t) for n, t in (("name", pa.string()), ("view", pa.string()), ("c", pa.int32()), ("own", pa.float64()), ("n", pa.int64()), ("total", pa.float64()), ("squares", pa.float64()), ("top", top), ("members", pa.list_(pa.int32())))]


def neighbour_statistics(view_rows: DataFrame) -> DataFrame:
    """(name, view, i, n, total, squares, top): for every available paper the number of other available ones, sum and
    sum of squares of the similarities to them, and the four nearest (ties: the higher index first).

    Papers with equal terms are one class, and classes are compared: a class against the lists of classes that hold its
    terms, and the five best papers of all are kept, of which one may be the paper itself. The classes of a block are cut
    into chunks of about ``CHUNK`` on both sides, so a class is shuffled twice per chunk of its block; small blocks, which
    are one chunk, share tasks.
    """
    n = max(48, 4 * int(view_rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    usable = view_rows.where("available")
    same = usable.groupBy("name", "view", "terms", F.when(F.col("view") == "title", F.col("weights")).otherwise(F.array().cast("array<double>")).alias("weights")).agg(F.sort_array(F.collect_list("i"), asc=False).alias("members"))
    classes = cut_lineage(same.withColumn("c", F.element_at("members", -1)))
    release(view_rows.sparkSession)  # what the terms and their weights were shuffled in
    sized = classes.join(classes.groupBy("name", "view").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks")), ["name", "view"])
    part = lambda seed: F.pmod(F.xxhash64("c", F.lit(seed)), F.col("chunks")).cast("int")
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    placed = sized.withColumn("qa", part(1)).withColumn("ra", part(2)).withColumn("to", F.explode(F.array_distinct(F.concat(
        F.transform(every, lambda k: F.struct(F.col("qa").alias("q"), k.alias("r"))), F.transform(every, lambda k: F.struct(k.alias("q"), F.col("ra").alias("r")))))))
    asks, first = F.col("to.q") == F.col("qa"), (F.col("to.r") == 0) & (F.col("to.q") == F.col("qa"))
    bucket = F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("name", "view"), F.lit(8 * n))).otherwise(F.xxhash64("name", "view"))
    rows = placed.select(
        bucket.alias("bucket"), F.col("to.q").alias("q"), F.col("to.r").alias("r"), "name", "view", "c", "terms", "weights", F.size("members").alias("papers"), F.slice("members", 1, 5).alias("high"),
        F.when(first, F.col("members")).otherwise(F.array().cast("array<int>")).alias("members"), asks.alias("asks"), (F.col("to.r") == F.col("ra")).alias("given"))
    dense = DENSE
    found = rows.repartition(n, "bucket", "q", "r").groupBy("bucket", "q", "r").applyInArrow(lambda t: _compare(t, dense), _PART_SCHEMA)
    whole = found.groupBy("name", "view", "c").agg(F.max("own").alias("own"), F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.sort_array(F.flatten(F.collect_list("top")), asc=False).alias("top"), F.flatten(F.collect_list("members")).alias("members"))
    papers = whole.where("n > 1").withColumn("i", F.explode("members"))
    own = F.col("own")
    return papers.select("name", "view", "i", (F.col("n") - 1).alias("n"), (F.col("total") - own).alias("total"), (F.col("squares") - own).alias("squares"), F.slice(F.filter("top", lambda t: t["j"] != F.col("i")), 1, 4).alias("top"))


def pair_statistics(stats: DataFrame) -> DataFrame:
    """(name, view, pairs, mean, std): over the pairs i < j of available papers; std is the population's."""
    s = stats.groupBy("name", "view").agg((F.sum("n") / 2).alias("pairs"), (F.sum("total") / 2).alias("t"), (F.sum("squares") / 2).alias("q"))
    mean = F.col("t") / F.col("pairs")
    return s.select("name", "view", F.col("pairs").cast("long").alias("pairs"), mean.alias("pairwise_similarity_mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("pairs") - mean * mean)).alias("pairwise_similarity_std"))


def nearest_and_margin(stats: DataFrame) -> DataFrame:
    """(name, view, nearest mean, margin mean): papers with one other count for the nearest, with two for the margin."""
    first, second = F.get("top", F.lit(0))["sim"], F.get("top", F.lit(1))["sim"]
    return stats.groupBy("name", "view").agg(F.avg(first).alias("nearest_neighbor_similarity_mean"), F.avg(first - second).alias("nearest_neighbor_margin_mean"))


def top_neighbours(stats: DataFrame, k: int = 3) -> DataFrame:
    """(name, view, i, rank, j, similarity)."""
    return stats.select("name", "view", "i", F.posexplode(F.slice("top", 1, k)).alias("r", "t")).select("name", "view", "i", (F.col("r") + 1).alias("rank"), "t.j", F.col("t.sim").alias("similarity"))


def neighbour_agreement(stats: DataFrame, k: int = 3) -> DataFrame:
    """(name, first, second, agreement): mean Jaccard of the top-k sets of two views over papers with any neighbour."""
    sets = stats.select("name", "view", "i", F.transform(F.slice("top", 1, k), lambda t: t["j"]).alias("s"))
    wide = sets.groupBy("name", "i").agg(*[F.max(F.when(F.col("view") == v, F.col("s"))).alias(v) for v in ("title", "organization", "coauthor")])
    none = F.array().cast("array<int>")
    out = None
    for a, b in (("title", "organization"), ("title", "coauthor"), ("organization", "coauthor")):
        x, y = F.coalesce(a, none), F.coalesce(b, none)
        both, union = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
        part = wide.where(union > 0).groupBy("name").agg(F.avg(both / union).alias("agreement")).select("name", F.lit(a).alias("first"), F.lit(b).alias("second"), "agreement")
        out = part if out is None else out.unionByName(part)
    return out


VIEWS = ("title", "organization", "coauthor")


def block_statistics(stats: DataFrame, k: int = 3) -> DataFrame:
    """One row per block with what ``pair_statistics``, ``nearest_and_margin`` and ``neighbour_agreement`` give, as columns
    "view_metric", "first_second_neighbor_agreement" and "mean_cross_view_agreement": the statistics are read once."""
    first, second = F.get("top", F.lit(0))["sim"], F.get("top", F.lit(1))["sim"]
    own = F.struct("n", "total", "squares", first.alias("first"), (first - second).alias("margin"), F.transform(F.slice("top", 1, k), lambda t: t["j"]).alias("s"))
    wide = stats.groupBy("name", "i").agg(*[F.max(F.when(F.col("view") == v, own)).alias(v) for v in VIEWS])
    none = F.array().cast("array<int>")
    pairs = [(a, b) for at, a in enumerate(VIEWS) for b in VIEWS[at + 1 :]]
    for a, b in pairs:
        x, y = F.coalesce(F.col(a)["s"], none), F.coalesce(F.col(b)["s"], none)
        wide = wide.withColumn(f"{a}_{b}", F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))))
    sums = wide.groupBy("name").agg(
        *[F.sum(F.col(v)[c]).alias(f"{v}_{c}") for v in VIEWS for c in ("n", "total", "squares")],
        *[F.avg(F.col(v)[c]).alias(f"{v}_nearest_neighbor_{m}_mean") for v in VIEWS for c, m in (("first", "similarity"), ("margin", "margin"))],
        *[F.avg(f"{a}_{b}").alias(f"{a}_{b}_neighbor_agreement") for a, b in pairs])
    out = sums
    for v in VIEWS:
        mean = F.try_divide(F.col(f"{v}_total"), F.col(f"{v}_n"))
        out = out.withColumn(f"{v}_pairwise_similarity_mean", mean).withColumn(f"{v}_pairwise_similarity_std", F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col(f"{v}_squares"), F.col(f"{v}_n")) - mean * mean)))
        out = out.withColumn(f"{v}_pairwise_similarity_std", F.when(mean.isNotNull(), F.col(f"{v}_pairwise_similarity_std")))
    return out.withColumn("mean_cross_view_agreement", mean_of_available(*[F.col(f"{a}_{b}_neighbor_agreement") for a, b in pairs])).drop(*[f"{v}_{c}" for v in VIEWS for c in ("n", "total", "squares")])


def jaccard(a: Column, b: Column, policy: str = "either") -> Column:
    """Jaccard of two arrays as sets; null if either is empty ("either") or only if both are ("both")."""
    none = (F.size(a) == 0) | (F.size(b) == 0) if policy == "either" else (F.size(a) == 0) & (F.size(b) == 0)
    x = F.size(F.array_intersect(a, b))
    return F.when(~none, x / F.size(F.array_union(a, b)))


def mean_of_available(*values: Column) -> Column:
    """The mean of the values that are not null; null if none is."""
    known = F.filter(F.array(*values), lambda v: v.isNotNull())
    return F.try_divide(F.aggregate(known, F.lit(0.0), lambda acc, v: acc + v), F.size(known))


def block_pairs(papers: DataFrame, columns: list[str]) -> DataFrame:
    """All unordered pairs of a block with both sides' columns (suffix _i, _j): a join on the block and a pair of tiles.

    The result is quadratic in the block by definition; no single key holds more than 2 * TILE papers.
    """
    last = papers.groupBy("name").agg(F.floor(F.max("i") / TILE).cast("int").alias("last"))
    tile = F.floor(F.col("i") / TILE).cast("int")
    p = papers.join(last, "name")
    left = p.select("name", tile.alias("ta"), F.explode(F.sequence(tile, "last")).alias("tb"), *[F.col(c).alias(f"{c}_i") for c in columns])
    right = p.select("name", F.explode(F.sequence(F.lit(0), tile)).alias("ta"), tile.alias("tb"), *[F.col(c).alias(f"{c}_j") for c in columns])
    return left.join(right, ["name", "ta", "tb"]).where("i_i < i_j").drop("ta", "tb")


def shared_tokens(tokens: DataFrame) -> DataFrame:
    """(name, paper_i, paper_j, shared) with paper_i < paper_j: number of tokens that two papers of a block share, from
    an inverted index (name, paper_id, t).

    The papers of a token are cut into tiles of about ``TILE`` by a hash, and tiles are paired, so that a token that
    most papers of a block have is no single task; a pair is counted per token before tokens are added up.
    """
    n = tokens.groupBy("name", "t").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    p = tokens.join(n.where("tiles is not null"), ["name", "t"]).withColumn("own", F.pmod(F.xxhash64("paper_id"), F.col("tiles")).cast("int"))
    side = p.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("name", "t", "paper_id", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    a, b = side.alias("a"), side.alias("b")
    both = (F.col("a.name") == F.col("b.name")) & (F.col("a.t") == F.col("b.t")) & (F.col("a.p") == F.col("b.p")) & (F.col("a.q") == F.col("b.q")) & (F.col("a.paper_id") < F.col("b.paper_id"))
    both = both & ((F.col("a.own") != F.col("b.own")) | (F.col("a.p") == F.col("a.q")))
    return a.join(b, both).groupBy(F.col("a.name").alias("name"), F.col("a.paper_id").alias("paper_i"), F.col("b.paper_id").alias("paper_j")).agg(F.count(F.lit(1)).alias("shared"))


def _vectors(papers: DataFrame, terms: Column, name: str) -> DataFrame:
    docs = papers.select("name", "i", terms.alias("terms"))
    return tfidf(docs, ["name"]).groupBy("name", "i").agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias(name))


def tile_pairs(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, ta, tb, a, b): every pair ta <= tb of the tiles under a key, each tile as an array of structs of ``columns``
    (the first is the number "i") in the order of i.

    A tile is shuffled as one row, about the square root of the number of tiles under its key times; the pairs themselves
    come out of the join and are never shuffled.
    """
    n = max(48, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tiles = cut_lineage(rows.groupBy(*keys, F.floor(F.col("i") / TILE).cast("int").alias("tile")).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("rows")))
    salts = tiles.groupBy(*keys).agg(F.ceil(F.sqrt(F.max("tile") + 1)).cast("int").alias("salts"))
    t = tiles.join(salts, keys)
    left = t.select(*keys, F.col("tile").alias("ta"), F.pmod("tile", "salts").alias("salt"), F.col("rows").alias("a")).repartition(n, *keys, "salt")
    right = t.select(*keys, F.col("tile").alias("tb"), F.explode(F.sequence(F.lit(0), F.least(F.col("salts") - 1, "tile"))).alias("salt"), F.col("rows").alias("b")).repartition(n, *keys, "salt")
    return left.join(right, [*keys, "salt"]).where("ta <= tb").select(*keys, "ta", "tb", "a", "b")


def tile_groups(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, salt, right, tile, rows): the tiles under a key, each as an array of structs of ``columns`` (the first is the
    number "i") in the order of i, in groups by (key, salt) for ``each_tile_pair``: first the tiles of that salt, then all
    that they are compared with.

    A tile is shuffled as one row, about the square root of the number of tiles under its key times. Groups lie whole in
    partitions of about equal numbers of pairs, the largest first, so that no task runs on by itself at the end; pairs are
    formed in the task.
    """
    n = max(96, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tiles = cut_lineage(rows.groupBy(key, F.floor(F.col("i") / TILE).cast("int").alias("tile")).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("rows")))
    size = tiles.select(key, "tile", F.size("rows").alias("n"))
    sized = size.join(size.groupBy(key).agg(F.ceil(F.sqrt(F.max("tile") + 1)).cast("int").alias("salts"), F.sum("n").alias("papers")), key)
    work = sized.groupBy(key, F.pmod("tile", "salts").alias("salt")).agg(F.sum(F.col("n") * (F.col("papers") - F.col("tile") * TILE)).alias("work")).withColumn("less", -F.col("work"))
    before = cut_lineage(weighted_rank(work, [], ["less", key, "salt"], "work", "before"))
    place = F.least(F.lit(n - 1), F.floor(F.col("before") / before.agg(F.sum("work").alias("of")).scalar() * n)).cast("int")
    t = tiles.join(before.withColumn("place", place).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("salt", "place"))).alias("places")), key)
    own = F.get("places", F.pmod("tile", F.size("places")))
    left = t.select(key, "tile", "rows", F.lit(False).alias("right"), own.alias("g"))
    right = t.select(key, "tile", "rows", F.lit(True).alias("right"), F.explode(F.slice("places", F.lit(1), F.col("tile") + 1)).alias("g"))
    placed = left.unionByName(right).select(key, "g.salt", "right", "tile", "rows", "g.place").repartitionById(n, F.col("place"))
    return placed.drop("place").sortWithinPartitions(key, "salt", "right", "tile")


class _Side:
    """The papers of a tile as numpy arrays; list columns as flat values with the row of each."""

    def __init__(self, column: pa.ListArray, k: int):
        s = column[k].values
        self.n = len(s)
        self.field = {f.name: s.field(f.name) for f in s.type}

    def get(self, name: str) -> np.ndarray:
        return self.field[name].to_numpy(zero_copy_only=False)

    def sizes(self, name: str) -> np.ndarray:
        c = self.field[name]
        return np.diff(c.offsets.to_numpy())

    def flat(self, name: str) -> np.ndarray:
        return self.field[name].flatten().to_numpy(zero_copy_only=False)


def _products(x: _Side, y: _Side, terms: str, weights: str | None = None) -> np.ndarray:
    """The product of every row of x with every row of y over the terms that both sides have."""
    tx, ty = x.flat(terms), y.flat(terms)
    seen, code = np.unique(np.concatenate([tx, ty]), return_inverse=True)
    cx, cy = code[: len(tx)], code[len(tx) :]
    both = np.zeros(len(seen), bool)
    both[cx] = True
    there = np.zeros(len(seen), bool)
    there[cy] = True
    both &= there
    place, out = np.cumsum(both) - 1, []
    for side, c in ((x, cx), (y, cy)):
        keep = both[c]
        m = np.zeros((side.n, int(both.sum())))
        m[np.repeat(np.arange(side.n), side.sizes(terms))[keep], place[c[keep]]] = side.flat(weights)[keep] if weights else 1.0
        out.append(m)
    return out[0] @ out[1].T


def _sides(batches):
    """The sides of every pair of tiles, and whether they are one tile."""
    for batch in batches:
        ta, tb = batch.column("ta").to_numpy(), batch.column("tb").to_numpy()
        for k in range(batch.num_rows):
            yield _Side(batch.column("a"), k), _Side(batch.column("b"), k), ta[k] == tb[k]


def each_pair(batches):
    """(sides x, y, chosen pairs): of one tile with itself the pairs i < j, else all; rows are flat places in x * y."""
    for batch in batches:
        ta, tb = batch.column("ta").to_numpy(), batch.column("tb").to_numpy()
        for k in range(batch.num_rows):
            x, y = _Side(batch.column("a"), k), _Side(batch.column("b"), k)
            at = np.flatnonzero(np.triu(np.ones((x.n, y.n), bool), 1)) if ta[k] == tb[k] else np.arange(x.n * y.n)
            if len(at):
                yield batch, k, x, y, at


def each_tile_pair(batches):
    """(key, sides x, y, chosen pairs as ``each_pair`` has them) of every pair of tiles in the groups of ``tile_groups``."""
    group, own = None, []
    for batch in batches:
        key, salt, right, tile, rows = (batch.column(k) for k in range(5))
        salt, right, tile = salt.to_numpy(), right.to_numpy(zero_copy_only=False), tile.to_numpy()
        for k in range(batch.num_rows):
            here = key[k].as_py(), salt[k]
            if here != group:
                group, own = here, []
            y = _Side(rows, k)
            if not right[k]:
                own.append((tile[k], y))
                continue
            for ta, x in own:
                if ta <= tile[k]:
                    at = np.flatnonzero(np.triu(np.ones((x.n, y.n), bool), 1)) if ta == tile[k] else np.arange(x.n * y.n)
                    if len(at):
                        yield here[0], x, y, at


def _outer(x: _Side, y: _Side, name: str, at: np.ndarray) -> np.ndarray:
    return (x.get(name)[:, None] & y.get(name)[None, :]).ravel()[at]


def _known_papers(cards: DataFrame, truth: DataFrame) -> DataFrame:
    """The papers with a known author, numbered, with what a comparison needs; words and names as hashes."""
    hashed = lambda c: F.transform(c, lambda w: F.xxhash64(w))
    p = numbered(cards.join(truth.select("name", "paper_id", F.col("label").alias("author")), ["name", "paper_id"]))
    p = p.select("name", "i", "paper_id", F.xxhash64("author").alias("author"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("abstract", F.lit("")).alias("abstract"), target_org().alias("org"), hashed(coauthor_set()).alias("co"))
    p = cut_lineage(p.select("name", "i", "paper_id", "author", (clean_text("title") != "").alias("title_ok"), (clean_text("abstract") != "").alias("abstract_ok"), (F.col("org") != "").alias("org_ok"), F.xxhash64("org").alias("org"),
                             hashed(F.array_distinct(tokens("org"))).alias("ot"), "co", hashed(tokens("title")).alias("tt"), hashed(tokens("abstract")).alias("at")))
    none = F.array().cast("array<struct<term:bigint,weight:double>>")
    for view in ("t", "a"):
        v = tfidf(p.select("name", "i", F.col(f"{view}t").alias("terms")), ["name"]).groupBy("name", "i").agg(F.collect_list(F.struct("term", "weight")).alias("v"))
        v = p.select("name", "i").join(v, ["name", "i"], "left").select("name", "i", F.coalesce("v", none).alias("v"))
        p = p.drop(f"{view}t").join(v.select("name", "i", F.col("v.term").alias(f"{view}t"), F.col("v.weight").alias(f"{view}w")), ["name", "i"])
    return p


_COMPARED = ["author", "title_ok", "abstract_ok", "org_ok", "org", "ot", "co", "tt", "tw", "at", "aw"]
_RECORD_SCHEMA = (
    "author_block string, paper_i string, paper_j string, gt_same boolean, title_available boolean, title_cosine_similarity double, abstract_available boolean, abstract_cosine_similarity double, "
    "organization_available boolean, organization_exact_match boolean, organization_text_similarity double, coauthor_available_i boolean, coauthor_available_j boolean, shared_coauthor_count int, "
    "coauthor_jaccard_similarity double, coauthor_overlap_indicator boolean")


def _jaccards(x: _Side, y: _Side, terms: str, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(available, shared, union) of the pairs; available where neither set is empty."""
    sx, sy = x.sizes(terms), y.sizes(terms)
    shared = np.rint(_products(x, y, terms)).astype(np.int32)
    union = (sx[:, None] + sy[None, :]).astype(np.int32) - shared
    return ((sx > 0)[:, None] & (sy > 0)[None, :]).ravel()[at], shared.ravel()[at], np.maximum(union, 1).ravel()[at]


def _records(digits: int | None):
    half_up = (lambda v: np.floor(v * 10.0**digits + 0.5) / 10.0**digits) if digits is not None else lambda v: v

    def run(batches):
        for key, x, y, at in each_tile_pair(batches):
            own, other = at // y.n, at % y.n
            null = lambda v, known: pa.array(v, mask=~known)
            cos = lambda f, ok: null(half_up(np.clip(_products(x, y, f"{f}t", f"{f}w").ravel()[at], 0.0, 1.0)), ok)
            t_ok, a_ok, o_ok = (_outer(x, y, f"{f}_ok", at) for f in ("title", "abstract", "org"))
            j_ok, j_shared, j_union = _jaccards(x, y, "ot", at)
            c_ok, c_shared, c_union = _jaccards(x, y, "co", at)
            yield pa.RecordBatch.from_arrays([
                pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(at), np.int32)), pa.array([key])).dictionary_decode(), x.field["paper_id"].take(pa.array(own)), y.field["paper_id"].take(pa.array(other)), pa.array((x.get("author")[:, None] == y.get("author")[None, :]).ravel()[at]),
                pa.array(t_ok), cos("t", t_ok), pa.array(a_ok), cos("a", a_ok), pa.array(o_ok), null((x.get("org")[:, None] == y.get("org")[None, :]).ravel()[at], o_ok), null(half_up(j_shared / j_union), j_ok),
                pa.array((x.sizes("co") > 0)[own]), pa.array((y.sizes("co") > 0)[other]), null(c_shared, c_ok), null(half_up(c_shared / c_union), c_ok), null(c_shared > 0, c_ok),
            ], names=[c.split()[0] for c in _RECORD_SCHEMA.split(", ")])

    return run


def pair_records(cards: DataFrame, truth: DataFrame, digits: int | None = None) -> DataFrame:
    """One row per pair of papers of a block with a known author: similarities per field, null where not available, and
    rounded (half up) where ``digits`` are given."""
    p = _known_papers(cards, truth)
    return tile_groups(p, "name", ["i", "paper_id", *_COMPARED]).mapInArrow(_records(digits), _RECORD_SCHEMA)


#: Fields and metrics of the separation statistics.
FIELD_SPECS = [
    ("title", "title_cosine_similarity"), ("abstract", "abstract_cosine_similarity"), ("organization", "organization_text_similarity"),
    ("coauthor_jaccard", "coauthor_jaccard_similarity"), ("shared_coauthor_count", "shared_coauthor_count"),
]
#: Values are counted as whole multiples of 10 ** -DIGITS, cosines in bins of so many of them first; 0 has a bin of its own.
BIN = 1 << 16
_COUNT_SCHEMA = "field int, same boolean, key long, w long, s double"


def _tallied(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes that occur, all below ``size``, and how often; no sort unless there are far more codes than values."""
    if size > max(1 << 16, 4 * codes.size):
        return np.unique(codes, return_counts=True)
    n = np.bincount(codes.ravel(), minlength=1)
    at = np.flatnonzero(n)
    return at, n[at]


def _counts(wanted: dict[tuple[int, bool], list[int]] | None):
    """Sums over the pairs of a task: frequencies and sums by field, same author or not, and value (of cosines by bin, with
    the sum at the first one); with ``wanted`` the frequencies of the cosines in the bins named."""

    def run(batches):
        bins = 2 + 10**DIGITS // BIN
        cosines: dict = {}
        exact: dict = {}

        def add(f: int, same: bool, keys: np.ndarray, w: np.ndarray, scale: float) -> None:
            for key, n in zip(keys.tolist(), w.tolist()):
                old = exact.get((f, same, key), (0, 0.0))
                exact[f, same, key] = (old[0] + n, old[1] + n * key / scale)

        for x, y, itself in _sides(batches):
            equal = x.get("author")[:, None] == y.get("author")[None, :]

            def chosen(m: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
                """The entries of papers that have the field, of a tile with itself i < j."""
                if not own.all():
                    m = m[own]
                if not other.all():
                    m = m[:, other]
                return m[np.flatnonzero(own)[:, None] < np.flatnonzero(other)[None, :]] if itself else m

            for f, (name, c) in enumerate((("title", "t"), ("abstract", "a"))):
                if wanted is not None and not any(k[0] == f for k in wanted):
                    continue
                have = x.get(f"{name}_ok"), y.get(f"{name}_ok")
                v, same = np.clip(chosen(_products(x, y, f"{c}t", f"{c}w"), *have), 0.0, 1.0), chosen(equal, *have)
                key = np.rint(v * 10.0**DIGITS)
                if wanted is None:
                    n, s = cosines.setdefault(f, (np.zeros(2 * bins, np.int64), np.zeros(2)))
                    code = np.ceil(key / BIN).astype(np.int64)
                    code += bins * same
                    n += np.bincount(code.ravel(), minlength=2 * bins)
                    of_same = v[same].sum()
                    s += v.sum() - of_same, of_same
                else:
                    for (g, kind), some in wanted.items():
                        for b in some if g == f else []:
                            inside = (key > (b - 1) * BIN) & (key <= b * BIN)
                            add(f, kind, *np.unique(key[inside][same[inside] == kind].astype(np.int64), return_counts=True), 10.0**DIGITS)
            if wanted is None:
                for f, terms in ((2, "ot"), (3, "co")):
                    sx, sy = x.sizes(terms), y.sizes(terms)
                    have = sx > 0, sy > 0
                    if not have[0].any() or not have[1].any():
                        continue
                    shared = np.rint(_products(x, y, terms)).astype(np.int64)
                    union = sx[:, None].astype(np.int64) + sy[None, :] - shared
                    width = int(sx.max()) + int(sy.max()) + 1
                    codes, n = _tallied(chosen((shared * width + union) * 2 + equal, *have), 2 * width * width)
                    for code, m in zip(codes.tolist(), n.tolist()):
                        kind, s, u = bool(code % 2), code // 2 // width, code // 2 % width
                        for g, value in ((f, s / u), *(((4, float(s)),) if f == 3 else ())):
                            key = round(value * 10**DIGITS)
                            old = exact.get((g, kind, key), (0, 0.0))
                            exact[g, kind, key] = (old[0] + m, old[1] + m * value)
        rows = [(f, same, key, w, s) for (f, same, key), (w, s) in exact.items()]
        for f, (n, s) in cosines.items():
            some, sums = np.flatnonzero(n), s.tolist()
            for k in some.tolist():
                rows.append((f, k >= bins, k % bins, int(n[k]), sums[k >= bins]))
                sums[k >= bins] = 0.0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.float64()))], names=["field", "same", "key", "w", "s"])

    return run


def _at_ranks(keys: list[tuple[int, int]], ranks: list[int]) -> list[tuple[int, int]]:
    """(key, number of values below it) of the values with the given ranks; keys come sorted with their frequencies."""
    out, below, k = [], 0, 0
    for rank in ranks:
        while below + keys[k][1] <= rank:
            below += keys[k][1]
            k += 1
        out.append((keys[k][0], below))
    return out


def field_separation(cards: DataFrame, truth: DataFrame) -> DataFrame:
    """Per field: available, same-author and other pairs of papers with known authors, means and medians of both, and the
    gap of the means.

    All pairs are compared, none becomes a row. A first pass adds up frequencies: of the sets by value, of the cosines
    by bin (at most 10 ** DIGITS / BIN of them); a second one takes the exact values in the bins that hold a median.
    """
    spark = cards.sparkSession
    tiles = tile_pairs(_known_papers(cards, truth), ["name"], ["i", *_COMPARED])
    summed = lambda wanted: tiles.mapInArrow(_counts(wanted), _COUNT_SCHEMA).groupBy("field", "same", "key").agg(F.sum("w").alias("w"), F.sum("s").alias("s")).collect()
    first: dict = {}
    for r in summed(None):  # bins and values of sets, as many for any number of papers
        first.setdefault((r["field"], r["same"]), []).append((r["key"], r["w"], r["s"]))
    n, total, found = {k: sum(x[1] for x in v) for k, v in first.items()}, {k: sum(x[2] for x in v) for k, v in first.items()}, {}
    wanted: dict = {}
    for k, v in first.items():
        found[k] = _at_ranks(sorted(x[:2] for x in v), [(n[k] - 1) // 2, n[k] // 2])
        if k[0] < 2 and any(b for b, _ in found[k]):
            wanted[k] = sorted({b for b, _ in found[k]})
    exact: dict = {}
    for r in summed(wanted) if wanted else []:  # the values of at most two bins each
        exact.setdefault((r["field"], r["same"]), []).append((r["key"], r["w"]))
    for k in wanted:
        below = found[k][0][1]
        ranks = [(n[k] - 1) // 2 - below, n[k] // 2 - below]
        found[k] = _at_ranks(sorted(exact[k]), ranks)
    median = {k: sum(v for v, _ in f) / 2 / 10**DIGITS for k, f in found.items()}
    mean = {k: total[k] / n[k] for k in n}
    rows = []
    for f, (field, metric) in enumerate(FIELD_SPECS):
        a, b = (f, True), (f, False)
        if a in n or b in n:
            gap = mean[a] - mean[b] if a in n and b in n else None
            rows.append((field, metric, n.get(a, 0) + n.get(b, 0), n.get(a, 0), n.get(b, 0), mean.get(a), mean.get(b), median.get(a), median.get(b), gap))
    return spark.createDataFrame(rows, "field string, metric string, available_pair_count long, same_pair_count long, different_pair_count long, same_mean double, different_mean double, same_median double, different_median double, separation_gap double")
