"""Contexts (orders and groups of records) and prompts built from them.

A context row is (name, condition, repetition, group_no, position, record_index) with the fields of the record.
"""

from __future__ import annotations

import random
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockwise.common import cut_lineage, numbered_within
from blockwise.functions.fields import alnum_coauthor_set, organization_tokens
from blockwise.functions.text import tokens
from blockwise.operators.graph import bipartite_components
from blockwise.operators.selection import chronological, organization_groups
from blockwise.operators.similarity import _vectors, numbered

#: Seeds of the three shuffled repetitions (fixed values).
SEEDS = (101, 202, 303)
CONTRACT = "Answer with one JSON object: assignments maps every record_index to a cluster id, labels maps every cluster id to a short name."
INSTRUCTIONS = {
    "minimal": "Group the records by author.",
    "task_definition": "Group the records by author. All of them carry the same name; records of one person belong together, records of different people do not.",
}
INSTRUCTIONS["evidence_guidance"] = INSTRUCTIONS["task_definition"] + " Weigh shared coauthors first, then organizations, then topics."
INSTRUCTIONS["error_aware"] = INSTRUCTIONS["task_definition"] + " Do not merge people because of a common topic, and do not split a person because of a move."
INSTRUCTIONS["analyze_then_cluster"] = INSTRUCTIONS["evidence_guidance"] + " First work out who the people are, then assign every record."


SPLIT_TASK = "These records were put together. Split them where they belong to different people; keep them whole otherwise."
#: Characters of a compact prompt beside its records and the name.
FIXED_LENGTH = len("Author name: ") + len(INSTRUCTIONS["minimal"]) + len(CONTRACT) + 3 * len("\n\n")


def prompt_texts() -> dict[str, str]:
    return dict(INSTRUCTIONS)


def record_text() -> Column:
    """A record as lines of text; empty coauthors are left out."""
    people = F.array_join(F.filter("coauthors", lambda x: x != ""), "; ")
    orgs = F.array_join(F.filter("organization", lambda x: x != ""), "; ")
    return F.concat_ws("\n", F.concat(F.lit("Paper ID: P"), (F.col("i") + 1).cast("string")), F.concat(F.lit("Title: "), F.coalesce("title", F.lit(""))), F.concat(F.lit("Organization: "), orgs), F.concat(F.lit("Coauthors: "), people))


def record_json() -> Column:
    """A record as a compact JSON object."""
    return F.to_json(F.struct(F.col("i").alias("record_index"), F.coalesce("title", F.lit("")).alias("title"), F.col("organization"), F.col("coauthors")))


def block_prompts(cards: DataFrame, instruction: str = "minimal", as_text: bool = False) -> DataFrame:
    """(name, prompt): instruction, the records of the block in order, and the contract of the answer.

    The prompt of a block is one string by definition; records are gathered in order with their text only.
    """
    p = numbered(cards).select("name", "i", (record_text() if as_text else record_json()).alias("r"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "r"))), lambda x: x["r"]), "\n\n" if as_text else "\n")
    return p.groupBy("name").agg(joined.alias("records")).select("name", F.concat_ws("\n\n", F.concat(F.lit("Author name: "), F.col("name")), F.lit(INSTRUCTIONS[instruction]), F.col("records"), F.lit(CONTRACT)).alias("prompt"))


def split_prompt(members: DataFrame) -> DataFrame:
    """(name, cluster_index, prompt): a second look at the records of one mixed cluster."""
    r = members.select("name", "cluster_index", "i", record_json().alias("r")).groupBy("name", "cluster_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "r"))), lambda x: x["r"]), "\n").alias("records"))
    return r.select("name", "cluster_index", F.concat_ws("\n\n", F.lit(SPLIT_TASK), F.col("records"), F.lit(CONTRACT)).alias("prompt"))


def prompt_size(cards: DataFrame) -> DataFrame:
    """(name, papers, tokens, tokens_per_paper) of the compact prompt, without making it: lengths are added up."""
    p = numbered(cards).select("name", F.length(record_json()).alias("n"))
    t = F.floor((F.sum("n") + F.count(F.lit(1)) - 1 + F.lit(FIXED_LENGTH) + F.first(F.length("name"))) / 4)
    return p.groupBy("name").agg(F.count(F.lit(1)).alias("papers"), t.alias("tokens")).withColumn("tokens_per_paper", F.col("tokens") / F.col("papers"))


def _shuffle(seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        order = sorted(pdf["i"])
        random.Random(seed).shuffle(order)
        return pd.DataFrame({"name": pdf["name"].iloc[0], "i": order, "position": range(len(order))})

    return run


def random_order(cards: DataFrame, seed: int) -> DataFrame:
    """(name, i, position): the records of each block shuffled by Python's generator with this seed.

    Only record numbers go to Python; a block's order is one permutation and so one group.
    """
    return _shuffled(numbered(cards), seed)


def _shuffled(p: DataFrame, seed: int) -> DataFrame:
    return p.select("name", "i").groupBy("name").applyInPandas(_shuffle(seed), "name string, i int, position int")


class _Rows:
    """Sparse rows of one field, kept by their terms: the products of one row with all rows from the rows that share a
    term with it."""

    def __init__(self, keys: list, values: list | None = None):
        self.sizes, self.n = np.array([len(k) for k in keys]), len(keys)
        codes: dict = {}
        self.cols = np.array([codes.setdefault(x, len(codes)) for k in keys for x in k], dtype=np.int64)
        self.vals = np.ones(len(self.cols)) if values is None else np.array([v for row in values for v in row], dtype=float)
        self.ends = np.cumsum(self.sizes)
        by_term = np.argsort(self.cols, kind="stable")
        self.rows, self.weights = np.repeat(np.arange(self.n), self.sizes)[by_term], self.vals[by_term]
        self.starts = np.searchsorted(self.cols[by_term], np.arange(len(codes) + 1))

    def products(self, k: int) -> np.ndarray:
        part = slice(self.ends[k] - self.sizes[k], self.ends[k])
        first, last = self.starts[self.cols[part]], self.starts[self.cols[part] + 1]
        many = last - first
        at = np.arange(many.sum()) + np.repeat(first - np.cumsum(many) + many, many)
        return np.bincount(self.rows[at], self.weights[at] * np.repeat(self.vals[part], many), self.n)


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """Greedy nearest-neighbour chain from the least paper id; candidates by score (to nine digits), then id.

    A step goes through the records that share a term with the current one and once over the scores of all, so a block
    of n records takes n * n simple operations in numpy beside those, and memory for its entries.
    """
    pdf = pdf.sort_values("paper_id").reset_index(drop=True)
    titles = [dict(t or {}) for t in pdf["tv"]]
    fields = [_Rows([list(t) for t in titles], [list(t.values()) for t in titles]), _Rows([list(x) for x in pdf["ot"]]), _Rows([list(x) for x in pdf["co"]])]
    left = np.ones(len(pdf), dtype=bool)
    order = [0]
    left[0] = False
    for _ in range(len(pdf) - 1):
        cur = order[-1]
        total, known = fields[0].products(cur), np.ones(len(pdf))
        for f in fields[1:]:
            shared = f.products(cur)
            union = f.sizes + f.sizes[cur] - shared
            total = total + np.divide(shared, union, out=np.zeros(len(pdf)), where=union > 0)
            known = known + (union > 0)
        score = np.where(left, np.round(total / known, 9), -1.0)
        order.append(int(score.argmax()))  # the first of equal ones has the least id
        left[order[-1]] = False
    return pd.DataFrame({"name": pdf["name"].iloc[0], "i": pdf["i"].to_numpy()[order], "position": range(len(order))})


def similarity_chain(cards: DataFrame) -> DataFrame:
    """(name, i, position): each record followed by the most similar one left (mean of title cosine, organization and
    coauthor Jaccard where available). Sequential within a block by its definition."""
    return _chained(numbered(cards))


def _chained(p: DataFrame) -> DataFrame:
    p = cut_lineage(p.select("name", "i", "paper_id", "title", organization_tokens().alias("ot"), alnum_coauthor_set().alias("co")))
    p = p.join(_vectors(p, tokens("title"), "tv"), ["name", "i"], "left").drop("title")
    return p.groupBy("name").applyInPandas(_chain, "name string, i int, position int")


#: The arrangements of ``contexts``.
CONDITIONS = ("original_flat", "chronological_order", "organization_grouped", "coauthor_network", "multifield_similarity", "random_order")


def contexts(cards: DataFrame, conditions: list[str] | tuple[str, ...] = CONDITIONS) -> DataFrame:
    """(name, condition, repetition, group_no, position, i): six arrangements of the same records, or those named.

    original_flat, chronological_order, random_order (three repetitions), organization_grouped, coauthor_network and
    multifield_similarity; group_no is null for flat ones. Only those asked for are worked out, each by itself,
    so that no plan holds them all.
    """
    p = cut_lineage(numbered(cards))
    flat = lambda df, condition, position, repetition=0: df.select("name", F.lit(condition).alias("condition"), F.lit(repetition).alias("repetition"), F.lit(None).cast("int").alias("group_no"), position.alias("position"), "i")
    by_group = lambda df, cond: numbered_within(cut_lineage(df.select("name", "group_no", "i")), ["name"], ["group_no", "i"], "position").select("name", F.lit(cond).alias("condition"), F.lit(0).alias("repetition"), "group_no", "position", "i")

    def network() -> DataFrame:
        co = p.select("name", "i", alnum_coauthor_set().alias("co"))
        comp = bipartite_components(co.select("name", "i", F.explode("co").alias("token")), co, ["name"])
        groups = numbered_within(comp.select("name", "component").distinct(), ["name"], ["component"], "group_no").withColumn("group_no", F.col("group_no") + 1)
        return by_group(comp.join(groups, ["name", "component"]), "coauthor_network")

    made = {
        "original_flat": lambda: [flat(p, "original_flat", F.col("i"))],
        "chronological_order": lambda: [flat(chronological(p), "chronological_order", F.col("place") - 1)],
        "organization_grouped": lambda: [by_group(organization_groups(p), "organization_grouped")],
        "coauthor_network": lambda: [network()],
        "multifield_similarity": lambda: [flat(_chained(p), "multifield_similarity", F.col("position"))],
        "random_order": lambda: [flat(_shuffled(p, seed), "random_order", F.col("position"), rep) for rep, seed in enumerate(SEEDS)],
    }
    return reduce(DataFrame.unionByName, [df for c in CONDITIONS if c in conditions for df in map(cut_lineage, made[c]())])


def group_label(group_no: Column) -> Column:
    return F.concat(F.lit("Group "), group_no.cast("string"))


CONTEXT_TASK = (
    "Every record below carries an author whose normalized name is {name}; different people may share it. Build broad candidate clusters for a later, finer step. "
    "Papers of one person must not be parted; a doubtful paper goes to the broadest cluster that may hold it; no cluster may take nearly everything. Use title, organization and coauthors only."
)


def context_prompts(arranged: DataFrame, cards: DataFrame) -> DataFrame:
    """(name, condition, repetition, prompt): the prompt of each arrangement made by ``contexts``.

    Records stand as compact JSON in the order of the arrangement; where it has groups, as groups named "Group k" in
    the order of their numbers. A prompt is one string per block and arrangement by definition.
    """
    r = numbered(cards.select("name", "paper_id", "record_index", "title", "organization", "coauthors")).select("name", "i", record_json().alias("r"))
    rows = arranged.join(r, ["name", "i"])
    in_order = lambda extra: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*extra, "r"))), lambda x: x["r"]), ",")
    keys = ["name", "condition", "repetition"]
    flat = rows.where("group_no is null").groupBy(*keys).agg(in_order(["position"]).alias("body"))
    groups = rows.where("group_no is not null").groupBy(*keys, "group_no").agg(in_order(["position"]).alias("papers"))
    wrapped = groups.select(*keys, "group_no", F.concat(F.lit('{"group":"'), group_label(F.col("group_no")), F.lit('","papers":['), "papers", F.lit("]}")).alias("g"))
    grouped = wrapped.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("group_no", "g"))), lambda x: x["g"]), ",").alias("body"))
    text = F.concat_ws("\n\n", F.replace(F.lit(CONTEXT_TASK), F.lit("{name}"), F.col("name")), F.lit(CONTRACT), F.concat(F.lit("PAPERS:\n["), "body", F.lit("]")))
    return flat.unionByName(grouped).select(*keys, text.alias("prompt"))


def dry_run(cards: DataFrame, truth: DataFrame) -> DataFrame:
    """What a request would hold, without sending it: papers, known authors, characters of the compact prompt, and papers
    with a title, an organization and coauthors."""
    has = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    filled = cards.groupBy("name").agg(F.count(F.lit(1)).alias("papers"), has(F.length("title") > 0).alias("with_title"), has(F.exists("organization", lambda o: o != "")).alias("with_organization"), has(F.size("coauthors") > 0).alias("with_coauthors"))
    authors = truth.groupBy("name").agg(F.countDistinct("label").alias("authors"))
    p = numbered(cards).select("name", F.length(record_json()).alias("n")).groupBy("name").agg((F.sum("n") + F.count(F.lit(1)) - 1).alias("record_characters"))
    return filled.join(authors, "name", "left").join(p, "name").select("name", "papers", F.coalesce("authors", F.lit(0)).alias("authors"), "record_characters", "with_title", "with_organization", "with_coauthors")
