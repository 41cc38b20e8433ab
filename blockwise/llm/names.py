"""Variant spellings of names typed by people: pigeonhole segment join with banded verification, then linking."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockwise.common import cut_lineage, release, settled
from blockwise.llm.consistent import consistent_form
from blockwise.operators.graph import bipartite_components

# Titles before or behind a name.
TITLES = "dr prof ing professor doctor mr mrs ms miss sir phd md dipl mag jr sr".split()
# Words of organization names that say nothing.
ORG_STOP = "the of for and at in de der die und von fur des la le du".split()
# What people type where they have no organization.
PLACEHOLDERS = ["", "n/a", "na", "none", "null", "unknown", "-", "--", "?", ".", "nil", "not available", "no affiliation"]


def _folds() -> tuple[str, str]:
    """Letters with a mark or stroke and the letter below it, made from the character database."""
    strokes = {"ø": "o", "đ": "d", "ł": "l", "ħ": "h", "ŧ": "t", "ı": "i"}
    src, dst = list(strokes), list(strokes.values())
    for o in range(0xC0, 0x250):
        ch = chr(o)
        base = unicodedata.normalize("NFD", ch)[0]
        if base != ch and base.isascii():
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


_FOLD = _folds()


def folded(c: Column) -> Column:
    """Lower case without accents."""
    return F.regexp_replace(F.translate(F.lower(c), *_FOLD), r"\p{M}+", "")


# ---------------------------------------------------------------- segment join


def _segments(length: int, k: int) -> list[tuple[int, int]]:
    """(start from 0, size) of k+1 nearly equal segments; the last length % (k+1) are longer by one."""
    base, more = divmod(length, k + 1)
    out, start = [], 0
    for i in range(k + 1):
        size = base + (i >= k + 1 - more)
        out.append((start, size))
        start += size
    return out


def _held(text: str, k: int) -> set[str]:
    """The segments of an indexed text, each with the text's length and its number."""
    return {f"{len(text)} {i} {text[s : s + w]}" for i, (s, w) in enumerate(_segments(len(text), k))}


def _looked_up(text: str, k: int, swaps: bool, longest: int) -> set[str]:
    """The segments that a text within k edits may hold, of texts of up to ``longest`` letters; see ``segment_join``."""
    n, out = len(text), set()
    for length in range(max(k + 1, n - k), longest + 1):
        segments, longer = _segments(length, k), n - length
        for i, (s, w) in enumerate(segments):
            for shift in range(-min(i, k), min(i, k) + 1):
                if abs(shift - longer) <= k - i and s + shift >= 0 and s + shift + w <= n:
                    out.add(f"{length} {i} {text[s + shift : s + shift + w]}")
        if swaps and abs(longer) < k:
            w = segments[0][1]
            if 1 <= w < n:
                out.add(f"{length} 0 {text[: w - 1]}{text[w]}")
            s, w = segments[k]
            if k > 1 and w >= 1 and s + longer >= 1:  # with one edit the first segment is enough
                at = s + longer
                out.add(f"{length} {k} {text[at - 1]}{text[at + 1 : at + w]}")
    return out


def _places(texts: DataFrame, of) -> DataFrame:
    """(t, h): the hashed places of every text."""

    def run(batches):
        for b in batches:
            found = [sorted(of(x)) for x in b.column(2).to_pylist()]
            at = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).cast(pa.string()).take(at), pa.array([x for f in found for x in f], pa.string())], names=["t", "key", "place"])

    name = texts.columns[1]
    return texts.select("t", F.col("key").cast("string").alias("key"), name).mapInArrow(run, "t long, key string, place string").select("t", F.xxhash64("key", "place").alias("h"))


def one_edit(a: Column, b: Column) -> Column:
    """At most one insertion, deletion, substitution or swap of neighbours; the swap is told by its place."""
    swap = (F.length(a) == F.length(b)) & (F.levenshtein(a, b, 2) == 2) & F.exists(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(a) - 1)),
        lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))) == b)
    return (F.levenshtein(a, b, 1) >= 0) | swap


@F.pandas_udf(T.BooleanType())
def _two_errors(a, b):
    import pandas as pd

    return pd.Series([_typing_errors(x, y) <= 2 for x, y in zip(a, b)], dtype=bool)


def segment_join(index: DataFrame, probe: DataFrame | None, key: str, text: str, k: int, swaps: bool = False) -> DataFrame:
    """(key, indexed, probed): distinct pairs of different texts under the same key within edit distance k.

    Each indexed text is cut into k+1 segments of which a text within k edits must hold one unchanged. The inverted
    index has (key, length, segment number, segment); a probe looks its substrings up at positions shifted by at most
    k, for lengths that differ by at most k. Both sides are hash-joined on a hash of all four, so no pair of texts is
    compared that shares no segment; candidates are verified with the banded edit distance. With ``swaps`` two swapped
    neighbours count as one edit: a swap within a segment damages this one only, and for one across a cut the probe
    also looks up its first and its last segment with the two letters at the cut swapped back (one of the two is whole
    then but for that, for k up to 2). Texts are taken distinct first. Texts shorter than k+1 characters and nulls do
    not take part. Without a probe side the index is joined with itself: a text then looks up lengths up to its own
    only, and each pair is given both ways. Only hashes and row ids are shuffled for the lookup, not texts. The distinct
    texts are materialised first, since lookup and verification both read them.
    """
    if swaps and k > 2:
        raise ValueError("swaps are found for k up to 2")
    texts = lambda df, name: df.select(F.col(key).alias("key"), F.col(text).alias(name)).where(F.col("key").isNotNull() & (F.length(name) > k)).distinct().withColumn("t", F.xxhash64("key", name))
    alone = probe is None
    ix_texts = cut_lineage(texts(index, "indexed"))
    pr_texts = ix_texts.withColumnRenamed("indexed", "probed") if alone else cut_lineage(texts(probe, "probed"))
    ix = _places(ix_texts, lambda x: _held(x, k))
    pr = _places(pr_texts, lambda x: _looked_up(x, k, swaps, len(x) if alone else len(x) + k))
    pairs = ix.toDF("i", "h").join(pr.toDF("p", "h"), "h").where("i <> p").select("i", "p").distinct()
    a, b = ix_texts.select(F.col("t").alias("i"), "key", "indexed"), pr_texts.select(F.col("t").alias("p"), F.col("key").alias("_key"), "probed")
    pairs = pairs.join(a, "i").join(b, "p").where((F.col("key") == F.col("_key")) & (F.col("indexed") != F.col("probed")))
    if not swaps:
        near = F.levenshtein("indexed", "probed", k) >= 0
    elif k == 1:
        near = one_edit(F.col("indexed"), F.col("probed"))
    else:  # a swap is two edits of the banded distance
        pairs = pairs.where(F.levenshtein("indexed", "probed", 2 * k) >= 0)
        near = _two_errors("indexed", "probed")
    found = pairs.where(near).select("key", "indexed", "probed")
    if probe is None:
        found = found.select("key", F.explode(F.array(F.struct("indexed", "probed"), F.struct(F.col("probed").alias("indexed"), F.col("indexed").alias("probed")))).alias("p")).select("key", "p.indexed", "p.probed")
    return found.distinct()


# ---------------------------------------------------------------- organizations


def org_tokens(org: Column) -> Column:
    """Words of an organization name, lower case without accents; words of other scripts only where there is no Latin one."""
    plain = F.regexp_replace(folded(org), r"['’.]", " ")
    latin = F.regexp_extract_all(plain, F.lit("[a-z0-9]+"), F.lit(0))
    other = F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.when(F.exists(latin, lambda w: F.length(w) > 1), latin).otherwise(other)


def abbreviates(short: Column, full: Column) -> Column:
    """A beginning of the full word, or letters of it in their order that keep its first and its last."""
    letters = F.regexp_replace(F.substring(short, F.lit(2), F.greatest(F.length(short) - 2, F.lit(0))), "(.)", "$1[a-z]*")
    pattern = F.concat(F.lit("^"), F.substring(short, 1, 1), F.lit("[a-z]*"), letters, F.substring(short, -1, 1), F.lit("$"))
    skeleton = (F.length(short) >= 3) & F.call_function("rlike", full, pattern)
    return (F.length(full) >= 5) & (4 * F.length(short) <= 3 * F.length(full)) & (F.startswith(full, short) | skeleton)


def spelled_out(names: DataFrame) -> DataFrame:
    """(word, full): words of organization names that are a typing error or a short form of another word, and that word.

    Learnt from all distinct names (id, words) alone. Two names are held against each other if they agree in one of
    their two rarest words, in the number of words and in the first letters of all. The words in which they differ are
    paired by first letter. A pair counts if one word is found near the other by the segment join of all words against
    each other (one edit from five letters on, two from eight) and two thirds as frequent at most, or abbreviates it; and if
    the word in common is rarer than the full word. Proper names, which are the rarest words of a name, are thus
    taken as they are, since places differ by single letters. All pairs of two names must count. Of several full words
    the one seen with most words in common wins (ties: the more frequent, then the first).
    """
    each = names.select("id", F.explode("words").alias("word"))
    df = cut_lineage(each.groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    counted = each.join(df, "word").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("by_n"))
    profile = names.join(counted, "id").select("words", F.array_join(F.array_sort(F.transform("words", lambda w: F.substring(w, 1, 1))), "").alias("sig"), "by_n").where(F.size("words") > 1)
    keyed = cut_lineage(profile.select("words", "sig", F.element_at("by_n", -1)["n"].alias("most"), F.explode(F.slice("by_n", 1, 2)).alias("k")).select("words", F.xxhash64("sig", "k.word").alias("h"), "sig", "k.word", "k.n", "most"))
    a, b = keyed.alias("a"), keyed.where("n < most").alias("b")  # the full side has a word more frequent than the one in common
    both = a.join(b, (F.col("a.h") == F.col("b.h")) & (F.col("a.word") == F.col("b.word")) & (F.col("a.sig") == F.col("b.sig")) & (F.col("a.words") != F.col("b.words")))
    rest = lambda x, y: F.array_sort(F.array_except(x, y))
    pairs = both.select(F.col("a.word").alias("common"), F.col("a.n").alias("rare"), F.xxhash64("a.words", "b.words").alias("pair"), F.explode(F.arrays_zip(rest(F.col("a.words"), F.col("b.words")).alias("w"), rest(F.col("b.words"), F.col("a.words")).alias("v"))).alias("z")).select("common", "rare", "pair", "z.w", "z.v")
    words = df.select("word", F.lit(1).alias("all"))
    longest = settled(segment_join(words.where(F.length("word") >= 8), None, "all", "word", 2))
    shorter = settled(segment_join(words.where(F.length("word") >= 5), None, "all", "word", 1, swaps=True))
    near = cut_lineage(longest.unionByName(shorter).select(F.col("indexed").alias("v"), F.col("probed").alias("w")).distinct().withColumn("near", F.lit(True)))
    nw, nv = df.select(F.col("word").alias("w"), F.col("n").alias("nw")), df.select(F.col("word").alias("v"), F.col("n").alias("nv"))
    judged = pairs.join(near, ["w", "v"], "left").join(nw, "w").join(nv, "v")
    typo = F.coalesce("near", F.lit(False))
    way = F.when((typo & (2 * F.col("nv") >= 3 * F.col("nw"))) | abbreviates(F.col("w"), F.col("v")), 1).when((typo & (2 * F.col("nw") >= 3 * F.col("nv"))) | abbreviates(F.col("v"), F.col("w")), -1).otherwise(0)
    judged = judged.withColumn("way", way).withColumn("good", (F.col("way") != 0) & (F.when(F.col("way") == 1, F.col("nv")).otherwise(F.col("nw")) > F.col("rare")))
    sound = judged.groupBy("pair", "common").agg(F.every("good").alias("all_good"), F.collect_set(F.struct(F.when(F.col("way") == 1, F.col("w")).otherwise(F.col("v")).alias("word"), F.when(F.col("way") == 1, F.col("v")).otherwise(F.col("w")).alias("full"), F.greatest("nw", "nv").alias("n"))).alias("p"))
    votes = sound.where("all_good").select("common", F.explode("p").alias("p")).groupBy("p.word", "p.full", "p.n").agg(F.countDistinct("common").alias("votes"))
    best = votes.groupBy("word").agg(F.min(F.struct((-F.col("votes")).alias("v"), (-F.col("n")).alias("m"), "full")).alias("m")).select("word", "m.full")
    return cut_lineage(best)


def org_keys(orgs: DataFrame) -> DataFrame:
    """(org, org_key) for every distinct non-null org in its consistent form: one key for all spellings of the same one.

    The key is the sorted set of the name's words after empty words are dropped and misspelt or short words written
    out, see ``spelled_out``; this is done twice, for short forms that are misspelt. A placeholder or a name without
    words has a null key.
    """
    names = orgs.select("org").where("org is not null").distinct().select(F.xxhash64("org").alias("id"), "org", F.array_sort(F.array_distinct(F.filter(org_tokens(F.col("org")), lambda w: ~w.isin(ORG_STOP)))).alias("words"), F.lower(F.trim("org")).isin(PLACEHOLDERS).alias("none"))
    names = cut_lineage(names)
    full = spelled_out(names.where(~F.col("none")).select(F.xxhash64("words").alias("id"), "words").distinct())
    each = names.select("org", "none", F.explode_outer("words").alias("word"))
    for _ in range(2):
        each = each.join(full, "word", "left").select("org", "none", F.coalesce("full", "word").alias("word"))
    return each.groupBy("org").agg(F.max("none").alias("none"), F.array_join(F.array_sort(F.collect_set("word")), " ").alias("k")).select("org", F.when(F.col("none") | (F.col("k") == ""), None).otherwise(F.col("k")).alias("org_key"))


def org_pairs(register: DataFrame, id_col: str = "org_id", org: str = "org") -> DataFrame:
    """(id_a, id_b), id_a < id_b: rows of a register whose names are spellings of the same organization.

    Null ids and names, placeholders and repeated rows give nothing of their own. Departments of one university stay apart, as do
    institutes of different places or kinds with near-equal names.
    """
    rows = register.where(F.col(id_col).isNotNull() & F.col(org).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(org).alias("org")).distinct()
    formed = consistent_form(rows, ["org"]).select("id", F.col("org_form").alias("org"))
    keyed = cut_lineage(formed.join(org_keys(formed), "org").where("org_key is not null").select("id", "org_key").distinct())
    a, b = keyed.alias("a"), keyed.alias("b")
    return a.join(b, (F.col("a.org_key") == F.col("b.org_key")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).distinct()


# ---------------------------------------------------------------- persons

_SPLIT = re.compile(r"[\s.]+")
_STROKES = str.maketrans({"ø": "o", "đ": "d", "ł": "l", "ħ": "h", "ŧ": "t", "ı": "i"})
#: Least letters of surnames that are linked over two typing errors.
LONG = 7
#: Least share of the places of a short given name at which its full form stands beside it, and least number of them.
NICK_SHARE, NICK_LEAST = 0.3, 3
#: How many times as frequent a common given name is as its typing errors at least.
MEND = 20
FORM = ("given", "full", "initials")


def fold_text(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", s.lower().translate(_STROKES)) if unicodedata.category(c) != "Mn")


def parse_name(name: str, given_words: frozenset[str]) -> tuple[str, str, str]:
    """(surname, given name, initials) of a name, folded; given is "" where only initials stand.

    A comma puts the surname first. Else single letters are initials, and a name that ends in initials has its
    surname first; of two full words the one that is a common given name is the given name, by default the first.
    The initials are the single letters in their order, the first letter of a full given name not included. Two
    letters behind a surname are two initials. A given name with a hyphen is a given name and an initial.
    """
    sur, given, inits = _parse(fold_text(name), given_words)
    parts = [w for w in given.split("-") if w]
    if len(parts) > 1:
        given, inits = parts[0], "".join(w[0] for w in parts[1:]) + inits
    return sur, given, inits


def _words(text: str) -> list[str]:
    return [w for w in (x.strip("-") for x in _SPLIT.split(text)) if w]


def _parse(low: str, given_words: frozenset[str]) -> tuple[str, str, str]:
    if "," in low:
        head, tail = low.split(",", 1)
        sur = [w for w in _words(head) if w not in TITLES]
        rest = [w for w in _words(tail.replace(",", " ")) if w not in TITLES]
        if sur and rest:
            full = [w for w in rest if len(w) > 1]
            return " ".join(sur), full[0] if full else "", "".join(w for w in [*rest] if len(w) == 1) + "".join(w[0] for w in full[1:])
        low = low.replace(",", " ")
    words = _words(low)
    while len(words) > 1 and words[0] in TITLES:
        words.pop(0)
    if len(words) > 2 and words[-1] in TITLES:
        words.pop()
    if len(words) == 2 and len(words[1]) == 2 and len(words[0]) > 2 and words[1] not in given_words:
        return words[0], "", words[1]
    if not words:
        return "", "", ""
    if len(words) == 1:
        return words[0], "", ""
    full = [i for i, w in enumerate(words) if len(w) > 1]
    if not full:
        return " ".join(words), "", ""
    if len(full) == 1:
        i = full[0]
        return words[i], "", "".join(w for j, w in enumerate(words) if j != i)
    first, last = full[0], full[-1]
    given = lambda w: w in given_words
    flip = (len(words[-1]) == 1 and not given(words[first])) or (given(words[last]) and not given(words[first]))
    if len(words[-1]) == 1 and len(full) == 2 and given(words[last]):
        flip = True
    g, s = (last, first) if flip else (first, last)
    inits = [w if len(w) == 1 else w[0] for j, w in enumerate(words) if j not in (g, s)]
    return words[s], words[g], "".join(inits)


def _one_edit(a: str, b: str) -> bool:
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (i + 1 < len(a) and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def _typing_errors(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours between two words."""
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        before, last = last, row
    return last[-1]


def _middle_ok(a: str, b: str) -> bool:
    return not a or not b or a == b or a.startswith(b) or b.startswith(a)


def resolve(forms: list[tuple[str, str, str]]) -> list[int]:
    """Number of the person of each form (given, full form of given, initials) of one surname at one place.

    Given names are one person if their full forms are equal or one typing error apart (three letters or more) and
    their middle initials do not contradict. A form with initials only joins the one person they fit; where they
    fit several, it stays by itself. The result does not depend on the order of the forms.
    """
    order = sorted(range(len(forms)), key=lambda i: forms[i])
    person = list(range(len(forms)))

    def find(i: int) -> int:
        while person[i] != i:
            i = person[i]
        return i

    groups: dict[tuple[str, str], list[int]] = {}
    for i in order:
        if forms[i][0]:
            groups.setdefault((forms[i][1], forms[i][2]), []).append(i)
    for same in groups.values():
        for i in same[1:]:
            person[find(i)] = find(same[0])
    # names within one edit share a string with at most one letter left out of each
    middles: dict[str, list[str]] = {}
    for g, m in groups:
        middles.setdefault(g, []).append(m)
    shared: dict[str, list[str]] = {}
    for g in middles:
        for v in {g, *(g[:k] + g[k + 1 :] for k in range(len(g)))}:
            shared.setdefault(v, []).append(g)
    near: dict[str, set[str]] = {g: {g} for g in middles}
    for words in shared.values():
        for x, ga in enumerate(words):
            for gb in words[:x]:
                if min(len(ga), len(gb)) >= 3 and gb not in near[ga] and _one_edit(ga, gb):
                    near[ga].add(gb)
                    near[gb].add(ga)
    for ga in sorted(near):
        known = {m for g in near[ga] for m in middles[g] if m}
        for gb in sorted(g for g in near[ga] if g <= ga):
            for ma in middles[ga]:
                for mb in middles[gb]:
                    # beside two different middle initials a form without one is nobody's
                    if _middle_ok(ma, mb) and not (ma != mb and not (ma and mb) and len(known) > 1):
                        person[find(groups[ga, ma][0])] = find(groups[gb, mb][0])
    # initials
    by_letter: dict[str, list[tuple[str, int]]] = {}
    for (g, m), members in groups.items():
        for letter in {forms[j][0][0] for j in members} | {g[0]}:
            by_letter.setdefault(letter, []).append((m, members[0]))
    for i in order:
        given, _, inits = forms[i]
        if not given and inits:
            fits = {find(j) for m, j in by_letter.get(inits[0], []) if _middle_ok(inits[1:], m)}
            if len(fits) == 1:
                person[find(i)] = fits.pop()
    bare: dict[str, int] = {}
    for i in order:
        if not forms[i][0] and find(i) == i:
            bare.setdefault(forms[i][2], i)
            person[i] = bare[forms[i][2]]
    for inits, i in bare.items():
        longer = [j for other, j in bare.items() if inits and other != inits and other.startswith(inits)]
        if len(longer) == 1 and find(i) == i:
            person[i] = find(longer[0])
    return [find(i) for i in range(len(forms))]


def _resolve_batches(batches):
    """Rows (block, org_key, surname, forms: list of struct) to one row per form with the person it stands for."""
    names = ["block", "org_key", "surname", "person", "name_key", *FORM]
    for b in batches:
        out: list[list] = [[] for _ in names]
        for r in b.to_pylist():
            forms = [tuple(f[c] for c in FORM) for f in r["forms"]]
            people = resolve(forms)
            labels = {}
            for i in sorted(range(len(forms)), key=lambda i: (forms[i], r["forms"][i]["name_key"])):
                labels.setdefault(people[i], r["forms"][i]["name_key"])
            for f, p in zip(r["forms"], people):
                for col, v in zip(out, (r["block"], r["org_key"], r["surname"], labels[p], f["name_key"], *(f[c] for c in FORM))):
                    col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], names=names)


def _same_person(a, b) -> bool:
    forms = [tuple(f[c] for c in FORM) for f in (*a, *b)]
    people = resolve(forms)
    return any(people[i] == people[j] for i in range(len(a)) for j in range(len(a), len(forms)))


@F.pandas_udf(T.BooleanType())
def _one_person(a, b):
    import pandas as pd

    return pd.Series([_same_person(x, y) for x, y in zip(a, b)], dtype=bool)


def _letters(forms: str) -> Column:
    """First letters by which two forms of one person may meet: of the given name, its full form, or the initials."""
    of = lambda f: F.when(f["given"] != "", F.array(F.substring(f["given"], 1, 1), F.substring(f["full"], 1, 1))).otherwise(F.array(F.substring(f["initials"], 1, 1)))
    return F.array_distinct(F.flatten(F.transform(forms, of)))


def given_names(names: DataFrame, share: float) -> DataFrame:
    """(word): words that make up at least ``share`` of the words of all distinct names (five at least) and stand behind
    a comma at least as often as before one. At most 1/share words."""
    low = names.select(folded(F.col("name_key")).alias("low"))
    split = lambda c: F.split(F.regexp_replace(c, r"[.,]", " "), r"\s+")
    part = low.select(F.contains("low", F.lit(",")).alias("comma"), F.substring_index("low", ",", 1).alias("head"), F.expr("substring(low, length(substring_index(low, ',', 1)) + 1)").alias("tail"))
    each = part.select("comma", F.explode(split(F.col("head"))).alias("word"), F.lit(False).alias("behind")).unionByName(part.where("comma").select("comma", F.explode(split(F.col("tail"))).alias("word"), F.lit(True).alias("behind")))
    counts = each.where(F.length("word") > 1).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("comma") & F.col("behind")).alias("b"), F.count_if(F.col("comma") & ~F.col("behind")).alias("a"))
    total = counts.agg(F.sum("n").alias("of")).scalar()
    return counts.where((F.col("n") >= F.greatest(F.lit(5.0), F.lit(share) * total)) & (F.col("b") >= F.col("a")) & ~F.col("word").isin(TITLES)).select("word")


def full_given_names(forms: DataFrame) -> DataFrame:
    """(given, full): short forms of given names and the name they stand for, learnt from the forms alone.

    Where exactly two given names stand beside one surname at one place, they mostly belong to one person. A name with
    another, more frequent (or, as frequent, longer) one beside it at ``NICK_SHARE`` of such places (``NICK_LEAST`` at least, one less where the
    other holds it or begins alike) is a short form of it; siblings' names are spread over many. Of several the most frequent partner wins (ties: the first).
    """
    named = forms.where((F.length("given") > 1) & (F.col("org_key") != "")).select("block", "org_key", "surname", "given").distinct()
    freq = named.groupBy("given").agg(F.count(F.lit(1)).alias("n"))
    two = named.groupBy("block", "org_key", "surname").agg(F.count(F.lit(1)).alias("k"), F.min("given").alias("x"), F.max("given").alias("y")).where("k = 2")
    ways = two.select(F.explode(F.array(F.struct(F.col("x").alias("given"), F.col("y").alias("full")), F.struct(F.col("y").alias("given"), F.col("x").alias("full")))).alias("p")).groupBy("p.given", "p.full").agg(F.count(F.lit(1)).alias("c"))
    ways = cut_lineage(ways)
    seen = ways.groupBy("given").agg(F.sum("c").alias("d"))
    good = ways.join(seen, "given").join(freq.withColumnRenamed("n", "n_given"), "given").join(freq.select(F.col("given").alias("full"), F.col("n").alias("n_full")), "full")
    alike = F.contains("full", "given") | (F.substring("full", 1, 2) == F.substring("given", 1, 2))
    good = good.where((F.col("c") >= F.lit(NICK_LEAST) - alike.cast("int")) & (F.col("c") >= NICK_SHARE * F.col("d")) & (F.struct("n_full", F.length("full"), "full") > F.struct("n_given", F.length("given"), "given")))
    best = cut_lineage(good.groupBy("given").agg(F.min(F.struct((-F.col("c")).alias("c"), "full")).alias("m")).select("given", "m.full"))
    again = best.select(F.col("given").alias("full"), F.col("full").alias("further"))
    return best.join(again, "full", "left").select("given", F.coalesce("further", "full").alias("full"))


def mended_given_names(parsed: DataFrame, common: DataFrame, nick: DataFrame) -> DataFrame:
    """(given, full): given names that are neither common nor short forms, one edit (swaps included) from exactly one
    common one that is ``MEND`` times as frequent: its typing errors, found by the segment join."""
    counts = cut_lineage(parsed.where(F.length("given") > 2).groupBy(F.col("given").alias("word")).agg(F.count(F.lit(1)).alias("n")))
    every = common.where(F.length("word") > 3).withColumn("all", F.lit(1))
    rare = counts.join(F.broadcast(common), "word", "left_anti").join(nick.select(F.col("given").alias("word")), "word", "left_anti").withColumn("all", F.lit(1))
    pairs = settled(segment_join(every, rare, "all", "word", 1, swaps=True)).join(counts.select(F.col("word").alias("probed"), "n"), "probed").join(counts.select(F.col("word").alias("indexed"), F.col("n").alias("of")), "indexed")
    near = pairs.where(F.col("of") >= MEND * F.col("n")).groupBy(F.col("probed").alias("given")).agg(F.min("indexed").alias("full"), F.count(F.lit(1)).alias("k")).where("k = 1").select("given", "full")
    return near.join(nick.toDF("full", "further"), "full", "left").select("given", F.coalesce("further", "full").alias("full"))


def near_surnames(persons: DataFrame) -> DataFrame:
    """(place, sa, sb, kind), both ways: surnames of one place that may be one person's, typed differently.

    Kind 1: five letters or more, one edit apart (swaps included), by the segment join. Kind 2: ``LONG`` letters or
    more, two typing errors apart, with a first letter of given name or initials in common (deletion neighbourhoods,
    verified). Kind 3: one below five letters, both of three or more, one edit apart, by the segment join as well.
    """
    surnames = persons.select("place", "surname").distinct()
    many = surnames.groupBy("place").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("place")
    surnames = cut_lineage(surnames.join(many, "place", "left_semi"))
    usual = surnames.where(F.length("surname") >= 3)
    one = segment_join(usual, None, "place", "surname", 1, swaps=True)
    one = settled(one.select(F.col("key").alias("place"), F.col("indexed").alias("sa"), F.col("probed").alias("sb"), F.when(F.least(F.length("indexed"), F.length("probed")) < 5, 3).otherwise(1).alias("kind")))
    long = persons.where((F.length("surname") >= LONG) & ~F.exists("forms", lambda f: (f["given"] == "") & (f["initials"] == ""))).join(many, "place", "left_semi")
    long = long.select("place", "surname", F.explode(_letters("forms")).alias("letter")).distinct()
    texts = long.select(F.concat_ws("\x1e", "place", "letter").alias("key"), "surname")
    two = segment_join(texts, None, "key", "surname", 2, swaps=True).where(~one_edit(F.col("indexed"), F.col("probed")))
    two = settled(two.select(F.substring_index("key", "\x1e", 1).alias("place"), F.col("indexed").alias("sa"), F.col("probed").alias("sb"), F.lit(2).alias("kind")).distinct())
    return one.unionByName(two)


def link_persons(persons: DataFrame) -> DataFrame:
    """(pid, person_id): persons (place, surname, pid, forms) of one surname each, joined over near surnames.

    Persons with given names, and persons with initials only, are one if ``resolve`` takes their forms for one person
    (for kind 3 only with given names); they are joined into components. A person with initials only then goes to the
    one component with given names that it fits, its own surname included; where it fits several, it stays. Only
    persons with near surnames and a first letter in common are compared.
    """
    near = near_surnames(persons)
    named = F.exists("forms", lambda f: f["given"] != "")
    side = persons.select("place", "surname", "pid", "forms", named.alias("named"), F.explode(_letters("forms")).alias("letter"))
    own = near.where("kind < 3").select("place", "sa", F.col("sa").alias("sb"), F.lit(0).alias("kind")).distinct()
    links = near.unionByName(own)
    a = side.select("place", F.col("surname").alias("sa"), F.col("pid").alias("pa"), F.col("forms").alias("fa"), F.col("named").alias("na"), "letter")
    b = side.select("place", F.col("surname").alias("sb"), F.col("pid").alias("pb"), F.col("forms").alias("fb"), F.col("named").alias("nb"), "letter")
    cand = links.join(a, ["place", "sa"]).join(b, ["place", "sb", "letter"]).where(F.col("pa") != F.col("pb"))
    # named pairs and unnamed pairs once; an unnamed one (a) with a named one (b)
    cand = cand.where(((F.col("na") == F.col("nb")) & (F.col("pa") < F.col("pb")) & (F.col("kind") > 0)) | (~F.col("na") & F.col("nb")))
    cand = cand.where((F.col("kind") < 3) | (F.col("na") & F.col("nb"))).select("place", "pa", "pb", "fa", "fb", "na", "nb").dropDuplicates(["pa", "pb"])
    good = cut_lineage(cand.where(_one_person("fa", "fb")).select("place", "pa", "pb", (F.col("na") == F.col("nb")).alias("equal")))
    token = F.concat_ws("\x1e", "pa", "pb")
    ends = good.where("equal").select("place", F.explode(F.array("pa", "pb")).alias("pid"), token.alias("token"))
    comp = bipartite_components(ends, ends, ["place"], "pid").select("pid", "component")
    base = persons.select("pid").join(comp, "pid", "left").select("pid", F.coalesce("component", "pid").alias("component"))
    base = cut_lineage(base)
    fits = good.where("not equal").select("pa", F.col("pb").alias("pid")).join(base, "pid").groupBy("pa").agg(F.countDistinct("component").alias("n"), F.min("component").alias("to")).where("n = 1")
    return base.join(fits.select(F.col("pa").alias("pid"), "to"), "pid", "left").select("pid", F.coalesce("to", "component").alias("person_id"))


def person_links(entries: DataFrame, entry_id: str = "entry_id", name: str = "name", org: str = "org", block: str = "block_name", given_share: float = 0.0005) -> DataFrame:
    """(entry_id, person_id, name_key): the person behind every entry with a name; name_key is the name as compared.

    A person is known by the organization and the block; people of the same name at different organizations are
    different. Names and organizations are taken in their consistent form and counted as distinct values first, so
    that a spelling typed by a third of all rows is one row. Common given names tell which word of a name is the given
    name (``given_names``, at most 1/given_share words); a given name one edit from exactly one of them, by the segment
    join, is that one, and short forms are written out as learnt from the data (``full_given_names``). The forms of one
    surname in one block and organization are resolved together (``resolve``); persons of near surnames there are
    linked (``link_persons``). A person without an organization joins the one person of that block whose name fits, if
    there is exactly one. Null names, null ids and names without a letter give no row; a null block is a block of its own.
    """
    spark = entries.sparkSession
    base = entries.where(F.col(entry_id).isNotNull() & F.col(name).isNotNull()).select(F.col(entry_id).cast("long").alias("entry_id"), F.col(name).alias("name"), F.col(org).alias("org"), F.coalesce(F.col(block), F.lit("")).alias("block"))
    cells = cut_lineage(base.select("block", "name", "org").distinct())
    typed = consistent_form(cells.select("name").distinct(), ["name"]).select("name", F.trim(F.regexp_replace(F.lower("name_form"), r"(?U)\s+", " ")).alias("name_key")).where("name_key != ''")
    typed = cut_lineage(typed)
    raw_orgs = cut_lineage(consistent_form(cells.select("org").where("org is not null").distinct(), ["org"]))
    orgs = raw_orgs.join(org_keys(raw_orgs.select(F.col("org_form").alias("org"))).withColumnRenamed("org", "org_form"), "org_form").where("org_key is not null").select("org", "org_key")
    cells = cut_lineage(cells.join(typed, "name").join(orgs, "org", "left").select("block", "name", "org", "name_key", F.coalesce("org_key", F.lit("")).alias("org_key")))
    release(spark)  # the driver keeps the plans and files of all that comes before otherwise
    distinct_names = typed.select("name_key").distinct()
    common = cut_lineage(given_names(distinct_names, given_share))
    known = frozenset(r["word"] for r in common.collect())  # at most 1/given_share words

    def parse(batches):
        for b in batches:
            cols = list(zip(*(parse_name(k, known) for k in b.column(0).to_pylist()))) if b.num_rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), *(pa.array(c, pa.string()) for c in cols)], names=["name_key", "surname", "given", "initials"])

    parsed = cut_lineage(distinct_names.mapInArrow(parse, "name_key string, surname string, given string, initials string").where("surname != ''"))
    forms = cut_lineage(cells.select("block", "org_key", "name_key").distinct().join(parsed, "name_key"))
    release(spark)
    nick = cut_lineage(full_given_names(forms))
    mended = settled(mended_given_names(parsed, common, nick))
    forms = forms.join(nick.unionByName(mended), "given", "left").withColumn("full", F.coalesce("full", "given"))
    buckets = forms.groupBy("block", "org_key", "surname").agg(F.collect_set(F.struct("name_key", *FORM)).alias("forms"))
    people = buckets.mapInArrow(_resolve_batches, "block string, org_key string, surname string, person string, name_key string, given string, full string, initials string")
    pid = F.concat_ws("\x1f", "block", "org_key", "surname", "person")
    people = cut_lineage(people.select("block", "org_key", "surname", "name_key", *FORM, pid.alias("pid")))
    persons = cut_lineage(people.groupBy("pid", F.concat_ws("\x1f", "block", "org_key").alias("place"), "surname", "block", "org_key").agg(F.collect_set(F.struct(*FORM)).alias("forms")))
    release(spark)
    linked = cut_lineage(persons.join(link_persons(persons), "pid").select("pid", "person_id", "block", "org_key", "surname", "forms"))
    release(spark)
    adopted = settled(_adopt(linked))
    final = linked.join(adopted, "person_id", "left").select("pid", F.coalesce("to_person", "person_id").alias("person_id"))
    named = people.select("block", "org_key", "name_key", "pid").join(final, "pid").select("block", "org_key", "name_key", "person_id")
    found = cells.join(named, ["block", "org_key", "name_key"]).select("block", "name", F.coalesce("org", F.lit("")).alias("o"), F.col("org").isNull().alias("no"), "name_key", "person_id")
    rows = base.select("entry_id", "block", "name", F.coalesce("org", F.lit("")).alias("o"), F.col("org").isNull().alias("no")).distinct()
    return rows.join(found, ["block", "name", "o", "no"]).select("entry_id", "person_id", "name_key").distinct()


def _adopt(linked: DataFrame) -> DataFrame:
    """(person_id, to_person) for persons without an organization that fit exactly one of their block that has one."""
    side = linked.select("person_id", "block", "surname", "org_key", "forms", F.explode(_letters("forms")).alias("letter"))
    lost = side.where("org_key = ''").drop("org_key")
    known = side.where("org_key != ''").select("block", "surname", "letter", F.col("person_id").alias("to_person"), F.col("forms").alias("to_forms"))
    pairs = lost.join(known, ["block", "surname", "letter"]).dropDuplicates(["person_id", "to_person", "forms", "to_forms"])
    good = pairs.where(_one_person("forms", "to_forms"))
    return good.groupBy("person_id").agg(F.countDistinct("to_person").alias("n"), F.min("to_person").alias("to_person")).where("n = 1").drop("n")


def person_pairs(entries: DataFrame, **columns) -> DataFrame:
    """(id_a, id_b), id_a < id_b: entries of one person under differently typed names."""
    links = cut_lineage(person_links(entries, **columns))
    many = links.groupBy("person_id").agg(F.min("name_key").alias("lo"), F.max("name_key").alias("hi")).where("lo != hi").select("person_id")
    links = links.join(many, "person_id")
    a, b = links.alias("a"), links.alias("b")
    return a.join(b, (F.col("a.person_id") == F.col("b.person_id")) & (F.col("a.entry_id") < F.col("b.entry_id")) & (F.col("a.name_key") != F.col("b.name_key"))).select(F.col("a.entry_id").alias("id_a"), F.col("b.entry_id").alias("id_b")).distinct()
