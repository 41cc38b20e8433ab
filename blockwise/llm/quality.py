"""Per-document text quality statistics, exact per-language ranks and outlier scores."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockwise.common import cut_lineage, join_by_weight, weighted_rank

# Frequent function words of English, German, Spanish, French, Italian, Portuguese and Dutch.
COMMON_WORDS = """the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which
one you were her all she there would their we him been has when who will more no if out so said what up its about into than them can
only other these then some that's between most nobody why each both still kept
der die das und ist nicht ein eine einer einem einen den dem des von zu zur zum mit auf für im als auch es an werden aus er hat dass sie
nach bei um noch wie über so sind oder war wird haben wir ihr dabei ohne aber sich wenn
el la los las de que y en un una es no se por con para su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre
también me hasta hay donde desde todo nos qué ellos del fue ha son hemos nadie muchos
le la les de des et en un une est que qui dans pour pas sur au par plus ne se ce il elle on avec son sa ses mais ou nous vous leur été
deux sont du aux sans cette ces depuis n'est d'un il's
il di che e è per un una non con del della sono come anche più nel alla
o os as um uma do da dos das em no na não por com para ao
het een en van is dat die niet op te zijn met voor""".split()  # fmt: skip
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_BULLET = re.compile(r"(?:[-*•·–▪◦‣]|\(?\d{1,4}[.)\]:]|\[\d{1,4}\]|[A-Za-z][.)])\s+\S")
_END = re.compile(r"[.!?。！？…:][\"'”’»)\]*_]*$")
_BORDER = re.compile(r"[\s+|:=_-]*[-=_]{3,}[\s+|:=_-]*$")
_CELLS = re.compile(r"[^,]*(?:,[^,\s][^,]*){3,}$|[^;]*(?:;[^;\s][^;]*){3,}$")
_GAP = re.compile(r"\S( {2,})(?=\S)")
_BAR = re.compile(r" [|•»›·] ")
_MARKUP = re.compile(r"&#?\w+;|</?\w+[^>]*>")
_GIBBERISH = re.compile(r"[bcdfghjklmnpqrstvwxz0-9]{3,}")
_BLOB = re.compile(r"\S{50,}")
_ODD_CLASS = frozenset({"So", "Sc", "Sk", "Sm", "No", "Cc", "Co", "Cn"})
KINDS = ("prose", "list", "table", "junk")
#: Statistics of the outlier scores, and where in them a kind stands: 1 among the greatest values, -1 among the least, 0 at either end.
DIRECTIONS = {
    "list": {"common_share": -1, "ending_share": -1, "prose_share": -1, "words_per_line": -1, "list_share": 1},
    "table": {"common_share": -1, "ending_share": -1, "prose_share": -1, "digit_ratio": 1, "symbol_ratio": 1, "table_share": 1},
    "junk": {"common_share": -1, "ending_share": -1, "prose_share": -1, "mean_word_length": 0, "distinct_share": 0, "symbol_ratio": 0, "junk_share": 1},
}
STATISTICS = sorted({c for d in DIRECTIONS.values() for c in d})
#: Documents of the whole collection that the ranks of a language are mixed with, so that a rare language has ranks at all.
PRIOR = 200
#: Width of the bins in which the threshold of the score is sought.
BIN = 0.05
STATS_SCHEMA = (
    "doc_id long, lang string, n_words int, n_lines int, n_chars int, mean_word_length double, symbol_ratio double, digit_ratio double, ending_share double, "
    "common_share double, words_per_line double, distinct_share double, prose_share double, list_share double, table_share double, junk_share double"
)
_COMMON = frozenset(COMMON_WORDS)


def line_kind(x: str, words: list[str], n_common: int) -> str:
    """The kind of one stripped, non-empty line: prose, list, table or junk. ``words`` are its lower-cased words."""
    n = len(words)
    ends = _END.search(x) is not None
    bullet = _BULLET.match(x) is not None
    sentence = n >= 3 and n_common >= 0.12 * n
    if _BORDER.match(x) and len(x) >= 5:
        return "table"
    if not (sentence and ends):
        if len(x) > 2 and x[0] == "|" == x[-1] and x.count("|") >= 3 or x.count("\t") >= 2 or (n_common <= 0.25 * n and not bullet and _CELLS.match(x)):
            return "table"
        if n_common <= 0.25 * n and "   " in x and len(_GAP.findall(x)) >= 2:
            return "table"
    if len(_MARKUP.findall(x)) >= 3:
        return "junk"
    if n >= 12 and len(set(words)) <= max(4, 0.02 * n):
        return "junk"
    bars = len(_BAR.findall(x))
    if bars >= 5 and bars >= 0.3 * n and n_common < 0.25 * n:
        return "junk"
    if n >= 5 and sum(_GIBBERISH.fullmatch(w) is not None and not w.isdigit() for w in words) > 0.4 * n:
        return "junk"
    if _BLOB.search(x) and len(x) > 12 * max(1, n - x.count("/") - x.count("+")):
        return "junk"
    if not x.isascii() or n_common == 0:
        visible = len(x) - x.count(" ")
        odd = sum(not (c.isalpha() or c.isdecimal()) and (unicodedata.category(c) in _ODD_CLASS or c in "¶\ufffd") for c in x)
        if odd > 0.2 * visible:
            return "junk"
        if n_common == 0 and visible >= 10 and sum(not c.isalnum() for c in x if c != " ") > 0.5 * visible:
            return "junk"
    if bullet:
        return "list"
    if n >= 3 and n_common <= 0.1 * n and x.count(",") + x.count(";") >= 0.6 * n:
        return "list"
    if ends and n >= 2:
        return "prose"
    if not n:
        return "junk"
    if ". " not in x and "? " not in x:
        if n <= 5 and n_common == 0:
            return "list"
        if n <= 12 and all(w[0].isupper() or w.lower() in _COMMON or not w[0].isalpha() for w in _WORD.findall(x)) and n > n_common:
            return "list"
    return "prose"


def document_statistics(text: str) -> tuple:
    """The statistics of one text, in the order of ``STATS_SCHEMA`` from n_words on."""
    chars = dict.fromkeys(KINDS, 0)
    total = n_words = n_common = letters = n_ends = n_lines = 0
    seen: set[str] = set()
    kinds = []
    for raw in text.splitlines():
        x = raw.strip()
        if not x:
            continue
        words = _WORD.findall(x.lower())
        common = sum(w in _COMMON for w in words)
        kind = line_kind(x, words, common)
        kinds.append((kind, len(x)))
        n_lines += 1
        total += len(x)
        n_words += len(words)
        n_common += common
        letters += sum(map(len, words))
        n_ends += _END.search(x) is not None
        seen.update(words)
    for kind, n in kinds:
        chars[kind] += n
    visible = max(1, len("".join(text.split())))
    digits = sum(map(text.count, "0123456789"))
    symbols = sum(not (c.isalnum() or c.isspace()) for c in text)
    w, ln, t = max(1, n_words), max(1, n_lines), max(1, total)
    return (
        n_words, n_lines, len(text), round(letters / w, 2), round(symbols / visible, 4), round(digits / visible, 4), round(n_ends / ln, 4),
        round(n_common / w, 4), round(n_words / ln, 2), round(len(seen) / w, 4), *(round(chars[k] / t, 4) for k in KINDS),
    )


def text_statistics(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per input row: language, counts, ratios and the share of characters in each kind of line.

    lang is lower-cased and trimmed, null or blank becomes "und". Ratios are rounded to four digits, means to two. A
    null text counts as empty; a text without words has all ratios 0. Whole texts are read in Arrow batches, in one
    narrow map without a shuffle (the line rules as built-in expressions took thirty times the CPU seconds).
    """
    d = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.nullif(F.trim(F.lower(F.col(lang))), F.lit("")), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches):
        names = [c.split()[0] for c in STATS_SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.string(), *[pa.int32()] * 3, *[pa.float64()] * 11]
        for b in batches:
            rows = [document_statistics(t) for t in b.column(2).to_pylist()]
            cols = list(zip(*rows)) if rows else [[]] * 14
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.string()), *(pa.array(c, k) for c, k in zip(cols, kinds[2:]))], names=names)

    return d.mapInArrow(run, STATS_SCHEMA)


def rank_tails(stats: DataFrame, columns: list[str], counted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(long rows: doc_id, lang, stat, value), (table: stat, lang, value, n_rows, low, high, low_all, high_all): exact ranks.

    low and high are the shares P(X <= value) and P(X >= value) among the documents of the language, low_all and
    high_all those among all documents. Equal values are merged with their number before they are ranked by
    range-partitioned sorting with partition offsets, so ranks are exact at any size and a value shared by most
    documents is one row. ``stat`` is the place of the column. Null statistics are left out.
    The ranks are those among the rows of ``counted`` if given, which must hold every value; n_rows is the number of
    long rows of a value.
    """
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("stat"), F.col(c).cast("double").alias("value")) for i, c in enumerate(columns)])).alias("s")
    long = stats.select("doc_id", "lang", each).select("doc_id", "lang", "s.stat", "s.value").where("value is not null")
    values = long.groupBy("stat", "lang", "value").agg(F.count(F.lit(1)).alias("n_rows"))
    if counted is None:
        values = values.withColumn("n", F.col("n_rows"))
    else:
        few = counted.select("lang", each).select("lang", "s.stat", "s.value").where("value is not null").groupBy("stat", "lang", "value").agg(F.count(F.lit(1)).alias("n"))
        values = values.join(few, ["stat", "lang", "value"])
    values = values.select("stat", "lang", "value", "n_rows", "n")
    whole = values.groupBy("stat", "value").agg(F.sum("n_rows").alias("n_rows"), F.sum("n").alias("n")).select("stat", F.lit(None).cast("string").alias("lang"), "value", "n_rows", "n")
    ranked = weighted_rank(values.unionByName(whole), ["stat", "lang"], "value", "n", "below")
    sizes = ranked.groupBy("stat", "lang").agg(F.sum("n").alias("of"))  # one row per statistic and language
    shares = ranked.alias("r").join(sizes.alias("z"), (F.col("r.stat") == F.col("z.stat")) & F.col("r.lang").eqNullSafe(F.col("z.lang")))
    shares = shares.select("r.stat", "r.lang", "value", "n_rows", "n", "of", ((F.col("below") + F.col("n")) / F.col("of")).alias("low"), (1 - F.col("below") / F.col("of")).alias("high"))
    every = shares.where("lang is null").select("stat", "value", F.col("low").alias("low_all"), F.col("high").alias("high_all"))
    return long, shares.where("lang is not null").join(every, ["stat", "value"])


def outlier_scores(stats: DataFrame) -> DataFrame:
    """(doc_id, list_score, table_score, junk_score, score): how far a document stands on the side of a kind.

    A statistic of which a kind has little (or much) adds the log odds of its rank, log(P(X >= x) / P(X <= x)) or its
    negative; one in which a kind stands at either end adds the negative log of the two-sided tail as far as it
    exceeds its mean, 1.
    The score of a kind is the mean over its statistics, the greater one of two: against the language, whose ranks are
    mixed with ``PRIOR`` documents of the whole collection, and against the whole collection, as a language may consist
    of lists. score is the greatest of the three. Documents that agree in all statistics and counts (copies) count as
    one in the ranks, so that a group of copies does not make itself usual; all of them get the score.
    """
    copies_once = stats.select("lang", "n_chars", "n_words", "n_lines", *STATISTICS).distinct()
    long, table = rank_tails(stats, STATISTICS, copies_once)
    mixed = lambda c: (F.col(c) * F.col("of") + F.col(f"{c}_all") * PRIOR) / (F.col("of") + PRIOR)
    table = table.withColumns({"low": mixed("low"), "high": mixed("high")})

    def gain(kind: str, low: str, high: str) -> Column:
        out = F.lit(0.0)
        for c, way in DIRECTIONS[kind].items():
            add = way * F.log(F.col(low) / F.col(high)) if way else F.greatest(F.lit(0.0), -F.log(F.least(F.lit(1.0), 2 * F.least(low, high))) - 1)
            out = F.when(F.col("stat") == STATISTICS.index(c), add).otherwise(out)
        return out / len(DIRECTIONS[kind])

    kinds = list(DIRECTIONS)
    all_rows = long.agg(F.count(F.lit(1)).alias("all_rows"))
    table = table.select("stat", "lang", "value", "n_rows", *[gain(k, "low", "high").alias(f"own_{k}") for k in kinds], *[gain(k, "low_all", "high_all").alias(f"all_{k}") for k in kinds]).withColumn("all_rows", all_rows.scalar())
    joined = join_by_weight(long, table, ["stat", "lang", "value"], "n_rows", "all_rows")
    sums = joined.groupBy("doc_id").agg(*[F.greatest(F.sum(f"own_{k}"), F.sum(f"all_{k}")).alias(f"{k}_score") for k in kinds])
    return sums.withColumn("score", F.greatest(*[f"{k}_score" for k in kinds]))


def score_threshold(scores: DataFrame) -> float:
    """The score that parts the documents best: least variance within the two parts, over a histogram of all scores.

    The histogram is small, as scores are means of logs of shares: some hundred bins. Without any score it is 0.
    """
    rows = scores.groupBy(F.floor(F.col("score") / BIN).alias("bin")).agg(F.count(F.lit(1)).alias("n")).where("bin is not null").orderBy("bin").collect()
    if len(rows) < 2:
        return 0.0 if not rows else rows[0]["bin"] * BIN
    at, n = np.array([r["bin"] for r in rows], float), np.array([r["n"] for r in rows], float)
    share, mean = np.cumsum(n)[:-1] / n.sum(), np.cumsum(n * at)[:-1] / n.sum()
    best = int(np.argmax(((n @ at / n.sum()) * share - mean) ** 2 / (share * (1 - share))))
    return float((at[best] + 1) * BIN)


def quality_report(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Statistics, outlier scores and kind of every document (one row per id; a repeated row counts once).

    A document is taken for something else than prose if its outlier score passes the threshold that parts the scores
    of all documents best (``score_threshold``). An exact check follows: at least half of the characters of such a
    document stand in lines that are no prose; kind is then the one that holds most characters among list, table and
    junk (ties in that order). All others are "prose"; an empty or null text is "empty". Where more than half of a
    whole collection is no prose, ranks cannot tell the greater part from prose and documents of it may stay prose.
    Rows with a null id are left out. An empty table gives no rows.
    """
    docs = documents.where(F.col(doc_id).isNotNull()).select(doc_id, text, lang).dropDuplicates([doc_id])
    stats = cut_lineage(text_statistics(docs, doc_id, text, lang))  # a few numbers a document, read four times
    scores = cut_lineage(outlier_scores(stats.where("n_lines > 0"))).withColumnRenamed("doc_id", "_id")
    threshold = score_threshold(scores)
    most = F.greatest("list_share", "table_share", "junk_share")
    kind = (
        F.when(F.col("n_lines") == 0, "empty").when((F.coalesce("score", F.lit(0.0)) < threshold) | (F.col("prose_share") >= 0.5), "prose")
        .when(F.col("list_share") == most, "list").when(F.col("table_share") == most, "table").otherwise("junk")
    )
    return stats.join(scores, F.col("doc_id") == F.col("_id"), "left").drop("_id").withColumn("kind", kind)
