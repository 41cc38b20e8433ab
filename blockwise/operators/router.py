"""Block features, a logistic reliability model, and risk-coverage curves."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockwise.common import cut_lineage, numbered_within
from blockwise.functions.fields import coverage
from blockwise.operators import similarity as sm
from blockwise.operators.prompts import prompt_size
from blockwise.operators.selection import seeded_order

VIEWS = sm.VIEWS
BASIC = ["paper_count", "title_coverage", "organization_coverage", "coauthor_coverage", "overall_coverage", "estimated_prompt_tokens", "tokens_per_paper"]
SIMILARITY = [f"{v}_{m}" for v in VIEWS for m in ("pairwise_similarity_mean", "pairwise_similarity_std", "nearest_neighbor_similarity_mean", "nearest_neighbor_margin_mean")]
AGREEMENT = ["title_organization_neighbor_agreement", "title_coauthor_neighbor_agreement", "organization_coauthor_neighbor_agreement", "mean_cross_view_agreement"]
SYMBOLS = ["title_digit_ratio", "title_non_alphabetic_ratio", "title_uppercase_token_ratio", "title_formula_like_token_ratio"]
FEATURES = [*BASIC, *SIMILARITY, *AGREEMENT, *SYMBOLS]
#: Feature sets of the compared rankers; the random one uses a seeded hash of the name.
MODEL_FEATURES = {"paper_count_only": ["paper_count"], "coverage_only": ["title_coverage", "organization_coverage", "coauthor_coverage", "overall_coverage"], "full": FEATURES}


def title_symbols(cards: DataFrame) -> DataFrame:
    """Per block: digits and non-letters among visible characters, upper-case words among words with a letter (two
    letters or more), formula-like words among words. Counts are added up over titles; a block without words has 0."""
    t = F.coalesce("title", F.lit(""))
    words = F.filter(F.split(t, r"(?U)\s+"), lambda w: w != "")
    has = lambda w, p: F.regexp_like(w, F.lit(p))
    upper = F.filter(words, lambda w: (F.regexp_count(w, F.lit(r"\p{L}")) >= 2) & (F.regexp_count(w, F.lit(r"\p{L}")) == F.regexp_count(w, F.lit(r"\p{Lu}"))))
    formula = F.filter(words, lambda w: (has(w, r"\p{L}") & has(w, r"\p{Nd}")) | (has(w, r"[\p{L}\p{N}]") & has(w, r"[=+*/^]")))
    s = cards.select(
        "name", F.regexp_count(t, F.lit(r"(?U)\S")).alias("c"), F.regexp_count(t, F.lit(r"\p{Nd}")).alias("d"), F.regexp_count(t, F.lit(r"\p{L}")).alias("l"), F.size(words).alias("w"),
        F.size(F.filter(words, lambda w: has(w, r"\p{L}"))).alias("a"), F.size(upper).alias("u"), F.size(formula).alias("f"))
    g = s.groupBy("name").agg(*[F.sum(x).alias(x) for x in "cdlwauf"])
    per = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    c = F.col
    return g.select("name", per(c("d"), c("c")).alias(SYMBOLS[0]), per(c("c") - c("l"), c("c")).alias(SYMBOLS[1]), per(c("u"), c("a")).alias(SYMBOLS[2]), per(c("f"), c("w")).alias(SYMBOLS[3]))


def block_features(cards: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row per block: the 27 features of ``FEATURES``; what cannot be computed is null."""
    near = sm.block_statistics(sm.neighbour_statistics(sm.views(cards)))
    cov = coverage(cards, blocks, "router")
    size = prompt_size(cards).select("name", F.col("tokens").cast("double").alias("estimated_prompt_tokens"), "tokens_per_paper")
    f = cov.withColumn("paper_count", F.col("paper_count").cast("double")).join(size, "name", "left").join(near, "name", "left").join(title_symbols(cards), "name", "left")
    return f.select("name", *FEATURES)


def fold_of(name: Column, label: Column, folds: int = 5, seed: int = 42) -> Column:
    """A fold number, balanced within each class, from a seeded hash order. For frames of blocks."""
    return F.pmod(F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64(name, F.lit(seed)), name)), F.lit(folds))


def split_blocks(df: DataFrame, share: float = 0.8, seed: int = 42) -> DataFrame:
    """Add ``part``: train for the first round(share * blocks) of a seeded order of the names, test for the others."""
    keyed = df.withColumn("_h", seeded_order(seed, "name"))
    many = df.agg(F.round(F.count(F.lit(1)) * share).alias("n"))
    return numbered_within(keyed, [], ["_h", "name"], "_k").withColumn("part", F.when(F.col("_k") < many.scalar(), "train").otherwise("test")).drop("_h", "_k")


#: One row per feature, and one for the constant term.
MODEL_SCHEMA = "feature string, median double, mean double, scale double, coefficient double"
CONSTANT = "(constant)"


#: Newton steps of a fit at most, and the change of a coefficient from which on it goes no further.
STEPS, ENOUGH = 100, 1e-8


def _standardized(df: DataFrame, columns: list[str], label: str, sets: int) -> dict[int, dict]:
    """By training set (flags ``_in0``, ``_in1`` ..): rows, ones, and per column median, mean and deviation once nulls are
    filled with the median. One row a set comes to the driver."""
    member = F.filter(F.array(*[F.lit(k) for k in range(sets)]), lambda k: F.element_at(F.array(*[F.col(f"_in{j}") for j in range(sets)]), k + 1))
    of = [f(c).alias(f"{x}{i}") for i, c in enumerate(columns) for x, f in (("d", lambda c: F.percentile(c, F.lit(0.5))), ("k", F.count), ("m", F.avg), ("s", F.stddev_pop))]
    found = df.withColumn("_set", F.explode(member)).groupBy("_set").agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("ones"), *of).collect()  # one row a set
    out = {k: {"n": 0, "ones": 0, "median": {c: 0.0 for c in columns}, "mean": {c: 0.0 for c in columns}, "scale": {c: 1.0 for c in columns}} for k in range(sets)}
    for r in found:
        o, n = out[r["_set"]], r["n"]
        o["n"], o["ones"] = n, int(r["ones"] or 0)
        for i, c in enumerate(columns):
            known = r[f"k{i}"]
            if known:
                med, mean, dev = float(r[f"d{i}"]), float(r[f"m{i}"]), float(r[f"s{i}"])
                if known < n:
                    of_known, mean = mean, (known * mean + (n - known) * med) / n
                    dev = ((known * (dev**2 + (of_known - mean) ** 2) + (n - known) * (med - mean) ** 2) / n) ** 0.5
                o["median"][c], o["mean"][c], o["scale"][c] = med, mean, dev if dev > 1e-12 * abs(mean) else 1.0
    return out


def _pass(fits: list[dict], columns: list[str], label: str):
    """Loss, gradient and curvature of every fit at its point, added up over the rows of a task."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            col = {c: b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in (*columns, label)}
            for f in fits:
                rows = b.column(f"_in{f['set']}").to_numpy(zero_copy_only=False).astype(bool)
                x = np.ones((int(rows.sum()), len(f["columns"]) + 1))
                for i, c in enumerate(f["columns"]):
                    v = col[c][rows]
                    x[:, i] = (np.where(np.isnan(v), f["median"][i], v) - f["mean"][i]) / f["scale"][i]
                y = col[label][rows]
                w = np.where(y == 1, f["weights"][1], f["weights"][0])
                z = x @ f["at"]
                p = 0.5 * (1 + np.tanh(z / 2))
                loss, grad, curve = (w * (np.logaddexp(0, z) - y * z)).sum(), x.T @ (w * (p - y)), (x * (w * p * (1 - p))[:, None]).T @ x
                sums[f["no"]] = sums.get(f["no"], 0.0) + np.concatenate([[loss], grad, curve.ravel()])
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["no", "sums"])

    return run


def fit_rows(df: DataFrame, sets: list[Column], models: list[tuple[int, list[str]]], label: str = "reliable_085") -> list[list[tuple]]:
    """The rows of ``MODEL_SCHEMA`` of several models, each a (number of its training set, columns): balanced logistic
    regressions with L2 penalty C = 1, as ``fit_model`` says.

    All are fitted at once by Newton's method: a pass over the frame adds up gradients and curvatures of all models, one
    row per model and partition comes to the driver, and a step that does not lower the loss is halved.
    """
    columns = list(dict.fromkeys(c for _, cs in models for c in cs))
    rows = cut_lineage(df.select(F.col(label).cast("double").alias(label), *[F.col(c).cast("double").alias(c) for c in columns], *[s.alias(f"_in{k}") for k, s in enumerate(sets)]))
    stats = _standardized(rows, columns, label, len(sets))
    fits, out = [], []
    for no, (k, own) in enumerate(models):
        s = stats[k]
        n, ones = s["n"], s["ones"]
        f = {"no": no, "set": k, "columns": own, "at": np.zeros(len(own) + 1)} | {x: [s[x][c] for c in own] for x in ("median", "mean", "scale")}
        out.append(f)
        if ones in (0, n):
            f["at"][-1] = float("inf") if n and ones == n else float("-inf")
        else:
            fits.append(f | {"weights": (n / (2 * (n - ones)), n / (2 * ones)), "best": None})
    open_fits = fits
    for _ in range(STEPS):
        if not open_fits:
            break
        sums: dict[int, np.ndarray] = {}
        sent = [{x: f[x] for x in ("no", "set", "columns", "median", "mean", "scale", "weights", "at")} for f in open_fits]
        for r in rows.mapInArrow(_pass(sent, columns, label), "no int, sums binary").collect():  # one row per model and partition
            sums[r["no"]] = sums.get(r["no"], 0.0) + np.frombuffer(bytes(r["sums"]))
        going = []
        for f in open_fits:
            v, m = sums[f["no"]], len(f["at"])
            penalty = np.append(np.ones(m - 1), 0.0)
            loss = v[0] + 0.5 * (penalty * f["at"] ** 2).sum()
            if f["best"] is None or loss <= f["best"][0] + 1e-12 * abs(f["best"][0]):
                step = -np.linalg.lstsq(v[1 + m :].reshape(m, m) + np.diag(penalty), v[1 : 1 + m] + penalty * f["at"], rcond=None)[0]
                f["best"] = loss, f["at"], step
            else:
                f["best"] = *f["best"][:2], f["best"][2] / 2
            if np.abs(f["best"][2]).max() > ENOUGH:
                f["at"] = f["best"][1] + f["best"][2]
                going.append(f)
            else:
                f["at"] = f["best"][1]
        open_fits = going
    for f in open_fits:
        f["at"] = f["best"][1]
    for f in fits:
        out[f["no"]]["at"] = f["at"]
    return [[*zip(f["columns"], f["median"], f["mean"], f["scale"], [float(c) for c in f["at"][:-1]]), (CONSTANT, None, None, None, float(f["at"][-1]))] for f in out]


def fit_model(train: DataFrame, columns: list[str], label: str = "reliable_085") -> DataFrame:
    """The model as a frame of ``MODEL_SCHEMA``: balanced logistic regression with L2 penalty C = 1.

    Nulls become the training median, columns are scaled by the training mean and population deviation. With one class
    only, all coefficients are 0 and the constant gives the share of that class.
    """
    return train.sparkSession.createDataFrame(fit_rows(train, [F.lit(True)], [(0, columns)], label)[0], MODEL_SCHEMA)


def _scored(rows: list[tuple], df: DataFrame) -> DataFrame:
    z = F.lit(next(r[4] for r in rows if r[0] == CONSTANT))
    for feature, median, mean, scale, coefficient in rows:
        if feature != CONSTANT and coefficient:
            z = z + (F.coalesce(F.col(feature), F.lit(median)) - mean) / scale * coefficient
    return df.withColumn("predicted_probability", 1 / (1 + F.exp(-z)))


def predict(model: DataFrame, df: DataFrame) -> DataFrame:
    """Add ``predicted_probability``: the model is read as one expression, so scoring is a narrow projection."""
    return _scored([tuple(r) for r in model.select("feature", "median", "mean", "scale", "coefficient").collect()], df)  # one row a feature


def cross_validated(features: DataFrame, folds: int = 5, models: dict[str, list[str]] | None = None) -> DataFrame:
    """(name, b3_f1, reliable_085, hard_080, predicted_probability, model_name): out-of-fold for the given rankers.

    By default all of ``MODEL_FEATURES`` and a random one. The fits of all rankers and folds read a frame of blocks, not
    of papers, on the executors, in common passes.
    """
    df = cut_lineage(features.withColumn("fold", fold_of(F.col("name"), F.col("reliable_085"), folds)))
    keep = ["name", "b3_f1", "reliable_085", "hard_080"]
    out = df.select(*keep, (F.pmod(F.xxhash64("name", F.lit(42)), F.lit(1 << 30)) / float(1 << 30)).alias("predicted_probability"), F.lit("random").alias("model_name")) if models is None else None
    wanted = [(name, columns, k) for name, columns in (models or MODEL_FEATURES).items() for k in range(folds)]
    fitted = fit_rows(df, [F.col("fold") != k for k in range(folds)], [(k, columns) for _, columns, k in wanted])
    for (name, _, k), rows in zip(wanted, fitted):
        scored = _scored(rows, df.where(F.col("fold") == k)).select(*keep, "predicted_probability", F.lit(name).alias("model_name"))
        out = scored if out is None else out.unionByName(scored)
    return out


def final_model(train: DataFrame, columns: list[str] = FEATURES) -> tuple[DataFrame, float]:
    """(model of all training blocks, threshold): the threshold is chosen on the out-of-fold probabilities of the training
    blocks, never on those of a model that has seen them; 0.5 where there is nothing to choose from."""
    chosen = choose_threshold(threshold_sweep(cross_validated(train, models={"full": columns}))).first()  # one row
    return fit_model(train, columns), float(chosen["threshold"]) if chosen else 0.5


def importance(model: DataFrame) -> DataFrame:
    """(feature, coefficient, place): coefficients of the scaled features, the greatest absolute value first."""
    w = Window.orderBy(F.abs("coefficient").desc(), "feature")  # one row a feature
    return model.where(F.col("feature") != CONSTANT).select("feature", "coefficient", F.row_number().over(w).alias("place"))


def _selection(accepted: Column) -> list[Column]:
    r, h, n = F.col("reliable_085"), F.col("hard_080"), F.count(F.lit(1))
    return [
        F.count_if(accepted).alias("accepted_authors"), F.avg(F.when(accepted, r)).alias("accepted_precision"), (F.count_if(accepted) / n).alias("coverage"),
        F.try_divide(F.count_if(~accepted & (h == 1)).cast("double"), F.count_if(h == 1).cast("double")).alias("hard_block_recall"), F.avg(F.when(accepted, F.col("b3_f1"))).alias("accepted_mean_b3_f1")]


def selection_metrics(df: DataFrame, accepted: Column, by: list[str] | None = None) -> DataFrame:
    """Accepted blocks, their precision, coverage, recall of hard blocks among the refused, mean B-cubed F1; null where undefined."""
    return df.groupBy(*(by or [])).agg(*_selection(accepted))


def coverage_curve(df: DataFrame) -> DataFrame:
    """Per model and k: the metrics of accepting the k blocks of greatest probability (ties by name).

    Cumulative sums over the blocks of a model; blocks, not papers, are the rows.
    """
    w = Window.partitionBy("model_name").orderBy(F.col("predicted_probability").desc(), "name")
    run, every = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("model_name")
    k, n = F.row_number().over(w), F.count(F.lit(1)).over(every)
    hard = F.sum("hard_080").over(every)
    return df.select("model_name", k.alias("accepted_authors"), (F.sum("reliable_085").over(run) / k).alias("accepted_precision"), (k / n).alias("coverage"), F.try_divide((hard - F.sum("hard_080").over(run)).cast("double"), hard.cast("double")).alias("hard_block_recall"), (F.sum("b3_f1").over(run) / k).alias("accepted_mean_b3_f1"))


def coverage_checkpoints(curve: DataFrame, targets: tuple[float, ...] = (0.2, 0.4, 0.6, 0.8, 1.0)) -> DataFrame:
    """The curve at ceil(target * n) accepted blocks."""
    n = F.max("accepted_authors").over(Window.partitionBy("model_name"))
    t = curve.withColumn("_n", n).withColumn("target_coverage", F.explode(F.array(*[F.lit(x) for x in targets])))
    return t.where(F.col("accepted_authors") == F.ceil(F.col("target_coverage") * F.col("_n"))).drop("_n")


def threshold_sweep(df: DataFrame) -> DataFrame:
    """Metrics at the thresholds .50, .55 .. .95."""
    t = df.withColumn("threshold", F.explode(F.array(*[F.lit(x / 100) for x in range(50, 100, 5)])))
    return selection_metrics(t, F.col("predicted_probability") >= F.col("threshold"), ["threshold"])


def choose_threshold(sweep: DataFrame, least: float = 0.90) -> DataFrame:
    """One row: among thresholds of at least that precision the one of greatest coverage, then precision, then the
    lowest; if there is none, of greatest precision, then coverage, then the lowest."""
    ok = F.coalesce(F.col("accepted_precision") >= least, F.lit(False))
    known = sweep.where("accepted_precision is not null").withColumn("_ok", ok)
    first = F.when(F.col("_ok"), F.col("coverage")).otherwise(F.col("accepted_precision"))
    second = F.when(F.col("_ok"), F.col("accepted_precision")).otherwise(F.col("coverage"))
    return known.orderBy(F.col("_ok").desc(), first.desc(), second.desc(), "threshold").limit(1).drop("_ok")


def failure_modes(df: DataFrame) -> DataFrame:
    """One row: hard blocks by low precision (P < .8) and low recall (R < .8)."""
    h = df.where("hard_080 = 1")
    p, r = F.col("b3_precision") < 0.8, F.col("b3_recall") < 0.8
    return h.agg(F.count_if(p & ~r).alias("low_precision_only"), F.count_if(~p & r).alias("low_recall_only"), F.count_if(p & r).alias("both_low"), F.count_if(~p & ~r).alias("neither"))


def rank_correlations(df: DataFrame, columns: list[str], target: str = "b3_f1") -> DataFrame:
    """(feature, spearman): correlation of average ranks with the target's, rows with a null left out per feature."""
    long = df.select(F.col(target).alias("y"), F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns]))).where("x is not null and y is not null")
    avg_rank = lambda c: F.rank().over(Window.partitionBy("feature").orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("feature", c)) - 1) / 2
    r = long.select("feature", avg_rank("x").alias("rx"), avg_rank("y").alias("ry"))
    s = r.groupBy("feature").agg(F.covar_pop("rx", "ry").alias("c"), F.stddev_pop("rx").alias("sx"), F.stddev_pop("ry").alias("sy"))
    return s.select("feature", F.try_divide("c", F.col("sx") * F.col("sy")).alias("spearman"))
