"""Cross-validated linear models from one triangular factor a fold.

The design's rows, [1, terms..., response], are reduced to a triangle by QR in every
task, and triangles to one a fold. The triangle has the same products as the rows, but
its condition is theirs and not its square. Any formula is a choice of its columns and
a training set the other folds' triangles under one another, so all folds and formulas
are solved from a few numbers a fold and the data are read once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.session import cut, small_side, written

NARROW = 24
FEW_DIGESTS = 10_000  # that are read to find the one at a rank
MANY_DIGESTS, SPREAD = 1_000_000, 4.0  # from here on in one pass; half a root of n is the most a rank's deviation can be
LANES = 16  # groups that a fold's triangles are reduced in before they are one
RANK_TOLERANCE = 1e-10  # of the largest singular value, columns scaled
WAVES = ("", "prev_", "prev2_", "prev3_")


def formula_terms(extra: list[str]) -> list[str]:
    """M1, M2: word_len * freq for the current word and three before, and each
    extra predictor at the same four places; a:b is a product."""
    base = [t for w in WAVES for t in (f"{w}word_len", f"{w}freq", f"{w}word_len:{w}freq")]
    return base + [f"{w}{x}" for x in extra for w in WAVES]


def term_column(term: str) -> Column:
    parts = [F.col(p).cast("double") for p in term.split(":")]
    return parts[0] if len(parts) == 1 else parts[0] * parts[1]


def is_complete(columns: list[str]) -> Column:
    """Whether all the columns are there and finite."""
    whole = F.lit(True)
    for c in columns:
        number = F.col(c).cast("double")
        whole = whole & number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))
    return whole


def complete_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose design columns are all there and finite."""
    return rows.where(is_complete(columns))


def complete_report(rows: DataFrame, columns: list[str]) -> DataFrame:
    """How many rows there are, are complete, and are left out."""
    return rows.select(F.coalesce(is_complete(columns), F.lit(False)).alias("whole")).agg(
        F.count(F.lit(1)).alias("n_input"), F.count_if("whole").alias("n_complete"), F.count_if(~F.col("whole")).alias("n_excluded")
    )


def baselines(buggy: str = "surprisal_buggy") -> dict[str, list[str]]:
    """M3: terms beyond the lexical controls: none, or the uncorrected surprisal at the
    current word and three before."""
    return {"empty": [], "full_surprisal": [f"{w}{buggy}" for w in WAVES]}


def grid_formulas(first: dict[int, str], second: dict[int, str], prefix: str = "") -> dict[str, list[str]]:
    """M8, M9: the lexical controls alone, with each predictor of either family, and
    with each pair, every predictor at four places."""
    out = {"m0": formula_terms([])}
    out |= {f"a{k}": formula_terms([a]) for k, a in first.items()} | {f"b{k}": formula_terms([b]) for k, b in second.items()}
    out |= {f"a{i}b{j}": formula_terms([a, b]) for i, a in first.items() for j, b in second.items()}
    return {f"{prefix}{name}": terms for name, terms in out.items()}


def grid_deltas(scores: DataFrame, first: list[int], second: list[int], prefix: str = "") -> DataFrame:
    """M8, M9: per cell and fold the log densities of the four models and the gain of
    each predictor given the other, as means and sums."""
    scores = sound_scores(scores)
    cells = scores.sparkSession.createDataFrame([(i, j, f"{prefix}a{i}", f"{prefix}b{j}", f"{prefix}a{i}b{j}") for i in first for j in second], "first int, second int, a string, b string, ab string")
    held = scores.select("fold", "n_train", "n_test", F.col("formula"), "ll_mean", "ll_sum")
    out = F.broadcast(cells).crossJoin(held.where(F.col("formula") == f"{prefix}m0").select("fold", "n_train", "n_test", F.col("ll_mean").alias("ll_m0_mean"), F.col("ll_sum").alias("ll_m0_sum")))
    for name, column in (("a", "a"), ("b", "b"), ("joint", "ab")):
        part = held.select(F.col("formula").alias(column), "fold", F.col("ll_mean").alias(f"ll_{name}_mean"), F.col("ll_sum").alias(f"ll_{name}_sum"))
        out = out.join(part, [column, "fold"])
    gains = {f"delta_{x}_given_{y}_{f}": F.col(f"ll_joint_{f}") - F.col(f"ll_{y}_{f}") for x, y in (("a", "b"), ("b", "a")) for f in ("mean", "sum")}
    return out.drop("a", "b", "ab").withColumns(gains)


def sample_too_small(sizes: DataFrame, terms: int | Column) -> DataFrame:
    """M5: folds (n_train) whose training rows are no more than the terms."""
    return sizes.where(F.col("n_train") <= terms)


def digest_at(rows: DataFrame, ranks: list[int]) -> dict[int, tuple[str, int, int]]:
    """For each rank from 1 of rows(digest) in the order of hexadecimal digests: the digest
    there, how many are below it and how many equal it. Counts by ever longer prefixes
    narrow a rank down to a few digests; four letters more a pass, 65,536 rows a rank."""
    open_, found = {r: ("", 0) for r in ranks}, {}
    for length in (4, 8, 12, 32):
        if not open_:
            break
        known = sorted({prefix for prefix, _ in open_.values()})
        inside = rows.where(F.substring("digest", 1, length - 4 if length < 32 else 12).isin(known)) if known != [""] else rows
        counts = sorted((r["p"], r["n"]) for r in inside.groupBy(F.substring("digest", 1, length).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
        narrowed = {}
        for rank, (prefix, below) in open_.items():
            for p, n in counts:
                if p.startswith(prefix):
                    if below + n >= rank:
                        narrowed[rank] = (p, below, n)
                        break
                    below += n
        few = sorted({p for p, _, n in narrowed.values() if n <= FEW_DIGESTS or length == 32})
        digests = sorted((r["digest"], r["n"]) for r in rows.where(F.substring("digest", 1, length).isin(few)).groupBy("digest").agg(F.count(F.lit(1)).alias("n")).collect()) if few else []
        open_ = {}
        for rank, (p, below, _) in narrowed.items():
            if p not in few:
                open_[rank] = (p, below)
                continue
            for digest, n in digests:
                if digest.startswith(p):
                    if below + n >= rank:
                        found[rank] = (digest, below, n)
                        break
                    below += n
    return found


def digest_near(near: Callable[[list[int]], DataFrame], n: int, ranks: list[int]) -> dict[int, tuple[str, int, int]] | None:
    """digest_at of n digests by one pass over them: a digest's rank is known to some square
    roots of n before, so those about each rank are written and the others only counted. None
    where one lies outside after all, or the ranks are too near each other."""
    half = math.ceil(SPREAD * math.sqrt(n)) * 2**64 // n
    edges = [min(max(0, r * 2**64 // n + side), 2**64 - 1) for r in ranks for side in (-half, half)]
    if any(b <= a for a, b in zip(edges, edges[1:], strict=False)):
        return None
    found = written(near(edges), "digests")
    counts = dict(found.where("n IS NOT NULL").groupBy("place").agg(F.sum("n")).collect())
    before, shift = {}, {}  # of each rank the digests below its place, and how many of these aren't written
    for k, r in enumerate(ranks):
        before[r] = sum(counts.get(p, 0) for p in range(2 * k + 1))
        shift[r] = sum(counts.get(p, 0) for p in range(0, 2 * k + 1, 2))
        if not before[r] < r <= before[r] + counts.get(2 * k + 1, 0):
            return None
    at = digest_at(found.where("digest IS NOT NULL").select("digest"), [r - shift[r] for r in ranks])
    return {r: (digest, below + shift[r], equal) for r in ranks for digest, below, equal in [at[r - shift[r]]]}


def assign_folds(rows: DataFrame, keys: list[str], folds: int, seed: str, digests: tuple[DataFrame, int, Callable[[list[int]], DataFrame]] | None = None) -> DataFrame:
    """Ranks by a seeded digest, cut into folds of even width as R's cut does.

    The rows are written once, but for wide rows that come from a written table by no
    shuffle and are made again when they are read: these bring their digest, and digests
    are the column alone, its length, and what takes it apart by edges. A fold ends at a digest, which counts of
    digests find, so the rows themselves are neither sorted nor shuffled; only rows that
    share the digest where a fold ends (their keys are equal) are numbered.
    """
    marked = rows if digests else written(rows, "folds").withColumn("digest", F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys])))
    alone, n, near = digests or (marked.select("digest"), marked.count(), None)
    last = {f: f * (n - 1) // folds + 1 for f in range(1, folds)} if n else {}  # the last rank of each fold
    ranks = sorted(set(last.values()))
    ends = near and n > MANY_DIGESTS and digest_near(near, n, ranks) or digest_at(alone, ranks)
    bounds = [(f, *ends[rank], rank) for f, rank in last.items()]
    fold = reduce(lambda c, b: c + (F.col("digest") > b[1]).cast("int"), bounds, F.lit(1))
    shared = {d: (below, rank) for f, d, below, equal, rank in bounds if below + equal > rank}
    if not shared:
        return marked.withColumn("fold", fold).drop("digest")
    tied = F.col("digest").isin(list(shared))
    place = F.row_number().over(Window.partitionBy("digest").orderBy(*keys))
    rank = reduce(lambda c, d: F.when(F.col("digest") == d, shared[d][0] + place).otherwise(c), shared, place)
    split = reduce(lambda c, b: c + (F.col("rank") > b[4]).cast("int"), bounds, F.lit(1))
    ranked = marked.where(tied).withColumn("rank", rank).withColumn("fold", split).drop("rank")
    return marked.where(~tied).withColumn("fold", fold).unionByName(ranked).drop("digest")


def fold_by_text(rows: DataFrame, folds: int, seed: str, text_id: str = "text_id") -> DataFrame:
    """Whole texts in one fold, by the seeded digest of the text's id."""
    digest = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col(text_id).cast("string"))), 1, 8), 16, 10).cast("long")
    return rows.withColumn("fold", (digest % folds + 1).cast("int"))


def wide_gram(rows: DataFrame, terms: list[str], response: str) -> DataFrame:
    """M4's sums for many terms: each partition multiplies its rows' matrix with itself
    in numpy, batch by batch, and hands out p * p / 2 numbers a fold."""
    columns = [F.lit(1.0), *[term_column(t) for t in terms], F.col(response).cast("double")]
    named = rows.select(F.col("fold").cast("int").alias("fold"), *[c.alias(f"c{k}") for k, c in enumerate(columns)])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            fold, *values = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            x = np.column_stack(values).astype(float)
            for k in np.unique(fold):
                part = x[fold == k]
                sums[int(k)] = sums.get(int(k), 0.0) + part.T @ part
        for k, total in sums.items():
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_pydict({"fold": np.full(len(i), k, np.int32), "i": i.astype(np.int32), "j": j.astype(np.int32), "v": total[i, j]})

    partial = named.mapInArrow(products, "fold int, i int, j int, v double")
    return partial.groupBy("fold", "i", "j").agg(F.sum("v").alias("v"))


def gram(rows: DataFrame, terms: list[str], response: str) -> DataFrame:
    """M4's sums: (fold, i, j, v) for i <= j over [1, terms..., response]; sums
    combine before the shuffle, p * p / 2 numbers a fold and task. From NARROW terms
    on the products are made in numpy, as one plan can't hold so many sums."""
    if len(terms) > NARROW:
        return wide_gram(rows, terms, response)
    columns = [F.lit(1.0), *[term_column(t) for t in terms], F.col(response).cast("double")]
    names = list(range(len(columns)))
    sums = [F.sum(columns[i] * columns[j]).alias(f"v_{i}_{j}") for i in names for j in names if i <= j]
    wide = rows.groupBy("fold").agg(*sums)
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"v_{i}_{j}").alias("v")) for i in names for j in names if i <= j])
    return wide.select("fold", F.inline(cells))


def triangle(rows: np.ndarray) -> np.ndarray:
    """The square upper triangle with the rows' products, its diagonal 0 or above."""
    r = np.linalg.qr(rows, mode="r")
    r = np.vstack([r, np.zeros((rows.shape[1] - len(r), rows.shape[1]))])
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]


def factors(rows: DataFrame, terms: list[str], response: str) -> DataFrame:
    """M4: (fold, line, values), the lines of each fold's triangle over [1, terms...,
    response]. A task reduces its rows batch by batch and hands on p lines a fold; these
    are reduced in LANES groups and then to one triangle."""
    columns = [F.lit(1.0), *[term_column(t) for t in terms], F.col(response).cast("double")]
    named = rows.select(F.col("fold").cast("int").alias("fold"), *[c.alias(f"c{k}") for k, c in enumerate(columns)])
    lined = pa.schema([("fold", pa.int32()), ("lane", pa.int32()), ("values", pa.list_(pa.float64()))])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            fold, *values = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            x = np.column_stack(values).astype(float)
            for k in np.unique(fold).tolist():
                part = x[fold == k]
                held[k] = triangle(np.vstack([held[k], part]) if k in held else part)
        lane = TaskContext.get().partitionId() % LANES
        for k, r in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(r), pa.int32()), pa.array([lane] * len(r), pa.int32()), pa.array(r.tolist(), lined.field("values").type)], schema=lined)

    def merge(lines: pd.DataFrame) -> pd.DataFrame:
        r = triangle(np.vstack(lines["values"].to_list()))
        return pd.DataFrame({"fold": lines["fold"].iloc[0], "lane": lines["lane"].iloc[0], "line": range(len(r)), "values": r.tolist()})

    ddl = "fold int, lane int, line int, values array<double>"
    lanes = named.mapInArrow(reduce, "fold int, lane int, values array<double>").groupBy("fold", "lane").applyInPandas(merge, ddl)
    return lanes.groupBy("fold").applyInPandas(merge, ddl).drop("lane")


def _fit(train: np.ndarray, use: list[int]) -> tuple[np.ndarray, int]:
    """Coefficients and rank of a formula's columns, each scaled to length one."""
    x = train[:, use]
    scale = np.linalg.norm(x, axis=0)
    scale[scale == 0] = 1
    beta, _, _, singular = np.linalg.lstsq(x / scale, train[:, -1], rcond=RANK_TOLERANCE)
    return beta / scale, int((singular > RANK_TOLERANCE * singular[0]).sum())


def fold_scores(triangles: DataFrame, terms: list[str], formulas: dict[str, list[str]]) -> DataFrame:
    """M4, M5, M7: for each formula and fold the mean and summed held-out Gaussian log
    density, the coefficients, and whether they are sound: the training design has full
    rank and more rows than coefficients, and the density is finite."""
    place = {t: k + 1 for k, t in enumerate(terms)}
    wanted = {name: [0, *[place[t] for t in use]] for name, use in formulas.items()}

    def solve(lines: pd.DataFrame) -> pd.DataFrame:
        by_fold = {fold: np.vstack(part.sort_values("line")["values"].to_list()) for fold, part in lines.groupby("fold")}
        out = []
        for fold, held in by_fold.items():
            train = triangle(np.vstack([r for k, r in by_fold.items() if k != fold] or [0 * held]))
            n_train, n_test = round(train[0, 0] ** 2), round(held[0, 0] ** 2)
            for name, use in wanted.items():
                beta, rank = _fit(train, use)
                rss = lambda r: float(((r[:, -1] - r[:, use] @ beta) ** 2).sum())  # noqa: B023, E731
                variance = rss(train) / n_train if n_train else 0.0
                density = -n_test / 2 * math.log(2 * math.pi * variance) - rss(held) / (2 * variance) if variance > 0 else math.nan
                sound = rank == len(use) and n_train > len(use) and math.isfinite(density)
                out.append((name, fold, n_train, n_test, density / n_test, density, sound, beta.tolist()))
        return pd.DataFrame(out, columns=["formula", "fold", "n_train", "n_test", "ll_mean", "ll_sum", "sound", "coefficients"])

    ddl = "formula string, fold int, n_train long, n_test long, ll_mean double, ll_sum double, sound boolean, coefficients array<double>"
    # One group of folds * p * p numbers, whatever the rows.
    return triangles.groupBy(F.lit(0).alias("all")).applyInPandas(solve, ddl)


def sound_scores(scores: DataFrame) -> DataFrame:
    """M5: the scores, unless one isn't sound, which stops the job."""
    refused = F.raise_error(F.format_string("no sound fit of %s in fold %d: too few training rows, a rank lost, or no finite density", "formula", "fold"))
    return scores.where(F.when(F.col("sound"), F.lit(True)).otherwise(refused.cast("boolean")))


def coefficients(scores: DataFrame, formulas: dict[str, list[str]]) -> DataFrame:
    """M7: (formula, fold, term, coef)."""
    named = F.create_map(*[x for name, use in formulas.items() for x in (F.lit(name), F.array(*[F.lit(t) for t in ["(Intercept)", *use]]))])
    pairs = F.arrays_zip(F.element_at(named, F.col("formula")).alias("term"), F.col("coefficients").alias("coef"))
    return scores.select("formula", "fold", F.explode(pairs).alias("p")).select("formula", "fold", F.col("p.term"), F.col("p.coef"))


def deltas(scores: DataFrame, pairs: list[tuple[str, str, str]]) -> DataFrame:
    """M6, M8, M9: for (name, with, without) the fold differences of log density; scores
    that aren't sound stop the job."""
    scores = sound_scores(scores)
    wanted = scores.sparkSession.createDataFrame(pairs, "delta string, with_name string, without_name string")
    plus = scores.select(F.col("formula").alias("with_name"), "fold", "n_test", F.col("ll_mean").alias("plus_mean"), F.col("ll_sum").alias("plus_sum"))
    minus = scores.select(F.col("formula").alias("without_name"), "fold", F.col("ll_mean").alias("minus_mean"), F.col("ll_sum").alias("minus_sum"))
    joined = plus.join(F.broadcast(wanted), "with_name").join(minus, ["without_name", "fold"])
    return joined.select("delta", "fold", "n_test", (F.col("plus_mean") - F.col("minus_mean")).alias("delta_mean"), (F.col("plus_sum") - F.col("minus_sum")).alias("delta_sum"))


def baseline_deltas(scores: DataFrame, predictors: list[str]) -> DataFrame:
    """M3, M6: (predictor, fold, diff_empty, diff_full_surprisal): the gain of each over
    either baseline, from formulas named baseline_predictor and baseline_none."""
    gains = deltas(scores, [(f"{base}|{p}", f"{base}_{p}", f"{base}_none") for base in baselines() for p in predictors])
    base, name = (F.split_part("delta", F.lit("|"), F.lit(k)) for k in (1, 2))
    return gains.groupBy(name.alias("predictor"), "fold").agg(*[F.max(F.when(base == b, F.col("delta_mean"))).alias(f"diff_{b}") for b in baselines()])


def fold_summary(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A4: mean over folds and its standard error, null for one fold."""
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("se"), F.count(value).alias("k"))


def pivot_grid(rows: DataFrame, row: str, column: str, values: list, value: str) -> DataFrame:
    """A5: mean of value with rows by one context and columns by the other."""
    return rows.groupBy(row).pivot(column, values).agg(F.avg(value))


def prediction_errors(rows: DataFrame, terms: list[str], response: str, betas: DataFrame) -> DataFrame:
    """MSE, MAE and R squared of held-out rows under each fold's coefficients
    (formula, fold, coefficients over [1, terms])."""
    x = [F.lit(1.0), *[term_column(t) for t in terms]]
    joined = rows.join(small_side(betas.select("formula", "fold", "coefficients"), betas.count()), "fold")
    fitted = sum((F.get("coefficients", F.lit(k)) * c for k, c in enumerate(x)), F.lit(0.0))
    y = F.col(response).cast("double")
    scored = joined.select("formula", "fold", y.alias("y"), (y - fitted).alias("e"))
    return scored.groupBy("formula", "fold").agg(F.avg(F.col("e") * F.col("e")).alias("mse"), F.avg(F.abs("e")).alias("mae"), (1 - F.avg(F.col("e") * F.col("e")) / F.var_pop("y")).alias("r2"))


def _newton_sums(rows: DataFrame, names: list[str], betas: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """For every fold the gradient and the Hessian of its training rows at its
    coefficients, from one pass: a row counts for each fold but its own."""
    folds, b = list(betas), np.array(list(betas.values())).T

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(folds), len(b), len(b) + 1))
        for batch in batches:
            fold, y, *values = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            x = np.column_stack([np.ones(len(y)), *values]).astype(float)
            p = 0.5 * (1 + np.tanh(x @ b / 2))
            for k, name in enumerate(folds):
                own = fold != name
                z, q = x[own], p[own, k]
                total[k, :, 0] += z.T @ (y[own] - q)
                total[k, :, 1:] += (z * (q * (1 - q))[:, None]).T @ z
        k, i, j = np.indices(total.shape).reshape(3, -1)
        yield pa.RecordBatch.from_pydict({"k": k.astype(np.int32), "i": i.astype(np.int32), "j": j.astype(np.int32), "v": total.ravel()})

    out = np.zeros((len(folds), len(b), len(b) + 1))
    for r in rows.select("fold", "label", *names).mapInArrow(sums, "k int, i int, j int, v double").groupBy("k", "i", "j").agg(F.sum("v").alias("v")).collect():  # folds * terms^2
        out[r["k"], r["i"], r["j"]] = r["v"]
    return dict(zip(folds, out, strict=True))


def logistic_scores(rows: DataFrame, terms: list[str], response: str, most_steps: int = 30) -> DataFrame:
    """Fold, n_test, mean held-out Bernoulli log density of an unpenalised logistic
    fit on the other folds. Newton's steps for all folds share one pass over the rows;
    they end when no coefficient moves, or after most_steps (separable data never rest)."""
    names = [f"x{k}" for k in range(len(terms))]
    wide = rows.select(F.col("fold").cast("int").alias("fold"), F.col(response).cast("double").alias("label"), *[term_column(t).alias(n) for n, t in zip(names, terms, strict=True)])
    ready = cut(complete_rows(wide, ["label", *names]))
    betas = {r["fold"]: np.zeros(len(terms) + 1) for r in ready.select("fold").distinct().orderBy("fold").collect()}
    for _ in range(most_steps if betas else 0):
        steps = {fold: np.linalg.lstsq(s[:, 1:], s[:, 0], rcond=None)[0] for fold, s in _newton_sums(ready, names, betas).items()}
        betas = {fold: b + steps[fold] for fold, b in betas.items()}
        if max(np.abs(s).max() for s in steps.values()) < 1e-10:
            break
    fitted = rows.sparkSession.createDataFrame([(fold, b.tolist()) for fold, b in betas.items()], "fold int, beta array<double>")
    z = sum((F.get("beta", F.lit(k + 1)) * F.col(n) for k, n in enumerate(names)), F.get("beta", F.lit(0)))
    signed = F.when(F.col("label") > 0.5, -z).otherwise(z)  # the density is -log(1 + e^signed)
    density = -(F.greatest(signed, F.lit(0.0)) + F.log1p(F.exp(-F.abs(signed))))
    return ready.join(F.broadcast(fitted), "fold").groupBy("fold").agg(F.count(F.lit(1)).alias("n_test"), F.avg(density).alias("ll_mean"))
