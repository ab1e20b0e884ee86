"""Linear model family from Gram blocks (X3): OLS, ridge, lasso, elastic net, Bayesian ridge.

One data pass: every task folds its rows into per-block Gram matrices of Z = [1, x, y]
(``mapInPandas`` partial sums, numpy inside the task); the partial matrices of a block are added in two
salted steps, so one pooled block of many tasks is not one task's. The Grams of series are a table: a fold's
training Gram is a running sum (expanding) or that of the last blocks (rolling), solved where the series'
blocks are, by ``mapInPandas``, for every model. Scoring is one more pass: the coefficient table (folds x d
numbers) joins back on the fold key. Only pooled Grams, whose number is that of the folds, reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


SALTS = 32   # first step of adding the Grams of one block
HELD = 64    # Grams of a task at a time


@dataclass
class Gram:
    """Sufficient statistics of [1, x_1..x_d, y] over a row set (G = Z'Z)."""
    G: np.ndarray

    @property
    def n(self) -> float:
        return float(self.G[0, 0])

    def __add__(self, o: Gram) -> Gram:
        return Gram(self.G + o.G)

    def __sub__(self, o: Gram) -> Gram:
        return Gram(self.G - o.G)

    def centered(self):
        """(Sxx, sxy, syy, xbar, ybar) of the centred problem."""
        n = self.n
        d = self.G.shape[0] - 2
        sx = self.G[0, 1:d + 1]
        sy = self.G[0, d + 1]
        xbar, ybar = sx / n, sy / n
        Sxx = self.G[1:d + 1, 1:d + 1] - n * np.outer(xbar, xbar)
        sxy = self.G[1:d + 1, d + 1] - n * xbar * ybar
        syy = self.G[d + 1, d + 1] - n * ybar * ybar
        return Sxx, sxy, syy, xbar, ybar


def _key(values: tuple) -> tuple:
    """Key of a row as pandas gives it: a missing number is not equal to itself there."""
    return tuple(None if v != v else v for v in values)


def _added(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum of the Grams of equal ``keys``, streamed in the tasks that the keys are dealt to."""
    def run(it):
        last = total = None
        out: list = []
        for pdf in it:
            for row in pdf.itertuples(index=False, name=None):
                k, g = _key(row[:-1]), np.frombuffer(row[-1])
                if k != last:
                    if last is not None:
                        out.append((*last, total.tobytes()))
                    last, total = k, g.copy()
                else:
                    total += g
            if len(out) > 64:
                yield pd.DataFrame(out, columns=[*keys, "_gram"])
                out = []
        if last is not None:
            out.append((*last, total.tobytes()))
        if out:
            yield pd.DataFrame(out, columns=[*keys, "_gram"])

    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("_gram", T.BinaryType())])
    return rows.select(*keys, "_gram").repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def gram_table(df: DataFrame, features: Sequence[str], target: str, keys: Sequence[str],
               center: dict[str, float] | None = None) -> DataFrame:
    """keys and ``_gram`` (the whole matrix of [1, x - c, y - c], row by row) of each block of rows;
    rows with a missing value are left out. ``center``: optional shift per column that keeps the
    sums small; results are shift-invariant after centring."""
    cols = [*features, target]
    center = center or {}
    d2 = len(cols) + 1
    keys = list(keys)
    fields = [df.schema[k] for k in keys]
    schema = T.StructType([*fields, T.StructField("_salt", T.IntegerType()), T.StructField("_gram", T.BinaryType())])
    shifts = np.array([center.get(c, 0.0) for c in cols])

    def part(it):
        from pyspark import TaskContext
        salt = TaskContext.get().partitionId() % SALTS
        acc: dict[tuple, np.ndarray] = {}
        for pdf in it:
            pdf = pdf.dropna(subset=cols)
            if pdf.empty:
                continue
            for k, g in pdf.groupby(keys, sort=False, dropna=False):
                k = k if isinstance(k, tuple) else (k,)
                z = np.empty((len(g), d2))
                z[:, 0] = 1.0
                z[:, 1:] = g[cols].to_numpy(dtype=float) - shifts
                m = z.T @ z
                acc[k] = acc[k] + m if k in acc else m
            if len(acc) > HELD:  # a task with many blocks does not gather them all
                yield pd.DataFrame([(*k, salt, m.tobytes()) for k, m in acc.items()], columns=[*keys, "_salt", "_gram"])
                acc = {}
        if acc:
            yield pd.DataFrame([(*k, salt, m.tobytes()) for k, m in acc.items()], columns=[*keys, "_salt", "_gram"])

    partial = df.select(*keys, *cols).mapInPandas(part, schema)
    return _added(_added(partial, [*keys, "_salt"]).drop("_salt"), keys)


def as_gram(raw: bytes) -> Gram:
    flat = np.frombuffer(raw)
    d2 = int(round(len(flat) ** 0.5))
    return Gram(flat.reshape(d2, d2).copy())


def gram_blocks(df: DataFrame, features: Sequence[str], target: str, block_cols: Sequence[str],
                center: dict[str, float] | None = None) -> dict[tuple, Gram]:
    """:func:`gram_table` on the driver: for pooled blocks, whose number is that of the folds."""
    keys = list(block_cols)
    return {tuple(r[c] for c in keys): as_gram(r["_gram"]) for r in gram_table(df, features, target, keys, center).collect()}


def column_means(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    r = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
    return {c: float(r[c]) if r[c] is not None else 0.0 for c in cols}


# ---- solvers on a Gram ---------------------------------------------------------------------------
@dataclass
class LinearFit:
    coef: np.ndarray
    intercept: float
    converged: bool = True

    def shifted(self, center: np.ndarray, y_shift: float) -> LinearFit:
        """Coefficients for the original (unshifted) columns."""
        return LinearFit(self.coef, self.intercept + y_shift - float(self.coef @ center), self.converged)


def solve_ridge(g: Gram, alpha: float) -> LinearFit:
    """alpha = 0: OLS (minimum-norm least squares); alpha > 0: sklearn Ridge with intercept. OLS is
    solved on the standardised Gram: columns of magnitudes 1e10 and 1 in one matrix would lose
    directions to rounding."""
    if alpha == 0:
        scaled, s = standardized(g)
        Sxx, sxy, *_ = scaled.centered()
        coef = np.linalg.lstsq(Sxx, sxy, rcond=None)[0] / s
        _, _, _, xbar, ybar = g.centered()
    else:
        Sxx, sxy, _, xbar, ybar = g.centered()
        coef = np.linalg.solve(Sxx + alpha * np.eye(len(sxy)), sxy)
    return LinearFit(coef, float(ybar - xbar @ coef))


def solve_elastic_net(g: Gram, alpha: float, l1_ratio: float = 1.0, max_iter: int = 1000,
                      tol: float = 1e-4, warm: np.ndarray | None = None) -> LinearFit:
    """Coordinate descent on the covariance form of sklearn's objective
    (1/2n)||y - Xb||^2 + alpha l1 ||b||_1 + alpha (1 - l1)/2 ||b||^2 (lasso: l1 = 1).
    ``warm``: start from a previous solution (consecutive walk-forward folds differ by one
    block, so a warm start converges in a few sweeps)."""
    Sxx, sxy, _, xbar, ybar = g.centered()
    n = g.n
    d = len(sxy)
    b = np.zeros(d) if warm is None or len(warm) != d else warm.copy()
    l1, l2 = n * alpha * l1_ratio, n * alpha * (1.0 - l1_ratio)
    diag = np.diag(Sxx)
    for _ in range(max_iter):
        delta = 0.0
        for j in range(d):
            if diag[j] <= 0:
                continue
            rho = sxy[j] - Sxx[j] @ b + Sxx[j, j] * b[j]
            new = np.sign(rho) * max(abs(rho) - l1, 0.0) / (diag[j] + l2)
            delta = max(delta, abs(new - b[j]))
            b[j] = new
        if delta <= tol * max(1.0, np.abs(b).max()):
            break
    else:
        return LinearFit(b, float(ybar - xbar @ b), False)
    return LinearFit(b, float(ybar - xbar @ b))


def solve_elastic_net_batch(gs: Sequence[Gram], alpha, l1_ratio=1.0, max_iter: int = 1000,
                            tol: float = 1e-4) -> list[LinearFit]:
    """The same coordinate descent for many problems at once (all folds / groups): the sweep
    over coordinates is a Python loop, each coordinate update is vectorised over problems."""
    if not gs:
        return []
    cs = [g.centered() for g in gs]
    Sxx = np.stack([c[0] for c in cs])
    sxy = np.stack([c[1] for c in cs])
    xbar = np.stack([c[3] for c in cs])
    ybar = np.array([c[4] for c in cs])
    n = np.array([g.n for g in gs])
    P, d = sxy.shape
    alpha = np.broadcast_to(np.asarray(alpha, dtype=float), (P,))  # one value or one per problem
    l1_ratio = np.broadcast_to(np.asarray(l1_ratio, dtype=float), (P,))
    l1, l2 = n * alpha * l1_ratio, n * alpha * (1.0 - l1_ratio)
    diag = np.einsum("pii->pi", Sxx)
    B = np.zeros((P, d))
    active = np.ones(P, dtype=bool)
    for _ in range(max_iter):
        delta = np.zeros(P)
        idx = np.where(active)[0]
        S, Bi = (Sxx, B) if len(idx) == P else (Sxx[idx], B[idx])
        for j in range(d):
            dj = diag[idx, j]
            rho = sxy[idx, j] - np.einsum("pk,pk->p", S[:, j, :], Bi) + dj * Bi[:, j]
            new = np.where(dj > 0, np.sign(rho) * np.maximum(np.abs(rho) - l1[idx], 0.0) / np.where(dj > 0, dj + l2[idx], 1.0), 0.0)
            delta[idx] = np.maximum(delta[idx], np.abs(new - Bi[:, j]))
            Bi[:, j] = new
        if Bi is not B:
            B[idx] = Bi
        active = delta > tol * np.maximum(1.0, np.abs(B).max(axis=1))
        if not active.any():
            break
    return [LinearFit(B[p], float(ybar[p] - xbar[p] @ B[p]), not active[p]) for p in range(P)]


def standardized(g: Gram) -> tuple[Gram, np.ndarray]:
    """The Gram of [1, x / s, y] with s = population std of x over the same rows (a scaler fit on
    exactly these rows), and s. Constant columns keep s = 1."""
    n = g.n
    d = g.G.shape[0] - 2
    Sxx, _, _, _, _ = g.centered()
    s = np.sqrt(np.clip(np.diag(Sxx) / max(n, 1.0), 0.0, None))
    s[s == 0] = 1.0
    scale = np.concatenate([[1.0], 1.0 / s, [1.0]])
    return Gram(g.G * np.outer(scale, scale)), s


def solve_many(solver: str, gs: Sequence[Gram], params, standardize: bool = False) -> list[LinearFit]:
    """Solve one model on many Grams; lasso / elastic net run batched. ``params``: one dict, or
    one dict per Gram (e.g. every trial x fold of a search in one batch). ``standardize``: fit on
    features scaled by each Gram's own (training) std, coefficients mapped back."""
    if standardize:
        pairs = [standardized(g) for g in gs]
        fits = solve_many(solver, [p[0] for p in pairs], params)
        out = []
        for (g, s), f in zip(pairs, fits):
            out.append(LinearFit(f.coef / s, f.intercept, f.converged))
        return out
    plist = list(params) if isinstance(params, (list, tuple)) else [params] * len(gs)
    if solver == "lasso":
        return solve_elastic_net_batch(gs, [p.get("alpha", 0.1) for p in plist], 1.0)
    if solver == "elastic_net":
        return solve_elastic_net_batch(gs, [p.get("alpha", 0.1) for p in plist],
                                       [p.get("l1_ratio", 0.5) for p in plist])
    return [SOLVERS[solver](g, p) for g, p in zip(gs, plist)]


def solve_bayesian_ridge(g: Gram, max_iter: int = 300, tol: float = 1e-3, a1: float = 1e-6, a2: float = 1e-6,
                         l1: float = 1e-6, l2: float = 1e-6) -> LinearFit:
    """Evidence maximisation (alpha: noise precision, lambda: weight precision) on the
    eigen-decomposition of the centred Gram."""
    Sxx, sxy, syy, xbar, ybar = g.centered()
    n = g.n
    eig, V = np.linalg.eigh(Sxx)
    eig = np.clip(eig, 0.0, None)
    alpha = 1.0 / (syy / n + np.finfo(float).eps)
    lam = 1.0
    coef = np.zeros(len(sxy))
    proj = V.T @ sxy
    for _ in range(max_iter):
        new = V @ (proj / (eig + lam / alpha))
        rss = syy - 2.0 * new @ sxy + new @ Sxx @ new
        gamma = float(np.sum(alpha * eig / (lam + alpha * eig)))
        lam = (gamma + 2.0 * l1) / (float(new @ new) + 2.0 * l2)
        alpha = (n - gamma + 2.0 * a1) / (max(rss, 0.0) + 2.0 * a2)
        done = np.sum(np.abs(coef - new)) < tol
        coef = new
        if done:
            break
    return LinearFit(coef, float(ybar - xbar @ coef))


SOLVERS = {
    "linear_regression": lambda g, p: solve_ridge(g, 0.0),
    "ridge": lambda g, p: solve_ridge(g, p.get("alpha", 1.0)),
    "lasso": lambda g, p: solve_elastic_net(g, p.get("alpha", 0.1), 1.0, warm=p.get("_warm")),
    "elastic_net": lambda g, p: solve_elastic_net(g, p.get("alpha", 0.1), p.get("l1_ratio", 0.5), warm=p.get("_warm")),
    "bayesian_ridge": lambda g, p: solve_bayesian_ridge(g),
}


# ---- fold-blocked evaluation ------------------------------------------------------------------------
FITS = "model string, n long, intercept double, coef array<double>, converged boolean, error string"


def _fit_rows(grams: Sequence[Gram], models: dict[str, tuple[str, dict]], shift: np.ndarray, y_shift: float) -> list[list[tuple]]:
    """Rows of ``FITS`` for each Gram: a model that cannot be fitted has a reason instead of numbers."""
    out: list[list[tuple]] = [[] for _ in grams]
    good = [i for i, g in enumerate(grams) if g.n >= 2]
    for name, (solver, params) in models.items():
        for i, g in enumerate(grams):
            if g.n < 2:
                out[i].append((name, int(g.n), None, None, False, "fewer than two training rows"))
        try:
            fits = solve_many(solver, [grams[i] for i in good], params)
        except np.linalg.LinAlgError:
            fits = []
            for i in good:  # one by one: only the folds at fault fail
                try:
                    fits.append(solve_many(solver, [grams[i]], params)[0])
                except np.linalg.LinAlgError as e:
                    fits.append(f"LinAlgError: {e}")
        for i, fit in zip(good, fits, strict=True):
            if isinstance(fit, str):
                out[i].append((name, int(grams[i].n), None, None, False, fit))
            else:
                fit = fit.shifted(shift, y_shift)
                out[i].append((name, int(grams[i].n), fit.intercept, fit.coef.tolist(), bool(fit.converged), None))
    return out


def fold_fits(grams: DataFrame, group: Sequence[str], block: str, last_fold: str, models: dict[str, tuple[str, dict]], features: Sequence[str],
              target: str, center: dict[str, float], window_blocks: int | None = None) -> DataFrame:
    """group, fold and ``FITS`` of every fold 0 .. ``last_fold`` (a column of ``grams``, constant in a group) of every
    group. Fold f trains on the blocks 0 .. f, or on the last ``window_blocks`` of them. Blocks arrive in order, so the
    state of a group is one running sum (or the blocks of the window) and the ``HELD`` folds solved together."""
    shift, y_shift = np.array([center[c] for c in features]), center[target]
    d2 = len(features) + 2
    group = list(group)
    names = [*group, "fold", *[c.split()[0] for c in FITS.split(", ")]]

    def run(it):
        key = end = None
        total, window, fold, held, out = np.zeros((d2, d2)), [], 0, [], []

        def solve():
            for (f, _), rows in zip(held, _fit_rows([Gram(g) for _, g in held], models, shift, y_shift), strict=True):
                out.extend((*key, f, *r) for r in rows)
            held.clear()

        def upto(f):
            """Folds before ``f`` have all their blocks."""
            nonlocal fold
            while fold < f and fold <= end:
                train = total if window_blocks is None else sum((g for b, g in window if b > fold - window_blocks), np.zeros((d2, d2)))
                held.append((fold, np.array(train)))
                fold += 1
                if len(held) >= HELD:
                    solve()

        for pdf in it:
            for row in pdf.itertuples(index=False, name=None):
                k, blk, last, g = _key(row[:len(group)]), int(row[-3]), row[-2], np.frombuffer(row[-1]).reshape(d2, d2)
                if k != key:
                    if key is not None:
                        upto(end + 1)
                        solve()
                    key, end, fold, window, total = k, -1 if pd.isna(last) else int(last), 0, [], np.zeros((d2, d2))
                upto(blk)
                if window_blocks is None:
                    total = total + g
                else:
                    window = [(b, w) for b, w in window if b > blk - window_blocks] + [(blk, g)]
            if out:
                yield pd.DataFrame(out, columns=names)
                out.clear()
        if key is not None:
            upto(end + 1)
            solve()
        if out:
            yield pd.DataFrame(out, columns=names)

    schema = ", ".join([*(f"`{k}` {grams.schema[k].dataType.simpleString()}" for k in group), "fold long", FITS])
    return grams.select(*group, block, last_fold, "_gram").repartition(*group).sortWithinPartitions(*group, block).mapInPandas(run, schema)


def group_fits(grams: DataFrame, group: Sequence[str], models: dict[str, tuple[str, dict]], features: Sequence[str], target: str,
               center: dict[str, float]) -> DataFrame:
    """group and ``FITS`` of each group's one Gram."""
    one = grams.withColumns({"_blk": F.lit(0), "_last": F.lit(0).cast("long")})
    return fold_fits(one, group, "_blk", "_last", models, features, target, center).drop("fold")


def coefficient_table(spark, fits: dict[tuple, LinearFit], key_names: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(keys..., intercept, coef array) — folds x models rows (small: never data rows). The
    coefficients stay one array column so the scoring join stays narrow."""
    first = next(iter(fits), None)

    def ktype(i, name):
        if first is not None:
            v = first[i]
            return "bigint" if isinstance(v, (int, np.integer)) else ("double" if isinstance(v, float) else "string")
        return "bigint" if name in ("fold", "_blk") else "string"
    ddl = ", ".join([f"`{n}` {ktype(i, n)}" for i, n in enumerate(key_names)] + ["intercept double", "coef array<double>"])

    def norm(v):
        return int(v) if isinstance(v, (int, np.integer)) else (float(v) if isinstance(v, (float, np.floating)) else v)
    rows = [(*[norm(x) for x in k], float(fit.intercept), [float(v) for v in fit.coef]) for k, fit in fits.items()]
    return spark.createDataFrame(rows, ddl)


def score(df: DataFrame, coefs: DataFrame, join_keys: Sequence[str], features: Sequence[str],
          out: str = "pred", how: str = "inner") -> DataFrame:
    """One pass: join rows to their fold's coefficients (a table of folds x models rows) and
    evaluate intercept + sum b_j x_j (``zip_with`` of the coefficient array and the features)."""
    j = df.join(coefs, list(join_keys), how)
    x = F.array(*[F.col(c).cast("double") for c in features])
    dot = F.aggregate(F.zip_with(F.col("coef"), x, lambda b, v: b * v), F.lit(0.0), lambda acc, t: acc + t)
    extra = [c for c in coefs.columns if c not in join_keys and c not in ("intercept", "coef")]
    return j.select(*df.columns, *extra, (F.col("intercept") + dot).alias(out))
