"""Logit and least squares with default or cluster-robust errors.

Rows stay in Spark: every step sums products and scores over all rows in numpy, batch by batch, and adds up one set of sums a
task; the driver solves the k-by-k system. Several outcomes of one design share each pass. Robust errors need one more
aggregation, by cluster.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonemill.session import share_package


@dataclass
class Design:
    """Rows with columns of outcomes, cluster and x0, x1, ...; names of the x columns and of the outcomes."""

    rows: DataFrame
    names: list[str]
    outcomes: tuple[str, ...] = ("y",)

    def columns(self) -> list[str]:
        return [f"x{i}" for i in range(len(self.names))]


#: Levels of a factor that a design may have: each is a column.
MOST_LEVELS = 2000


def design(df: DataFrame, y: str | list[str], numeric, factor: str | None = None, base: str | None = None, cluster: str | None = None, coding: str = "treatment", interactions=()) -> Design:
    """Intercept, levels of a factor, numeric columns and products. Rows with any null are left out; of several outcomes (a list) a row
    may lack some, and takes part in the fits of the others.

    coding: `treatment` against the base level (by default the first), or `sum`: levels against their mean, the last one -1 in
    all of them. interactions: (a, b) pairs of numeric columns, or of a numeric column and a level's name, or the factor for all of its
    levels that are columns.
    """
    several = [y] if isinstance(y, str) else list(y)
    used = [*(several if len(several) == 1 else []), *numeric, *([factor] if factor else []), *([cluster] if cluster else [])]
    df = df.dropna(subset=list(dict.fromkeys(used)))
    terms: list[tuple[str, Column]] = [("Intercept", F.lit(1.0))]
    levels = sorted(r[0] for r in df.select(factor).distinct().limit(MOST_LEVELS + 1).collect()) if factor else []
    if len(levels) > MOST_LEVELS:
        raise ValueError(f"{factor} has more than {MOST_LEVELS} levels, each a column of the design")
    flags = {}
    if factor and coding == "treatment":
        base = base if base in levels else levels[0]
        flags = {v: (F.col(factor) == v).cast("double") for v in levels if v != base}
    elif factor:
        flags = {v: F.when(F.col(factor) == v, 1.0).when(F.col(factor) == levels[-1], -1.0).otherwise(0.0) for v in levels[:-1]}
    terms += list(flags.items())
    terms += [(c, F.col(c).cast("double")) for c in numeric]
    known = dict(terms) | {v: (F.col(factor) == v).cast("double") for v in levels if v not in flags}
    pairs = [pair for a, b in interactions for pair in ([(a, v) for v in flags] if b == factor and b not in known else [(a, b)])]
    terms += [(f"{a}:{b}", known[a] * known[b]) for a, b in pairs]
    group = F.col(cluster).cast("string") if cluster else F.lit(None).cast("string")
    outcomes = ("y",) if len(several) == 1 else tuple(f"y{i}" for i in range(len(several)))
    rows = df.select(*(F.col(c).cast("double").alias(name) for c, name in zip(several, outcomes, strict=True)), group.alias("cluster"), *(c.alias(f"x{i}") for i, (_, c) in enumerate(terms)))
    return Design(rows, [n for n, _ in terms], outcomes)


def from_formula(df: DataFrame, formula: str, cluster: str | None = None) -> Design:
    """The design of a formula: `y ~ a + b`, or `y + z ~ ...` for several outcomes.

    Terms: a numeric column; C(f), C(f, Treatment('base')) or C(f, Sum) for a factor (one at most); a:b for a product, also with the
    factor, C(f):a; a*b for a + b + a:b. An intercept is always there. A term that stands twice counts once.
    """
    left, _, right = formula.partition("~")
    outcomes = [y.strip() for y in left.split("+") if y.strip()]
    if not outcomes or not right.strip():
        raise ValueError(f"{formula!r} is not `outcome ~ terms`")
    factors: dict[str, tuple[str, str | None]] = {}
    numeric: list[str] = []
    products: list[tuple[str, str]] = []

    def column(term: str) -> str:
        """The column of a single term, which is noted as a factor or a number."""
        found = re.fullmatch(r"""C\(\s*(\w+)\s*(?:,\s*(?:Treatment(?:\(\s*['"](.*?)['"]\s*\))?|(Sum)(?:\(\))?)\s*)?\)""", term)
        if found:
            factors.setdefault(found[1], ("sum" if found[3] else "treatment", found[2]))
            return found[1]
        if not re.fullmatch(r"\w+", term):
            raise ValueError(f"{term!r} is no term")
        return term

    for term in (t.strip() for t in right.split("+")):
        parts = [p.strip() for p in re.split(r"[:*]", term)]
        names = [column(p) for p in parts]
        if len(parts) > 2:
            raise ValueError(f"{term!r} has more than two parts")
        if len(parts) == 1 or "*" in term:
            numeric += [n for n in names if n not in factors]
        if len(parts) == 2:
            products.append(tuple(sorted(names, key=lambda n: n in factors)))
    if len(factors) > 1:
        raise ValueError(f"{formula!r} has more than one factor")
    factor, (coding, base) = next(iter(factors.items()), (None, ("treatment", None)))
    return design(df, outcomes[0] if len(outcomes) == 1 else outcomes, list(dict.fromkeys(n for n in numeric if n not in factors)), factor, base, cluster, coding, list(dict.fromkeys(products)))


def _linear(xs, beta) -> Column:
    out = F.lit(0.0)
    for x, b in zip(xs, beta, strict=True):
        out = out + F.col(x) * float(b)
    return out


def _sums(d: Design, asked: list[tuple[str, np.ndarray, str]]) -> list[tuple[np.ndarray, np.ndarray, int, float]]:
    """For each (outcome, beta, family): the sum of weight x x', the sum of residual x, the rows and the sum of squared residuals; one
    pass for all, whose plan does not depend on beta."""
    xs, k = d.columns(), len(d.names)
    ys = list(dict.fromkeys(y for y, _, _ in asked))
    size = k * k + k + 2

    def partial(batches):
        total = np.zeros((len(asked), size))
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in range(k)])
            for at, (name, beta, family) in enumerate(asked):
                y = batch.column(k + ys.index(name)).to_numpy(zero_copy_only=False).astype(float)  # null as NaN
                own, y = x[~np.isnan(y)], y[~np.isnan(y)]
                with np.errstate(over="ignore"):
                    mean = 1 / (1 + np.exp(-(own @ beta))) if family == "logit" else own @ beta
                weight = mean * (1 - mean) if family == "logit" else np.ones(len(y))
                total[at] += np.concatenate([(own.T @ (own * weight[:, None])).ravel(), own.T @ (y - mean), [len(y), ((y - mean) ** 2).sum()]])
        yield pa.record_batch([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "value"])

    share_package(d.rows.sparkSession)
    got = dict(d.rows.select(*(F.col(c).cast("double") for c in (*xs, *ys))).mapInArrow(partial, "at long, value double").groupBy("at").agg(F.sum("value")).collect())
    out = np.array([got.get(i, 0.0) for i in range(size * len(asked))]).reshape(len(asked), size)
    return [(o[: k * k].reshape(k, k), o[k * k : k * k + k], int(o[-2]), float(o[-1])) for o in out]


@dataclass
class Fit:
    names: list[str]
    beta: np.ndarray
    cov: np.ndarray
    n: int
    family: str
    rounds: int = 1
    converged: bool = True

    def table(self) -> list[tuple]:
        """term, coef, se, z, p, low, high, odds (exp of the coefficient; null for least squares)."""
        out = []
        for name, b, v in zip(self.names, self.beta, np.diag(self.cov), strict=True):
            se = math.sqrt(max(float(v), 0.0))
            z = float(b) / se if se else float("nan")
            p = math.erfc(abs(z) / math.sqrt(2)) if se else float("nan")
            out.append((name, float(b), se, z, p, float(b) - 1.959963984540054 * se, float(b) + 1.959963984540054 * se, math.exp(min(float(b), 700.0)) if self.family == "logit" else None))
        return out

    def frame(self, spark, label: str) -> DataFrame:
        rows = [(label, *r, self.n) for r in self.table()]
        return spark.createDataFrame(rows, "model string, term string, coef double, se double, z double, p double, low double, high double, odds double, n long")


def fit(d: Design, family: str = "logit", errors: str = "default", small_sample: bool = True, rounds: int = 50, tolerance: float = 1e-10) -> Fit:
    """Newton's method for a logit, normal equations for `ols`. errors: `default` or `cluster` (by the design's cluster). A fit tells its
    rounds and whether it converged; on separated data it does not."""
    return fit_joint(d, [family], errors, small_sample, rounds, tolerance)[0]


def fit_joint(d: Design, families: list[str], errors: str = "default", small_sample: bool = True, rounds: int = 50, tolerance: float = 1e-10) -> list[Fit]:
    """A fit for each outcome of a design, by its family; outcomes that are not done share a pass a step."""
    d = Design(d.rows.persist(StorageLevel.MEMORY_AND_DISK), d.names, d.outcomes)  # every step reads the rows again
    try:
        return _fit_joint(d, families, errors, small_sample, rounds, tolerance)
    finally:
        d.rows.unpersist()


def _fit_joint(d: Design, families: list[str], errors: str, small_sample: bool, rounds: int, tolerance: float) -> list[Fit]:
    xs, k = d.columns(), len(d.names)
    betas, took, done = [np.zeros(k) for _ in families], [0] * len(families), [False] * len(families)
    for _ in range(rounds):
        todo = [i for i, ready in enumerate(done) if not ready]
        if not todo:
            break
        for i, (h, g, _, _) in zip(todo, _sums(d, [(d.outcomes[i], betas[i], families[i]) for i in todo]), strict=True):
            step = np.linalg.lstsq(h, g, rcond=None)[0]
            betas[i], took[i] = betas[i] + step, took[i] + 1
            done[i] = families[i] == "ols" or bool(np.abs(step).max(initial=0) < tolerance)
    sums = _sums(d, [(y, b, f) for y, b, f in zip(d.outcomes, betas, families, strict=True)])
    breads = [np.linalg.pinv(h) for h, *_ in sums]
    if errors == "cluster":
        residuals = []
        for y, beta, family in zip(d.outcomes, betas, families, strict=True):
            eta = _linear(xs, beta)
            residuals.append(F.col(y) - (1 / (1 + F.exp(-eta)) if family == "logit" else eta))
        rows = d.rows.withColumns({f"r{i}": x for i, x in enumerate(residuals)})
        scores = [F.sum(F.col(f"r{i}") * F.col(x)).alias(f"s{i}_{j}") for i in range(len(families)) for j, x in enumerate(xs)]
        clusters = rows.groupBy("cluster").agg(*scores, *(F.count(f"r{i}").alias(f"n{i}") for i in range(len(families))))
        # the products of cluster sums are summed in Spark as well: clusters may be many
        pairs = list(combinations_with_replacement(range(k), 2))
        got = iter(clusters.agg(*(x for i in range(len(families)) for x in (*(F.sum(F.col(f"s{i}_{a}") * F.col(f"s{i}_{b}")) for a, b in pairs), F.count_if(F.col(f"n{i}") > 0)))).first())
    out = []
    for beta, family, bread, (_, _, n, squares), steps, ready in zip(betas, families, breads, sums, took, done, strict=True):
        if errors == "cluster":
            meat = np.zeros((k, k))
            for a, b in pairs:
                meat[a, b] = meat[b, a] = next(got) or 0.0
            groups = int(next(got))
            cov = (groups / (groups - 1) * (n - 1) / (n - k) if small_sample and groups > 1 and n > k else 1.0) * bread @ meat @ bread
        else:
            cov = bread * squares / max(n - k, 1) if family == "ols" else bread
        out.append(Fit(d.names, beta, cov, n, family, steps, ready))
    return out


def predicted(d: Design, f: Fit) -> DataFrame:
    """The design's rows with the fitted mean."""
    eta = _linear(d.columns(), f.beta)
    return d.rows.withColumn("fitted", 1 / (1 + F.exp(-eta)) if f.family == "logit" else eta)
