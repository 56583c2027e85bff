"""Research analyses that need more than one aggregate: regressions, assumptions, normality, multiple comparisons (RA)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.special import f_upper, gamma_q, t_two_sided


def ols(df: DataFrame, y: str, xs: list[str]) -> dict:
    """RA-5, RA-6: coefficients, standard errors, t, p (intercept under `const`), R2, adjusted R2, F and its p. One distributed pass for the normal equations."""
    rows = df.select(y, *xs).na.drop()
    cols = [F.lit(1.0), *[F.col(x).cast("double") for x in xs], F.col(y).cast("double")]
    k = len(cols)
    sums = rows.agg(F.count(F.lit(1)), *[F.sum(cols[i] * cols[j]) for i in range(k) for j in range(i, k)]).first()
    n, m = sums[0], np.zeros((k, k))
    it = iter(sums[1:])
    for i in range(k):
        for j in range(i, k):
            m[i, j] = m[j, i] = next(it) or 0.0
    xtx, xty, yty = m[:-1, :-1], m[:-1, -1], m[-1, -1]
    inverse = np.linalg.inv(xtx)
    b = inverse @ xty
    p, df_e = len(b), n - len(b)
    sse = yty - b @ xty
    sst = yty - m[0, -1] ** 2 / n
    se = np.sqrt(sse / df_e * np.diag(inverse))
    r2 = 1 - sse / sst
    f = (r2 / (p - 1)) / ((1 - r2) / df_e) if p > 1 else float("nan")
    names = ["const", *xs]
    return {
        "n": n,
        "coef": dict(zip(names, b.tolist())),
        "se": dict(zip(names, se.tolist())),
        "t": dict(zip(names, (b / se).tolist())),
        "p": {c: t_two_sided(float(v), df_e) for c, v in zip(names, b / se)},
        "r2": float(r2),
        "adj_r2": float(1 - (1 - r2) * (n - 1) / df_e),
        "f": float(f),
        "p_f": f_upper(float(f), p - 1, df_e) if p > 1 else None,
    }


def vif(df: DataFrame, xs: list[str]) -> dict[str, float]:
    """RA-7: 1 / (1 - R2) of each predictor on the others."""
    return {x: 1 / (1 - ols(df, x, [o for o in xs if o != x])["r2"]) for x in xs}


def residuals(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    b = ols(df, y, xs)["coef"]
    fit = F.lit(b["const"])
    for x in xs:
        fit = fit + F.lit(b[x]) * F.col(x)
    return df.withColumn("residual", F.col(y) - fit)


def breusch_pagan(df: DataFrame, y: str, xs: list[str]) -> dict:
    """RA-7: n R2 of squared residuals on the predictors."""
    r = ols(residuals(df, y, xs).withColumn("_e2", F.col("residual") ** 2), "_e2", xs)
    lm = r["n"] * r["r2"]
    return {"lm": lm, "p": gamma_q(len(xs) / 2, lm / 2)}


def durbin_watson(df: DataFrame, y: str, xs: list[str], order: str) -> float:
    """RA-7, WN-8. The order is total, so one task sorts; the frame holds order and residual only."""
    e = residuals(df, y, xs).select(order, "residual")
    d = F.col("residual") - F.lag("residual").over(Window.orderBy(order))
    return e.withColumn("d", d).agg((F.sum(F.col("d") ** 2) / F.sum(F.col("residual") ** 2)).alias("dw")).first()[0]


def logit(df: DataFrame, y: str, xs: list[str]) -> dict:
    """RA-20: coefficients, odds ratios, Wald p, McFadden R2, accuracy at one half."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    rows = VectorAssembler(inputCols=xs, outputCol="_x").transform(df.select(F.col(y).cast("double").alias(y), *xs).na.drop())
    model = GeneralizedLinearRegression(family="binomial", featuresCol="_x", labelCol=y, tol=1e-10, maxIter=50).fit(rows)
    s = model.summary
    names = [*xs, "const"]
    coef = dict(zip(names, [*model.coefficients.toArray().tolist(), model.intercept]))
    hit = model.transform(rows).agg(F.avg(((F.col("prediction") >= 0.5).cast("double") == F.col(y)).cast("double"))).first()[0]
    return {"coef": coef, "odds": {k: math.exp(v) for k, v in coef.items()}, "p": dict(zip(names, s.pValues)), "mcfadden": 1 - s.deviance / s.nullDeviance, "accuracy": hit}


#: Coefficients of Royston's algorithm AS R94 for the Shapiro-Wilk test.
C1 = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
C2 = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
C3 = (0.544, -0.39978, 0.025054, -0.0006714)
C4 = (1.3822, -0.77857, 0.062767, -0.0020322)
C5 = (-1.5861, -0.31082, -0.083751, 0.0038915)
C6 = (-0.4803, -0.082676, 0.0030302)
G = (-2.273, 0.459)


def _poly(c, x):
    return sum(k * x**i for i, k in enumerate(c))


def _norm_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def shapiro_wilk(values) -> tuple[float, float]:
    """RA-7: W and p, for 3 to 5000 values."""
    x = np.sort(np.asarray(values, float))
    n = len(x)
    if n < 3 or n > 5000 or x[0] == x[-1]:
        return float("nan"), float("nan")
    m = np.array([_norm_quantile((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    mm, u = float(m @ m), 1 / math.sqrt(n)
    a = m / math.sqrt(mm)
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0, math.sqrt(0.5)])
    else:
        last = a[-1] + _poly(C1, u)
        if n > 5:
            second = a[-2] + _poly(C2, u)
            phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a = m / math.sqrt(phi)
            a[-2], a[1] = second, -second
        else:
            a = m / math.sqrt((mm - 2 * m[-1] ** 2) / (1 - 2 * last**2))
        a[-1], a[0] = last, -last
    w = min(1.0, float(a @ x) ** 2 / float(((x - x.mean()) ** 2).sum()))
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    y, log_n = math.log(1 - w) if w < 1 else -40.0, math.log(n)
    if n <= 11:
        g = _poly(G, n)
        if y >= g:
            return w, 1e-99
        y, mu, sd = -math.log(g - y), _poly(C3, n), math.exp(_poly(C4, n))
    else:
        mu, sd = _poly(C5, log_n), math.exp(_poly(C6, log_n))
    return w, 0.5 * math.erfc((y - mu) / sd / math.sqrt(2))


def normality(df: DataFrame, group: str, value: str) -> DataFrame:
    """RA-7, RA-28: group, n, w, p. The test is defined up to 5000 values; larger groups have null."""
    kind = df.schema[group].dataType.simpleString()
    n = F.count(F.lit(1)).over(Window.partitionBy(group))
    own = df.select(group, F.col(value).cast("double").alias("v")).where("v IS NOT NULL").withColumn("n", n)
    small = own.where("n <= 5000").groupBy(group).applyInPandas(lambda d: pd.DataFrame([[d[group].iloc[0], *shapiro_wilk(d["v"])]], columns=[group, "w", "p"]), f"`{group}` {kind}, w double, p double")
    return own.groupBy(group).agg(F.count(F.lit(1)).alias("n")).join(small, group, "left")


def studentized_range_sf(q: float, k: int, df: float) -> float:
    """RA-13: P(range of k means > q), by Gauss-Legendre quadrature over the normal and the chi density."""
    z, wz = np.polynomial.legendre.leggauss(96)
    z, wz = 8 * z, 8 * wz
    from math import erf

    cdf = np.vectorize(lambda v: 0.5 * (1 + erf(v / math.sqrt(2))))
    phi = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)

    def within(r: float) -> float:
        return float((wz * phi * k * (cdf(z) - cdf(z - r)) ** (k - 1)).sum())

    half = 6 / math.sqrt(2 * df)
    s, ws = np.polynomial.legendre.leggauss(64)
    lo, hi = max(1e-9, 1 - half), 1 + half
    s, ws = (hi - lo) / 2 * s + (hi + lo) / 2, (hi - lo) / 2 * ws
    log_d = math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2
    return min(1.0, max(0.0, 1 - float((ws * np.exp(log_d) * np.array([within(q * v) for v in s])).sum())))


def tukey_hsd(df: DataFrame, group: str, value: str) -> pd.DataFrame:
    """RA-13: all pairs of group means. Groups are few; one aggregate row each comes to the driver."""
    g = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v")).orderBy(group).toPandas()
    df_e = float(g["n"].sum() - len(g))
    mse = float(((g["n"] - 1) * g["v"]).sum() / df_e)
    rows = []
    for i in range(len(g)):
        for j in range(i + 1, len(g)):
            d = g["m"][i] - g["m"][j]
            q = abs(d) / math.sqrt(mse / 2 * (1 / g["n"][i] + 1 / g["n"][j]))
            rows.append((g[group][i], g[group][j], d, q, studentized_range_sf(q, len(g), df_e)))
    return pd.DataFrame(rows, columns=["a", "b", "diff", "q", "p"])


def krejcie_morgan(n: int, chi2: float = 3.841, p: float = 0.5, d: float = 0.05) -> int:
    """RA-29."""
    return math.ceil(chi2 * n * p * (1 - p) / (d * d * (n - 1) + chi2 * p * (1 - p)))
