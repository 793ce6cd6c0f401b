"""Survival models as columns.

Each model adds risk, p10, p50, p90 and s_<horizon> to its rows, so one evaluation serves all of them.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwell.operators import models, survival

HORIZONS = (90.0, 180.0, 365.0)
SHARES = (0.1, 0.5, 0.9)
#: Stands for the median of a curve that never comes down to a half.
NEVER = 1e9


def outputs(horizons: tuple[float, ...] = HORIZONS) -> list[str]:
    return [f"p{round(100 * p)}" for p in SHARES] + [f"s_{h:g}" for h in horizons]


def summary(curve: DataFrame, by: list[str], horizons: tuple[float, ...] = HORIZONS) -> DataFrame:
    """One row for each curve: first crossings of the shares and the last value up to each horizon."""
    first = [F.min(F.when(F.round("survival", 12) <= F.round(F.lit(1.0 - p), 12), F.col("days"))).alias(f"p{round(100 * p)}") for p in SHARES]
    last = [F.coalesce(F.max_by("survival", F.when(F.col("days") <= h, F.struct("days", -F.col("survival")))), F.lit(1.0)).alias(f"s_{h:g}") for h in horizons]
    return curve.groupBy(*by).agg(*first, *last)


def median_risk(p50: Column) -> Column:
    return -F.when(p50 != 0, p50).otherwise(F.lit(NEVER))


def fit_strata(train: DataFrame, levels: list[list[str]], min_rows: int = 40, min_events: int = 15, horizons: tuple[float, ...] = HORIZONS) -> list[tuple[list[str], DataFrame]]:
    """(fields, curve summaries of the strata that are large enough) for each level; an empty level is all rows."""
    out = []
    for by in levels:
        table = summary(survival.km_curve(train, by, days="duration", event="observed"), by, horizons)
        if by:
            size = train.groupBy(*by).agg(F.count("*").alias("n"), F.sum("observed").alias("e"))
            table = table.join(size.where((F.col("n") >= min_rows) & (F.col("e") >= min_events)).select(*by), by, "left_semi")
        out.append((by, table))
    return out


def predict_strata(rows: DataFrame, tables: list[tuple[list[str], DataFrame]], horizons: tuple[float, ...] = HORIZONS) -> DataFrame:
    """``rows`` with level (the first that has the row's stratum) and that stratum's summary."""
    names, out = outputs(horizons), rows
    for n, (by, table) in enumerate(tables):
        found = table.select(*by, F.struct(F.lit(n).alias("level"), *names).alias(f"_m{n}"))
        out = out.join(found, by, "left") if by else out.join(F.broadcast(found))  # without fields: one row
    best = F.coalesce(*[F.col(f"_m{n}") for n in range(len(tables))])
    out = out.withColumn("_best", best).select(*rows.columns, "_best.*")
    return out.withColumn("risk", median_risk(F.col("p50")))


def breslow(rows: DataFrame, eta: Column) -> DataFrame:
    """(days, hazard): the cumulative baseline hazard at each duration with events, for linear predictors ``eta``."""
    relative = F.exp(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), eta)))
    cells = rows.groupBy(F.col("duration").alias("days")).agg(F.sum("observed").cast("double").alias("e"), F.sum(relative).alias("r"))
    later = Window.orderBy(F.desc("days")).rowsBetween(Window.unboundedPreceding, 0)  # one row a duration
    steps = cells.withColumn("at_risk", F.sum("r").over(later)).where("e > 0")
    before = Window.orderBy("days").rowsBetween(Window.unboundedPreceding, 0)
    return steps.select("days", F.sum(F.col("e") / F.col("at_risk")).over(before).alias("hazard"))


def predict_cox(rows: DataFrame, eta: Column, hazard: list[tuple[float, float]], horizons: tuple[float, ...] = HORIZONS) -> DataFrame:
    """``rows`` with the predictions of exp(-hazard * exp(eta)); ``hazard`` is (days, cumulative) by days, one pair a duration."""
    days, total = np.array([d for d, _ in hazard]), np.array([h for _, h in hazard])
    last = [float(total[days <= h][-1]) if (days <= h).any() else 0.0 for h in horizons]

    @F.pandas_udf("p10 double, p50 double, p90 double")
    def crossings(relative: pd.Series) -> pd.DataFrame:
        out = {}
        for p in SHARES:
            # the hazard at which survival is down to 1 - p, to twelve places
            least = -math.log(1.0 - p + 5e-13) / relative.to_numpy()
            at = np.searchsorted(total, least, side="left")
            out[f"p{round(100 * p)}"] = np.where(at < len(days), np.append(days, np.nan)[np.minimum(at, len(days))], np.nan)
        return pd.DataFrame(out).astype(object).where(lambda x: x.notna(), None)

    relative = F.exp(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), eta)))
    out = rows.withColumn("risk", eta).withColumn("_r", relative).withColumn("_q", crossings("_r"))
    return out.select(*rows.columns, "risk", *[F.col(f"_q.{n}") for n in ("p10", "p50", "p90")], *[F.exp(-F.lit(x) * F.col("_r")).alias(f"s_{h:g}") for h, x in zip(horizons, last)])


def linear(coefficients, start: float = 0.0) -> Column:
    """start + coefficients . x as an expression."""
    parts = F.zip_with("x", F.array(*[F.lit(float(b)) for b in coefficients]), lambda a, b: a * b)
    return F.aggregate(parts, F.lit(float(start)), lambda s, v: s + v)


def predict_weibull(rows: DataFrame, scale: Column, shape: float, knots: list[tuple[float, float]] | None = None, horizons: tuple[float, ...] = HORIZONS) -> DataFrame:
    """``rows`` with the predictions of a Weibull distribution, or of the one that ``knots`` map its probabilities to."""
    knots = knots or [(0.0, 0.0), (1.0, 1.0)]
    quantile = {p: (-math.log(1.0 - min(0.999999, inverse(knots, p)))) ** (1.0 / shape) for p in SHARES}
    chance = lambda h: 1.0 - F.exp(-F.pow(F.lit(h) / F.col("_scale"), F.lit(shape)))
    out = rows.withColumn("_scale", scale)
    return out.select(
        *rows.columns, (-F.col("_scale")).alias("risk"), *[(F.col("_scale") * q).alias(f"p{round(100 * p)}") for p, q in quantile.items()],
        *[(1.0 - models.interpolate(chance(h), knots)).alias(f"s_{h:g}") for h in horizons])


def inverse(knots: list[tuple[float, float]], probability: float) -> float:
    """The least input that a monotone piecewise linear map takes to ``probability``."""
    for (a, ya), (b, yb) in zip(knots, knots[1:]):
        if probability <= yb:
            return a if yb <= ya else a + (probability - ya) / (yb - ya) * (b - a)
    return 1.0


def predict_forest(rows: DataFrame, trees: list[dict], horizons: tuple[float, ...] = HORIZONS) -> DataFrame:
    """``rows`` with the predictions of the mean of the trees' curves."""
    names = outputs(horizons)

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def score(xs: pd.Series) -> pd.DataFrame:
        def leaf(node, x):
            while "curve" not in node:
                node = node["left"] if x[node["feature"]] <= node["cut"] else node["right"]
            return np.array(node["curve"])

        known: dict[tuple, list[float | None]] = {}
        for x in map(tuple, xs):
            if x not in known:
                curves = [leaf(t, x) for t in trees]
                days = np.unique(np.concatenate([c[:, 0] for c in curves]))
                at = lambda d: np.mean([c[np.searchsorted(c[:, 0], d, side="right") - 1, 1] for c in curves], axis=0)
                s = at(days)
                down = [np.flatnonzero(np.round(s, 12) <= round(1.0 - p, 12)) for p in SHARES]
                known[x] = [float(days[i[0]]) if len(i) else None for i in down] + [float(at(np.array([h]))[0]) for h in horizons]
        return pd.DataFrame([known[tuple(x)] for x in xs], columns=names, dtype=object)

    out = rows.withColumn("_p", score("x"))
    return out.select(*rows.columns, "_p.*").withColumn("risk", median_risk(F.col("p50")))


def calibration_pairs(scored: DataFrame, horizons: tuple[float, ...] = HORIZONS) -> DataFrame:
    """(p, y) of each row and horizon, without rows that were censored before the horizon."""
    pair = [F.struct(F.lit(h).alias("h"), (1.0 - F.col(f"s_{h:g}")).alias("p")) for h in horizons]
    rows = scored.select("duration", "observed", F.explode(F.array(*pair)).alias("z")).select("duration", "observed", "z.*")
    rows = rows.where(~((F.col("observed") == 0) & (F.col("duration") < F.col("h"))))
    return rows.select("p", F.when((F.col("observed") == 1) & (F.col("duration") <= F.col("h")), 1.0).otherwise(0.0).alias("y"))


def fit_calibrator(scored: DataFrame, horizons: tuple[float, ...] = HORIZONS, least: int = 30) -> list[tuple[float, float]]:
    """Knots of the monotone map from predicted to observed shares; the identity for fewer than ``least`` pairs."""
    pairs = calibration_pairs(scored, horizons)
    if pairs.limit(least).count() < least:
        return [(0.0, 0.0), (1.0, 1.0)]
    return models.calibration_knots(pairs, "p", "y")


def top_coefficients(names: list[str], coefficients, limit: int = 12) -> list[dict]:
    """The largest coefficients by absolute value, the first of equal ones first."""
    ranked = sorted(zip(names, map(float, coefficients)), key=lambda x: -abs(x[1]))
    return [{"feature": n, "coefficient": round(b, 5)} for n, b in ranked[:limit]]
