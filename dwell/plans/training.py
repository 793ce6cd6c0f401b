"""The training pipeline: five models, development and holdout windows, ranking, calibration, confidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwell.operators import evaluate, models, predictors

#: What the score of a deployment counts, and the grades.
GRADES = ((75, "high"), (55, "moderate"), (0, "limited"))


def confidence(n: int, c: float, brier: float, coverage: float) -> int:
    """0 to 100 from the size of the training set, discrimination, calibration and coverage, less 20 for a single source."""
    clip = lambda x: min(1.0, max(0.0, x))
    score = 25 * min(1, n / 1000) + 30 * clip((c - 0.5) / 0.2) + 25 * clip(1 - brier / 0.25) + 20 * clip(1 - abs(coverage - 0.8) / 0.8) - 20
    return int(round(min(100.0, max(0.0, score))))


def grade_of(score: int) -> str:
    return next(name for least, name in GRADES if score >= least)


def rank_models(evaluations: DataFrame) -> DataFrame:
    """``evaluations`` with place: by concordance, highest first and missing last, then by the 180-day Brier score and name.

    One row a model.
    """
    from pyspark.sql import Window

    order = Window.orderBy(F.desc_nulls_last("harrell_c_index"), "brier_180", "model")
    return evaluations.withColumn("place", F.row_number().over(order))


def fit_all(train: DataFrame, encoder: models.FeatureEncoder, levels: list[list[str]], key: str) -> tuple[dict[str, Callable[[DataFrame], DataFrame]], dict]:
    """The five models by name as functions of encoded rows, and their parameters."""
    size = len(encoder.names)
    whole = predictors.fit_strata(train, [[]])
    strata = predictors.fit_strata(train, levels)
    beta, hazard = models.fit_cox(train, size)
    theta = models.fit_weibull(train, size)
    trees = models.fit_forest(train, key)
    scale, shape = weibull_of(theta)
    found = {
        "kaplan_meier_global": lambda rows: predictors.predict_strata(rows, whole),
        "kaplan_meier_stratified": lambda rows: predictors.predict_strata(rows, strata),
        "cox_ph": lambda rows: predictors.predict_cox(rows, predictors.linear(beta), hazard),
        "weibull_aft": lambda rows: predictors.predict_weibull(rows, scale, shape),
        "random_survival_forest": lambda rows: predictors.predict_forest(rows, trees),
    }
    return found, {"cox": beta.tolist(), "hazard": hazard, "weibull": theta.tolist(), "trees": trees}


def weibull_of(theta) -> tuple[F.Column, float]:
    """Scale as an expression over x, and shape."""
    import math

    eta = predictors.linear(theta[1:-1], theta[0])
    return F.exp(F.greatest(F.lit(-10.0), F.least(F.lit(10.0), eta))), math.exp(theta[-1])


def train_baselines(rows: DataFrame, categories: list[str], numbers: list[str], levels: list[list[str]], calibration_end: str, key: str = "case_id", least: tuple[int, int, int] = (100, 50, 50)) -> dict:
    """Fit on split = 'train', rank on the test rows lodged up to ``calibration_end``, report the rest as holdout.

    ``rows`` has split, duration, observed, lodged and the features. Fewer rows than ``least`` (train,
    test, each window) are an error. The Weibull model is the deployed one; its isotonic calibration is
    a candidate that is only reported.
    """
    rows = rows.cache()
    early = F.col("lodged") <= F.lit(calibration_end).cast("date")
    part = F.when(F.col("split") == "train", "train").when(early, "development").otherwise("holdout")
    sizes = {r["part"]: r.asDict() for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("rows"), F.sum("observed").alias("events"), F.min("lodged").alias("start"), F.max("lodged").alias("end")).collect()}
    count = lambda p: sizes[p]["rows"] if p in sizes else 0
    if count("train") < least[0] or count("development") + count("holdout") < least[1] or min(count("development"), count("holdout")) < least[2]:
        raise ValueError(f"too few rows to train and test: { {p: count(p) for p in ('train', 'development', 'holdout')} }")
    encoder = models.FeatureEncoder.fit(rows.where("split = 'train'"), categories, numbers)
    coded = encoder.transform(rows)
    train, test = coded.where("split = 'train'").cache(), coded.where("split = 'test'")
    windows = {"test": test, "development": test.where(early), "holdout": test.where(~early)}
    found, parameters = fit_all(train, encoder, levels, key)
    # a model's scores are made once for all windows; one row a model comes back
    evaluations: dict[str, list[dict]] = {w: [] for w in windows}
    for name, score in found.items():
        scored = score(test).cache()
        for w in windows:
            some = scored if w == "test" else scored.where(early) if w == "development" else scored.where(~early)
            evaluations[w].append(evaluate.evaluate_model(some, name).first().asDict())
        scored.unpersist()
    spark = rows.sparkSession
    schema = "model string, harrell_c_index double, brier_180 double"
    ranked = rank_models(spark.createDataFrame([(e["model"], e["harrell_c_index"], e["brier_180"]) for e in evaluations["development"]], schema)).orderBy("place").collect()
    knots = predictors.fit_calibrator(found["weibull_aft"](windows["development"]))
    scale, shape = weibull_of(parameters["weibull"])
    candidate = evaluate.evaluate_model(predictors.predict_weibull(windows["holdout"], scale, shape, knots), "calibrated_weibull_aft").first().asDict()
    deployed = next(e for e in evaluations["holdout"] if e["model"] == "weibull_aft")
    sure = confidence(count("train"), deployed["harrell_c_index"] or 0.5, deployed["brier_180"], deployed["event_only_p10_p90_coverage"] or 0.0)
    for frame in (rows, train):
        frame.unpersist()
    return {
        "engine": "weibull_aft", "feature_encoder": encoder.to_dict(), "parameters": parameters["weibull"], "rows": {p: count(p) for p in sizes},
        "time_split": {p: {k: str(x) if k in ("start", "end") else x for k, x in s.items() if k != "part"} for p, s in sizes.items()},
        "evaluations": evaluations["test"], "development_evaluations": evaluations["development"], "holdout_evaluations": evaluations["holdout"],
        "deployment_holdout_evaluation": deployed, "candidate_calibration_holdout_evaluation": candidate, "calibration_knots": [list(k) for k in knots],
        "ranking": [r["model"] for r in ranked], "selected_baseline": ranked[0]["model"], "confidence": {"score": sure, "grade": grade_of(sure)},
        "interpretability": {
            "cox_top_absolute_coefficients": predictors.top_coefficients(encoder.names, parameters["cox"]), "weibull_aft_shape": round(shape, 5),
            "weibull_aft_top_absolute_coefficients": predictors.top_coefficients(["intercept", *encoder.names], parameters["weibull"][:-1]),
        },
    }
