"""Seeded random search over the parameter space; each trial is a distributed fit."""

from __future__ import annotations

import math
import random
import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from needledrop.config import Settings
from needledrop.operators.metrics import trial_summary
from needledrop.plans.training import HAND_PICKED_PARAMS, Encoded, evaluate, fit_with_patience

# The search space.
LEARNING_RATE = (0.005, 0.2)
MAX_DEPTH = (3, 10)
MIN_CHILD_WEIGHT = (1, 20)
SUBSAMPLE = (0.6, 1.0)
COLSAMPLE = (0.6, 1.0)
N_ESTIMATORS = (100, 200, 300, 500, 900, 1000, 1500, 2000, 3500, 5000)
# Trial budgets of the class and of the full run.
DEFAULT_TRIALS, FULL_RUN_TRIALS = 100, 50

TRIAL_SCHEMA = "tid int, params map<string,double>, mean_cv_score double, fold_scores array<double>, error string"


def draw(rng: random.Random, estimators: tuple[int, ...] = N_ESTIMATORS) -> dict:
    low, high = (math.log(x) for x in LEARNING_RATE)
    return {
        "learning_rate": math.exp(rng.uniform(low, high)),
        "max_depth": rng.randint(*MAX_DEPTH),
        "min_child_weight": rng.randint(*MIN_CHILD_WEIGHT),
        "subsample": rng.uniform(*SUBSAMPLE),
        "colsample_bytree": rng.uniform(*COLSAMPLE),
        "n_estimators": rng.choice(estimators),
    }


def convert(params: dict) -> dict:
    """Whole-number parameters as int."""
    whole = ("n_estimators", "max_depth", "min_child_weight")
    return {k: int(v) if k in whole else v for k, v in params.items()}


def run_trial(tid: int, encoded: Encoded, params: dict, settings: Settings) -> dict:
    """One fit on the temporal split; a failed trial has no score and cannot win.

    The trial's ``n_estimators`` becomes the number of trees it kept, so that the winner can be grown again.
    """
    params = convert(params)
    try:
        model, rounds = fit_with_patience(encoded, params, settings)
        params = {**params, "n_estimators": rounds}
        auc = evaluate(model, encoded, settings)["auc"]
        scores, error = ([auc], None) if auc is not None else ([], "validation rows of one class only")
    except Exception as e:  # noqa: BLE001 - a bad parameter set must not end the search
        scores, error = [], str(e)
    # The keys of a trial.
    return {
        "tid": tid,
        "params": params,
        "mean_cv_score": scores[0] if scores else None,
        "fold_scores": scores,
        "std_cv_score": 0.0 if scores else None,
        "error": error,
    }


def search(
    encoded: Encoded,
    n_trials: int = DEFAULT_TRIALS,
    parallelism: int = 2,
    settings: Settings = Settings(),
    estimators: tuple[int, ...] = N_ESTIMATORS,
    first: dict | None = None,
) -> dict:
    """Trial 0 is the hand-picked set; the others are drawn from a seeded generator.

    The encoded rows are cached for the length of the search and shared by all trials.
    """
    rng = random.Random(settings.seed)
    start = HAND_PICKED_PARAMS if first is None else first
    candidates = [start, *[draw(rng, estimators) for _ in range(n_trials - 1)]][:n_trials]
    rows = encoded.rows.persist()
    began = time.time()
    try:
        shared = Encoded(rows, encoded.encoder)
        with ThreadPoolExecutor(max_workers=parallelism) as pool:
            trials = list(pool.map(lambda p: run_trial(p[0], shared, p[1], settings), enumerate(candidates)))
    finally:
        rows.unpersist()
    done = [t for t in trials if t["mean_cv_score"] is not None]
    if not done:
        raise RuntimeError(f"every trial failed, the first with: {trials[0]['error']}")
    best = max(done, key=lambda t: (t["mean_cv_score"], -t["tid"]))
    # The keys of the search results.
    return {
        "best_params": best["params"],
        "best_score": best["mean_cv_score"],
        "tuning_results": trials,
        "tuning_time": time.time() - began,
        "config": {"n_trials": n_trials, "seed": settings.seed},
    }


def trial_frame(spark: SparkSession, trials: list[dict]) -> DataFrame:
    rows = [
        (t["tid"], {k: float(v) for k, v in t["params"].items()}, t["mean_cv_score"], t["fold_scores"], t["error"])
        for t in trials
    ]
    return spark.createDataFrame(rows, TRIAL_SCHEMA)


def top_trials(spark: SparkSession, trials: list[dict], n: int = 5) -> DataFrame:
    return trial_summary(trial_frame(spark, trials), n)
