"""Writers for predictions, search results and models."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from needledrop.operators.numbering import with_sequential_id
from needledrop.sources.store import path_exists


def prediction_rows(scored: DataFrame, obs_id: str | None = "obs_id", order: str | None = None) -> DataFrame:
    """(obs_id, target); without ids the rows are numbered from 0 in the order of ``order``."""
    if obs_id is None:
        if order is None:
            raise ValueError("rows without ids need a column that gives their order")
        scored, obs_id = with_sequential_id(scored, order, "_seq"), "_seq"
    kind = dict(scored.dtypes)
    target = vector_to_array("probability")[1] if kind.get("probability") == "vector" else F.col("target")
    return scored.select(F.col(obs_id).alias("obs_id"), target.cast("double").alias("target"))


def prediction_path(
    auc: float | None = None, kind: str = "full", suffix: str | None = None, now: datetime | None = None
) -> str:
    """Fixed format: submissions/submission_KIND_auc_0.0000_DATE_TIME[_SUFFIX].csv."""
    if auc is None:
        return "last_submission.csv"
    stamp = (now or datetime.now()).strftime("%Y%m%d_%H%M%S")
    tail = f"_{suffix}" if suffix else ""
    return f"submissions/submission_{kind}_auc_{auc:.4f}_{stamp}{tail}.csv"


def write_predictions(rows: DataFrame, path: str) -> str:
    """A folder of CSV parts with header; every executor writes its own part."""
    rows.select("obs_id", "target").write.mode("overwrite").option("header", True).csv(path)
    return path


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str) -> PipelineModel:
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no model at {path}; run the search or the training first")
    return PipelineModel.load(path)


def write_search_results(spark: SparkSession, result: dict, folder: str) -> tuple[str, str]:
    """The trials as JSON rows, and a text summary of the best parameters."""
    trials, summary = f"{folder}/search_results", f"{folder}/best_params_summary"
    document = json.dumps(
        # The keys.
        {
            "best_params": result["best_params"],
            "best_score": result["best_score"],
            "tuning_results": result["tuning_results"],
            "config": result["config"],
            "total_trials": len(result["tuning_results"]),
        }
    )
    facts = {"auc": f"{result['best_score']:.6f}", "trials": len(result["tuning_results"]), **result["best_params"]}
    lines = [f"{name}={value}" for name, value in facts.items()]
    one_text = "value string"
    spark.createDataFrame([(document,)], one_text).coalesce(1).write.mode("overwrite").text(trials)
    spark.createDataFrame([("\n".join(lines),)], one_text).coalesce(1).write.mode("overwrite").text(summary)
    return trials, summary
