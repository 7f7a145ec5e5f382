"""Fit, evaluate and apply the boosted-tree classifier."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from needledrop.config import Settings
from needledrop.operators.columns import categorical_columns, feature_columns, numeric_columns
from needledrop.operators.encode import FeatureEncoder, FeatureEncoderModel
from needledrop.operators.metrics import classification_report, feature_importance, roc_auc
from needledrop.operators.split import TEST, TRAIN, VALIDATION
from needledrop.plans.boosting import boost
from needledrop.sources.sinks import prediction_path, prediction_rows, save_model, write_predictions

# Default parameters, and the hand-picked ones of the run without search.
DEFAULT_PARAMS = {
    "n_estimators": 2000,
    "learning_rate": 0.03,
    "max_depth": 6,
    "subsample": 0.8,
    "colsample_bytree": 0.8,
}
HAND_PICKED_PARAMS = {
    "n_estimators": 900,
    "learning_rate": 0.03,
    "max_depth": 5,
    "min_child_weight": 5,
    "subsample": 0.7,
    "colsample_bytree": 0.8,
}


# Fixed value: rounds without a greater AUC on the val rows after which boosting ends.
PATIENCE = 50


def classifier(params: dict, settings: Settings = Settings()) -> GBTClassifier:
    """Spark's boosted trees for a parameter set.

    They have no counterpart of the L1 and L2 terms.

    Every tree is a few distributed aggregations, and node ids are cached and checkpointed, so
    that the lineage of thousands of trees stays short.
    """
    return GBTClassifier(
        featuresCol="features",
        labelCol=settings.label,
        maxIter=int(params.get("n_estimators", DEFAULT_PARAMS["n_estimators"])),
        stepSize=float(params.get("learning_rate", DEFAULT_PARAMS["learning_rate"])),
        maxDepth=int(params.get("max_depth", DEFAULT_PARAMS["max_depth"])),
        minInstancesPerNode=int(params.get("min_child_weight", 1)),
        subsamplingRate=float(params.get("subsample", 1.0)),
        featureSubsetStrategy=str(float(params.get("colsample_bytree", 1.0))),
        maxBins=256,
        cacheNodeIds=True,
        checkpointInterval=10,
        seed=settings.seed,
    )


@dataclass
class Encoded:
    """Encoded rows of all folds with the stage that made them."""

    rows: DataFrame
    encoder: FeatureEncoderModel


def encode(dataset: DataFrame, settings: Settings = Settings(), table_dir: str = "") -> Encoded:
    """Fit the encoder on the train rows and encode every row."""
    fold = F.col(settings.fold_column)
    features = feature_columns(dataset, (settings.fold_column,))
    learn = dataset.where(fold == TRAIN).select(*features)
    stage = FeatureEncoder(
        numberCols=numeric_columns(learn),
        textCols=categorical_columns(learn),
        cut=settings.rare_cut,
        spreadBy=settings.obs_id,
        tableDir=table_dir,
    )
    model = stage.fit(learn)
    rows = model.transform(dataset).select(settings.obs_id, settings.label, settings.fold_column, "features")
    return Encoded(rows, model)


def fit(encoded: Encoded, params: dict | None = None, settings: Settings = Settings()) -> GBTClassificationModel:
    """All trees of ``params``, fitted on the train rows."""
    rows = encoded.rows.where(F.col(settings.fold_column) == TRAIN)
    rows = rows.withColumn(settings.label, F.col(settings.label).cast("double"))
    return classifier(DEFAULT_PARAMS if params is None else params, settings).fit(rows)


def fit_with_patience(
    encoded: Encoded, params: dict | None = None, settings: Settings = Settings(), patience: int = PATIENCE
) -> tuple[GBTClassificationModel, int]:
    """The trees up to the round of greatest AUC on the val rows, and their number; no tree is grown twice."""
    params = {**DEFAULT_PARAMS, **({} if params is None else params)}
    fold = F.col(settings.fold_column)
    train, val = encoded.rows.where(fold == TRAIN), encoded.rows.where(fold == VALIDATION)
    found = boost(train, val, settings.label, params, settings.seed, patience)
    return found.model, found.rounds


def scored(model: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    """Add ``score``, the probability of class 1, and ``prediction``."""
    return model.transform(rows).withColumn("score", vector_to_array("probability")[1])


def evaluate(model: GBTClassificationModel, encoded: Encoded, settings: Settings = Settings()) -> dict:
    """AUC as a number, the class report and the scored validation rows as frames."""
    rows = encoded.rows.where(F.col(settings.fold_column) == VALIDATION)
    predictions = scored(model, rows).select(settings.obs_id, settings.label, "score", "prediction")
    auc = roc_auc(predictions, settings.label, "score").first()["auc"]
    return {
        "auc": auc,
        "report": classification_report(predictions, settings.label, "prediction"),
        "predictions": predictions,
    }


def importance(spark: SparkSession, model: GBTClassificationModel, names: list[str], top: int = 20) -> DataFrame:
    pairs = [(n, float(v)) for n, v in zip(names, model.featureImportances.toArray())]
    return feature_importance(spark.createDataFrame(pairs, "feature string, importance double"), top)


def train_and_apply(
    encoded: Encoded,
    params: dict | None,
    folder: str | None = None,
    kind: str = "full",
    settings: Settings = Settings(),
    model_path: str | None = None,
    predictions_path: str | None = None,
) -> dict:
    """Fit, evaluate, write the test predictions and save the model.

    The predictions go to ``predictions_path``, else to a name below ``folder``. The model grows all trees of
    ``params``; a search hands over the number that its best trial kept.
    """
    spark = encoded.rows.sparkSession
    model = fit(encoded, params, settings)
    metrics = evaluate(model, encoded, settings)
    test = scored(model, encoded.rows.where(F.col(settings.fold_column) == TEST))
    predictions = prediction_rows(test.select(settings.obs_id, F.col("score").alias("target")), settings.obs_id)
    path = predictions_path or (f"{folder}/{prediction_path(metrics['auc'], kind)}" if folder else None)
    if path:
        write_predictions(predictions, path)
    pipeline = PipelineModel(stages=[encoded.encoder, model])
    if model_path:
        save_model(pipeline, model_path)
    return {
        "model": pipeline,
        "predictions": predictions,
        "path": path,
        "importance": importance(spark, model, encoded.encoder.feature_names()),
        **metrics,
    }
