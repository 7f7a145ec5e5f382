"""The three entry points: fixed parameters, search, and column profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from needledrop.config import Settings
from needledrop.operators import profile
from needledrop.plans.dataset import PAST_COUNTS, build_dataset, impute, load_frames
from needledrop.plans.search import FULL_RUN_TRIALS, search, top_trials
from needledrop.plans.training import HAND_PICKED_PARAMS, Encoded, encode, train_and_apply
from needledrop.sources.sinks import write_search_results
from needledrop.sources.store import settled


def prepared(
    spark: SparkSession,
    train_path: str,
    test_path: str,
    catalogue: str,
    folder: str,
    counts: tuple[str, ...] = PAST_COUNTS,
    settings: Settings = Settings(),
    fill_from_val: bool = False,
    enriched: tuple[str, str] | None = None,
    multi_line: bool = False,
    count_cache: str | None = None,
    catalogue_store: str | None = None,
    across_frames: bool = False,
) -> Encoded:
    """Load, enrich, derive, impute and encode; each step that is read again is a table.

    The encoder fills nulls from the train rows. ``fill_from_val`` fills them before that
    from train and val rows together, as the original does.
    """
    train, test = load_frames(spark, train_path, test_path, catalogue, f"{folder}/enriched", enriched, multi_line, catalogue_store)
    dataset = build_dataset(train, test, counts=counts, settings=settings, cache=count_cache, across_frames=across_frames)
    dataset = settled(dataset, "dataset")
    dataset = impute(dataset, True, settings) if fill_from_val else dataset
    encoded = encode(dataset, settings, table_dir=f"{folder}/models")
    return Encoded(settled(encoded.rows, "encoded"), encoded.encoder)


def run_short(
    spark: SparkSession,
    train_path: str,
    test_path: str,
    catalogue: str,
    folder: str,
    params: dict = HAND_PICKED_PARAMS,
    settings: Settings = Settings(),
    counts: tuple[str, ...] = PAST_COUNTS,
    enriched: tuple[str, str] | None = None,
    predictions: str | None = None,
    multi_line: bool = False,
    count_cache: str | None = None,
    catalogue_store: str | None = None,
    across_frames: bool = False,
) -> dict:
    """Train with fixed parameters and write the predictions."""
    kept = {
        "enriched": enriched, "multi_line": multi_line, "count_cache": count_cache, "catalogue_store": catalogue_store,
        "across_frames": across_frames,
    }
    encoded = prepared(spark, train_path, test_path, catalogue, folder, counts, settings, **kept)
    return train_and_apply(encoded, params, folder, "short", settings, f"{folder}/models/best_model", predictions)


def run_full(
    spark: SparkSession,
    train_path: str,
    test_path: str,
    catalogue: str,
    folder: str,
    n_trials: int = FULL_RUN_TRIALS,
    settings: Settings = Settings(),
    counts: tuple[str, ...] = PAST_COUNTS,
    enriched: tuple[str, str] | None = None,
    predictions: str | None = None,
    multi_line: bool = False,
    count_cache: str | None = None,
    catalogue_store: str | None = None,
    across_frames: bool = False,
    **search_options,
) -> dict:
    """Search, train with the best parameters, write predictions and search results."""
    kept = {
        "enriched": enriched, "multi_line": multi_line, "count_cache": count_cache, "catalogue_store": catalogue_store,
        "across_frames": across_frames,
    }
    encoded = prepared(spark, train_path, test_path, catalogue, folder, counts, settings, **kept)
    found = search(encoded, n_trials, settings=settings, **search_options)
    written = write_search_results(spark, found, f"{folder}/tuning_results")
    done = train_and_apply(encoded, found["best_params"], folder, "full", settings, f"{folder}/models/best_model", predictions)
    return {**done, "search": found, "search_files": written, "top_trials": top_trials(spark, found["tuning_results"], 3)}


def run_profile(df: DataFrame, target: str = "fwdbtn", exact: bool = True) -> dict[str, DataFrame | dict]:
    """Every column by class; the roles are decided first, then all columns share a pass per report.

    Without ``exact`` medians and distinct counts come from sketches and the curves from linear bins.
    """
    width = len(df.columns)
    # Every report reads the table again: only the profiled columns, written once.
    df = settled(df.select(target, *[c for c in df.columns if c not in profile.NOT_PROFILED]), "profiled")
    roles = {r["column"]: r["role"] for r in profile.column_roles(df).collect()}
    numbers = [c for c, r in roles.items() if r == profile.NUMERIC]
    texts = [c for c, r in roles.items() if r == profile.CATEGORICAL]
    out: dict[str, DataFrame | dict] = {
        "roles": roles,
        "target": profile.target_distribution(df, target),
        "shape": df.agg(F.count(F.lit(1)).alias("rows"), F.lit(width).alias("columns")),
    }
    if numbers:
        out["stats"] = profile.class_conditional_stats(df, numbers, target, exact)
        out["histogram"] = profile.class_histogram(df, numbers, target)
        out["density"] = (profile.class_kde if exact else profile.class_kde_binned)(df, numbers, target)
    if texts:
        out["categories"] = profile.class_category_counts(df, texts, target)
    return out


def write_profile(reports: dict[str, DataFrame | dict], folder: str) -> dict[str, str | dict]:
    """Every report as Parquet below ``folder``; the paths by name."""
    paths: dict[str, str | dict] = {}
    for name, part in reports.items():
        if isinstance(part, DataFrame):
            paths[name] = f"{folder.rstrip('/')}/{name}"
            part.write.mode("overwrite").parquet(paths[name])
        else:
            paths[name] = part
    return paths
