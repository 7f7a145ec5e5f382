"""python -m needledrop short|full TRAIN TEST CATALOGUE FOLDER, or: profile TABLE FOLDER."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from needledrop.plans.dataset import PARITY_COUNTS, PAST_COUNTS
from needledrop.plans.runs import run_full, run_profile, run_short, write_profile
from needledrop.plans.search import FULL_RUN_TRIALS
from needledrop.sources.scans import read_enriched


def main() -> None:
    parser = argparse.ArgumentParser(prog="needledrop", description=__doc__)
    runs = parser.add_subparsers(dest="run", required=True)
    for name in ("short", "full"):
        p = runs.add_parser(name)
        for arg in ("train", "test", "catalogue", "folder"):
            p.add_argument(arg)
        p.add_argument("--enriched", nargs=2, metavar=("TRAIN", "TEST"), help="tables that are joined already; the inputs are not read")
        p.add_argument("--predictions", help="path of the predictions; by default a name below FOLDER")
        p.add_argument("--future-counts", action="store_true", help="20-minute counts that see later plays, as in the original")
        p.add_argument("--count-cache", metavar="FOLDER", help="keep history counts by day there; not with --future-counts")
        p.add_argument("--across-frames", action="store_true", help="history counts see both frames; not with --count-cache")
        p.add_argument("--catalogue-store", metavar="FOLDER", help="keep parsed documents there; only new files are parsed")
        p.add_argument("--multi-line", action="store_true", help="text files have quoted fields with line breaks")
        if name == "full":
            p.add_argument("--trials", type=int, default=FULL_RUN_TRIALS)
    p = runs.add_parser("profile")
    p.add_argument("table")
    p.add_argument("folder", help="every report is written below it")
    p.add_argument("--approximate", action="store_true", help="medians and distinct counts from sketches, curves from bins")
    p.add_argument("--multi-line", action="store_true", help="a CSV table has quoted fields with line breaks")
    args = parser.parse_args()

    spark = SparkSession.builder.appName(f"needledrop-{args.run}").getOrCreate()
    if args.run == "profile":
        reports = run_profile(read_enriched(spark, args.table, multi_line=args.multi_line), exact=not args.approximate)
        for name, part in write_profile(reports, args.folder).items():
            print(name, part)
        return
    paths = (args.train, args.test, args.catalogue, args.folder)
    how = {
        "enriched": args.enriched,
        "predictions": args.predictions,
        "multi_line": args.multi_line,
        "count_cache": args.count_cache,
        "catalogue_store": args.catalogue_store,
        "across_frames": args.across_frames,
        "counts": PARITY_COUNTS if args.future_counts else PAST_COUNTS,
    }
    done = run_short(spark, *paths, **how) if args.run == "short" else run_full(spark, *paths, n_trials=args.trials, **how)
    print(f"validation AUC {done['auc']:.4f}; predictions in {done['path']}")
    done["report"].show()
    done["importance"].show(10, truncate=False)
    if "top_trials" in done:
        done["top_trials"].show(truncate=False)


if __name__ == "__main__":
    main()
