"""Command line: ``python -m trapline <job> ...`` for the table-based jobs."""
from __future__ import annotations

import argparse
import json

from trapline.session import local_session


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="trapline")
    ap.add_argument("--master", default=None, help="Spark master (default: local[*] session)")
    sub = ap.add_subparsers(dest="job", required=True)
    d = sub.add_parser("detect", help="score an image folder into the detections table")
    d.add_argument("images"), d.add_argument("table")
    d.add_argument("--scorer", required=True, help="scorer factory as module:function")
    d.add_argument("--names", help="name dictionary JSON (default: built-in seed)")
    d.add_argument("--threshold", type=float, default=None), d.add_argument("--chunk", type=int, default=None)
    d.add_argument("--resume", action="store_true", help="skip images already in the table")
    d.add_argument("--runs", help="append run statistics to this table")
    p = sub.add_parser("pivot", help="date x label pivot CSV")
    p.add_argument("table"), p.add_argument("out"), p.add_argument("--images")
    s = sub.add_parser("summary", help="summary report CSV")
    s.add_argument("table"), s.add_argument("out")
    r = sub.add_parser("route", help="sort image files into species folders")
    r.add_argument("table"), r.add_argument("images"), r.add_argument("out")
    r.add_argument("--move", action="store_true"), r.add_argument("--by-date", action="store_true")
    r.add_argument("--manifest")
    args = ap.parse_args(argv)

    if args.master:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.master(args.master).appName("trapline").getOrCreate()
    else:
        spark = local_session()
    from trapline.plans import jobs

    if args.job == "detect":
        print(json.dumps(_detect(spark, args), default=str))
    elif args.job == "pivot":
        jobs.pivot_report(spark, args.table, args.out, image_root=args.images)
    elif args.job == "summary":
        jobs.summary_report_job(spark, args.table, args.out)
    elif args.job == "route":
        print(json.dumps(jobs.route_images(spark, args.table, args.images, args.out,
                                           mode="move" if args.move else "copy", by_date=args.by_date,
                                           manifest_path=args.manifest), default=str))


def _detect(spark, args) -> dict:
    import importlib

    from pyspark.errors import AnalysisException

    from trapline.operators.names import names_frame
    from trapline.operators.scoring import ScoringOptions
    from trapline.plans.detect import detect_images, run_detection
    from trapline.sinks.tables import read_table, record_run
    from trapline.sources.images import list_images
    from trapline.sources.names_json import read_names

    module, _, func = args.scorer.partition(":")
    factory = getattr(importlib.import_module(module), func)
    opts = {k: v for k, v in (("confidence_threshold", args.threshold), ("chunk_size", args.chunk)) if v is not None}
    options = ScoringOptions.from_dict(opts)
    names = read_names(spark, args.names) if args.names else names_frame(spark)
    listing = list_images(spark, args.images)
    try:  # any storage that the reader knows; a table that isn't there yet is an empty one
        done = read_table(spark, args.table) if args.resume else None
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = None
    total = listing.count()
    summary = run_detection(detect_images(listing, factory, names, options, done=done), args.table,
                            total_images=total)
    if args.runs:
        record_run(spark, summary, args.runs)
    return summary


if __name__ == "__main__":
    main()
