"""Run named reports over a folder of tables and store each as Parquet.

    python -m holdfast DATA OUT [NAME ...]

Without names, every report runs. ``--list`` prints the names.
"""

from __future__ import annotations

import argparse
import os
from collections.abc import Sequence

from pyspark.sql import SparkSession

from holdfast.plans import catalog
from holdfast.session import build_session, run_folder


def run(spark: SparkSession, data: str, out: str, names: Sequence[str]) -> None:
    known = catalog.queries()
    unknown = sorted(set(names) - set(known))
    if unknown:
        raise SystemExit(f"unknown reports: {', '.join(unknown)}")
    with run_folder(spark):
        for name in names or known:
            known[name](spark, data).write.mode("overwrite").parquet(os.path.join(out, name))
        catalog.forget_trainings()


def main() -> None:
    parser = argparse.ArgumentParser(prog="holdfast", description="Retention reports on Spark")
    parser.add_argument("data", nargs="?", help="folder with the input tables")
    parser.add_argument("out", nargs="?", help="folder for the reports")
    parser.add_argument("names", nargs="*", help="reports to run; all if none is given")
    parser.add_argument("--list", action="store_true", help="print the report names and stop")
    args = parser.parse_args()
    if args.list:
        print("\n".join(catalog.queries()))
        return
    if not args.out:
        parser.error("DATA and OUT are needed")
    run(build_session(), args.data, args.out, args.names)


if __name__ == "__main__":
    main()
