"""Runs pipelines: python -m ondula.cli FILE.toml ... [-v LEVEL]"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from ondula.plans.pipeline import run_files

LEVELS = {"none": logging.CRITICAL, "error": logging.ERROR, "warning": logging.WARNING, "command": logging.INFO, "debug": logging.DEBUG, "index": logging.DEBUG}


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("files", nargs="+")
    parser.add_argument("-v", "--verbosity", choices=LEVELS, default="warning")
    given = parser.parse_args()
    logging.basicConfig(level=LEVELS[given.verbosity])
    run_files(SparkSession.builder.appName("ondula").getOrCreate(), given.files)


if __name__ == "__main__":
    main()
