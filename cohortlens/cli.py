"""Command line: ``python -m cohortlens --data-dir D --output O``."""

from __future__ import annotations

import argparse
import logging
import sys

from .config import Settings

VERSION = "0.1.0"


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="cohortlens", description="Multiresistance analysis of binary isolate-by-feature tables.")
    p.add_argument("--data-dir", default=".")
    p.add_argument("--output", default="output")
    p.add_argument("--files", nargs="*", help="tables to join by their id instead of the preferred one")
    p.add_argument("--bootstrap", type=int, default=5000, help="replicates")
    p.add_argument("--fdr-alpha", type=float, default=0.05)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--verbose", action="store_true")
    p.add_argument("--version", action="version", version=VERSION)
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO if a.verbose else logging.WARNING)
    try:
        settings = Settings(data_dir=a.data_dir, output_dir=a.output, n_iterations=a.bootstrap, alpha=a.fdr_alpha, seed=a.seed)
        from pyspark.sql import SparkSession

        from .plans.analysis import analyse

        found = analyse(SparkSession.builder.appName("cohortlens").getOrCreate(), settings, a.files)
    except Exception as e:  # noqa: BLE001 - the process's exit code tells
        logging.error("%s", e)
        return 1
    print(f"{found['status']}: {found['total_files']} files in {found['output_dir']}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
