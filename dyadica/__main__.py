"""``python -m dyadica evidence|merge|advanced --input FOLDER --output FOLDER``"""

from __future__ import annotations

import argparse

from .plans import runs
from .session import build_session

RUNS = {"evidence": runs.evidence_run, "merge": runs.merge_run, "advanced": runs.advanced_run}


def main() -> None:
    parser = argparse.ArgumentParser(prog="dyadica")
    parser.add_argument("run", choices=RUNS, nargs="?", default="evidence")
    parser.add_argument("--input", required=True, help="folder of the raw trial files")
    parser.add_argument("--output", required=True, help="folder for tables and reports")
    args = parser.parse_args()
    spark = build_session(f"dyadica {args.run}")
    RUNS[args.run](spark, args.input, args.output).show(200, truncate=False)
    spark.stop()


if __name__ == "__main__":
    main()
