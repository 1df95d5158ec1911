"""What both jobs share: config files, the log, the command line's session."""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def settings(spec: argparse.ArgumentParser) -> dict:
    """Arguments of the command line over those of the config file; a name that the file alone has is an error."""
    spec.add_argument("--config", default=str(Path(__file__).with_name(spec.prog + ".json")), help="JSON file with any of the other arguments")
    given = {k: v for k, v in vars(spec.parse_args()).items() if v is not None}
    held = json.loads(Path(given.pop("config")).read_text())
    known = {a.dest for a in spec._actions}
    if unknown := sorted(set(held) - known):
        spec.error(f"unknown settings: {', '.join(unknown)}")
    out = held | given
    if missing := sorted(a.dest for a in spec._actions if a.required is False and a.dest not in out and a.dest not in ("help", "config")):
        spec.error(f"missing settings: {', '.join(missing)}")
    return out


def command_line(run, spec: argparse.ArgumentParser) -> None:
    """Start a session, run the job, stop the session."""
    from stackwright.session import build_session

    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    arguments = settings(spec)
    spark = build_session(spec.prog)
    try:
        run(spark, **arguments)
    finally:
        spark.stop()


def counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    """The rows, and a count of them that is there once they are written."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen
