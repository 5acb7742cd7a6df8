"""What the jobs share: config, arguments, session settings."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """The session's settings while a job runs; afterwards they are as before."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def main(name: str, run: Callable, defaults: dict, argv: list[str] | None = None) -> None:
    """Defaults, then the config file, then arguments; unknown keys are an error."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=run.__doc__)
    parser.add_argument("--config", help="JSON file with any of the values below")
    for key, value in defaults.items():
        parser.add_argument(f"--{key.replace('_', '-')}", type=json.loads if isinstance(value, dict | list) else type(value) if value is not None else str, default=None)
    given = vars(parser.parse_args(argv))
    config = dict(defaults)
    if given["config"]:
        with open(given["config"], encoding="utf-8") as f:
            found = json.load(f)
        if unknown := set(found) - set(defaults):
            parser.error(f"unknown keys in {given['config']}: {sorted(unknown)}")
        config |= found
    config |= {k: v for k, v in given.items() if k != "config" and v is not None}
    if missing := [k for k, v in config.items() if v is None]:
        parser.error(f"no value for {', '.join(missing)}")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, **config)
    finally:
        spark.stop()
