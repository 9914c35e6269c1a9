"""Command lines of the jobs: a config file gives the options, arguments override it, and only here a session is made and stopped."""
from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from inspect import signature

from pyspark.sql import SparkSession

from docloom.plans.extract import MEDICAL, Lexicons


def lexicons(found: dict | None) -> Lexicons:
    """Word lists from a config's table; those it doesn't name are the medical ones."""
    given = {k: [tuple(x) if isinstance(x, list) else x for x in v] if isinstance(v, list) else v for k, v in (found or {}).items()}
    return Lexicons(**(vars(MEDICAL) | given))


def main(run: Callable, args: list[str] | None = None) -> dict:
    """Runs a job's function with the options of its config file and of the command line (--name value for each of its parameters)."""
    names = [p for p in signature(run).parameters if p != "spark"]
    parser = argparse.ArgumentParser(description=run.__doc__)
    parser.add_argument("--config", help="JSON file of options")
    for name in names:
        parser.add_argument(f"--{name.replace('_', '-')}", dest=name)
    given = vars(parser.parse_args(args))
    path, options = given.pop("config"), {}
    if path:
        with open(path, encoding="utf-8") as f:
            options = json.load(f)
    for name, value in given.items():
        if value is not None:
            options[name] = json.loads(value) if value.lstrip("-").isdigit() or value[:1] in "{[" else value
    unknown = set(options) - set(names)
    if unknown:
        parser.error(f"unknown options: {', '.join(sorted(unknown))}")
    if isinstance(options.get("word_lists"), dict):
        options["word_lists"] = lexicons(options["word_lists"])
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(run.__module__).getOrCreate()
    try:
        return run(spark, **options)
    finally:
        spark.stop()
