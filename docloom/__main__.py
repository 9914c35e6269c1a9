"""Command line.

    python -m docloom --articles DIR --ids FILE --out DIR [--models DIR] [--generator module:function] ...
    python -m docloom train --articles DIR --gold FILE --models DIR [--folds N] [--max-iter N]
    python -m docloom pairs --articles DIR --gold FILE --out DIR

A generator or encoder is named as module:function.  The function is called once in each Python worker, with
device=... if --device is given, and returns what takes a list of texts: to texts (generator) or vectors (encoder).
"""
from __future__ import annotations

import argparse
import importlib
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession

from .operators.ranking import distinct_check
from .operators.vectors import hashing_encoder
from .plans import training
from .plans.extract import Models, batched, inference
from .sources.articles import file_faults, read_asked, read_labels, read_submission, write_pairs, write_submission


def _factory(name: str | None, device: str | None) -> Callable | None:
    """The function that module:function names, found when it is called, so that only workers load a model."""
    if name is None:
        return None
    module, _, function = name.partition(":")

    def make():
        found = getattr(importlib.import_module(module), function)
        return found(device=device) if device else found()
    return make


def _options(p: argparse.ArgumentParser) -> argparse.ArgumentParser:
    p.add_argument("--articles", required=True, help="folder of PMC<id>.nxml files")
    p.add_argument("--parsed", help="folder that keeps parsed files for the next run")
    p.add_argument("--format", default="csv", choices=["csv", "parquet"], help="of the table of ids or labels")
    p.add_argument("--encoder", help="module:function; without it words are hashed")
    p.add_argument("--device", help="given to the generator and the encoder")
    return p


def _infer(spark: SparkSession, args: list[str]) -> None:
    p = _options(argparse.ArgumentParser(prog="docloom"))
    p.add_argument("--ids", required=True, help="table with a column pmcids")
    p.add_argument("--out", required=True)
    p.add_argument("--models", help="folder with study_type, sex, ranker and cache; rules are used for what is absent")
    p.add_argument("--generator", help="module:function that lists conditions; rules are used without it")
    p.add_argument("--batch", type=int, default=16, help="texts that the generator gets at once")
    p.add_argument("--faults", help="folder for a table of where files aren't well formed, and which rule was used there")
    a = p.parse_args(args)
    if a.faults:
        file_faults(spark, a.articles).write.mode("overwrite").parquet(a.faults)
    hooks = {"make_encoder": _factory(a.encoder, a.device) or hashing_encoder}
    if a.generator:
        hooks["generate"] = batched(_factory(a.generator, a.device), a.batch)
    models = Models.load(spark, a.models, **hooks) if a.models else Models(**hooks)
    ids = read_labels(spark, a.ids, a.format)
    write_submission(inference(ids, read_asked(spark, a.articles, ids, a.parsed), models), a.out)
    row = distinct_check(read_submission(spark, a.out), "pmcids").first()
    if not row["unique"]:
        raise SystemExit(f"{row['n_rows']} rows but {row['n_keys']} ids")


def _train(spark: SparkSession, args: list[str]) -> None:
    p = _options(argparse.ArgumentParser(prog="docloom train"))
    p.add_argument("--gold", required=True, help="table of labels")
    p.add_argument("--models", required=True, help="folder to write to")
    p.add_argument("--folds", type=int, default=5)
    p.add_argument("--max-iter", type=int, default=100)
    a = p.parse_args(args)
    none = spark.createDataFrame([], "text_sha1 string, embedding array<float>")
    gold = read_labels(spark, a.gold, a.format)
    articles = read_asked(spark, a.articles, gold, a.parsed)
    models, meta = training.train(articles, gold, none, _factory(a.encoder, a.device) or hashing_encoder, folds=a.folds, max_iter=a.max_iter)
    models.save(a.models)
    meta.write.mode("overwrite").json(f"{a.models}/measured")


def _pairs(spark: SparkSession, args: list[str]) -> None:
    p = _options(argparse.ArgumentParser(prog="docloom pairs"))
    p.add_argument("--gold", required=True, help="table of labels")
    p.add_argument("--out", required=True, help="folder; gen_cond and gen_elig are written there")
    a = p.parse_args(args)
    gold = read_labels(spark, a.gold, a.format)
    both = training.generator_pairs(read_asked(spark, a.articles, gold, a.parsed), gold)
    for name, pairs in zip(("gen_cond", "gen_elig"), both):
        write_pairs(pairs, f"{a.out}/{name}")


def main(args: list[str] | None = None) -> None:
    args = sys.argv[1:] if args is None else args
    job = {"train": _train, "pairs": _pairs}.get(args[0] if args else "")
    (job or _infer)(SparkSession.builder.getOrCreate(), args[1:] if job else args)


if __name__ == "__main__":
    main()
