"""Command line: python -m tsumugi [--tasks char,word] --predictors module:registry [--dictionary FOLDER] (--text TEXT | --filename FILE ...)."""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import SparkSession

from tsumugi.plans.pipeline import FORMATS, Pipeline, Registry, analyze, check_tasks, in_order, parse_tasks, rendered, write
from tsumugi.plans.word_stage import Dictionary
from tsumugi.sources import sinks


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tsumugi", description=__doc__)
    source = parser.add_mutually_exclusive_group(required=True)
    source.add_argument("--text")
    source.add_argument("--filename", action="append")
    parser.add_argument("--tasks", default="char,word")
    parser.add_argument("--input-format", default="raw", choices=FORMATS)
    parser.add_argument("--predictors", help="module:name of a Registry; without one, every stage is missing")
    parser.add_argument("--dictionary", help="a folder with the tables that the task word looks up (Dictionary.write makes one)")
    parser.add_argument("--output", help="a folder for the text; else it is printed")
    given = parser.parse_args(args)
    try:
        tasks = parse_tasks(given.tasks)
        check_tasks(tasks, given.input_format)
        if "word" in tasks and not given.dictionary:
            raise ValueError("the task word needs --dictionary")
    except ValueError as e:
        parser.error(str(e))
    module, _, name = (given.predictors or "").partition(":")
    registry = getattr(importlib.import_module(module), name) if given.predictors else Registry()
    spark = SparkSession.builder.appName("tsumugi").getOrCreate()
    found = analyze(spark, Pipeline(registry, dictionary=Dictionary.read(spark, given.dictionary) if given.dictionary else None), given.tasks, text=given.text, files=given.filename, kind=given.input_format)
    last = tasks[-1]
    if given.output:
        write(found, last, given.output)
    else:
        texts = rendered(found, last)
        lines = "".join(r["text"] for r in texts.orderBy(*in_order(texts)).toLocalIterator())
        print(sinks.rendered(lines), end="")


if __name__ == "__main__":
    main()
