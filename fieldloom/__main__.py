"""Command line: every option of ``plans.config.Options`` as ``--name value``; vectors are comma-separated."""

from __future__ import annotations

import argparse
import dataclasses
import json

from .plans.config import Options
from .plans.run import run


def parsed(arguments: list[str] | None = None) -> Options:
    parser = argparse.ArgumentParser(prog="fieldloom", description=__doc__)
    for f in dataclasses.fields(Options):
        default = f.default
        if isinstance(default, tuple):
            kind = lambda s: tuple(float(v) for v in s.split(",") if v)
        elif default is None:
            kind = float
        else:
            kind = type(default)
        parser.add_argument(f"--{f.name}", type=kind, default=default, help=f"default: {default!r}")
    return Options(**vars(parser.parse_args(arguments)))


def main() -> None:
    from pyspark.sql import SparkSession

    from .plans.shipping import ship_package

    options = parsed()
    spark = SparkSession.builder.appName("fieldloom").getOrCreate()
    ship_package(spark)
    result = run(spark, options)
    print(json.dumps({"theta": result.theta, "loglik": result.loglik, "evaluations": result.evaluations, "metrics": result.metrics, "seconds": result.seconds}))


if __name__ == "__main__":
    main()
