"""Command line: ``python -m quernstone analyse|report ...``.

Exit codes: 0 qualified or reported, 2 the collection didn't reach its target, 3 a rule of the
configuration or of the labels is broken, 4 the data doesn't qualify.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import session
from .functions import values
from .operators import metrics, parse
from .plans import collect
from .schemas import LABEL
from .sources import files, sinks

HOSTS = {"github": ("github.com", "/"), "stackexchange": (None, "/questions/"), "steam": ("steamcommunity.com", "/app/")}


def secret(name: str) -> bytes:
    """A hex secret of at least 32 bytes from the environment; it never becomes a column."""
    value = bytes.fromhex(os.environ[name])
    if len(value) < 32:
        raise ValueError(f"{name} must hold at least 32 bytes")
    return value


def analyse(a: argparse.Namespace) -> int:
    try:
        run = parse.Run(secret(a.secret_env), a.run_id, a.version, a.collected_at)
        quotas = {k: int(v) for k, v in json.loads(a.quotas).items()}
    except (KeyError, ValueError) as error:
        print(error, file=sys.stderr)
        return 3
    spark = session.build(app="quernstone-analyse")
    parsed = None
    for stratum in quotas:
        rows = files.payloads(files.pages(spark, f"{a.pages}/{stratum.replace('/', '_')}.json", a.source), a.source).drop("page", "place")
        one = {
            "github": lambda: parse.parse_issues(rows, stratum, run), "stackexchange": lambda: parse.parse_questions(rows, stratum, run),
            "steam": lambda: parse.parse_reviews(rows, int(stratum), stratum, a.after, a.before, run),
        }[a.source]()
        parsed = one if parsed is None else parsed.unionByName(one)
    # newest first within a stratum, as the services send them; recorded pages are few
    newest = Window.partitionBy("community").orderBy(F.col("published_at").desc(), "source_item_id")
    result = collect.collect(parsed.withColumn("_newest", F.row_number().over(newest)), quotas, F.col("_newest"))
    result.items = result.items.drop("_newest")
    host, path = HOSTS[a.source]
    ok = values.canonical_url(F.col("source_url"), F.lit(host) if host else F.lower(F.try_parse_url("source_url", F.lit("HOST"))), F.lit(path))
    report = collect.publish(result, a.root, a.run_id, quotas, ok, a.seed, secrets=(os.environ[a.secret_env],))
    print(json.dumps(report))
    return 0 if report["qualified"] else 2 if result.termination != "target_reached" else 4


def report(a: argparse.Namespace) -> int:
    spark = session.build(app="quernstone-report")
    try:
        density, agreement = metrics.development_report(files.json_lines(spark, a.labels, LABEL))
    except ValueError as error:
        print(error, file=sys.stderr)
        return 3
    sinks.write_json(spark, a.out, {"population": "development_only", "density": [r.asDict() for r in density.collect()], "agreement": [r.asDict() for r in agreement.collect()]})
    return 0


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quernstone", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("analyse", help="records from recorded pages to a named bundle")
    one.add_argument("--source", choices=sorted(HOSTS), required=True)
    for name in ("pages", "quotas", "root", "run-id", "secret-env", "collected-at"):
        one.add_argument(f"--{name}", required=True)
    for name, value in (("version", "1.0.0"), ("after", "1970-01-01"), ("before", "9999-01-01")):
        one.add_argument(f"--{name}", default=value)
    one.add_argument("--seed", type=int, default=1)
    one.set_defaults(run=analyse)
    two = commands.add_parser("report", help="densities and agreement of development labels")
    for name in ("labels", "out"):
        two.add_argument(f"--{name}", required=True)
    two.set_defaults(run=report)
    a = parser.parse_args(arguments)
    return a.run(a)


if __name__ == "__main__":
    sys.exit(main())
