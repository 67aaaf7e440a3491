"""Command line: ``python -m metaloom`` lists the queries; ``python -m metaloom QUERY FOLDER`` runs one and prints rows as JSON.

``resolve NAME FOLDER`` and ``evidence NODE FOLDER`` ask the graph view directly.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries_agents, queries_census, queries_relational, queries_sources  # noqa: F401  their queries are added to QUERIES
from .operators import ask
from .queries import QUERIES
from .sources.graph_view import graph, load


def run(spark: SparkSession, words: Sequence[str]) -> DataFrame:
    """The rows that a command asks for; ValueError for one that there is not."""
    if len(words) == 3 and words[0] == "evidence":
        return ask.evidence(graph(spark, words[2]).edges, words[1])
    if len(words) == 3 and words[0] == "resolve":
        names = load(spark, words[2], "nation").select(F.concat(F.lit("N:"), "n_nationkey").alias("id"), F.col("n_name").alias("name"))
        return ask.resolve(names, words[1])
    if len(words) == 2 and words[0] in QUERIES:
        return QUERIES[words[0]](spark, words[1])
    raise ValueError(f"no such command: {' '.join(words)}")


def main(argv: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="metaloom", description=__doc__)
    parser.add_argument("words", nargs="*", help="a query and a folder of tables; none: the list of queries")
    parser.add_argument("--limit", type=int, default=20, help="rows printed")
    args = parser.parse_args(argv)
    if not args.words:
        print("\n".join(sorted(QUERIES)))
        return 0
    spark = SparkSession.builder.appName("metaloom").getOrCreate()
    try:
        rows = run(spark, args.words)
    except ValueError as e:
        print(e)
        return 2
    for row in rows.limit(args.limit).toJSON().collect():
        print(json.dumps(json.loads(row), sort_keys=True))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
