"""Print the physical plan of registered queries.

    python -m listenflow.plans.explain /root/testdata/sf0.01 funnel_overall free_user_tiers

Prints Spark's formatted plan of each query: the place to check pushed
filters, pruned read schemas, join strategies and exchanges.  (Queries that
rank or materialize write their intermediate copies while being planned.)
"""

from __future__ import annotations

import sys

from listenflow.plans.registry import QUERIES
from listenflow.session import build_session


def main(argv: list[str]) -> None:
    sf_dir, names = argv[0], argv[1:] or list(QUERIES)
    spark = build_session()
    for name in names:
        df = QUERIES[name](spark, sf_dir)
        df.explain("formatted")
        print(f"==== {name} ====")


if __name__ == "__main__":
    main(sys.argv[1:])
