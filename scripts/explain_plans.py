"""Print the formatted physical plan of registered queries.

    python scripts/explain_plans.py [sf_dir] [name ...]

Use it to check that filters reach the scans (PushedFilters), that only the
needed columns are read (ReadSchema), where the exchanges are and whether
aggregates are partial + final.
"""

from __future__ import annotations

import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

DEFAULT = ["explorer_view", "overview_kpis", "histogram_audio", "sample_exact",
           "genre_zscore", "dedup_keep_first", "join_left_nullsafe"]


def main() -> None:
    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf_dir, args = args[0], args[1:]
    from cadenza.plans import catalog
    from cadenza.session import get_session
    spark = get_session("local[8]", shuffle_partitions=8)
    for name in args or DEFAULT:
        print(f"===== {name}")
        catalog.QUERIES[name](spark, sf_dir).explain("formatted")


if __name__ == "__main__":
    main()
