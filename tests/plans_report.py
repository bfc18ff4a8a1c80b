"""Write PLANS.md: physical plan trees (formatted explain, tree part) plus scan schemas and
pushed filters of the headline queries. python -m tests.plans_report [sf_dir]"""

from __future__ import annotations

import io
import re
import sys
from contextlib import redirect_stdout

import __spark_entry__ as entry_mod

HEADLINE = ["stratified_kfold", "roc_auc", "pr_curve", "target_encode_oof", "median_impute",
            "hash_features", "blend_search", "group_stats", "box_stats", "stacked_attribution",
            "payload_errors", "score_response"]


def formatted(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def summarise(text: str) -> str:
    tree, _, details = text.partition("\n\n\n")
    keep = [ln for ln in details.splitlines()
            if re.match(r"^(ReadSchema|PushedFilters|Arguments: hashpartitioning|Arguments: rangepartitioning|Arguments: SinglePartition)", ln.strip())]
    return tree.strip() + "\n\n" + "\n".join(sorted(set(keep)))


def main(argv):
    from riskweave.session import local_session
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    qs = entry_mod.queries()
    out = ["# Physical plans of headline queries",
           "",
           f"Generated by `python -m tests.plans_report {sf}` (initial adaptive plans; AQE may still "
           "switch joins to broadcast and coalesce partitions at run time). Scan lines show column "
           "pruning (`ReadSchema`) and pushed filters.", ""]
    for name in HEADLINE:
        out += [f"## {name}", "", "```", summarise(formatted(qs[name](spark, sf))), "```", ""]
    with open("PLANS.md", "w") as fh:
        fh.write("\n".join(out))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
