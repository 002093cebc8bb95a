"""Write the formatted physical plans of key queries to PLANS.md.
Usage: python scripts/show_plans.py [sf_dir]"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from faultline.plans.catalog import QUERIES  # noqa: E402
from faultline.session import build_session  # noqa: E402

KEY = ["trigram_totals", "doc_trigram_counts", "records_of_bad_outputs", "trace_back_lines",
       "trace_forward_records", "part_test_matrix"]


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", shuffle_partitions=16)
    out = ["# Physical plans of key queries", "",
           f"Generated by `scripts/show_plans.py` on `{sf_dir}` (local[8], AQE on). "
           "Plans are the initial AQE plans (`explain('formatted')` before execution).", ""]
    for name in KEY:
        df = QUERIES[name](spark, sf_dir)
        plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        # keep the tree and the scan / exchange / aggregate / join details
        keep, lines = [], plan.splitlines()
        for ln in lines:
            if len(ln) > 400:
                ln = ln[:400] + " ..."
            keep.append(ln)
        out += [f"## {name}", "", "```", *keep, "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out))


if __name__ == "__main__":
    main()
