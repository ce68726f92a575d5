"""Run registered queries against their twins: ``python tests/run_checks.py SF_DIR [name ...]``."""

import sys
import time
import traceback

sys.path.insert(0, __file__.rsplit("/", 2)[0])
sys.path.insert(0, __file__.rsplit("/", 1)[0])

from compare import connect, difference  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from rimlight.session import build_session  # noqa: E402


def main() -> None:
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="8g", spark__sql__execution__arrow__maxRecordsPerBatch="256")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, twins = entry.queries(), entry.oracle_sql()
    failed = []
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            why = difference(df, con, twins[name]) if name in twins else None
            extra = "" if name in twins else f" (no twin, {df.count()} rows)"
        except Exception as e:  # noqa: BLE001
            why = "".join(traceback.format_exception_only(e))[:1200]
            extra = ""
        print(f"{'ok  ' if why is None else 'FAIL'} {name} {time.time() - start:.1f}s{extra}", flush=True)
        if why:
            failed.append(name)
            print("     " + why, flush=True)
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main()
