"""Run registered queries against their check SQL: python tests/check.py [folder] [name ...]."""

import sys
import time
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parent.parent), str(Path(__file__).resolve().parent)]

import __spark_entry__ as entry  # noqa: E402
from compare import check_engine, differences  # noqa: E402
from conftest import new_session  # noqa: E402

folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
wanted = sys.argv[2:]
spark = new_session()
engine = check_engine(folder)
sqls = entry.oracle_sql()
bad = 0
for name, run in entry.queries().items():
    if wanted and name not in wanted:
        continue
    start = time.time()
    try:
        df = run(spark, folder)
        if name in sqls:
            said = differences(df, engine, sqls[name])
        else:
            said = "" if df.count() else "no rows"
            name += " (rows only)"
    except Exception as error:  # noqa: BLE001
        said = f"{type(error).__name__}: {str(error)[:700]}"
    bad += bool(said)
    print(f"{'BAD' if said else 'ok '} {name} {time.time() - start:.1f}s {said[:900]}", flush=True)
print(f"{bad} bad")
