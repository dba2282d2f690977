"""Run named queries against their SQL: ``python tests/check_oracle.py [prefix ...]``."""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
sys.path.insert(0, os.path.dirname(__file__))

from compare import connect, diff  # noqa: E402

import __spark_entry__ as e  # noqa: E402
from newsiq import get_session  # noqa: E402

sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
spark = get_session("oracle", os.environ.get("ORACLE_CPUS", "8"))
con = connect(sf)
q, o = e.queries(), e.oracle_sql()
wanted = sys.argv[1:]
names = [n for n in q if not wanted or any(n.startswith(w) for w in wanted)]
fails = 0
for n in names:
    t0 = time.time()
    try:
        df = q[n](spark, sf)
        df = spark.createDataFrame(df.toArrow()) if df.schema and "array" not in str(df.dtypes) else df
        t1 = time.time()
        if n in o:
            msg = diff(df, con, o[n])
            tag = "ok  " if msg is None else "FAIL"
        else:
            msg, tag = f"rows {df.count()}", "rows"
        t2 = time.time()
        rows = "" if msg else f"spark={t1 - t0:.1f} duck={t2 - t1:.1f} rows={df.count()}"
    except Exception as ex:  # noqa: BLE001
        msg, tag, rows = str(ex)[:1500], "ERR ", ""
        if os.environ.get("TRACE"):
            traceback.print_exc()
    fails += tag in ("FAIL", "ERR ")
    print(f"{tag} {n} {time.time() - t0:.2f}s {rows} {msg or ''}", flush=True)
print("fails", fails, "of", len(names))
