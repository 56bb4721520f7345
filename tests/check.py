"""Command line check: python tests/check.py [sf] [name prefix ...]"""
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402
from slatemill.session import local_session  # noqa: E402
from tests.oracle import connect, differences  # noqa: E402

sf = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
want = sys.argv[2:]
spark = local_session("8")
spark.sparkContext.setLogLevel("ERROR")
con = connect(sf)
sql, bad = entry.oracle_sql(), 0
for name, fn in entry.queries().items():
    if want and not any(name.startswith(w) for w in want):
        continue
    t = time.time()
    try:
        got = fn(spark, sf).toPandas()
        took = time.time() - t
        note = "rows only" if name not in sql else differences(got, con.sql(sql[name]).df()) or "ok"
        if len(got) == 0:
            note += " EMPTY"
    except Exception as e:  # noqa: BLE001
        took, note, got = time.time() - t, "ERROR " + str(e)[:900], []
    if note not in ("ok", "rows only"):
        bad += 1
    print(f"{name:34s} {len(got):7d} rows {took:6.2f}s  {note}", flush=True)
print("failures:", bad)
