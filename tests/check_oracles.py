"""Run every registered query against its DuckDB oracle (as the driver does)."""
import json, sys, time, os
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from firmscope.session import local_session
from oracle_harness import compare
import __spark_entry__ as E

sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
only = sys.argv[1:]
spark = local_session(8)
qs, os_ = E.queries(), E.oracle_sql()
bad = 0
for name, fn in qs.items():
    if only and name not in only:
        continue
    t = time.time()
    try:
        df = fn(spark, sf)
        if name in os_:
            res = compare(df, os_[name], sf)
        else:
            res = {"rows_spark": df.count(), "ok": None}
    except Exception as e:
        res = {"ok": False, "error": repr(e)[:400]}
    res["sec"] = round(time.time() - t, 2)
    if res.get("ok") is False:
        bad += 1
    print(name, json.dumps(res, default=str)[:900], flush=True)
print("FAILED", bad)
