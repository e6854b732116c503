"""Compare every registered query with its SQL statement in DuckDB.

usage: python tools/check.py [name-part ...]   (SF_DIR selects the tables)
"""

import importlib.util
import os
import sys
import time
import traceback
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
from tidemark.session import local_session  # noqa: E402

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.01")


def normalise(frame):
    frame = frame[sorted(frame.columns)]
    # whole numbers with NULLs arrive as floats from one side and as a nullable type from the other
    frame = frame.astype({c: "float64" for c, t in frame.dtypes.items() if str(t) in ("Int64", "Int32") and frame[c].isna().any()})
    rows = [tuple("NULL" if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v)
                  for v in row) for row in frame.itertuples(index=False, name=None)]
    return list(frame.columns), [str(t) for t in frame.dtypes], sorted(rows)


def main(parts):
    spec = importlib.util.spec_from_file_location("entry", ROOT / "__spark_entry__.py")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    queries, statements = entry.queries(), entry.oracle_sql()
    spark = local_session("check")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for path in sorted(Path(SF_DIR).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    bad = []
    for name, run in queries.items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            got = run(spark, SF_DIR).toPandas()
        except Exception as error:
            bad.append(name)
            print(f"ERROR {name}: {str(error)[:600]}")
            if os.environ.get("TRACE"):
                traceback.print_exc()
            continue
        spent = time.time() - start
        if name not in statements:
            print(f"rows  {name}: {len(got)} rows {spent:.1f}s (no SQL)")
            continue
        start = time.time()
        try:
            want = con.execute(statements[name]).df()
        except Exception as error:
            bad.append(name)
            print(f"SQLERR {name}: {str(error)[:600]}")
            continue
        sql_spent = time.time() - start
        a, b = normalise(got), normalise(want)
        if a == b:
            print(f"ok    {name}: {len(got)} rows {spent:.1f}s sql {sql_spent:.1f}s")
            if not len(got):
                print(f"      EMPTY {name}")
            continue
        bad.append(name)
        print(f"DIFF  {name}: rows {len(a[2])} vs {len(b[2])}")
        if a[0] != b[0]:
            print("      columns", a[0], b[0])
        if a[1] != b[1]:
            print("      types", a[1], b[1])
        only_a = [r for r in a[2] if r not in set(b[2])][:4]
        only_b = [r for r in b[2] if r not in set(a[2])][:4]
        print("      spark", only_a)
        print("      sql  ", only_b)
    print(f"{len(bad)} failing: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
