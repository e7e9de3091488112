"""Runs registered queries and their DuckDB SQL side by side: python tests/compare.py SF_DIR [NAME...]"""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    """Rows with columns by name, in a form that does not depend on the engine's types."""
    def plain(x):
        if x is None or x is pd.NA or (isinstance(x, float) and x != x):
            return "null"
        if isinstance(x, bool) or type(x).__name__ == "bool_":
            return str(bool(x))
        if hasattr(x, "dtype") and x.shape == ():
            x = x.item()
        if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
            return format(float(x), ".6g") if float(x) != int(x) else str(int(x))
        return str(x)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(plain(x) for x in r) for r in frame.itertuples(index=False, name=None))


def compare(spark, con, name: str, query, sql: str | None, sf_dir: str) -> str:
    got = query(spark, sf_dir).toPandas()
    if not sql:
        return f"rows {len(got)}"
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"COLUMNS {sorted(got.columns)} {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    if a != b:
        only = [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2]
        return f"DIFFERENT {len(a)} {len(b)} {only}"
    return f"equal {len(a)}" + " EMPTY" * (not a)


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(sf_dir), entry.oracle_sql()
    for name, query in entry.queries().items():
        if (names and not any(name.startswith(n) for n in names)) or (not names and (name.startswith("op") or name == "pipeline")):
            continue
        began = time.time()
        try:
            said = compare(spark, con, name, query, sql.get(name), sf_dir)
        except Exception as e:
            said = "FAILED " + " ".join(str(e).split())[:600] + (traceback.format_exc()[-300:] if "Error" not in type(e).__name__ else "")
        print(f"{name}: {said} ({time.time() - began:.1f} s)", flush=True)


if __name__ == "__main__":
    main()
