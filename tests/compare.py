"""Side-by-side comparison of a registered query and its SQL text."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return float(repr(round(v, 6))) + 0.0
    if isinstance(v, int):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    return str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def spark_table(df):
    return table(df.columns, [tuple(r) for r in df.collect()])


def sql_table(con, sql):
    cur = con.execute(sql)
    return table([d[0] for d in cur.description], cur.fetchall())


def differences(a, b) -> str:
    (ca, ra), (cb, rb) = a, b
    if ca != cb:
        return f"columns {ca} != {cb}"
    if len(ra) != len(rb):
        sa, sb = set(ra), set(rb)
        return f"{len(ra)} rows != {len(rb)} rows; only spark {list(sa - sb)[:3]} only sql {list(sb - sa)[:3]}"
    bad = [(x, y) for x, y in zip(ra, rb) if x != y]
    return f"{len(bad)} of {len(ra)} rows differ, first {bad[0]}" if bad else ""


def main(names, sf_dir):
    from pyspark.sql import SparkSession

    sys.path.insert(0, ".")
    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    qs, oracle = entry.queries(), entry.oracle_sql()
    todo = [q for q in qs if not names or any(q.startswith(n) for n in names)]
    failed = []
    for q in todo:
        t = time.time()
        try:
            got = spark_table(qs[q](spark, sf_dir))
            dt = time.time() - t
            if q in oracle:
                t2 = time.time()
                d = differences(got, sql_table(con, oracle[q]))
                print(f"{'FAIL' if d else 'ok  '} {q:40s} {len(got[1]):7d} rows {dt:6.2f}s sql {time.time() - t2:5.2f}s {d[:900]}", flush=True)
                if d:
                    failed.append(q)
            else:
                print(f"rows {q:40s} {len(got[1]):7d} rows {dt:6.2f}s", flush=True)
        except Exception as e:  # noqa: BLE001
            failed.append(q)
            print(f"ERR  {q:40s} {type(e).__name__}: {str(e)[:1200]}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[2:], sys.argv[1])
