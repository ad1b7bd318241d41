"""Compare every registered query with its SQL on DuckDB: ``python tests/oracle.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "float": "FLOAT", "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    return value


def _rows(rows, order):
    return sorted(([_plain(r[i]) for i in order] for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


def differences(df, con, sql: str) -> list[str]:
    result = con.execute(sql)
    names, types = [d[0] for d in result.description], [str(d[1]) for d in result.description]
    expected = result.fetchall()
    found = [tuple(r) for r in df.collect()]
    out = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} against {sorted(names)}"]
    for name, kind in zip(names, types):
        ours = TYPES.get(df.schema[name].dataType.simpleString(), "?")
        if ours != kind:
            out.append(f"type of {name}: {ours} against {kind}")
    if len(found) != len(expected):
        out.append(f"rows: {len(found)} against {len(expected)}")
    wanted = sorted(names)
    ours = _rows(found, [df.columns.index(n) for n in wanted])
    theirs = _rows(expected, [names.index(n) for n in wanted])
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if wrong:
        a, b = wrong[0]
        out.append(f"{len(wrong)} rows differ, first: {str(a)[:300]} against {str(b)[:300]}")
    return out


def main() -> int:
    from lathework.plans import ORACLES, QUERIES
    from lathework.session import build_session

    args = sys.argv[1:]
    folder = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = build_session("oracle", "local[8]", sql__shuffle__partitions="8", ui__enabled="false", ui__showConsoleProgress="false", driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in args or QUERIES:
        start = time.time()
        try:
            df = QUERIES[name](spark, folder)
            if name in ORACLES:
                problems = differences(df, con, ORACLES[name])
                label = "ok"
            else:
                problems, label = [], f"rows {df.count()}"
        except Exception as error:  # report and go on with the next query
            problems, label = [f"{type(error).__name__}: {str(error)[:1500]}"], ""
        bad += bool(problems)
        print(f"{'BAD' if problems else label:9} {name:28} {time.time() - start:6.1f}s", *problems, sep="  ", flush=True)
    print("bad:", bad, "of", len(args or QUERIES))
    return bad


if __name__ == "__main__":
    sys.exit(main())
