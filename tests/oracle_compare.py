"""Compare a query with its SQL counterpart in DuckDB, value by value."""

import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

_TYPES = {
    "INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double",
    "VARCHAR": "string", "BOOLEAN": "boolean",
}


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return (1, "nan") if math.isnan(value) else (1, round(value, 9))
    return (0, "") if value is None else (1, value)


def _rows(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(df, con, sql):
    """Problems found, as text; empty when schema and rows agree."""
    cursor = con.execute(sql)
    want_schema = {d[0]: _TYPES.get(str(d[1]), str(d[1])) for d in cursor.description}
    want = cursor.fetchall()
    got_schema = dict(df.dtypes)
    if got_schema != want_schema:
        return f"schema {got_schema} != {want_schema}"
    got = _rows([tuple(r) for r in df.collect()], df.columns)
    want = _rows(want, list(want_schema))
    if got == want:
        return ""
    odd = [(g, w) for g, w in zip(got, want) if g != w][:3]
    return f"{len(got)} rows, {len(want)} wanted; first differences {odd}"


def main():
    import sys
    import __spark_entry__ as entry
    from tastegrid.session import build_session

    sf_dir = sys.argv[1]
    only = sys.argv[2:]
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8",
                          spark__driver__memory="8g", spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle = connect(sf_dir), entry.oracle_sql()
    for name, query in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            if name in oracle:
                verdict = compare(df, con, oracle[name]) or "ok"
            else:
                verdict = f"rows only: {df.count()}"
        except Exception as error:  # report every query, whatever it raises
            verdict = f"FAILED {type(error).__name__}: {str(error)[:1500]}"
        print(f"{name:28} {time.time() - start:7.2f}s  {verdict}", flush=True)


if __name__ == "__main__":
    main()
