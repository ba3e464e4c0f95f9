"""Side-by-side check of a registered query against its DuckDB oracle.

Used by the tests and by ``python -m ladle.plans.compare [keys...]``.
Columns are sorted by name and must have the same types; rows are compared
as a multiset after light value normalisation (doubles to 6 decimals,
timestamps to ISO text, nested values to tuples).
"""

from __future__ import annotations

import datetime as _dt
import decimal
import sys
from collections import Counter

from ..sources.tables import table_path

DRIVER_VIEWS = ("region nation customer supplier part orders lineitem events documents embeddings "
                "pages benchmark labels conversations").split()


# Spark type -> DuckDB type name, for the column-type comparison.
_TYPE_NAMES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
               "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        if v != v:
            return "nan"
        return round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6) + 0.0
    if isinstance(v, (_dt.datetime, _dt.date)):
        return v.isoformat(sep=" ") if isinstance(v, _dt.datetime) else v.isoformat()
    if isinstance(v, dict):
        return tuple((k, _norm(x)) for k, x in v.items())
    if hasattr(v, "asDict"):
        return tuple((k, _norm(x)) for k, x in v.asDict().items())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def duck_connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in DRIVER_VIEWS:
        con.execute(f"create view {t} as select * from read_parquet('{table_path(sf_dir, t)}')")
    return con


def run_oracle(con, sql: str):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return names, cur.fetchall()


def canon(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cols = [names[i] for i in order]
    return cols, Counter(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, sf_dir: str, key: str, con=None) -> dict:
    from .catalog import as_callables, oracle_sql
    q = as_callables()[key]
    sql = oracle_sql().get(key)
    df = q(spark, sf_dir)
    s_names = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    out = {"key": key, "spark_rows": len(s_rows)}
    if sql is None:
        out["status"] = "rows-only"
        return out
    con = con or duck_connect(sf_dir)
    o_names, o_rows = run_oracle(con, sql)
    out["oracle_rows"] = len(o_rows)
    sc, sv = canon(s_names, s_rows)
    oc, ov = canon(o_names, o_rows)
    s_types = {f.name: _TYPE_NAMES.get(f.dataType.simpleString(), f.dataType.simpleString())
               for f in df.schema.fields}
    rel = con.sql(sql)
    o_types = dict(zip(rel.columns, (str(t) for t in rel.types)))
    type_diff = {c: (s_types[c], o_types.get(c)) for c in s_types if s_types[c] != o_types.get(c)}
    if sc != oc:
        out["status"] = "schema"
        out["detail"] = f"spark={sc} oracle={oc}"
    elif type_diff:
        out["status"] = "types"
        out["detail"] = str(type_diff)
    elif sv != ov:
        out["status"] = "values"
        only_s = list((sv - ov).elements())[:3]
        only_o = list((ov - sv).elements())[:3]
        out["detail"] = f"spark-only={only_s} oracle-only={only_o}"
    else:
        out["status"] = "ok"
    return out


def main(argv: list[str]) -> int:
    from ..session import local_session
    from .catalog import as_callables
    sf_dir = "/root/testdata/sf0.01"
    keys = [a for a in argv if not a.startswith("--")]
    for a in argv:
        if a.startswith("--sf="):
            sf_dir = a.split("=", 1)[1]
    spark = local_session()
    con = duck_connect(sf_dir)
    keys = keys or sorted(as_callables())
    bad = 0
    for k in keys:
        try:
            r = compare(spark, sf_dir, k, con)
        except Exception as e:  # report and continue
            r = {"key": k, "status": "error", "detail": repr(e)[:400]}
        if r["status"] not in ("ok", "rows-only"):
            bad += 1
        print(r, flush=True)
    print(f"{len(keys) - bad}/{len(keys)} ok", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
