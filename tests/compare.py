"""Rows of a query and of DuckDB SQL over the same Parquet tables, in a form that can be compared."""

import glob
import math

import duckdb


def canonical(rows, names):
    def value(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.9g}"
        if hasattr(v, "isoformat"):
            return v.replace(tzinfo=None).isoformat(" ") if hasattr(v, "hour") else v.isoformat()
        if isinstance(v, (bytes, bytearray)):
            return bytes(v).hex()
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(map(value, v)) + "]"
        if hasattr(v, "as_tuple"):
            return f"{float(v):.9g}"
        return str(v)

    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(value(r[i]) for i in order) for r in rows)


def spark_rows(df):
    return canonical([tuple(r) for r in df.collect()], df.columns)


def duck_rows(sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = path.rsplit("/", 1)[1].removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return canonical(got.fetchall(), names)
