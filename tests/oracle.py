"""Run a registered query next to its SQL and compare the results."""

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = os.path.join(folder, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(round(value, 7) + 0.0)
    return "null" if value is None else str(value)


def _kind(name):
    name = str(name).lower()
    for kinds in (("int", "integer"), ("bigint",), ("double",), ("string", "varchar"), ("boolean",)):
        if name in kinds:
            return kinds[0]
    return name


def compare(df, con, sql):
    """None if both sides agree, else a short description of the difference."""
    reply = con.execute(sql)
    names = [d[0] for d in reply.description]
    kinds = {d[0]: _kind(d[1]) for d in reply.description}
    theirs = reply.fetchall()
    ours = df.collect()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    own_kinds = {f.name: _kind(f.dataType.simpleString()) for f in df.schema.fields}
    wrong = {c: (own_kinds[c], kinds[c]) for c in names if own_kinds[c] != kinds[c]}
    if wrong:
        return f"types (ours, theirs) {wrong}"
    order = sorted(names)
    spot = [names.index(c) for c in order]
    left = sorted(tuple(_plain(r[c]) for c in order) for r in ours)
    right = sorted(tuple(_plain(r[i]) for i in spot) for r in theirs)
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    for a, b in zip(left, right):
        if a != b:
            return f"first difference in {order}:\n  ours   {str(a)[:600]}\n  theirs {str(b)[:600]}"
    return None
