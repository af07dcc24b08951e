"""Compares a registered query with its SQL in DuckDB, as multisets of rows."""

import math
from collections import Counter
from pathlib import Path

import duckdb


def connection(sf_dir):
    db = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        db.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return db


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def difference(spark, db, sf_dir, query, sql):
    """Nothing where both agree, else a few rows of each side."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    mine = Counter(tuple(_plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in names]).collect())
    found = db.sql(f"SELECT {', '.join(names)} FROM ({sql})")
    theirs = Counter(tuple(_plain(v) for v in r) for r in found.fetchall())
    return None if mine == theirs else (len(mine), len(theirs), list((mine - theirs))[:3], list((theirs - mine))[:3])
