import glob
import os

import duckdb

DIR = "/root/testdata/sf0.001"


def same(spark, family, name, sf_dir=DIR):
    """The registered query and its SQL give the same rows."""
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    got = {f.__name__: f for f in family.QUERIES}[name](spark, sf_dir)
    want = c.execute(family.ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    key = lambda r: tuple("" if v is None else str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) and abs(v) < 1e15 else str(v) for v in r)
    assert sorted(map(key, got.select(*names).collect())) == sorted(map(key, want.fetchall()))
