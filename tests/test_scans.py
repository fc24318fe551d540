"""Trees of files: written by tasks, listed by tasks."""

from __future__ import annotations

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from voxframe import carriers as C
from voxframe.plans import QUERIES
from voxframe.sources import tables as R


def test_a_tree_is_listed_as_by_sparks_reader(spark, tmp_path):
    """Also hidden names, files at other depths and globs; both writers name the same folders, and the files hold the rows."""
    values = ["a b", "x/y", "50%=+", "ä*", "_z", "{q}"]
    df = spark.createDataFrame([(s, m, v, i) for s in "pq" for m in ("m1", "m2") for i, v in enumerate(values * 2)], "s string, m string, t string, n long")
    ours, theirs = str(tmp_path / "ours"), str(tmp_path / "theirs")
    R.write_tree(df, ("s", "m", "t"), ours)
    df.write.partitionBy("s", "m", "t").parquet(theirs)
    folders = lambda root: {os.path.relpath(d, root) for d, _, files in os.walk(root) if any(f.endswith(".parquet") for f in files)}
    assert folders(ours) == folders(theirs) and len(folders(ours)) == 24
    assert Counter(map(tuple, spark.read.parquet(ours).select(*df.columns).collect())) == Counter(map(tuple, df.collect()))
    for name in ("s=p/m=m1/.hidden/a.parquet", "s=p/m=m1/_t/a.parquet", "s=p/m=m1/_t=1/a.parquet", "s=p/m=m1/t=u/deep/b.txt", "top.parquet", "s=p/short.txt", "s=p/m=m1/t=u/_a.parquet", "s=p/m=m1/t=u/a.parquet._COPYING_"):
        (tmp_path / "ours" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "ours" / name).write_bytes(b"abc")
    for glob in ("*", "*.parquet", "{a,b}.*", "[!p]*.tx?"):
        want = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(ours).select(F.element_at(F.split("path", "/"), -1).alias("file"), "modificationTime", "length", F.element_at(F.split("path", "/"), -4).alias("subject"))
        got = R.inventory_scan(spark, ours, glob).select("file", "ts", "n_bytes", "subject")
        assert got.count() > 0 and Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    assert sorted({r[0] for r in R.inventory_scan(spark, ours, "part*").select(R.unescaped(F.substring("study", 3, 99))).collect()}) == sorted(values)


def test_tasks_of_a_scan_dont_grow_with_its_files(spark, tmp_path):
    for i in range(1200):
        (tmp_path / f"s{i // 4}" / "m" / f"t{i}").mkdir(parents=True)
        (tmp_path / f"s{i // 4}" / "m" / f"t{i}" / "f").touch()
    found = R.inventory_scan(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() <= 16 and found.select("study").distinct().count() == 1200


@pytest.mark.parametrize("odd", [None, "", "a/b", "+ %", "none", "-"])
def test_inventory_with_odd_studies(spark, monkeypatch, odd):
    rows = spark.createDataFrame([(1, "2024-01-01", odd, 3), (1, "2025-03-01", "view", 1), (None, None, "view", 2)], "subject long, modality string, study string, n_files long").withColumn("modality", F.to_date("modality"))
    monkeypatch.setattr(C, "inventory", lambda *_: rows)
    got = {tuple(r) for r in QUERIES["inventory_scan"](spark, "").collect()}
    assert got == {("1", "year2024", odd), ("1", "year2025", "view"), (None, None, "view")}
    monkeypatch.setattr(C, "inventory", lambda *_: rows.filter("false"))
    assert QUERIES["inventory_scan"](spark, "").count() == 0
