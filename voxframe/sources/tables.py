"""Reading and writing datasets, cohorts, inventories, reports and run stores."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable, Iterator, Sequence
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
OLDER_LABEL = "lesion"


def read_cohort(sheet: DataFrame, schema: dict[str, str], unknown: str = "?") -> DataFrame:
    """The sheet's columns named in the schema, cast; the unknown token becomes null, missing and other columns are left out."""
    return sheet.select(*[F.expr(f"nullif(trim(cast(`{c}` AS string)), '{unknown}')").cast(t).alias(c) for c, t in schema.items() if c in sheet.columns])


def _local(spark: SparkSession, folder: str) -> str | None:
    """The folder as a path of a file system that is mounted on every machine; None if it is of another kind."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


#: Characters that Spark escapes in the names of partition folders.
ESCAPED = re.compile(r"[\x01-\x1f\"#%'*/:=?\\\x7f{\[\]^]")


def write_tree(df: DataFrame, keys: Sequence[str], folder: str) -> None:
    """df's other columns as Parquet files in folder/key=value/..., a folder for each combination of the string keys, none of them null or empty; as Spark's partitioned writer names them.

    That writer takes some milliseconds for each small file and moves them one by one on the driver. On a mounted file
    system the tasks write the files where they belong; a task that is run again writes the same names.
    """
    dealt = df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, keys[0]).sortWithinPartitions(*keys)
    root = _local(df.sparkSession, folder)
    if root is None:
        return dealt.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(*keys).parquet(folder)
    os.makedirs(root, exist_ok=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for k, batch in enumerate(batches):
            names = list(zip(*[batch.column(c).to_pylist() for c in keys], strict=True))
            rest, start = pa.Table.from_batches([batch]).drop_columns(list(keys)), 0
            for values, same in groupby(names):
                rows = sum(1 for _ in same)
                at = os.path.join(root, *[f"{c}={ESCAPED.sub(lambda m: f'%{ord(m[0]):02X}', v)}" for c, v in zip(keys, values, strict=True)])
                os.makedirs(at, exist_ok=True)
                pq.write_table(rest.slice(start, rows), f"{at}/part-{part:05d}-{k:05d}.parquet", compression="none", use_dictionary=False, store_schema=False)
                start, n = start + rows, n + 1
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    dealt.mapInArrow(write, "n long").agg(F.sum("n")).collect()


def unescaped(c: Column) -> Column:
    """The value in the name of a partition folder."""
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


LISTED = pa.schema([("path", pa.string()), ("ts", pa.timestamp("us", "UTC")), ("n_bytes", pa.int64())])


def _seen(name: str) -> bool:
    """Whether Spark's readers see a file or folder of this name."""
    return not (name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name and name not in ("_metadata", "_common_metadata")))


def _listing(spark: SparkSession, root: str) -> DataFrame:
    """path, ts, n_bytes of the files below a folder: a task lists the folder, tasks list its folders, and tasks whatever is below those. The driver holds no name."""

    def run(whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: list[tuple[str, int | None, int | None]] = []
            make = lambda: pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), LISTED, strict=True)], schema=LISTED)
            for batch in it:
                for path, ts, size in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.int64()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    if size is not None:
                        out.append((path, ts, size))
                    todo = [path] if size is None else []
                    while todo:
                        with os.scandir(todo.pop()) as entries:
                            for e in entries:
                                if not _seen(e.name):
                                    continue
                                if not e.is_dir():
                                    found = e.stat()
                                    out.append((e.path, found.st_mtime_ns // 1_000_000 * 1000, found.st_size))
                                elif whole:
                                    todo.append(e.path)
                                else:
                                    out.append((e.path, None, None))
                                if len(out) >= 4096:
                                    yield make()
                                    out = []
            if out:
                yield make()

        return batches

    # A folder has no size yet.
    paths = spark.range(0, 1, 1, 1).select(F.lit(root).alias("path"), F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("long").alias("n_bytes"))
    for whole in (False, False, True):
        paths = paths.mapInArrow(run(whole), "path string, ts timestamp, n_bytes long")
        if not whole:
            paths = paths.repartition(4 * spark.sparkContext.defaultParallelism, "path")
    return paths.withColumn("path", F.concat(F.lit("file:"), "path"))


def inventory_scan(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """subject, modality, study, file of the files under folder/subject/modality/study/; contents aren't read.

    A folder of a mounted file system is listed by tasks. Others are listed by Spark's reader, whose driver holds an entry
    for each file and whose tasks take a few files each.
    """
    root = _local(spark, folder)
    if root is not None and os.path.isdir(root):
        pattern = spark._jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern()
        files = _listing(spark, root).filter(F.regexp_extract("path", "[^/]*$", 0).rlike(f"^(?:{pattern})$"))
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder).select("path", F.col("modificationTime").alias("ts"), F.col("length").alias("n_bytes"))
    parts = F.regexp_extract("path", r"([^/]+)/([^/]+)/([^/]+)/([^/]+)$", 0)
    pick = lambda k: F.element_at(F.split(parts, "/"), k)
    return files.filter(F.col("path").rlike(r"[^/]+/[^/]+/[^/]+/[^/]+$")).select(pick(1).alias("subject"), pick(2).alias("modality"), pick(3).alias("study"), pick(4).alias("file"), "ts", "n_bytes")


def save_dataset(tables: dict[str, DataFrame], folder: str, key: str = "subject") -> None:
    """A Parquet directory per table, partitioned by buckets of the key where the table has one."""
    for name, df in tables.items():
        if key in df.columns:
            df.withColumn("subject_bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")).repartition("subject_bucket").write.mode("overwrite").partitionBy("subject_bucket").parquet(f"{folder}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_dataset(spark: SparkSession, folder: str, name: str, optional: DataFrame | None = None) -> DataFrame:
    """A table of the dataset; an older name of the label column is accepted, a missing optional table is the given empty one."""
    from pyspark.errors import AnalysisException

    try:
        df = spark.read.parquet(f"{folder}/{name}")
    except AnalysisException:
        if optional is None:
            raise
        return optional
    if OLDER_LABEL in df.columns and "label" not in df.columns:
        df = df.withColumnRenamed(OLDER_LABEL, "label")
    return df.drop("subject_bucket")


HEADER = "<4siiid"


def pack_volume(values: np.ndarray, voxel_mm3: float) -> bytes:
    """A volume file: magic, three sizes, voxel volume, then values in C order."""
    return struct.pack(HEADER, b"VOX1", *values.shape, voxel_mm3) + np.ascontiguousarray(values, "<f8").tobytes()


VOLUME_SCHEMA = "path string, x int, y int, z int, value double, voxel_mm3 double"


def volume_rows(files: DataFrame) -> DataFrame:
    """path, content of volume files -> a row per voxel; NaN becomes 0. A file that is no volume or has another length raises."""

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in it:
            for path, content in zip(part["path"], part["content"], strict=True):
                magic, nx, ny, nz, mm3 = struct.unpack_from(HEADER, content)
                if magic != b"VOX1" or len(content) != struct.calcsize(HEADER) + 8 * nx * ny * nz:
                    raise ValueError(f"not a volume: {path}")
                values = np.nan_to_num(np.frombuffer(content, "<f8", offset=struct.calcsize(HEADER)).reshape(nx, ny, nz), nan=0.0)
                # One slice along x at a time bounds the batch.
                for x in range(nx):
                    y, z = np.indices((ny, nz)).reshape(2, -1)
                    yield pd.DataFrame({"path": path, "x": np.int32(x), "y": y.astype(np.int32), "z": z.astype(np.int32), "value": values[x].ravel(), "voxel_mm3": mm3})

    return files.select("path", "content").mapInPandas(batches, VOLUME_SCHEMA)


def pack_volumes(df: DataFrame, value: str, shape: tuple[int, int, int], voxel_mm3: float = 8.0) -> DataFrame:
    """path, content: each subject's dense volume as one file's bytes. A group is one volume, whose size the shape bounds."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        values = np.zeros(shape)
        values[part["x"], part["y"], part["z"]] = part["value"]
        return pd.DataFrame({"path": [str(part["subject"].iloc[0])], "content": [pack_volume(values, voxel_mm3)]})

    return df.select("subject", "x", "y", "z", F.col(value).alias("value")).groupBy("subject").applyInPandas(one, "path string, content binary")


def write_libsvm(df: DataFrame, label: str, features: str, folder: str) -> None:
    df.select(F.col(label).cast("double").alias("label"), F.col(features).alias("features")).write.mode("overwrite").format("libsvm").save(folder)


def read_libsvm(spark: SparkSession, folder: str, n_features: int) -> DataFrame:
    return spark.read.format("libsvm").option("numFeatures", str(n_features)).load(folder)


def write_report(sheets: dict[str, DataFrame], folder: str, form: str = "parquet") -> None:
    """One directory per sheet."""
    for name, df in sheets.items():
        df.write.mode("overwrite").format(form).option("header", "true").save(f"{folder}/{name}")


def load_runs(paths: DataFrame, path: str = "path") -> DataFrame:
    """model, rf and kernel of run folders: from params columns where present, otherwise from the folder's name (<model>_rf<r>[_k<k>])."""
    name = F.regexp_extract(path, "([^/]+)/*$", 1)
    part = lambda pattern: F.expr(f"nullif(regexp_extract(regexp_extract(`{path}`, '([^/]+)/*$', 1), '{pattern}', 1), '')").cast("int")
    given = lambda c: F.col(c) if c in paths.columns else F.lit(None)
    return paths.select(path, F.coalesce(given("param_model"), F.regexp_replace(name, "_rf[0-9]+.*$", "")).alias("model"), F.coalesce(given("param_rf"), part("_rf([0-9]+)")).alias("rf"), F.coalesce(given("param_kernel"), part("_k([0-9]+)")).alias("kernel"))
