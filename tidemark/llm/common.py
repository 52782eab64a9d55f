"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NULL_ID = 2**63 - 1
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_checkpoints(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder. Where none is set, a local session gets a folder of its
    own; a cluster gets an error, for a folder of one machine would lose what others wrote."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))


class Scratch:
    """Intermediate tables as Parquet in the shared checkpoint folder, each deleted by name once no
    later step reads it. The shuffle files of a step go when its table is written."""

    CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession, name: str):
        with_checkpoints(spark)
        self.spark, self.root = spark, f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"

    def put(self, name: str, df: DataFrame) -> DataFrame:
        before = self.spark.conf.get(self.CLEAN)
        self.spark.conf.set(self.CLEAN, "true")
        try:
            df.write.parquet(f"{self.root}/{name}")
        finally:
            self.spark.conf.set(self.CLEAN, before)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Delete these tables, or all of them without a name."""
        for path in [f"{self.root}/{n}" for n in names] or [self.root]:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def in_slices(run, rows: int = 1_000):
    """The function over Arrow batches, given at most so many rows at a time: bounds what it holds beside
    the batch, which Spark bounds by bytes."""

    def sliced(batches):
        return run(b.slice(i, rows) for b in batches for i in range(0, max(len(b), 1), rows))

    return sliced


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; equal in, equal out, and evenly spread."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX[0]
    x ^= x >> np.uint64(27)
    x *= _MIX[1]
    x ^= x >> np.uint64(31)
    return x


def rolling_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of `width` entries, by doubling."""
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        rest = width - have
        out = np.minimum(out[:-rest], out[rest:])
    return out


def join_sites(left: DataFrame, right: DataFrame, keys: list[str], rows: int, limit: int = 200_000) -> DataFrame:
    """Left join to a table of `rows` counted rows: broadcast up to `limit` of them, else an
    ordinary join whose hot keys Spark's adaptive execution splits. Keys compare null-safe."""
    cond = None
    for k in keys:
        right = right.withColumnRenamed(k, f"__r_{k}")
        c = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        cond = c if cond is None else cond & c
    out = left.join(F.broadcast(right) if rows <= limit else right, cond, "left")
    return out.drop(*[f"__r_{k}" for k in keys])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps; x has the features, y is 0 or 1.
    With one class only (or no rows) the weights are 0 and the intercept is the clamped log-odds."""
    n, d = x.shape
    p = (y.sum() + 0.5) / (n + 1.0)
    if n == 0 or y.min() == y.max():
        return np.zeros(d), float(np.log(p / (1 - p)))
    a = np.hstack([x, np.ones((n, 1))])
    w = np.zeros(d + 1)
    w[-1] = np.log(p / (1 - p))
    reg = np.r_[np.full(d, ridge * n), 1e-9]
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (q - y) + reg * w
        hess = (a * (q * (1 - q))[:, None]).T @ a + np.diag(reg + 1e-9)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])
