"""The register of runs: append-only tables keyed by ``run_id``."""

from __future__ import annotations

import datetime as dt
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.models.selection import combine_leaderboards
from tidegrid.spec import RunParams

RUN_SCHEMA = "run_id string, at timestamp_ntz, status string, progress int, params string, error string"

# Progress in percent after each step of a run.
PROGRESS = {"validated": 10, "preparation": 20, "holidays": 30, "missings": 40, "dataframe": 50, "training": 60, "metadata": 90, "completed": 100}


#: Folders by run in the log, and the size from which a batch is merged no more.
BUCKETS, BATCH_BYTES = 16, 8 << 20


def _fields() -> list[T.StructField]:
    return T.StructType.fromDDL(RUN_SCHEMA).fields


def bucket_of(run_id: str) -> int:
    return zlib.crc32(run_id.encode()) % BUCKETS


def _bucket(run_id: Column) -> Column:
    return (F.crc32(F.encode(run_id, "UTF-8")) % BUCKETS).cast("int")


def _vanished(e: Exception) -> bool:
    """Whether a file was gone that a listing had shown: another writer merged it."""
    return any(s in str(e) for s in ("FileNotFoundException", "FILE_NOT_EXIST", "PATH_NOT_FOUND", "does not exist"))


def _with_params(log: DataFrame) -> DataFrame:
    """Newest row of each run and its newest parameters, in one aggregate."""
    rest = [f.name for f in _fields() if f.name not in ("run_id", "params")]
    newest = F.max_by(F.struct(*rest), "at").alias("r")
    params = F.max_by("params", F.when(F.col("params").isNotNull(), F.col("at"))).alias("params")
    return log.groupBy("run_id").agg(newest, params).select("run_id", "r.*", "params")


def new_run_id() -> str:
    return uuid.uuid4().hex


def latest(log: DataFrame, run_id: str = "run_id", at: str = "at", ties: tuple[str, ...] = ()) -> DataFrame:
    """The newest row of each run. An aggregate, so long logs collapse before the shuffle."""
    rest = [c for c in log.columns if c != run_id]
    newest = F.max_by(F.struct(*rest), F.struct(at, *ties)).alias("r")
    return log.groupBy(run_id).agg(newest).select(run_id, "r.*")


class RunStore:
    """Run tables below one folder: ``runs`` (status log) and, per run, ``messages``, ``leaderboard``,
    ``series_leaderboard``, ``weights``, ``predictions``.

    Every write to the log is a batch folder of its own with the rows in folders by the hash of the run, so writers share no
    temporary files and reading one run opens one bucket per batch. Beyond ``batches`` folders the small ones are merged
    into one; no status is dropped but exact repeats. Readers take the newest row of a run, so a row that lies in an old and in
    the merged folder for a moment counts once."""

    def __init__(self, spark: SparkSession, root: str, batches: int = 64):
        self.spark, self.root, self.batches = spark, root.rstrip("/"), batches

    def _path(self, name: str):
        """A path below the root, and its file system."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _batches(self) -> list[str]:
        path, fs = self._path("runs")
        return [s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().startswith("batch=")] if fs.exists(path) else []

    def append(self, rows: DataFrame) -> None:
        """Append status rows (columns of RUN_SCHEMA; those not given are NULL) as one batch."""
        given = dict.fromkeys(rows.columns)
        columns = [(F.col(f.name) if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in _fields()]
        part = rows.select(*columns, _bucket(F.col("run_id")).alias("bucket"))
        part.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/runs/batch={uuid.uuid4().hex}")
        self.compact()

    def record(self, run_id: str, status: str, progress: int | None = None, params: RunParams | None = None, error: str | None = None) -> None:
        """Append a status row."""
        at = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        row = (run_id, at, status, progress, params.to_json() if params else None, error)
        self.append(self.spark.createDataFrame([row], RUN_SCHEMA).coalesce(1))

    def compact(self) -> None:
        """Merge the small batches once there are more than ``batches``. A batch goes only after its rows are in the merged one;
        if another writer merged them first, this one leaves it at that."""
        if len(self._batches()) <= self.batches:
            return
        try:
            small = [b for b in self._batches() if self._finished(b) and self._size(b) < BATCH_BYTES]
            if len(small) > 1:
                rows = self._read(small).select(*[f.name for f in _fields()], "bucket").distinct()
                rows.repartition("bucket").sortWithinPartitions("run_id", "at").write.partitionBy("bucket").parquet(f"{self.root}/runs/batch={uuid.uuid4().hex}")
        except Exception as e:
            if not _vanished(e):
                raise
            return
        for b in small if len(small) > 1 else []:
            path, fs = self._path(f"runs/{b}")
            fs.delete(path, True)

    def _finished(self, batch: str) -> bool:
        """Whether its writer has committed the batch; one that is still being written must not be merged and removed."""
        path, fs = self._path(f"runs/{batch}/_SUCCESS")
        return fs.exists(path)

    def _size(self, batch: str) -> int:
        path, fs = self._path(f"runs/{batch}")
        return fs.getContentSummary(path).getLength()

    def _read(self, batches: list[str]) -> DataFrame:
        # A batch being written, or without rows, has no bucket folder yet; with none at all the log is empty.
        paths = [f"{self.root}/runs/{b}" for b in batches]
        reader = self.spark.read.option("basePath", f"{self.root}/runs")
        return reader.schema(f"{RUN_SCHEMA}, batch string, bucket int").parquet(*paths) if paths else self.spark.createDataFrame([], f"{RUN_SCHEMA}, batch string, bucket int")

    def log(self, run_id: str | None = None) -> DataFrame:
        """All status rows, or those of one run, of which only its bucket is read."""
        rows = self._read(self._batches())
        if run_id is not None:
            rows = rows.where((F.col("bucket") == bucket_of(run_id)) & (F.col("run_id") == run_id))
        return rows.select(*[f.name for f in _fields()])

    def newest(self) -> DataFrame:
        """The newest status of every run, with the parameters it was started with."""
        return _with_params(self.log())

    def status(self, run_id: str) -> DataFrame:
        """The newest status row, with the parameters the run was started with; an error if there is none."""
        for attempt in range(3):
            try:
                found = _with_params(self.log(run_id))
                rows = found.collect()  # one row
                break
            except Exception as e:
                if not _vanished(e) or attempt == 2:
                    raise
        if not rows:
            raise ValueError(f"no run {run_id!r}")
        return self.spark.createDataFrame(rows, found.schema)

    def write(self, run_id: str, name: str, df: DataFrame) -> None:
        """Store one result of a run. Each run owns a folder, so a rerun replaces only its own rows."""
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/run_id={run_id}")

    def read(self, run_id: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/run_id={run_id}")

    def has(self, run_id: str, name: str) -> bool:
        path, fs = self._path(f"{name}/run_id={run_id}")
        return fs.exists(path)

    def leaderboard(self, run_id: str) -> DataFrame:
        return combine_leaderboards(self.read(run_id, "leaderboard"))
