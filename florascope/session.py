"""Session factory and the helpers that touch the session's settings."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast by hand only below this many bytes (rows times a stated width).
BROADCAST_BYTES = 64 << 20


def get_spark(cores: int = 8, partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session with the settings the library is tested under."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("florascope")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Folders made here for local sessions without a setting, by application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session, as in tests, may do without: it gets one of its own.

    The setting is static, so it is read and never set; a cluster without it raises, as no other folder is known to be shared.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="florascope-")
        atexit.register(shutil.rmtree, _OWN[sc.applicationId][7:], True)
    return _OWN[sc.applicationId]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may be gone already
        pass


def stage(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes df as a table into the shared folder and reads it again: lineage ends there, and any executor can be lost.

    The table is deleted when the process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.parquet(path)


def unstage(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more, where waiting for the end of the process would fill the disk."""
    for t in tables:
        for path in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            _delete(t.sparkSession, path)


def staged_batches(table: DataFrame, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of a staged table in the order of its partitions, some at a time."""
    for f in sorted(table.inputFiles()):
        fs, path = pafs.FileSystem.from_uri(f)
        with fs.open_input_file(path) as source:
            yield from pq.ParquetFile(source).iter_batches(1 << 16, columns=columns)


#: Arrays that this process has mapped, by place.
_MAPPED: dict[str, np.ndarray] = {}


class SharedArrays:
    """Arrays as files of the shared folder, which processes map: they are in no process's own memory and don't travel with functions.

    They are deleted when the driver's process ends.
    """

    def __init__(self, spark: SparkSession) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/arrays-{uuid.uuid4().hex}")
        where = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
        self.where, self.types = where.replace("file:/", "file:///", 1) if not where.startswith("file:///") else where, {}
        fs, at = pafs.FileSystem.from_uri(self.where)
        fs.create_dir(at)
        atexit.register(_delete, spark, self.where)

    def put(self, name: str, dtype: type, parts: Iterator[np.ndarray]) -> None:
        fs, at = pafs.FileSystem.from_uri(f"{self.where}/{name}")
        with fs.open_output_stream(at) as out:
            for x in parts:
                out.write(np.ascontiguousarray(x, dtype))
        self.types[name] = np.dtype(dtype).str

    def __getitem__(self, name: str) -> np.ndarray:
        key = f"{self.where}/{name}"
        if key not in _MAPPED:
            fs, at = pafs.FileSystem.from_uri(key)
            if not fs.get_file_info(at).size:
                return np.zeros(0, self.types[name])
            if not isinstance(fs, pafs.LocalFileSystem):
                # An executor elsewhere reads a copy.
                at = tempfile.NamedTemporaryFile(prefix="florascope-").name
                pafs.copy_files(key, f"file://{at}")
            # A plain array: slices of the subclass are slow.
            _MAPPED[key] = np.asarray(np.memmap(at, self.types[name], "r"))
        return _MAPPED[key]


def spread(df: DataFrame) -> DataFrame:
    """df, a scan with cheap projections, over at least as many partitions as there are cores.

    A table of one small file is one partition, which leaves all cores but one idle in costly projections. Tables with enough
    partitions, as all large ones, are left as they are: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def broadcast_if_small(df: DataFrame, rows: int, width: int) -> DataFrame:
    """A broadcast hint when rows times width (bytes a row, at most) stays below BROADCAST_BYTES; else df, for a shuffled join."""
    return F.broadcast(df) if rows * width <= BROADCAST_BYTES else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dense_ids(keys: DataFrame, col: str, id_col: str = "id") -> tuple[DataFrame, int]:
    """Numbers the distinct values of col from 0 in their order, without a single-task sort.

    Range partitions are sorted and written; each needs only the row counts of those before it (one number a partition
    on the driver). Returns the table (col, other columns, id_col) and the number of rows.
    """
    spark = keys.sparkSession
    n = shuffle_partitions(spark)
    ordered = stage(
        keys.repartitionByRange(n, col).sortWithinPartitions(col).withColumn("_m", F.monotonically_increasing_id()), "ids"
    )
    part, at = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    counts = {r["p"]: r["n"] for r in ordered.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    total, starts = 0, []
    for p in sorted(counts):
        starts.append((p, total))
        total += counts[p]
    if not starts:
        return ordered.withColumn(id_col, F.lit(0).cast("long")).drop("_m"), 0
    offset = F.element_at(F.create_map(*[F.lit(x) for pair in starts for x in pair]), part)
    return ordered.withColumn(id_col, (offset + at).cast("long")).drop("_m"), total
