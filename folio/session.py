"""Session helpers: only what a local run needs; a cluster brings its own settings."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Inputs below this are dealt to all cores where rows are costly; larger ones have files and row groups enough.
SMALL_INPUT = 512 << 20
#: Rows that are Python objects at once where a function makes much of each.
SLICE = 32
_local_folders: dict[str, str] = {}


def local_session(cores: str = "*", memory: str = "4g", partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``. Only a local session without one gets a folder of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = "file://" + tempfile.mkdtemp(prefix="folio-")
    return _local_folders[app]


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: a cut in the lineage that a lost executor can't undo."""
    path = f"{shared_dir(df.sparkSession)}/folio-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A small table in one row group is one task's work, however many cores there are: it is dealt to all of them. Large ones and streams stay as they are."""
    if df.isStreaming:
        return df
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < SMALL_INPUT else df


def by_slices(f, kind, rows: int = SLICE):
    """A function of one row's values as a UDF of this type. Only so many rows at a time are Python objects; what Spark hands over at once stays in Arrow."""
    from pyspark.sql.functions import ArrowUDFType, arrow_udf
    from pyspark.sql.pandas.types import to_arrow_type

    def run(batches):
        import pyarrow as pa

        to = to_arrow_type(kind)
        for batch in batches:
            columns = batch if isinstance(batch, tuple) else (batch,)
            for at in range(0, len(columns[0]), rows):
                yield pa.array([f(*values) for values in zip(*(c.slice(at, rows).to_pylist() for c in columns), strict=True)], to)

    return arrow_udf(run, kind, ArrowUDFType.SCALAR_ITER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
