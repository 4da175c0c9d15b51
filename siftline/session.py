"""Session defaults, bounded lookups and lineage cuts shared by all operators."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Most rows ever brought to the driver for a per-class or vocabulary table.
MAX_LOCAL_ROWS = 100_000

_own_folders: dict[str, str] = {}


def build_session(app: str = "siftline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for.

    Shuffle width is left to the cluster's own setting unless given in ``conf``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    A folder given with ``setCheckpointDir`` counts as well. Only where none is named and
    the master is local (a test run) is one made here, once per application; on a
    cluster that would be a folder of one machine, so it is an error there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
        application = spark.sparkContext.applicationId
        if application not in _own_folders:
            _own_folders[application] = "file://" + tempfile.mkdtemp(prefix="siftline-shared-")
        named = _own_folders[application]
    return named.rstrip("/")


def written(df: DataFrame, label: str = "stage", **options: str) -> DataFrame:
    """Cut lineage by writing ``df`` as Parquet into the shared folder.

    Unlike a row checkpoint, the table read back keeps column pruning and filter
    pushdown, so later narrow passes do not touch the wide columns, and its file
    size lets Catalyst decide on a broadcast by a known size. Losing an executor
    later never repeats the work above this point. ``options`` go to the Parquet writer.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/siftline/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_local(df: DataFrame, max_rows: int = MAX_LOCAL_ROWS) -> tuple[DataFrame, pa.Table | None]:
    """Bring a small lookup (one row per class, say) to the driver, if it is small.

    At most ``max_rows + 1`` rows are ever fetched. Within the bound the result is
    a local table of exactly known size, which Catalyst broadcasts by itself. Past
    the bound the lazy ``df`` comes back with no local copy, and joins against it
    run as shuffled joins that AQE may split.
    """
    fetched = df.limit(max_rows + 1).toArrow()
    if fetched.num_rows > max_rows:
        return df, None
    return df.sparkSession.createDataFrame(fetched, schema=df.schema), fetched


#: Input bytes per core below which a table is taken to have too few partitions.
SMALL_SHARE = 16 * 1024 * 1024


def spread(df: DataFrame) -> DataFrame:
    """Deal a small input out to all cores before work that is heavy on each row.

    A file with one row group, or one gzip shard, is read by one task whatever its
    split size. The size comes from Catalyst's own statistics; an input with a fair
    share for every core is left alone, so large scans get no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if planned_bytes(df) < cores * SMALL_SHARE else df


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """Some narrow columns of ``df`` in even partitions of at most SMALL_SHARE of input each, one for every core at least.

    For work that takes far longer on a row than reading it: what tasks get does not hang on
    the row groups of the files, which may hold millions of such rows. Only ``columns`` travel.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.select(*columns).repartition(max(cores, -(-planned_bytes(df) // SMALL_SHARE)))


def planned_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of ``df``; for a written table, its file size."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def fits_broadcast(df: DataFrame) -> bool:
    """Whether Catalyst itself will broadcast ``df`` by its known size."""
    threshold = df._jdf.sparkSession().sessionState().conf().autoBroadcastJoinThreshold()
    return planned_bytes(df) <= threshold
