"""Session settings, shared-folder tables and size-checked joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it is known to hold at most this many rows.
BROADCAST_ROWS = 200_000
#: The same for tables of two numbers, such as where each partition starts.
NARROW_BROADCAST_ROWS = 2_000_000
#: The JVM compiles no method of more bytes than this.
COMPILED_BYTES = 8000
#: Number of slices a hot join key is split into when the small side cannot be broadcast.
SALT_SLICES = 32


def build_session(app: str = "plumbline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every job of this package assumes."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.maxPartitionBytes", str(128 << 20))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a local session may go without the setting; it then gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="plumbline-")
    spark.sparkContext.setCheckpointDir(root)
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return a scan of it.

    The written table outlives any executor, and its real size is what Catalyst
    sees when it picks join strategies further up.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_all(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Write independent tables side by side, so that the cluster never waits for the slowest alone."""
    with ThreadPoolExecutor(max_workers=max(1, len(tables))) as pool:
        written = {name: pool.submit(materialize, df, name) for name, df in tables.items()}
        return {name: future.result() for name, future in written.items()}


def spread(df: DataFrame, each: int = 1) -> DataFrame:
    """Divide an input that has fewer splits than there are cores into ``each`` pieces a core; larger inputs are left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * each) if df.rdd.getNumPartitions() < cores else df


def compiled(spark: SparkSession) -> None:
    """Let Spark give up on generated methods that the JVM would only interpret; their operators then run one by one, compiled."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", str(COMPILED_BYTES))


def bounded(df: DataFrame, max_rows: int, limit: int | None = None) -> DataFrame:
    """``df`` marked for broadcast when its row bound allows it, else as it is."""
    return F.broadcast(df) if max_rows <= (BROADCAST_ROWS if limit is None else limit) else df


def attach(
    rows: DataFrame,
    facts: DataFrame,
    keys: Sequence[str],
    max_facts: int,
    spread: Sequence[str],
    how: str = "inner",
) -> DataFrame:
    """Join per-group ``facts`` (one or a few rows per key) to many ``rows``.

    ``max_facts`` is an upper bound on the rows of ``facts``. Within the broadcast
    limit the join needs no shuffle. Beyond it both sides are joined on the keys
    plus a slice number taken from the ``spread`` columns, so that a group holding
    a large share of all rows is still divided among many tasks.
    """
    keys = list(keys)
    if max_facts <= BROADCAST_ROWS:
        return rows.join(F.broadcast(facts), keys, how)
    slices = F.explode(F.sequence(F.lit(0), F.lit(SALT_SLICES - 1)))
    sliced_rows = rows.withColumn("_slice", F.pmod(F.xxhash64(*spread), F.lit(SALT_SLICES)).cast("int"))
    sliced_facts = facts.withColumn("_slice", slices)
    return sliced_rows.join(sliced_facts, [*keys, "_slice"], how).drop("_slice")
