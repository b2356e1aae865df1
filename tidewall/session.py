"""Session settings and the few cluster facts the operators need."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def local_session(cores: int | str = "*", app: str = "tidewall", **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster use the session you are given."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    Taken from ``spark.checkpoint.dir``. Only a local master may fall back to a
    temporary folder: on a cluster a machine-local folder is lost with its machine.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        current = sc.getCheckpointDir()
        if current is not None:
            return current
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="tidewall-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive the loss of any executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Give CPU-heavy row work enough tasks.

    Decided on the estimated size alone, nothing is run. An input large enough to give every core a
    split is returned as it is, so nothing is shuffled at scale; a smaller one is dealt out
    round-robin, which moves at most one split's worth per core.
    """
    if df.isStreaming:
        return df
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df if size >= cores * split else df.repartition(cores * per_core)


def collect_rules(df: DataFrame, max_rows: int = 10_000) -> list[dict]:
    """Bring a rule table to the driver, refusing anything that is not rule-sized."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"a rule table may hold at most {max_rows} rows")
    return [r.asDict(recursive=True) for r in rows]
