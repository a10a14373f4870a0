"""Session helpers: one place for the configs every job relies on."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

# Configs that matter at any scale: UTC for the ISO/file stamps, AQE for
# runtime coalescing / skew splitting / broadcast conversion, Arrow for the
# few pandas UDFs.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # remove checkpoint files once their DataFrame is garbage collected
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "convspark") -> SparkSession:
    """Build (or reuse) a session with the engine's defaults.

    On a cluster pass ``master=None`` and let spark-submit decide; locally
    the tests use ``local[*]`` with a small shuffle-partition count.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins.  Only when it is unset (local runs,
    tests) do we set our own, under ``fallback`` or the system temp dir.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Connect: the server owns the checkpoint dir
        sc = None
    if not conf_dir and sc is not None:
        conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        master = sc.master if sc is not None else ""
        if not fallback and not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile
        conf_dir = fallback or os.path.join(tempfile.gettempdir(), "convspark-checkpoints")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    if sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(conf_dir)
    return conf_dir


def bound_batches(spark: SparkSession, size: int) -> None:
    """Arrow batches of this session hold at most ``size`` bytes (or one row), unless the limit is set to something
    else than Spark's default."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("67108864b", "64m", "64MB"):
        spark.conf.set(name, str(size))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers (a zip, once per application), so that Python operators run from any
    working directory; an installed or PYTHONPATH copy is found first by workers that have one."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Connect: artifacts are the client's business
        return
    if sc.applicationId in _SHIPPED:
        return
    import tempfile
    import zipfile
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="convspark-"), "convspark.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("convspark", os.path.relpath(full, root)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def checkpoint_path(spark: SparkSession, *parts: str) -> str:
    """A sub-folder of the shared checkpoint dir (stream state, cut lineage)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return "/".join([base, *parts])


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss).

    Used between chained ordered passes (position -> running -> running): each
    pass branches its input, so without a cut the input plan would be evaluated
    once per branch of every later pass.  Eager: the rows are written once, now.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def spread(df: DataFrame, per_core: int = 1) -> DataFrame:
    """Round-robin ``df`` over every core when it has fewer partitions than cores.

    For CPU-heavy row work (regex cleaning, prompt rendering, model calls) on an
    input that arrives in a few large splits.  A big input already has more
    partitions than cores and is returned unchanged, so no shuffle is added at
    scale.  Looking at the partition count only plans the scan; it runs no job.
    """
    if df.isStreaming:
        return df  # micro-batches are sized by the source options instead
    try:
        plan = df._jdf.queryExecution().sparkPlan().toString()
        if "Exchange" in plan:
            # after a shuffle the partition count is decided at run time (AQE); asking
            # for it would execute the upstream stages, so leave such inputs alone
            return df
        target = df.sparkSession.sparkContext.defaultParallelism * per_core
        return df.repartition(target) if df.rdd.getNumPartitions() < target else df
    except Exception:  # noqa: BLE001 - e.g. a Connect session without the JVM handles
        return df


def default_partitions(spark: SparkSession, per_core: int = 2) -> int:
    """Partition count for latency-bound work (model calls): a few tasks per core."""
    try:
        return spark.sparkContext.defaultParallelism * per_core
    except Exception:  # noqa: BLE001 - Connect sessions: fall back to the shuffle setting
        return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
