"""Session settings and the shared scratch folder."""

import uuid

from pyspark.sql import SparkSession


def build_session(app="rallyframe", master=None, **conf):
    """Session with adaptive execution on; ``master=None`` leaves the choice to the launcher."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Split skewed join sides even where that costs another exchange.
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        # Tables bucketed by match serve joins by match, set and game where they lie.
        "spark.sql.requireAllClusterKeysForCoPartition": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Larger generated methods are never compiled by the JVM and would run interpreted.
        "spark.sql.codegen.hugeMethodLimit": "8000",
        # Call-site capture costs milliseconds per column expression while plans are built.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark):
    """The shared folder of ``spark.checkpoint.dir``, or one below the warehouse where that is unset.

    Both are reached by all executors; a machine-local folder would lose checkpoints together
    with an executor, so there is no such fallback, whatever the master.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    path = spark.conf.get("spark.checkpoint.dir", None)
    context.setCheckpointDir(path or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch")
    return context.getCheckpointDir()


def scratch_path(spark, label):
    """A fresh path below the shared folder, for tables written and read back."""
    return f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df):
    """Write ``df`` once to the shared folder and continue from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df, label):
    """Like ``materialise``, in Parquet files: later scans read only the columns they need."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
