"""Session helpers: a local session for tests and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Lists are up to 5000 long; below this limit a top-k is cut before its shuffle.
    "spark.sql.optimizer.windowGroupLimitThreshold": "5000",
    # Lists are collected for many small groups; keep hashing them.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "65536",
}
"""Settings a job of this library does well with; results do not depend on them."""


def local_session(cores: int | str = 8, app: str = "pickwell", **conf: str) -> SparkSession:
    """Session for tests and the bench; a cluster job brings its own."""
    scratch = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    settings = {
        "spark.sql.shuffle.partitions": str(cores),
        **RECOMMENDED,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.warehouse.dir": f"{scratch}/warehouse",
        "spark.checkpoint.dir": f"{scratch}/checkpoints",
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it then gets a fresh
    folder, remembered in the session so that later calls agree.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("pickwell.local.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.conf.set("pickwell.local.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def use_checkpoints(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable, keeping a folder already set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(f"{shared_dir(spark)}/checkpoints")
