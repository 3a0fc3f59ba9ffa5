"""Session settings the operators rely on.

* ``spark.sql.session.timeZone = UTC``: periods are computed on ``timestamp_ntz``
  wall-clock time; ``date_trunc`` returns a session-zone ``timestamp`` that is
  cast back to ``date``, which is only the identity in UTC.
* AQE on, with partition coalescing and skew-join splitting.
* ANSI mode stays on (Spark's default); divisions that may hit zero use
  ``try_divide``.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # checkpointed tables are removed once unreferenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tallyspark", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings above.

    On a cluster ``master`` is left to ``spark-submit``; tests pass ``local[*]``.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    # getOrCreate on an existing session ignores static builder options; the
    # time zone is a runtime option, so pin it explicitly.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    The folder comes from ``spark.checkpoint.dir`` (or one already set on the
    context).  Only when neither is set *and* the master is local -- a test
    run on one machine -- a scratch folder under the system temp directory is
    created and registered.  On a cluster an unset folder is an error: a
    machine-local path would not be shared by the executors.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster (e.g. on HDFS or object storage)")
        configured = tempfile.mkdtemp(prefix="tallyspark-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")
