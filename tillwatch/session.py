"""Session settings and durable hand-offs between stages."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: stored bytes of input for each file of a table that few_files is used for
FILE_BYTES = 4 << 20


def build_session(app: str = "tillwatch", **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    Nothing here is needed for right results except the UTC time zone; an existing session works too.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # merchant-month frames share hash(merchant_id); let joins on (merchant_id, month_end) use it
        .config("spark.sql.requireAllClusterKeysForCoPartition", "false")
        # no call-site lookup per column expression: wide plans build in half the time
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for name, value in conf.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package where it is used from a checkout instead of being installed."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a private one only on a single machine without any.

    The session's ``spark.checkpoint.dir`` comes first, then the folder set on the context. On a cluster, one of them
    is needed: a driver's temporary folder is another folder on each executor.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="tillwatch-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def stored_bytes(df: DataFrame, looked_at: int = 64) -> int:
    """About how many bytes the files hold that ``df`` reads; 0 if it reads none. No job runs.

    The sizes of ``looked_at`` files, evenly spread over their names, stand for all.
    """
    files = sorted(df.inputFiles())
    some = files[:: max(1, -(-len(files) // looked_at))]
    context = df.sparkSession.sparkContext
    jvm, conf, sizes = context._jvm, context._jsc.hadoopConfiguration(), []
    for name in some:
        at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        sizes.append(at.getFileSystem(conf).getFileStatus(at).getLen())
    return sum(sizes) * len(files) // max(1, len(some))


def few_files(df: DataFrame, file_bytes: int | None = None) -> DataFrame:
    """``df`` in one partition for each ``file_bytes`` of the files that it reads, at least one for each core, never in more than now.

    A shuffle of hundreds of partitions writes a small table as hundreds of files, and on a local disk Hadoop starts
    processes for the permissions of each. Without files to go by, ``df`` stays as it is.
    """
    stored = stored_bytes(df, 16)
    if not stored:
        return df
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-stored // (file_bytes or FILE_BYTES))))


class HandOffs:
    """Written stages that belong together; closing removes them.

    Frames read from them can't be used after that, so close when the results are written or collected.
    """

    def __init__(self):
        self._paths: list[tuple[SparkSession, str]] = []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        return hand_off(df, name, self)

    def add(self, spark: SparkSession, path: str) -> None:
        self._paths.append((spark, path))

    @property
    def last(self) -> str:
        """Where the stage written last lies."""
        return self._paths[-1][1]

    def close(self) -> None:
        for spark, path in self._paths:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        self._paths = []

    def __enter__(self) -> "HandOffs":
        return self

    def __exit__(self, *_) -> None:
        self.close()


def hand_off(df: DataFrame, name: str, owner: HandOffs | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back; ``owner`` removes it when closed.

    Cuts the lineage in a way that survives lost executors, and unlike a row checkpoint it stays columnar, so
    later stages read only the columns they use.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tillwatch/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if owner is not None:
        owner.add(spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
