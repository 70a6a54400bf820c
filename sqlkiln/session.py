"""Session helpers: a local session for tests and benches, the shared
checkpoint folder, materialisation and size-checked broadcast."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F

# Broadcast a join side only when its measured size is below this.
DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "sqlkiln") -> SparkSession:
    """A local session for tests and the bench (never used on a cluster)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder the cluster names in ``spark.checkpoint.dir``.
    Only a local master may go without: it takes a fresh temp folder.  On
    several machines a local folder would lose data, so that is an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not (sc.master or "local").startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="sqlkiln-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the checkpoint folder, for written tables."""
    import uuid

    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def measured_bytes(df: DataFrame) -> int:
    """Approximate in-memory size, summed over all rows: the byte length of
    strings and binaries, the length as JSON text of arrays, structs and maps
    (whatever they hold), 8 bytes per other value."""
    parts = []
    for field in df.schema.fields:
        name = f"`{field.name}`"
        t = field.dataType.simpleString()
        if t in ("string", "binary"):
            parts.append(F.coalesce(F.octet_length(F.col(name)), F.lit(0)))
        elif t.startswith(("array", "struct", "map")):
            parts.append(F.octet_length(F.to_json(F.struct(F.col(name).alias("v")))))
        else:
            parts.append(F.lit(8))
    if not parts:
        return 0
    total = parts[0].cast("long")
    for p in parts[1:]:
        total = total + p
    row = df.agg(F.sum(total.cast("long")).alias("b")).collect()[0]
    return int(row["b"] or 0)


def broadcast_if_small(df: DataFrame, max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Materialise a dimension side, measure it, and hint a broadcast only
    when it is below ``max_bytes``; otherwise leave it to a shuffle join
    (AQE skew-join splits hot keys there)."""
    small = materialize(df)
    if measured_bytes(small) <= max_bytes:
        return F.broadcast(small)
    return small


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``sqlkiln`` importable in Python workers (pandas UDFs and
    ``mapInPandas`` pickle its functions by reference): zip the package once
    per application and register it with ``addPyFile``, which ships it to
    every executor.  Clusters that install the package, or pass it with
    ``--py-files``, do not need this."""
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import sqlkiln

    pkg_dir = os.path.dirname(os.path.abspath(sqlkiln.__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="sqlkiln-pkg-"), "sqlkiln.zip")
    with zipfile.ZipFile(out, "w") as z:
        for root, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)
