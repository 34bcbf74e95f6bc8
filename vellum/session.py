"""Sessions, and this package on the executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


def session(name: str = "vellum", **conf: str) -> SparkSession:
    """A session with the settings this package relies on; anything given overrides them."""
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"} | conf
    return SparkSession.builder.appName(name).config(map=settings).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever they run: once for each Spark context, as a zip of its sources."""
    context = spark.sparkContext
    if getattr(context, "_vellum_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="vellum-")) / "vellum-package.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(PACKAGE.rglob("*.py")):
            z.write(source, source.relative_to(PACKAGE.parent))
    context.addPyFile(str(path))
    context._vellum_shipped = True


def tasks(spark: SparkSession) -> int:
    """Tasks for work that takes long for its size: enough for all cores."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share, ``spark.checkpoint.dir``; only in one process may it be unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that the driver and all executors share (master: {master})")
        base = "file://" + tempfile.mkdtemp(prefix="vellum-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/vellum/{label}-{uuid.uuid4().hex}"
