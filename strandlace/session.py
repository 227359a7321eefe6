"""Session helpers: sending the package to executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package wherever they run: Spark's file server hands it to each executor, once an application."""
    context = spark.sparkContext
    if context.applicationId not in _sent:
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="strandlace-")) / "strandlace_package.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*")):
                if p.is_file() and "__pycache__" not in p.parts:
                    z.write(p, p.relative_to(root.parent))
        context.addPyFile(str(archive))
        _sent.add(context.applicationId)
    return spark


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder named in ``spark.checkpoint.dir``; where that is unset on a local master, in a folder of this session."""
    if not (where := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="strandlace-")
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/{uuid.uuid4().hex}"


@contextmanager
def options(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings that hold inside the block only."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
