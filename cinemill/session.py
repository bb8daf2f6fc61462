"""Session helpers: lineage cuts and names that cannot clash."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    The session's own setting wins; a folder is made up only for a local master without a setting,
    as in tests, since on a cluster a machine-local folder would be lost with its machine.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="cinemill-checkpoint-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that later branches reuse one result."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free_name(name: str, taken) -> str:
    """``name``, with underscores added until no column in ``taken`` has it (case-insensitively)."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give every executor this package (once per application), wherever it was started from."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="cinemill-code-")
    archive = f"{folder}/cinemill-code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)
