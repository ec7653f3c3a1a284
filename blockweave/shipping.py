"""What jobs need of the cluster: the package's own code on the executors, and a folder that all of them share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_sent: set[str] = set()
_own: dict[str, str] = {}
#: How tables are compressed: hashes and addresses are hexadecimal text, which zstandard halves and the default codec leaves as it is.
CODEC = "zstd"


def ship(spark: SparkSession) -> None:
    """Add the package to the Python path of this application's executors, once; an installed copy does no harm."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    package = Path(__file__).parent
    target = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(target))
    _sent.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a temporary one for a session on this machine alone; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = f"file://{tempfile.mkdtemp(prefix='blockweave-')}"
    return _own[app]


def drop_shuffles(spark: SparkSession) -> None:
    """From now on the shuffled files of an action go when it ends, not when the driver happens to collect its garbage; a job of many
    actions else fills the disks with what nothing reads again."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """A table written to the shared folder and read again, so that it is computed once and plans start from it, and its folder."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", CODEC).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path
