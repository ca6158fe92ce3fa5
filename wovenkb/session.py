"""Session and table access."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "wovenkb", cpus: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings that tests and the benchmark use; on a cluster pass your own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory; local naive timestamps stay as they are stored."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The shared folder that the session names. Only a local session may do without one and gets a temporary folder, kept
    for the session; on a cluster, where executors would write what no one else can read, that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not named:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_dir.isDefined():
            named = set_dir.get()
        elif re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            named = tempfile.mkdtemp(prefix="wovenkb-")
        else:
            raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


_MADE: ContextVar[list | None] = ContextVar("wovenkb_made", default=None)


@contextmanager
def temporary() -> Iterator[None]:
    """Delete at the end what checkpoints are written inside; what is to last must be read or written out before."""
    made: list[DataFrame] = []
    mark = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(mark)
        for df in made:
            discard(df)


def checkpoint(df: DataFrame, lasting: bool = False) -> DataFrame:
    """Cut the lineage with a table written to the shared folder: it survives the loss of an executor, the rows are
    computed once (an RDD checkpoint computes them twice), and later plans start at a plain scan. A ``lasting`` one is
    not deleted with the other tables of ``temporary``."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/wovenkb/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._wovenkb_path = path
    made = _MADE.get()
    if made is not None and not lasting:
        made.append(out)
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a checkpoint that no plan reads any more."""
    path = getattr(df, "_wovenkb_path", None)
    if path:
        place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that Python workers can import it anywhere."""
    import shutil
    from pathlib import Path

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='wovenkb-')}/wovenkb", "zip", package.parent, package.name)
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)
