"""Session defaults and the shared scratch folder."""

import atexit
import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from logweir.sources import files


def build_session(app: str = "logweir", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; sizes are left to the cluster."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a local one is made only on a local master.

    On a cluster each executor would write to a disk of its own, so there a missing folder is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="logweir-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_folders: dict[str, str] = {}


def session_folder(spark: SparkSession) -> str:
    """This application's own folder below the shared one; it is removed when the driver's program ends."""
    key = f"{scratch_dir(spark)}/logweir-{spark.conf.get('spark.app.id', 'session')}"
    if key not in _folders:
        _folders[key] = key
        atexit.register(files.delete, key)
    return key


_scope: contextvars.ContextVar[str | None] = contextvars.ContextVar("scratch", default=None)


@contextlib.contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[str]:
    """Tables materialized inside are removed at the end, so a long-running job leaves none behind."""
    folder = f"{session_folder(spark)}/scope-{uuid.uuid4().hex}"
    token = _scope.set(folder)
    try:
        yield folder
    finally:
        _scope.reset(token)
        files.delete(folder)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the scratch folder and read back: lineage cut, safe against lost executors."""
    spark = df.sparkSession
    path = f"{_scope.get() or session_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
