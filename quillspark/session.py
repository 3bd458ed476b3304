"""Session factory and the shared folder that cluster jobs write to."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import json
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_recorders: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("recorders", default=())


def build_session(master: str = "local[8]", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the library is tested under."""
    builder = SparkSession.builder.master(master).appName("quillspark")
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(module: str) -> None:
    """Pickle the functions of ``module`` by value, so that executors need no copy of the library."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path under the session's ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder, which
    goes when the process ends; a cluster session without it is refused.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if "dir" not in _own:
            _own["dir"] = tempfile.mkdtemp(prefix="quillspark-")
            atexit.register(shutil.rmtree, _own["dir"], True)
        base = f"file://{_own['dir']}"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    for found in _recorders.get():
        found.append(path)
    return path


@contextlib.contextmanager
def recorded_dirs() -> Iterator[list[str]]:
    """The list that gets the paths which ``shared_dir`` names inside, in this thread."""
    found: list[str] = []
    before = _recorders.set((*_recorders.get(), found))
    try:
        yield found
    finally:
        _recorders.reset(before)


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: lineage ends there."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``shared_dir`` named."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def settled(spark: SparkSession, build: Callable[[], DataFrame], name: str) -> DataFrame:
    """Write what ``build`` gives to the shared folder, remove the folders that building it named, and read it again."""
    with recorded_dirs() as found:
        out = build()
    done = written(out, name)
    for path in found:
        removed(spark, path)
    return done


def quoted(name: str) -> str:
    """A column's name as ``select`` takes it, whatever is in it."""
    return "`" + name.replace("`", "``") + "`"


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only if ``df`` (cheap to count) has at most ``max_rows`` rows."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver as a DataFrame that stays in the plan: no RDD, no Python on executors."""
    from pyspark.sql import functions as F

    fields = [f.split() for f in schema.split(",")]
    data = json.dumps([dict(zip((f[0] for f in fields), r, strict=True)) for r in rows])
    kind = "array<struct<" + ",".join(f"`{n}`:{k}" for n, k in fields) + ">>"
    return spark.range(1).select(F.explode(F.from_json(F.lit(data), kind)).alias("r")).select("r.*")
