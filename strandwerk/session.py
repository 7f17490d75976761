"""Session defaults and the cutting of lineage."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid as _uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings for a session that this library starts itself; on a cluster the driver's own session is used as it is.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def start(app: str = "strandwerk", master: str | None = None, **conf: str) -> SparkSession:
    """A session with DEFAULTS, for tests, the bench and small jobs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=DEFAULTS | conf).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one only where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="strandwerk-")
    atexit.register(shutil.rmtree, made, True)
    spark.sparkContext.setCheckpointDir("file://" + made)
    return "file://" + made


def drop_table(spark: SparkSession, path: str) -> None:
    """Remove a table written by ``materialize``."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Cut:
    """Tables written to the shared folder so that a loop's plan stays short and survives the loss of an executor.

    ``write`` returns the table as it reads back; ``free`` removes tables that a later round has replaced.
    The tables still there when the program ends are removed then.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.made = spark, {}
        self.root = os.path.join(shared_folder(spark), f"strandwerk-{name}-{_uuid.uuid4().hex}")
        atexit.register(self._end)

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{len(self.made)}-{_uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.made[id(out)] = (path, out)
        return out

    def free(self, *tables: DataFrame) -> None:
        for t in tables:
            if id(t) in self.made and self.made[id(t)][0]:
                drop_table(self.spark, self.made[id(t)][0])
                self.made[id(t)] = ("", t)

    def sweep(self, *tables: DataFrame) -> None:
        """Free the tables, and collect the driver's garbage: only then does Spark remove the shuffle files and broadcasts
        of steps that are over, and the driver's heap shrinks to what is in use."""
        self.free(*tables)
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def keep(self, *tables: DataFrame) -> None:
        """Remove all tables but these, when what the others led to is written."""
        kept = {id(t) for t in tables}
        self.free(*[t for i, (_, t) in list(self.made.items()) if i not in kept])

    def _end(self) -> None:
        try:
            drop_table(self.spark, self.root)
        except Exception:
            pass
