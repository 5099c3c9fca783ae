"""Session defaults, shared scratch tables that cut lineage, and size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(app: str = "codeloom", cores: str = "*", partitions: int = 8) -> SparkSession:
    """Local session with the settings the engine relies on (UTC, AQE, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a temporary one only where none is set."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.gettempdir() + "/codeloom-shared"
    return root.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone
        pass


class Scratch:
    """Written tables in the shared folder: they survive lost executors and cut the lineage of loops.

    ``write`` returns the table read back. ``drop`` removes tables no longer read; whatever is left goes
    when the interpreter ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/codeloom/{uuid.uuid4().hex}"
        self.n = 0
        self.paths: dict[int, str] = {}
        atexit.register(_delete, spark, self.root)

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._scratch_path = path  # noqa: SLF001
        return out

    def drop(self, *dfs: DataFrame | None) -> None:
        for df in dfs:
            path = getattr(df, "_scratch_path", None)
            if path:
                _delete(self.spark, path)


def bounded_broadcast(df: DataFrame, max_rows: int = 20_000, max_bytes: int = 64 << 20) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows of at most ``max_bytes`` together, as text, else
    unhinted (a shuffled join)."""
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    n, size = df.limit(max_rows + 1).agg(F.count("*"), F.sum(size)).first()
    return F.broadcast(df) if n <= max_rows and (size or 0) <= max_bytes else df


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    The archive is staged beside the driver only; Spark serves it to every executor.
    """
    global _shipped
    sc = spark.sparkContext
    if _shipped == sc.applicationId:
        return
    _shipped = sc.applicationId
    base = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="codeloom-")) / "codeloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(base.rglob("*.py")):
            z.write(p, p.relative_to(base.parent))
    sc.addPyFile(str(target))


_shipped: str | None = None


def registry() -> tuple[dict, dict, Callable]:
    """(queries, SQL, decorator) of a module of queries; a query ships the package before it runs."""
    queries: dict[str, Callable] = {}

    def query(fn):
        def run(spark, sf_dir):
            ship(spark)
            return fn(spark, sf_dir)

        run.__doc__, run.__name__ = fn.__doc__, fn.__name__
        queries[fn.__name__] = run
        return fn

    return queries, {}, query
