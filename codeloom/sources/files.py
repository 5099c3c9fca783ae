"""Trees of files as rows: a distributed binary-file scan pruned by directory, suffix and size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text as T

#: Directories and files that scans leave out.
PRUNED = [".git", ".hg", ".svn", ".venv", "venv", "env", "node_modules", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", ".nox", ".data", "dist", "build", "_keep_", ".idea", ".vscode"]
INDEX_PRUNED = [".git", ".hg", ".svn", ".data", ".venv", "venv", "__pycache__", "node_modules", "dist", "build", "target", ".gradle", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".idea", ".vscode"]
HIDDEN_ALLOWED = [".kiro", ".github"]
SKIPPED_ENDS = [".min.js", ".min.css", ".map", ".lock", ".log"]
SOURCE_SUFFIXES = ["py", "pyi", "java", "scala", "sc", "kt", "kts", "js", "jsx", "ts", "tsx", "go", "rs", "c", "h", "cc", "cpp", "cxx", "hpp", "cs", "rb", "php", "swift", "m", "mm", "md", "toml", "yaml", "yml", "json", "sql", "sh", "bash", "zsh", "html", "css", "scss"]
MAX_BYTES = 2 * 1024 * 1024


def _scan(spark: SparkSession, root: str) -> DataFrame:
    """The file source passes over hidden directories, so the allowed ones at the root are named to it."""
    root = root.rstrip("/")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    extra = [f"{root}/{d}" for d in HIDDEN_ALLOWED if fs.exists(path(f"{root}/{d}"))]
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([root, *extra])


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path (below the root), size, modified of every file; contents are not read."""
    raw = _scan(spark, root)
    prefix = root.rstrip("/").split(":")[-1].lstrip("/") + "/"
    return raw.select(F.expr(f"substring(path, locate('{prefix}', path) + {len(prefix)})").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def _pruned(path: str, names: list[str], hidden: bool) -> Column:
    dirs = F.expr(f"slice(split({path}, '/'), 1, size(split({path}, '/')) - 1)")
    bad = F.arrays_overlap(dirs, F.array(*[F.lit(n) for n in names]))
    dotted = F.exists(dirs, lambda d: d.startswith(".") & ~d.isin(HIDDEN_ALLOWED))
    return bad if hidden else bad | dotted | T.basename(path).startswith(".")


def grep_candidates(spark: SparkSession, root: str, patterns: list[str] | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Files a text search reads: no pruned or hidden directory, no derived suffix, at most ``max_bytes``."""
    x = listing(spark, root)
    for e in SKIPPED_ENDS:
        x = x.where(~F.lower("path").endswith(e))
    return x.where(~_pruned("path", PRUNED, False) & (F.col("size") <= max_bytes) & T.matches_glob("path", patterns or []))


def index_candidates(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Files an exact index reads: source suffixes outside pruned directories."""
    return listing(spark, root).where(~_pruned("path", INDEX_PRUNED, True) & T.suffix("path").isin(SOURCE_SUFFIXES) & (F.col("size") <= max_bytes))


def contents(spark: SparkSession, root: str, wanted: DataFrame | None = None) -> DataFrame:
    """path, size, modified, hash, content (UTF-8, bad bytes replaced) of the files below a root."""
    raw = _scan(spark, root)
    prefix = root.rstrip("/").split(":")[-1].lstrip("/") + "/"
    x = raw.select(F.expr(f"substring(path, locate('{prefix}', path) + {len(prefix)})").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    if wanted is not None:
        x = x.join(wanted.select("path"), "path", "left_semi")
    return x.select("path", "size", "modified", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("hash"), F.decode("content", "UTF-8").alias("content"))


def sampled(files: DataFrame, max_files: int) -> DataFrame:
    """The first files by path: a cap that does not depend on the order of the walk."""
    return files.orderBy("path").limit(max_files)
