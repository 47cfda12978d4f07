"""Session settings and the shared scratch folder."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_LOCAL_BASE: dict[str, str] = {}
_TABLES: dict[tuple, str] = {}
_FINGERPRINTS: dict[tuple[str, str], str] = {}


def build_session(app: str = "orientlake", cores: str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one in ``spark.checkpoint.dir``.

    Only a local master may go without the setting; it then gets a fresh
    folder of its own, and the setting is filled in for later readers.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        base = _LOCAL_BASE.get(app)
        if base is None:
            base = _LOCAL_BASE[app] = tempfile.mkdtemp(prefix="orientlake-")
    return f"{base.rstrip('/')}/orientlake-{app}"


def new_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def place_of(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a local path or of an address with a scheme."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def batches_in(path: str) -> list[int]:
    """Numbers of the whole ``batch=N`` tables in a folder, in order."""
    system, at = place_of(path)
    found = system.get_file_info(fs.FileSelector(at, allow_not_found=True))
    numbers = [int(f.base_name.split("=", 1)[1]) for f in found if f.base_name.startswith("batch=")]
    return sorted(n for n in numbers if system.get_file_info(f"{at}/batch={n}/_SUCCESS").type != fs.FileType.NotFound)


def remove_dir(path: str) -> None:
    system, at = place_of(path)
    system.delete_dir(at)


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here,
    and a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = new_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def source_fingerprint(spark: SparkSession, path: str) -> str:
    """Hash of the names, sizes and times of the files below ``path``, taken once per session and path."""
    known = (spark.sparkContext.applicationId, path)
    if known in _FINGERPRINTS:
        return _FINGERPRINTS[known]
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        .selectExpr("path", "length", "cast(modificationTime as string) as t")
        .selectExpr("count(*) n", "sum(length) b", "max(t) t", "sum(xxhash64(path, length, t) % 1000000007) h")
        .first()
    )
    _FINGERPRINTS[known] = hashlib.sha1(repr(tuple(files)).encode()).hexdigest()[:16]
    return _FINGERPRINTS[known]


def table_once(spark: SparkSession, key: tuple, label: str, build) -> DataFrame:
    """Build a derived table once per session and read it from the shared folder after that."""
    full = (spark.sparkContext.applicationId, *key)
    if full not in _TABLES:
        path = new_dir(spark, label)
        build().write.parquet(path)
        _TABLES[full] = path
    return spark.read.parquet(_TABLES[full])
