"""Plumbing shared by the operators: tables, the shared folder, Arrow batches, split groups."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: dict[str, str] = {}
#: What ``materialise`` has written and nobody has deleted yet: path to the Hadoop settings it was written with.
_WRITTEN: dict[str, object] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session (as in tests) gets a temporary folder; a cluster is refused, since
    a folder of one machine is not seen by the others.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _OWN_DIRS.setdefault(app, "file://" + tempfile.mkdtemp(prefix="panelforge-"))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _WRITTEN:
        atexit.register(cleanup)  # what results were built on goes when the driver ends
    _WRITTEN[path] = spark.sparkContext._jsc.hadoopConfiguration()
    return spark.read.schema(df.schema).parquet(path)


def _delete(paths: list[str]) -> None:
    for path in paths:
        conf = _WRITTEN.pop(path)
        try:
            found = SparkSession._instantiatedSession._jvm.org.apache.hadoop.fs.Path(path)
            found.getFileSystem(conf).delete(found, True)
        except (AttributeError, Py4JError, OSError):  # the session has ended before; its folder stays
            return


def cleanup() -> None:
    """Delete all that ``materialise`` has written; call it once results that were built on it are stored."""
    _delete(list(_WRITTEN))


@contextmanager
def scratch(*keep: str) -> Iterator[None]:
    """Delete what is materialised inside once the block ends, but tables whose names are in ``keep``."""
    before = set(_WRITTEN)
    yield
    _delete([p for p in _WRITTEN if p not in before and p.rsplit("/", 1)[1].rsplit("-", 1)[0] not in keep])


def quoted(name: str) -> str:
    """A column's name as Spark reads it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def crc_mod(col: Column | str, n: int) -> Column:
    """crc32 of the value as text, modulo n; null stays null."""
    return F.crc32(F.col(col).cast("string") if isinstance(col, str) else col.cast("string")) % n


def chunks(batches: Iterator[pa.RecordBatch], rows: int = 512, mb: int = 16) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows and about ``mb`` MB (a longer row comes alone), which bounds memory."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = min(rows, batch.num_rows - at)
            while n > 1 and batch.slice(at, n).nbytes > mb << 20:
                n //= 2
            yield batch.slice(at, n)
            at += n


def block_pairs(members: DataFrame, keys: list[str], row_id: str, cap: int, at_least: int = 2) -> DataFrame:
    """Deal the rows of each group to tasks so that every pair of a group meets in exactly one of them.

    A group of more than ``cap`` rows is cut into blocks by a hash of ``row_id``; each pair of blocks is a
    subgroup (``bi`` <= ``bj``) and a row is sent to those of its own block, so that a task holds about
    2 * cap rows of a hot group. Pairs inside block i belong to subgroup (i, i). Adds own block ``b``.
    Groups of fewer than ``at_least`` (1 or 2) rows are left out.

    Sizes are written before rows are joined to them, so that adaptive execution can split a hot key's rows.
    """
    sizes = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > (1 if at_least > 1 else cap))
    sizes = materialise(sizes.select(*keys, F.ceil(F.col("_n") / F.lit(cap)).cast("int").alias("_nb")), "sizes")
    dealt = members.join(sizes, keys, "inner" if at_least > 1 else "left").withColumn("_nb", F.coalesce("_nb", F.lit(1)))
    dealt = dealt.withColumn("b", F.pmod(F.xxhash64(row_id), F.col("_nb")).cast("int"))
    dealt = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    return dealt.withColumns({"bi": F.least("b", "_o"), "bj": F.greatest("b", "_o")}).drop("_o", "_nb")
