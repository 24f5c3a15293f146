"""Shared storage: tables written once and read back, so that lineages and plans stay short."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of a join may be broadcast.
BROADCAST_ROWS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs in one process (tests) a
    temporary folder is made and remembered in the session; on a cluster, where
    each machine would see its own, that is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("factloom.shared.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("factloom.shared.dir", base)
    return base.rstrip("/")


#: Whether the shuffle files of a query go when it ends, not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Folders written so far by each table that is being kept, innermost last; ``None`` where they stay.
_meanwhile: list[list[str] | None] = []


#: Rows that one task writes of a table of counted, narrow rows.
TASK_ROWS = 8192


def few(df: DataFrame, rows: int, each: int = TASK_ROWS) -> DataFrame:
    """``df``, whose last stage reads and gives at most ``rows`` rows of a table, in no more tasks than those need, at ``each`` rows a task.

    A task writes a file, which on a local disk starts processes (see ``written``): small tables are not written in hundreds.
    """
    return df.coalesce(max(1, -(-rows // each)))


def written(df: DataFrame, path: str):
    """The writer of ``df`` to ``path``.

    Without its native library Hadoop starts a process for each mode that it
    sets, which at first has all memory of its JVM: four a file on a local disk,
    two of them for the file of checksums.  A table on the way goes without
    that file there, which takes one; Parquet's pages keep checksums of their own.
    """
    set_ = df.sparkSession._jsc.hadoopConfiguration().get("fs.file.impl")
    if set_ or not path.startswith("file:"):
        return df.write
    return df.write.option("fs.file.impl", "org.apache.hadoop.fs.RawLocalFileSystem").option("fs.file.impl.disable.cache", "true")


def materialize(df: DataFrame, name: str = "table", lean: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: a lost executor costs the rest of one stage only.  The
    files go when the driver's JVM ends.  A ``lean`` table is packed harder, and
    the shuffle files that it took go as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/factloom/{name}-{uuid.uuid4().hex}"
    if lean:
        before = spark.conf.get(CLEANUP, "false")
        spark.conf.set(CLEANUP, "true")
        try:
            written(df, path).option("compression", "zstd").parquet(path)
        finally:
            spark.conf.set(CLEANUP, before)
    else:
        written(df, path).parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    if _meanwhile and _meanwhile[-1] is not None:
        _meanwhile[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def kept(build: Callable[[], DataFrame], name: str = "cut") -> DataFrame:
    """What ``build`` gives, written; what it wrote on the way goes, but not what is kept itself."""
    _meanwhile.append([])
    try:
        own = build()
        mine = _meanwhile[-1]
        _meanwhile[-1] = None
        out = materialize(own, name, lean=True)
    finally:
        _meanwhile.pop()
    for path in mine:
        _delete(out.sparkSession, path)
    return out


def undisturbed(build: Callable):
    """What ``build`` gives; what it wrote on the way stays, for it may be read later."""
    _meanwhile.append(None)
    try:
        return build()
    finally:
        _meanwhile.pop()


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def drop(df: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote and no later plan reads."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/factloom/" in path:
            _delete(df.sparkSession, path)


def small(df: DataFrame, rows: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` are within ``bound``."""
    return F.broadcast(df) if rows <= bound else df


#: Ids up to which they are broadcast: the driver gathers them and builds their table, some 170 bytes an id, and several may be there at once.
AMONG_ROWS = 250_000
#: Bits that tell which of very many ids may be meant; a word of 64, and a row of 64 words.
BITS = 1 << 26


def among(df: DataFrame, ids: DataFrame, key: str = "id", bound: int | None = None) -> DataFrame:
    """The rows of ``df`` whose ``key`` is in ``ids(id)``, distinct and written: a small part of a large table.

    ``df`` is not dealt out as a whole: up to ``bound`` ids are broadcast;
    beyond, a bitmap of their hashes is, whose size is fixed, and only rows
    that it lets pass are joined by a shuffle.
    """
    own = ids.select(F.col("id").alias(key))
    if ids.count() <= (bound or AMONG_ROWS):
        return df.join(F.broadcast(own), key, "left_semi")
    # Ids are distinct.  A semi-join by shuffle would be moved below the bitmap, to all rows.
    return _passing(df, own, key).join(own, key).select(*df.columns)


def without(df: DataFrame, ids: DataFrame, key: str = "id", bound: int | None = None) -> DataFrame:
    """The other rows: those that ``among`` leaves out."""
    own = ids.select(F.col("id").alias(key))
    if ids.count() <= (bound or AMONG_ROWS):
        return df.join(F.broadcast(own), key, "left_anti")
    bits, columns = _bitmap(own, key), df.columns
    known = own.withColumn("_known", F.lit(True))
    left = _passing(df, own, key, bits=bits).join(known, key, "left").where("_known is null").select(*columns)
    return _passing(df, own, key, "left_anti", bits).unionByName(left)


def _bitmap(own: DataFrame, key: str) -> DataFrame:
    """``_block, _words``: a bit per hash of the key, in rows of 64 words; at most ``BITS / 4096`` rows, however many ids there are."""
    hashed = own.select(_place(key).alias("_h"))
    words = hashed.groupBy(F.shiftright("_h", 6).alias("_w")).agg(F.expr("bit_or(shiftleft(1L, cast(_h & 63 as int)))").alias("_bits"))
    rows = words.groupBy(F.shiftright("_w", 6).alias("_block")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("_w").bitwiseAND(F.lit(63)), "_bits"))).alias("_m"))
    return materialize(rows.select("_block", F.expr("transform(sequence(0L, 63L), i -> coalesce(try_element_at(_m, i), 0L))").alias("_words")).coalesce(1), "bits", lean=True)


def _place(key: str):
    return F.pmod(F.xxhash64(key), F.lit(BITS))


def _passing(df: DataFrame, own: DataFrame, key: str, how: str = "left_semi", bits: DataFrame | None = None) -> DataFrame:
    """The rows of ``df`` that may be among the ids, and few others; or (``left_anti``) those that are not."""
    bits = _bitmap(own, key) if bits is None else bits
    bit = F.expr("shiftright(_h, 12) = _block and shiftright(_words[cast(shiftright(_h, 6) & 63 as int)], cast(_h & 63 as int)) & 1 = 1")
    return df.withColumn("_h", _place(key)).join(F.broadcast(bits), bit, how).select(*df.columns)
