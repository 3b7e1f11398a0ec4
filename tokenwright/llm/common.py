"""Input shaping, shared-folder tables and connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 2000
_local: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slim(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (as long) and the text: extra columns can then clash with nothing.

    Arrow batches are kept to BATCH_ROWS rows, as rows hold whole texts."""
    spark = docs.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: the session's spark.checkpoint.dir, or, where unset, a folder
    of this machine (only sessions with local masters run without the setting)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = tempfile.mkdtemp(prefix="tokenwright-")
            atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
        where = _local[app]
    return where


_written: dict[str, SparkSession] = {}


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _delete_all() -> None:
    """Stored tables live as long as the application, since a lazy result may still read them."""
    for path, spark in _written.items():
        with contextlib.suppress(Exception):  # the session may be gone, and its folder with it
            _delete(spark, path)


def stored(df: DataFrame, instead_of: DataFrame | None = None, row_group: int | None = None) -> DataFrame:
    """Writes a table to the shared folder and rereads it: lineage ends there, and losing an
    executor costs nothing that was stored.  The table that it takes the place of is deleted."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/t-{uuid.uuid4().hex}"
    (df.write.option("parquet.block.size", row_group) if row_group else df.write).parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    if instead_of is not None and (old := getattr(instead_of, "_stored_at", None)) in _written:
        _delete(spark, old)
        del _written[old]
    return out


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that the frame has in no spelling."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def without(docs: DataFrame, marks: DataFrame, digest: Callable[[Column], Column], text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of `docs`, columns unchanged, that `marks` (id, digest, gone) allows: none of an
    (id, digest) that is gone, one of the repeated rows of one that isn't, all of any other."""
    marks = stored(marks)
    i, d, mi, md = fresh(docs, "row_id", "row_digest", "mark_id", "mark_digest")
    keyed = docs.withColumns({i: F.col(quoted(id_col)).cast("long"), d: digest(F.col(quoted(text_col)).cast("string"))})
    # merged, since neither side has a bound: the same plan at every size
    pair = lambda m: m.select(F.col("id").alias(mi), F.col("digest").alias(md)).hint("merge")
    on = F.col(i).eqNullSafe(F.col(mi)) & (F.col(d) == F.col(md))
    out = keyed.join(pair(marks), on, "left_anti")
    several = marks.where("not gone")
    if not several.isEmpty():
        out = out.unionByName(keyed.join(pair(several), on, "left_semi").dropDuplicates([i, d]))
    return out.select([F.col(quoted(c)) for c in docs.columns])


FILTER_BITS = 1 << 26


def member_filter(members: DataFrame, bits: int = FILTER_BITS):
    """A broadcast bit table of the values of `k`, 8 MB whatever the input: where more values are
    set than it parts, it only lets more rows pass on to the exact join behind it."""
    at = F.pmod("k", F.lit(bits)) + 1
    rows = members.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in rows.toLocalIterator():  # at most bits / 32,768 rows
        out[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(r.bits, np.uint8)
    return members.sparkSession.sparkContext.broadcast(out)


def may_hold(bits: np.ndarray, k: np.ndarray) -> np.ndarray:
    k = k % (8 * len(bits))  # the sign of the divisor, as pmod has it
    return bits[k >> 3] >> (k & 7).astype(np.uint8) & 1 == 1


try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018 - other C libraries lack it
except (OSError, AttributeError):
    _LIBC = None
CELL = 512


def _release() -> None:
    """Gives freed memory back to the system: workers outlive their tasks, and stand idle beside others."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def trimmed(run: Callable) -> Callable:
    """A function of batches whose worker keeps no memory that it has freed."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            _release()

    return wrapped


def bucket_pairs(rows: DataFrame, keys: list[str], cell: int = CELL) -> DataFrame:
    """(*keys, a, b): all pairs of different `node`s that share the keys and differ in `root`.

    A group of n rows is cut into n / cell blocks, and every two blocks meet in a cell that is a key
    of its own, so that no task holds more of a hot group than two blocks, and no pair is lost."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = rows.join(sizes, keys).withColumn("blocks", F.ceil(F.col("n") / cell)).withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    x = met.select(*keys, F.col("node").alias("x"), F.col("root").alias("rx"), F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"))
    y = met.select(*keys, F.col("node").alias("y"), F.col("root").alias("ry"), F.explode(F.sequence(F.lit(0).cast("long"), "block")).alias("i"), F.col("block").alias("j"))
    both = x.join(y, [*keys, "i", "j"]).where("rx <> ry and (i < j or x < y)")
    return both.select(*keys, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): connected components by alternating large-star and small-star steps.

    Every round maps each node's neighbours to the smallest of them, so rounds grow with the log
    of the nodes, and no step holds a component in one place.  root is the smallest node."""
    e = stored(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        nxt = large.join(small_low, "u")
        nxt = nxt.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small_low.select("u", F.col("m").alias("v")))
        e = stored(nxt.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), instead_of=e)
        # a fixed point is a forest of stars: no node is both a leaf and a centre
        now = e.select("u").join(e.select(F.col("v").alias("u")), "u", "left_semi").limit(1).count()
        many = e.groupBy("u").count().where("count > 1").limit(1).count() if now == 0 else 1
        if now == 0 and many == 0:
            break
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
