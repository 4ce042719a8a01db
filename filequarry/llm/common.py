"""Shared plumbing: written tables in the cluster's shared folder, and text rules that several operators use."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only separator of words here: ``[^\x20\x09-\x0D]+``.
SPACES = "[\\x20\\x09-\\x0D]+"
#: Stands for a null doc_id in keys and orders; such rows sort before all others.
NO_ID = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; if that is unset, one of our own on a single machine, and else an error."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="filequarry-"))
    return sc.getCheckpointDir().rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage ends there, and a lost executor costs nothing.

    The table goes when forget() says so, or else when the program ends.
    """
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, p = _hadoop(df.sparkSession, path)
    fs.deleteOnExit(p)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def _hadoop(spark: SparkSession, path: str) -> tuple:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def forget(df: DataFrame | None) -> None:
    """Delete what written() stored for df; nothing may read it any more."""
    path = getattr(df, "_written_path", None)
    if path:
        fs, p = _hadoop(df.sparkSession, path)
        fs.delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it a column that df doesn't have."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


#: Bits of a filter, and of one of its parts as Spark's bitmaps have them: 8 MB in all, however many keys there are. Each
#: row that is looked up copies one slice, of so many bytes.
FILTER_BITS, PART_BITS, SLICE = 1 << 26, 1 << 15, 256


def perhaps_in(df: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    """df with a boolean column ``name``: false only where ``key`` (long) is surely not in the one column of ``keys``.

    The filter's size is fixed, so that it may be broadcast; with very many keys it lets more rows through, and no key
    is ever lost.
    """
    (k,) = keys.columns
    bit = lambda c: F.pmod(c, F.lit(FILTER_BITS))
    part, bits, at = unused(df, "filter_part", "filter_bits", "filter_at")
    parts = keys.select(bit(F.col(k)).alias("b")).groupBy(F.expr(f"b div {PART_BITS}").alias("p"))
    parts = parts.agg(F.bitmap_construct_agg(F.col("b") % PART_BITS).alias("map"))
    n = PART_BITS // 8 // SLICE
    parts = parts.select("p", "map", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).select(F.expr(f"p * {n} + i").alias(part), F.expr(f"substring(map, i * {SLICE} + 1, {SLICE})").alias(bits))
    met = df.withColumn(at, bit(key)).withColumn(part, F.expr(f"`{at}` div {8 * SLICE}")).join(F.broadcast(parts), part, "left")
    byte = F.ascii(F.decode(F.expr(f"substring(`{bits}`, cast(`{at}` % {8 * SLICE} div 8 as int) + 1, 1)"), "ISO-8859-1"))
    hit = F.shiftrightunsigned(byte, 0).bitwiseAND(F.expr(f"shiftleft(1, cast(`{at}` % 8 as int))")) != 0
    return met.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(hit, F.lit(False)).alias(name))


def row_id() -> Column:
    """doc_id, with nulls made comparable."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def text_key(text: Column) -> Column:
    """64 bits that tell texts of the same doc_id apart; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def words_of(text: str | None) -> list[bytes]:
    """Words of a whole text, A-Z lower-cased and nothing else; bytes methods know ASCII only, as wanted."""
    return (text or "").encode("utf-8", "replace").lower().split()


def tidy() -> None:
    """Give back what a batch has freed: a Python worker stays for later stages, whose memory it must not hold."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidied(run):
    """Run a function of Arrow batches on one batch at a time, and tidy when that and all its objects are gone."""

    @functools.wraps(run)
    def each(batches):
        for batch in batches:
            yield from run(iter((batch,)))
            del batch
            tidy()

    return each
