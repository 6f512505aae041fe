"""What the operators of this subpackage share: shared-folder tables, blocks of UTF-8 bytes, vectorised words and hashes.

Text work is done on Arrow buffers: a batch of texts is one byte array with offsets, cut into blocks of
about ``BLOCK`` bytes (a longer text is a block of its own), so memory does not depend on the batch size. Batches are
of ``BATCH`` bytes, where the session leaves Spark's default, as the JVM and the worker each hold one.
Identifiers may be null: joins use ``NO_ID`` in their place and give null back.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK, BATCH = 1 << 19, 8 << 20
NO_ID = -(2**63)


def bounded(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches of BATCH bytes if it has Spark's default of 64 MB."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == f"{64 << 20}b":
        spark.conf.set(key, f"{BATCH}b")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Only where that is unset and the master is local (tests) it is under a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir() if hasattr(spark, "sparkContext") else None
    if not base:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{_local()}"
    return f"{base.rstrip('/')}/quire-{uuid.uuid4().hex}"


_LOCAL: list[str] = []


def _local() -> str:
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="quire-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return _LOCAL[0]


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """df as a table in the shared folder: cuts lineage and survives the loss of executors."""
    spark, path = df.sparkSession, path or shared_dir(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that only a result needs: all of them are deleted once the result is a table itself."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = bounded(spark), []

    def written(self, df: DataFrame) -> DataFrame:
        self.paths.append(shared_dir(self.spark))
        return written(df, self.paths[-1])

    def done(self, df: DataFrame) -> DataFrame:
        out = written(df)
        self.clear()
        return out

    def clear(self) -> None:
        while self.paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def with_id(col: str = "doc_id") -> Column:
    return F.coalesce(F.col(col).cast("long"), F.lit(NO_ID))


def text_digest(text: Column | None = None) -> Column:
    """SHA-256 of a text's UTF-8 bytes (null: empty), 32 bytes."""
    return F.unhex(F.sha2(F.coalesce(F.col("text") if text is None else text, F.lit("")).cast("binary"), 256))


def given_id(col: str = "doc_id") -> Column:
    return F.when(F.col(col) != NO_ID, F.col(col)).alias(col)


def lower_ascii(col: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]] if len(off) else buf[:0], off - off[0] if len(off) else np.zeros(1, np.int64)


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) for runs of rows of at most ``limit`` bytes, or one longer row."""
    buf, off = arrays(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, min(n, int(np.searchsorted(off, off[i] + limit, "right")) - 1))
        yield i, j, buf[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def pieces(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """A batch as slices of at most limit bytes of a column, or one longer row."""
    for i, j, _, _ in blocks(batch[column], limit):
        yield batch.slice(i, j - i)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    space = np.zeros(256, bool)
    space[[0x20, *range(9, 14)]] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    salt = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return space, lower, salt


SPACE, LOWER, SALT = _tables()
SALT_LOWER = SALT[LOWER]
_R = 0x9E3779B97F4A7C15 | 1
_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        n = max(n, BLOCK + 1)
        for k, base in enumerate((_R, pow(_R, -1, 2**64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POW[k] = np.cumprod(steps)
    return _POW[0][:n], _POW[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Bits of 64-bit values stirred, one to one."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return h


class Rolling:
    """Hashes of any byte ranges of a block, from one prefix sum modulo 2**64."""

    def __init__(self, buf: np.ndarray, salt: np.ndarray):
        up, self.down = _powers(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(salt[buf] * up[: len(buf)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def windows(self, k: int) -> np.ndarray:
        """Of every range of k bytes, by its start."""
        n = max(len(self.sums) - k, 0)
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n])


def words(buf: np.ndarray, off: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word ``[^\\x20\\x09-\\x0D]+`` of a block. between: which bytes are in no word."""
    inside = ~between[buf]
    n = len(buf)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(off, start, "right") - 1


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


class Sieve:
    """A set of 64-bit keys as bits: no false negatives. 16 bits a key, at most ``MOST`` bits (8 MB) whatever the number of keys."""

    MOST = 1 << 26

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 64 - 1)

    def __contains__(self, key: int) -> bool:
        return bool(self.has(np.array([key]))[0])

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = mix(keys.view(np.uint64)) & self.mask
        return (self.bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def sieve(keys: DataFrame, col: str) -> Sieve:
    """Of a column of longs; made on the executors, so that only its bits reach the driver."""
    size = 1 << 10
    n = keys.count()
    while size < min(16 * n, Sieve.MOST):
        size *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size // 64, np.uint64)
        for batch in batches:
            at = mix(batch["k"].to_numpy(zero_copy_only=False).view(np.uint64)) & np.uint64(size - 1)
            np.bitwise_or.at(bits, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        at = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(signed(bits[at]))], names=["at", "bits"])

    got = keys.select(F.col(col).alias("k")).mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(size // 64, np.int64)
    bits[got["at"].to_numpy()] = got["bits"].to_numpy()
    return Sieve(bits.view(np.uint64))


CELLS = 1 << 18


def _bit_set(df: DataFrame, gone: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame, Column, Column]:
    """df with the hash of cols, the bits of gone as a table to broadcast, the condition that joins them, and whether the bit is set."""
    cells, n = 1 << 4, gone.count()
    while cells < CELLS and 64 * cells < 16 * n:
        cells *= 2
    h = lambda: F.xxhash64(*cols).bitwiseAND(64 * cells - 1)
    at, bit = F.shiftright(F.col("quire hash"), 6), F.col("quire hash").bitwiseAND(63).cast("int")
    bits = gone.select(h().alias("quire hash")).distinct().groupBy(at.alias("quire at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(`quire hash` & 63 as int))")).alias("quire bits"))
    return df.withColumn("quire hash", h()), F.broadcast(bits), at == F.col("quire at"), F.coalesce(F.getbit("quire bits", bit), F.lit(0)) == 1


def parted(df: DataFrame, gone: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """df as (rows whose cols may be a row of gone, rows whose cols are not); none of cols is null.

    A bit set of the hashes of gone, 16 bits a row and at most ``CELLS`` cells of 64 bits whatever the rows (about 10 MB), is
    broadcast as a table, so this is one JVM stage without an exchange of df. More rows of gone let more of df pass as may be.
    """
    hashed, bits, on, may = _bit_set(df, gone, cols)
    joined = hashed.join(bits, on, "left")
    return joined.where(may).select(df.columns), joined.where(~may).select(df.columns)


def among(df: DataFrame, wanted: DataFrame, cols: list[str]) -> DataFrame:
    """The rows of df whose cols may be a row of wanted, as the first of parted, by a join that puts out no others."""
    hashed, bits, on, may = _bit_set(df, wanted, cols)
    return hashed.join(bits, on & may, "left_semi").select(df.columns)


def anti(df: DataFrame, gone: DataFrame, cols: list[str]) -> DataFrame:
    """df without the rows whose cols (none null) are a row of gone. Only rows that may be among them meet gone in a join."""
    may, not_ = parted(df, gone, cols)
    return not_.union(may.join(gone.select(cols).distinct(), cols, "left_anti").select(df.columns))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs but for the rows of gone(doc_id, digest): an identifier (NO_ID for null) and the text's digest, so no other text goes.

    Only rows whose identifier may be in gone meet it in a join, with their texts; all others stay on the map side.
    """
    gone = gone.select(F.col("doc_id").alias("quire id"), F.col("digest").alias("quire digest")).distinct()
    may, not_ = parted(docs.withColumn("quire id", with_id()), gone, ["quire id"])
    left = may.withColumn("quire digest", text_digest()).join(gone, ["quire id", "quire digest"], "left_anti")
    return not_.select(docs.columns).union(left.select(docs.columns))


LANES = 64


def lane(*cols: str) -> Column:
    """Of a row's identifier and a hash of its content, so that rows without identifiers have several lanes too."""
    return F.pmod(F.xxhash64(*cols), F.lit(LANES)).cast("int").alias("lane")


def lane_groups(df: DataFrame, keys: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """df has lane. (lane, keys) of every lane that holds a group of several rows; keys with first (smallest value) and members (rows) of those groups.

    Both grow with groups times lanes at most, and a key that a third of all rows share is LANES rows, so a join of df with
    them by lane and keys is even.
    """
    runs = df.groupBy("lane", *keys).agg(F.min(value).alias("first"), F.count("*").alias("members"))
    groups = runs.groupBy(*keys).agg(F.min("first").alias("first"), F.sum("members").alias("members")).where("members > 1")
    return runs.select("lane", *keys), groups


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """links (a, b) of longs to (id, c): the smallest identifier that each linked one reaches.

    Smallest labels spread along links and are then shortened by pointer jumping; each round is a written table.
    """
    keep = scratch.written if scratch else written
    both = keep(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = keep(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("c")))
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy(F.col("a").alias("id")).agg(F.min("c").alias("m"))
        better = keep(labels.join(near, "id").select("id", F.least("c", "m").alias("c"), F.col("c").alias("was")))
        up = better.select(F.col("id").alias("i"), F.col("c").alias("up"))
        jumped = keep(better.join(up, better["c"] == up["i"], "left").select("id", F.least("c", F.coalesce("up", "c")).alias("c"), "was"))
        labels = jumped.select("id", "c")
        if jumped.where("c <> was").isEmpty():
            return labels
