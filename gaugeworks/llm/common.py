"""Shared pieces: scratch tables in the cluster's checkpoint folder, and byte-level text kernels over packed documents."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MAX_SLICE = 1 << 20
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[tuple[SparkSession, str]] = []


def bounded(spark: SparkSession) -> None:
    """What goes to Python at once lies outside the JVM's heap, so sessions with Spark's default of 64 MB get a smaller bound."""
    if spark.conf.get(BATCH_BYTES).strip("b") == str(64 << 20):
        spark.conf.set(BATCH_BYTES, str(4 << 20))


_trimmed = [0.0]


def trim(every_s: float = 0.0) -> None:
    """Give freed memory back, as workers are used again by other operators."""
    import ctypes
    import time

    if time.monotonic() - _trimmed[0] < every_s:
        return
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not this C library
    _trimmed[0] = time.monotonic()


def lean(run):
    """A function for mapInArrow that leaves no freed memory behind."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def lean_group(run):
    """The same for applyInArrow, every few seconds."""

    def group(t: pa.Table) -> pa.Table:
        out = run(t)
        trim(2.0)
        return out

    return group


def lean_cogroup(run):
    def group(key, a: pa.Table, b: pa.Table) -> pa.Table:
        out = run(key, a, b)
        trim(2.0)
        return out

    return group


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where none is set, one under the warehouse on a single machine; elsewhere that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch")
    return sc.getCheckpointDir()


def fresh(names: list[str], name: str) -> str:
    """name, with as many underscores before it as it takes to be none of names (case does not tell names apart)."""
    taken = {n.lower() for n in names}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def cut(df: DataFrame, tag: str, block_mb: int = 16) -> DataFrame:
    """Write df to the shared scratch folder and read it back: a short lineage that outlives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    bounded(spark)
    _written.append((spark, path))
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")  # the table is stored, so shuffle files of making it can go
    try:
        df.write.option("compression", "zstd").option("parquet.block.size", block_mb << 20).parquet(path)
    finally:
        spark.conf.set(CLEANUP, was) if was is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch() -> None:
    """Delete the scratch tables written so far. Call it once the results that read them are stored."""
    while _written:
        spark, path = _written.pop()
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:
            continue  # its session has ended; others may not have


atexit.register(drop_scratch)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- packed text ------------------------------------------------------------------------------------------------

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
IS_ALNUM = np.zeros(256, bool)
IS_ALNUM[0x30:0x3A] = IS_ALNUM[0x61:0x7B] = IS_ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def packed(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks)
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, limit: int = MAX_SLICE) -> Iterator[tuple[int, int]]:
    """Runs of whole documents of at most limit bytes together; a longer document stands alone."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = b


def words(buf: np.ndarray, offs: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of member bytes inside each document, and per document the offset of its first word."""
    w = member[buf]
    first = offs[:-1][offs[:-1] < len(buf)]
    before = np.empty_like(w)
    if len(w):
        before[0] = False
        before[1:] = w[:-1]
        before[first] = False
    starts = np.flatnonzero(w & ~before)
    after = np.empty_like(w)
    if len(w):
        after[-1] = False
        after[:-1] = w[1:]
        after[first[first > 0] - 1] = False
    ends = np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
BASE = int(_rng.integers(1, 2**62)) * 2 + 1
_pow = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n + 1:
        size = 1 << int(n + 1).bit_length()
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _pow[k] = np.cumprod(p, dtype=np.uint64)
    return _pow[0], _pow[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever the word stands."""
    up, down = _powers(len(buf))
    total = np.empty(len(buf) + 1, np.uint64)
    total[0] = 0
    np.cumsum(BYTE[buf] * up[: len(buf)], dtype=np.uint64, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive word hashes; entry i covers words i to i+n-1, so there are len(h)-n+1."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out, size = h, 1
    for bit in bin(n)[3:]:  # doubling: 1, 2, 4 ... and one more word where n has a bit
        k = len(h) - 2 * size + 1
        out = mix(out[:k] * np.uint64(0x9E3779B97F4A7C15) + mix(out[size : size + k] + np.uint64(size)))
        size *= 2
        if bit == "1":
            k = len(h) - size
            out = mix(out[:k] * np.uint64(0xD6E8FEB86659FD93) + mix(h[size : size + k] + np.uint64(77)))
            size += 1
    return out[:m]


def hash_bytes(data: bytes) -> int:
    """The word hash of one byte string."""
    b = np.frombuffer(data, np.uint8)
    return int(word_hashes(b, np.array([0]), np.array([len(b)]))[0])


# ---- chunks: packed documents that several passes read again -------------------------------------------------------

CHUNK = pa.schema([("chunk", pa.int64()), ("offs", pa.binary()), ("text", pa.binary())])


def chunked(docs: DataFrame, text_col: str, carry: list[str], tag: str) -> DataFrame:
    """A scratch table of chunks of about 1 MB of whole texts: chunk (a unique number), offs, text (compressed bytes),
    rows (the carried columns of each document). Nulls in text are empty texts. Later passes name documents by chunk and place."""
    import zstandard
    from pyspark import TaskContext

    from pyspark.sql import functions as F

    own = docs.select(F.col(text_col).alias("text"), F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carry)]).alias("row"))
    kind = own.schema["row"].dataType.simpleString()

    def run(batches):
        pack, part, k = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId(), 0
        for b in batches:
            buf, offs = packed(b.column(0))
            rows = b.column(1)
            for a, z in slices(offs):
                own_rows = rows.slice(a, z - a)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part << 32 | k], pa.int64()),
                        pa.array([(offs[a : z + 1] - offs[a]).tobytes()], pa.binary()),
                        pa.array([pack.compress(buf[offs[a] : offs[z]].tobytes())], pa.binary()),
                        pa.ListArray.from_arrays(pa.array([0, z - a], pa.int32()), own_rows),
                    ],
                    ["chunk", "offs", "text", "rows"],
                )
                k += 1

    return cut(own.mapInArrow(lean(run), f"chunk long, offs binary, text binary, rows array<{kind}>"), tag)


def unpack(b: pa.RecordBatch, names: tuple[str, ...] = ()) -> Iterator[tuple]:
    """For each row of a batch of chunks: its number, bytes, offsets, carried rows, and the named further cells."""
    import zstandard

    unzip = zstandard.ZstdDecompressor()
    col = {n: b.column(k) for k, n in enumerate(b.schema.names)}
    for i in range(len(b)):
        offs = np.frombuffer(col["offs"][i].as_py(), np.int64)
        buf = np.frombuffer(unzip.decompress(col["text"][i].as_py(), max_output_size=max(1, int(offs[-1]))), np.uint8) if offs[-1] else np.zeros(0, np.uint8)
        rows = col["rows"][i].values if "rows" in col else None
        yield col["chunk"][i].as_py(), buf, offs, rows, *[col[n][i].as_py() for n in names]


def text_bytes(chunks: DataFrame) -> int:
    """A bound on the compressed bytes of a chunk table's texts, from their lengths alone."""
    from pyspark.sql import functions as F

    return int(chunks.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])


def blobs(chunk_rows: list[bytes] | None, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(chunk_rows or []), dtype)


def by_bucket(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For ascending uint64 keys: buckets 0..n-1 cut the key space into equal ranges; where each bucket's keys begin."""
    edges = (np.arange(1, n, dtype=object) * (1 << 64) // n).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]]), np.arange(n)
