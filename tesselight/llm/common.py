"""Shared pieces: scratch tables in the shared folder, Arrow text buffers, word hashes."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Python workers cut a batch into blocks of at most this many text bytes; each takes up to 60 times its size.
BLOCK_BYTES = 1 << 19

U64 = np.uint64


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder that ``spark.checkpoint.dir`` names.

    The setting is only replaced where it is unset, as in tests.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="tesselight-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return f"{root}/{name}-{uuid.uuid4().hex}"


#: For a local shared folder alone: no .crc beside each file. Hadoop starts ``chmod`` for every file that it makes, and
#: each such process shares its JVM's whole memory until it runs. Parquet pages have checksums of their own.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.options(**PLAIN_FILES, **options).parquet(path)
    trimmed(spark)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of a batch for Python, and the value that leaves the number of its rows (at most 10,000 by default) as its limit.
BATCH_BYTES, NO_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch", str((1 << 31) - 1)


def written_from_short_rows(df: DataFrame, name: str, **options: str) -> DataFrame:
    """:func:`written`, for plans that hand many rows of bounded size to Python.

    Spark sums a batch's bytes anew for every row, which costs more than handing over a short row.
    """
    conf = df.sparkSession.conf
    before = conf.get(BATCH_BYTES)
    conf.set(BATCH_BYTES, NO_LIMIT)
    try:
        return written(df, name, **options)
    finally:
        conf.set(BATCH_BYTES, before)


def gathered(df: DataFrame) -> DataFrame:
    """``df`` in a quarter of the usual partitions: for short rows, of which each would be a small file."""
    return df.repartition(max(1, tasks(df.sparkSession) // 4))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or one like it that ``df`` has not."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def discard(*frames: DataFrame) -> None:
    """Delete tables that :func:`written` made and nothing reads any more."""
    for df in frames:
        jvm = df.sparkSession.sparkContext._jvm
        for file in df.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def collected(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that are no longer held, and the driver what compiling them has taken."""
    gc.collect()
    if hasattr(spark, "_jvm"):  # not under Connect, whose server sees to it itself
        spark._jvm.System.gc()
        trimmed(spark)


def trimmed(spark: SparkSession) -> None:
    """Give the memory back that the driver's JVM has freed outside of its heap (its compiler's, mostly)."""
    if not hasattr(spark, "_jvm"):
        return
    java, new = spark._jvm.java.lang, spark.sparkContext._gateway.new_array
    name = spark._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    command = new(java.Object, 4)
    command[0], command[1] = name, "systemTrimNativeHeap"
    beans = java.Class.forName("javax.management.MBeanServer").getMethods()  # the server's own class is not open to Py4J
    try:
        next(m for m in beans if m.getName() == "invoke").invoke(java.management.ManagementFactory.getPlatformMBeanServer(), command)
    except Py4JError:  # only JVMs on glibc have it, from 17.0.9 on
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Words in a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: What operators keep in a worker process between tasks.
KEPT: list[dict] = []


def release() -> None:
    """Drop what earlier operators have kept: Spark reuses workers, and memory is shared.

    What they freed goes back to the system too, not only to this process's allocators.
    """
    for x in KEPT:
        x.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of few rows. Rows given to Spark as Arrow need no Python workers of their own on executors."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    columns = list(zip(*rows)) or [()] * len(kinds)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds))


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(off, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES):
    """Row ranges whose texts hold at most ``most`` bytes (a longer text stands alone)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes in place (a bijection)."""
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.Generator(np.random.PCG64(20240611)).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, U64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        steps = np.full(max(n, 1 << 16), _BASE, U64)
        steps[0] = U64(1)
        _POWERS = np.cumprod(steps, dtype=U64)
    return _POWERS[:n]


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (A-Z lower-cased) and word counts' offsets per text."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    space = _SPACE[buf]
    first = np.ones(n, bool)
    first[1:] = space[:-1]
    starts_of_text = offsets[:-1][offsets[:-1] < n]
    first[starts_of_text] = True
    first &= ~space
    last = np.ones(n, bool)
    last[:-1] = space[1:]
    ends_of_text = offsets[1:][offsets[1:] > 0] - 1
    last[ends_of_text] = True
    last &= ~space
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    # sums of byte * base**(n-1-j) over the block; a word's part times base**(s-n) no longer
    # depends on where the word stands, since base is odd and so has an inverse
    p = _powers(n)
    total = np.zeros(n + 1, U64)
    np.cumsum(_BYTE[_LOWER[buf]] * p[::-1], out=total[1:])
    h = (total[e] - total[s]) * p[s] * U64(pow(int(_BASE), -n, 1 << 64))
    h += (e - s).astype(U64) * U64(0xD1342543DE82EF95)
    return mix(h), np.searchsorted(s, offsets)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles, with offsets per text.

    A text with fewer words has its whole sequence as one shingle; without words, none.
    """
    words, at = word_hashes(buf, offsets)
    counts = np.diff(at)
    n = len(words)
    if n == 0:
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    grams = np.zeros(max(0, n - k + 1), U64)
    factor = [U64((2 * i + 1) * 0xA0761D6478BD642F & (1 << 64) - 1 | 1) for i in range(1, k + 1)]
    for i in range(k if n >= k else 0):  # a negative end of the slice would count from behind
        grams += words[i : n - k + 1 + i] * factor[i]
    mix(grams)
    out, sizes = [], np.zeros(len(counts), np.int64)
    for d in range(len(counts)):
        a, c = int(at[d]), int(counts[d])
        if c >= k:
            x = np.sort(grams[a : a + c - k + 1])
            if len(x) > 1:
                x = x[np.concatenate(([True], x[1:] != x[:-1]))]
        elif c:
            x = mix(np.array([sum(int(w) * (0xE7037ED1A0B428DB + 2 * i * 0x8EBC6AF09C88C6E3 | 1) for i, w in enumerate(words[a : a + c])) + c * 0x589965CC75374CC3 & (1 << 64) - 1], U64))
        else:
            continue
        out.append(x)
        sizes[d] = len(x)
    return (np.concatenate(out) if out else np.zeros(0, U64)), np.concatenate(([0], np.cumsum(sizes)))
