"""Shared helpers of the training-data operators: work tables, shipping, vectorised tokenising."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``[\x20\x09-\x0D]``, the only separators of words in these operators.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True

#: Everything but ASCII letters and digits and non-ASCII bytes: separators of "plain" words.
NON_ALNUM = np.ones(256, dtype=bool)
NON_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

CHUNK_BYTES = 1_000_000

#: Bounds of the Arrow batches that go to Python workers; whichever the session sets itself stands.
BATCH_ROWS, BATCH_BYTES = 2_000, 4_000_000

#: What Python workers keep between tasks, by operator; see ``mapped``.
_CACHES: dict[str, dict] = {}


def work_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors: ``spark.checkpoint.dir``, or our own where that is unset."""
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.startswith("local["):
            found = "file://" + tempfile.mkdtemp(prefix="pagequarry-")
        else:
            found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_pagequarry_work"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, tag: str = "t") -> DataFrame:
    """Cuts lineage: writes ``df`` as Parquet in the shared folder and reads it back.  The write's shuffle files go with it.

    ``discard`` removes the table once nothing reads it any more; what is left goes when the session ends.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    fs, p = _fs(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._work_path = path
    return out


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def discard(*tables: DataFrame) -> None:
    """Deletes work tables that ``materialize`` wrote and nothing will read again."""
    for t in tables:
        path = getattr(t, "_work_path", None)
        if path:
            fs, p = _fs(t.sparkSession, path)
            fs.delete(p, True)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, so that their Python workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_pagequarry_shipped", False):
        return
    for key, default, bound in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", None, BATCH_BYTES)):
        if sc.getConf().get(key) is None and (default is None or spark.conf.get(key, default) == default):
            spark.conf.set(key, str(bound))
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = os.path.join(tempfile.mkdtemp(prefix="pagequarry-"), "pagequarry_dist.zip")
    with zipfile.ZipFile(out, "w") as z:
        for d, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.join("pagequarry", os.path.relpath(full, root)))
    sc.addPyFile(out)
    sc._pagequarry_shipped = True


#: Keys with most rows that ``split_join`` sends to all tasks, at most; keys of no more rows than LIGHT are never among them.
HEAVY, LIGHT = 1000, 256


def split_join(left: DataFrame, right: DataFrame, key: str | list[str], weight: str) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has one row per key and in ``weight`` the number of left's rows under it.

    Left's rows under the HEAVY keys of most rows (so many keys are broadcast, and no more) are dealt over as many salts as there are partitions, and
    right's rows of these keys are repeated for each salt.  Of the other keys none holds more than a thousandth of all rows.
    ``weight`` is dropped.
    """
    keys = [key] if isinstance(key, str) else list(key)
    salts = partitions(left.sparkSession)
    hot = right.orderBy(F.desc(weight), *keys).limit(HEAVY).where(F.col(weight) > LIGHT).select(*keys, F.lit(True).alias("_heavy"))
    dealt = left.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.when(F.col("_heavy"), F.pmod(F.xxhash64(*left.columns), F.lit(salts))).otherwise(F.lit(0)).cast("int")).drop("_heavy")
    once = F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    copied = right.drop(weight).join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(once)).drop("_heavy")
    return dealt.join(copied, [*keys, "_salt"]).drop("_salt")


def kept(owner: str) -> dict:
    """What ``owner`` keeps in this Python worker from task to task; another owner's task frees it."""
    return _CACHES.setdefault(owner, {})


def mapped(df: DataFrame, run, schema: str, owner: str, large: int = 32_000_000) -> DataFrame:
    """``mapInArrow`` for workers that serve several operators: frees what others keep, and gives freed memory back at the end of a task.

    Blocks of ``large`` bytes or more go back as soon as they are freed, which costs array code some time.
    """

    def guarded(batches):
        for other in [k for k in _CACHES if k != owner]:
            del _CACHES[other]
        pa.set_memory_pool(pa.system_memory_pool())
        tidy(large)
        try:
            yield from run(batches)
        finally:
            trim()

    return df.mapInArrow(guarded, schema)


def tidy(large: int) -> None:
    """One arena for all threads, and large blocks apart from it."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-8, 1)  # M_ARENA_MAX
        libc.mallopt(-3, large)  # M_MMAP_THRESHOLD
    except (AttributeError, OSError):  # another C library
        pass


def trim() -> None:
    """Gives the C library's free memory back to the system."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), vectorised."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_POW: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = CHUNK_BYTES + 65536
    if n > size:  # a very long text: not kept
        return powers(_BASE, n), powers(_INV, n)
    if "p" not in _POW:
        _POW["p"], _POW["i"] = powers(_BASE, size), powers(_INV, size)
    return _POW["p"], _POW["i"]


class Words:
    """The words of some texts, as flat arrays.

    ``start``/``end`` are byte positions in ``buf``; ``doc`` is the text's position in the list;
    ``first``/``last`` bound each text's words; ``hash`` is a 64-bit hash of each word's bytes.
    """

    def __init__(self, texts: list[bytes], separators: np.ndarray = SPACE, lower: bool = False):
        self.buf = b"\n" + b"\n".join(texts) + b"\n"
        arr = np.frombuffer(self.buf, dtype=np.uint8)
        if lower:
            arr = LOWER[arr]
            self.buf = arr.tobytes()
        self.arr = arr
        gap = separators[arr]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        self.start, self.end = edge[0::2], edge[1::2]
        at = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=at[1:])
        self.at = at + 1
        bound = np.searchsorted(self.start, self.at)
        self.first, self.last = bound[:-1], bound[1:]
        self.doc = np.repeat(np.arange(len(texts)), self.last - self.first)

    @property
    def hash(self) -> np.ndarray:
        p, inv = _tables(len(self.arr) + 1)
        total = np.zeros(len(self.arr) + 1, dtype=np.uint64)
        np.cumsum(_BYTES[self.arr] * p[: len(self.arr)], out=total[1:])
        h = (total[self.end] - total[self.start]) * inv[self.start]
        return mix(h ^ ((self.end - self.start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))

    def left(self) -> np.ndarray:
        """For each word: the words of its text from it on, itself included."""
        return self.last[self.doc] - np.arange(len(self.start))


def grams(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``k`` word hashes (runs that cross texts are for the caller to drop)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, seed + k, dtype=np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[j : j + n]
    return mix(out)


def chunks(texts: list[bytes | None], size: int = CHUNK_BYTES):
    """Yields (lo, hi) so that texts[lo:hi] hold about ``size`` bytes (a longer text stands alone)."""
    lo, total = 0, 0
    for i, t in enumerate(texts):
        n = len(t or b"")
        if i > lo and total + n > size:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(texts):
        yield lo, len(texts)


def crc_mod(column: str, n: int) -> str:
    """SQL: crc32 of the id as text, modulo ``n``."""
    return f"pmod(crc32(encode(cast({column} as string), 'utf-8')), {n})"
