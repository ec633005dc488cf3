"""What the corpus operators share: Arrow text buffers, materialised intermediates, word hashing.

Intermediates are written as Parquet below ``spark.checkpoint.dir`` (a folder all
executors share), never kept as a local checkpoint: losing an executor costs a
recomputation of the tasks that read from it and nothing else.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one numpy pass works on; temporaries are a small multiple of it.
SLICE_BYTES = 1 << 21

_own_dir: list[str] = []
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset, a temporary folder of this process on a local master (tests), else an error."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="tessera-"))
    return "file://" + _own_dir[0]


#: Shuffle files of a finished write are of no more use; with this setting Spark drops them at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: computed once, lineage cut, shuffle files dropped."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    _made.append(path)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> int:
    """Delete every table that ``materialise`` has written in this process, once what was made of them is written elsewhere; how many."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    done = len(_made)
    while _made:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_made.pop())
        place.getFileSystem(conf).delete(place, True)
    return done


def discard(*frames: DataFrame) -> None:
    """Delete tables that ``materialise`` has returned and that nothing still to be computed reads."""
    for df in frames:
        conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            mine = next((x for x in _made if path.rsplit("/", 1)[1] == x.rsplit("/", 1)[1]), None)
            if mine is not None:
                place = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(mine)
                place.getFileSystem(conf).delete(place, True)
                _made.remove(mine)


def free_names(taken: str, *names: str) -> tuple[str, ...]:
    """Names of a result's columns beside the id column ``taken``: one that equals it (in any case) gets an underscore."""
    return tuple(f"{n}_" if n.lower() == taken.lower() else n for n in names)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, nulls as empty texts; zero-copy where Arrow allows it."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column, wide = column.cast(pa.string()), False
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer single text is a range of its own."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi
        lo = hi


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on a uint64 array."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


#: Bytes of words: ASCII letters lowered, digits, and every byte of a non-ASCII character; 0 elsewhere.
_FOLD = np.zeros(256, np.uint8)
for _b in range(256):
    if _b >= 128 or chr(_b).isalnum():
        _FOLD[_b] = ord(chr(_b).lower()) if _b < 128 else _b
_BASE = np.uint64(0x100000001B3)


def _powers(n: int) -> np.ndarray:
    p = np.empty(n, np.uint64)
    p[0] = 1
    with np.errstate(over="ignore"):
        for i in range(1, n):
            p[i] = p[i - 1] * _BASE
    return p


_POW = _powers(64)


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of consecutive texts, and the number of words before each text (length n + 1).

    A word is a maximal run of ASCII letters or digits (lower-cased) and non-ASCII
    characters, as ``[a-z0-9\\x80-...]+`` matches it after lowering A-Z.
    """
    n = len(offsets) - 1
    if len(raw) == 0:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    fold = _FOLD[raw]
    inside = fold != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    bounds = offsets[:-1]
    bounds = bounds[bounds < len(raw)]
    first[bounds] = inside[bounds]
    start = np.flatnonzero(first)
    if len(start) == 0:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    at = np.flatnonzero(inside)
    owner = np.cumsum(first[at]) - 1
    place = at - start[owner]
    with np.errstate(over="ignore"):
        value = (fold[at].astype(np.uint64) + np.uint64(1)) * _POW[place & 63] + (place >> 6).astype(np.uint64) * _GOLD
        value = mix(value + place.astype(np.uint64))
        head = np.flatnonzero(first[at])
        h = mix(np.add.reduceat(value, head))
    return h, np.searchsorted(start, offsets, side="left").astype(np.int64)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each window of k words of one array of word hashes (len - k + 1 of them)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * _BASE + mix(words[j : j + n] + np.uint64(j + 1) * _GOLD)
        return mix(out)
