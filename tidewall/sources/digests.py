"""MD5 of files of any size, read a range at a time.

MD5 runs through a file's bytes in order, but its state after any byte is 92 bytes long. A file above ``RANGE``
bytes is read in splits; the k-th round reads the k-th split of every such file, one task a split, and hands the states on.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewall.sources.tables import scan_files

RANGE = 128 << 20
BOM = b"\xef\xbb\xbf"
#: Spark's line reader unpacks files of these names, so they are read whole.
PACKED = r"\.(gz|bz2|zst|lz4|snappy|deflate)$"


class Md5:
    """An MD5 that can be put down and taken up again; hashlib's cannot. ``state`` is OpenSSL's MD5_CTX and the bytes so far."""

    def __init__(self, state: tuple[bytes, int] | None = None):
        import _hashlib

        self.lib = ctypes.CDLL(_hashlib.__file__)  # resolves the OpenSSL that Python itself uses
        self.context = ctypes.create_string_buffer(92)
        self.n = 0
        if state is None:
            self.lib.MD5_Init(self.context)
        else:
            self.context.raw, self.n = state

    def update(self, data: bytes) -> Md5:
        self.lib.MD5_Update(self.context, data, ctypes.c_size_t(len(data)))
        self.n += len(data)
        return self

    @property
    def state(self) -> tuple[bytes, int]:
        return self.context.raw, self.n

    def hexdigest(self) -> str:
        out, last = ctypes.create_string_buffer(16), ctypes.create_string_buffer(self.context.raw, 92)
        self.lib.MD5_Final(out, last)
        return out.raw.hex()


def _carry(states: dict[int, tuple[bytes, int, bool]]):
    """Takes up the state of every partition's file, adds its lines, and returns the state. The flag: no line has been read yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        context, n, first = states[part]
        md5, head = Md5((context, n)), b""
        for batch in batches:
            lines = batch.column(0).to_pylist()
            if not lines:
                continue
            data = b"\n".join(lines if first else [b"", *lines])
            head, first = (head + data[:4])[:4], False
            md5.update(data)
        yield pa.RecordBatch.from_pydict({"part": [part], "context": [md5.context.raw], "n": [md5.n], "head": [head]}, pa.schema([("part", pa.int64()), ("context", pa.binary()), ("n", pa.int64()), ("head", pa.binary())]))

    return run


def _rounds(lines: DataFrame, splits: dict[str, list[int]], start: bytes) -> dict[str, tuple[tuple[bytes, int], bytes]]:
    """State and first four bytes of every file, its splits (numbers of partitions) read one after the other."""
    sc = lines.sparkSession.sparkContext
    state = {f: (*Md5().update(start).state, True) for f in splits}
    head = dict.fromkeys(splits, start)
    for k in range(max(map(len, splits.values()), default=0)):
        at = {parts[k]: f for f, parts in splits.items() if k < len(parts)}
        step = lines.mapInArrow(_carry({p: state[f] for p, f in at.items()}), "part long, context binary, n long, head binary").rdd
        for r in sc.runJob(step, lambda rows: list(rows), sorted(at)):
            f = at[r.part]
            state[f] = (bytes(r.context), r.n, False)
            head[f] = (head[f] + bytes(r.head))[:4]
    return {f: (state[f][:2], head[f]) for f in splits}


def _large(spark: SparkSession, path: str, glob: str, sizes: dict[str, int], most: int, recursive: bool) -> dict[str, tuple[str, str]]:
    """MD5 and first four bytes (in hex) of the files above ``most`` bytes, by their escaped paths."""
    own = spark.newSession()  # every split is a partition of its own there
    own.conf.set("spark.sql.files.maxPartitionBytes", str(most))
    own.conf.set("spark.sql.files.openCostInBytes", str(most))
    lines = own.read.option("lineSep", "\n").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).text(path)
    lines = lines.where(F.col("_metadata.file_size") > most)
    places = lines.select("_metadata.file_path", "_metadata.file_block_start", F.spark_partition_id(), F.monotonically_increasing_id().alias("id"))
    firsts = places.where(F.col("id") % (1 << 33) == 0).drop("id")  # a partition's first row; without a row it has no bytes to add
    splits: dict[str, list[int]] = {f: [] for f in sizes}
    for f, _, part in sorted(firsts.collect()):
        if f in splits:
            splits[f].append(part)
    values = lines.select(F.col("value").cast("binary").alias("value"))
    out = {}
    for start in (b"", BOM):  # the line reader drops a byte order mark, which shows in the number of bytes
        for f, (state, head) in _rounds(values, {f: p for f, p in splits.items() if f not in out}, start).items():
            md5 = Md5(state)
            if md5.n == sizes[f] - 1:  # a last line feed ends a line and starts none
                md5.update(b"\n")
                head = (head + b"\n")[:4]
            if md5.n == sizes[f]:
                out[f] = md5.hexdigest(), head.hex().upper()
    if missing := sizes.keys() - out.keys():
        raise RuntimeError(f"files changed while they were read: {sorted(missing)}")
    return out


def file_digests(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True, most: int = RANGE) -> DataFrame:
    """Files as rows: path, name, size, md5 and magic (the first four bytes in hex).

    No task reads more than ``most`` bytes and a line of a larger file. Files up to that size are read when the rows are; larger ones,
    one after the other's splits, when this is called. Packed files (gz and the like) are read whole.
    """
    files = scan_files(spark, path, glob, recursive=recursive)
    listed = scan_files(spark, path, glob, content=False, recursive=recursive)
    whole = (F.col("_metadata.file_size") <= most) | F.col("_metadata.file_path").rlike(PACKED)  # known from the listing: no other file is opened
    rows = files.where(whole).select("path", "name", "size", F.md5("content").alias("md5"), F.hex(F.substring("content", 1, 4)).alias("magic"))
    large = listed.where(~whole).select("path", "name", "size", "_metadata.file_path").collect()
    if not large:
        return rows
    found = _large(spark, path, glob, {r.file_path: r["size"] for r in large}, most, recursive)
    return rows.unionByName(spark.createDataFrame([(*r[:3], *found[r.file_path]) for r in large], "path string, name string, size long, md5 string, magic string"))
