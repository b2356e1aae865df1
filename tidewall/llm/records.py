"""Token ids as length-delimited binary records, with a separate offset index.

A record is: length (8 bytes), masked CRC-32C of the length (4), payload, masked CRC-32C of the payload (4), all little-endian.
The payload holds the ids of one document, two or four bytes each. Files follow each other in the order
of the documents; the index names file, offset and length of every record, so records can be read
in any order.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewall.llm import arrays as A
from tidewall.llm import tokens
from tidewall.session import checkpoint_dir

# --- fixed values: the CRC-32C polynomial (reflected) and the mask of stored checksums ---
CASTAGNOLI = 0x82F63B78
MASK_ADD = 0xA282EAD8
MASK_ROTATE = 15
# --- end of fixed values ---

HEADER = struct.Struct("<QI")
FOOTER = struct.Struct("<I")
INDEX = "doc_id long, file_no int, file string, offset long, bytes long, n_tokens long, start_in_file long"


class _Linear:
    """A linear map on 32-bit checksums, applied to whole arrays through four tables."""

    def __init__(self, columns: np.ndarray):
        self.columns = columns
        bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
        self.tables = [np.bitwise_xor.reduce(np.where(bits == 1, columns[8 * k : 8 * k + 8], np.uint32(0)), axis=1).astype(np.uint32) for k in range(4)]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        t = self.tables
        return t[0][x & 255] ^ t[1][(x >> 8) & 255] ^ t[2][(x >> 16) & 255] ^ t[3][x >> 24]

    def twice(self) -> _Linear:
        return _Linear(self(self.columns))


def _one_byte() -> _Linear:
    columns = []
    for i in range(32):
        c = 1 << i
        for _ in range(8):
            c = (c >> 1) ^ (CASTAGNOLI if c & 1 else 0)
        columns.append(c)
    return _Linear(np.array(columns, np.uint32))


_SHIFTS: list[_Linear] = []


def _shift(k: int) -> _Linear:
    """What 2**k zero bytes do to a checksum."""
    while len(_SHIFTS) <= k:
        _SHIFTS.append(_SHIFTS[-1].twice() if _SHIFTS else _one_byte())
    return _SHIFTS[k]


def crc32c(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32C of data[s:e] for every pair: pairs of neighbouring checksums are folded until one is left."""
    size = (ends - starts).astype(np.int64)
    out = np.zeros(len(size), np.uint32)
    level = np.maximum(np.ceil(np.log2(np.maximum(size, 1))).astype(int), 2)
    for k in np.unique(level).tolist():
        rows = np.flatnonzero(level == k)
        per = max(1, (1 << 22) >> k)
        for lo in range(0, len(rows), per):
            pick = rows[lo : lo + per]
            padded = np.zeros((len(pick), 1 << k), np.uint8)  # zeros in front do not change the sum
            for i, (s, e) in enumerate(zip(starts[pick].tolist(), ends[pick].tolist(), strict=True)):
                padded[i, (1 << k) - (e - s) :] = data[s:e]
            x = _shift(2)(padded.view("<u4"))
            for step in range(2, k):
                x = _shift(step)(x[:, 0::2]) ^ x[:, 1::2]
            out[pick] = x[:, 0]
    init = np.full(len(size), 0xFFFFFFFF, np.uint32)
    for b in range(int(size.max(initial=0)).bit_length()):
        has = (size >> b) & 1 == 1
        init[has] = _shift(b)(init[has])
    return out ^ init ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    """The form in which a checksum is stored, so that a checksum of checksums does not degenerate."""
    x = crc.astype(np.uint64)
    turned = ((x >> np.uint64(MASK_ROTATE)) | (x << np.uint64(32 - MASK_ROTATE))) & np.uint64(0xFFFFFFFF)
    return ((turned + np.uint64(MASK_ADD)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def frame(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The framed records data[s:e] and the bytes of each."""
    size = (ends - starts).astype("<u8")
    head = size.view(np.uint8)
    at = np.arange(len(size)) * 8
    head_crc = masked(crc32c(head, at, at + 8)).tolist()
    body_crc = masked(crc32c(data, starts, ends)).tolist()
    raw, out = data.tobytes(), []
    for n, h, b, s, e in zip(size.tolist(), head_crc, body_crc, starts.tolist(), ends.tolist(), strict=True):
        out += (HEADER.pack(n, h), raw[s:e], FOOTER.pack(b))
    return out, size.astype(np.int64) + HEADER.size + FOOTER.size


def unframe(raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Payload bounds of the records at the offsets; raises ValueError where a checksum does not hold."""
    data = np.frombuffer(raw, np.uint8)
    at = offsets.astype(np.int64)
    size = data[at[:, None] + np.arange(8)].copy().view("<u8")[:, 0].astype(np.int64)
    word = lambda p: data[p[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
    if (masked(crc32c(data, at, at + 8)) != word(at + 8)).any():
        raise ValueError("a record's length does not match its checksum")
    starts, ends = at + HEADER.size, at + HEADER.size + size
    if (masked(crc32c(data, starts, ends)) != word(ends)).any():
        raise ValueError("a record does not match its checksum")
    return data, starts, ends


def _store(folder: str):
    """File system and path of a folder URI, for the tasks."""
    from pyarrow import fs

    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    uri = "s3://" + folder.split("://", 1)[1] if folder.startswith("s3a://") else folder
    uri = "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri
    return fs.FileSystem.from_uri(uri)


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh folder beside the checkpoints, which all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def _writer(folder: str, file: str, end_id: int, width: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        encoder = tokens.encoder(file)
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        no = context.partitionId()
        # another attempt at the task writes another file; the index names the one whose attempt counted
        name = f"part-{no:05d}-{context.taskAttemptId()}.rec"
        out, offset, ids_before = None, 0, 0
        for batch in batches:
            data, offsets = A.text_buffers(batch.column(1))
            for lo, hi in A.chunks(offsets, tokens.CHUNK):
                ids, at = encoder.encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                n = np.diff(at) + 1
                ids = np.insert(ids, at[1:], end_id).astype(f"<u{width}")
                if int(end_id).bit_length() > 8 * width or encoder.tok.get_vocab_size() > 1 << (8 * width):
                    raise ValueError("the ids do not fit the record's width")
                stops = np.cumsum(n) * width
                framed, sizes = frame(ids.view(np.uint8), stops - n * width, stops)
                out = out or store.open_output_stream(f"{root}/{name}")
                for piece in framed:
                    out.write(piece)
                offsets_out = offset + np.cumsum(sizes) - sizes
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array([no] * (hi - lo), pa.int32()), pa.array([name] * (hi - lo)), pa.array(offsets_out), pa.array(sizes), pa.array(n), pa.array(ids_before + np.cumsum(n) - n)],
                    names=["doc_id", "file_no", "file", "offset", "bytes", "n_tokens", "start_in_file"],
                )
                offset += int(sizes.sum())
                ids_before += int(n.sum())
        if out is not None:
            out.close()

    return write


def write_records(df: DataFrame, folder: str, file: str = "word_bpe_49k.json", end_id: int = 2, width: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text, append ``end_id``, and write the records in ascending ``key`` order under ``folder``.

    Returns the index, read back from ``folder``/index: doc_id, file_no, file, offset, bytes, n_tokens, start_in_file.
    Files are numbered in key order. A null text is an empty text (one id); null keys come first; rows
    of one key stand in the order of a hash of their texts, so that no key fills one file. ``width`` is the
    bytes of an id; ids that do not fit raise. Other columns of ``df`` are not written. An empty table gives an empty index.
    """
    named = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("_h"))
    ranged = named.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h").select("doc_id", "text")
    ranged.mapInArrow(_writer(f"{folder}/data", file, end_id, width), INDEX).write.parquet(f"{folder}/index")
    return df.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


def _reader(folder: str, width: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for batch in batches:
            names = np.array(batch.column("file").to_pylist(), object)
            offset = batch.column("offset").to_numpy()
            size = batch.column("bytes").to_numpy()
            new = np.r_[True, (names[1:] != names[:-1]) | (offset[1:] != offset[:-1] + size[:-1])] if len(names) else np.zeros(0, bool)
            edges = [*np.flatnonzero(new).tolist(), len(names)]
            crc, n = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                with store.open_input_file(f"{root}/{names[lo]}") as f:
                    for a in range(lo, hi, 512):  # records that follow each other are read together
                        b = min(a + 512, hi)
                        raw = f.read_at(int(offset[b - 1] + size[b - 1] - offset[a]), int(offset[a]))
                        data, starts, ends = unframe(raw, offset[a:b] - offset[a])
                        for i, (s, e) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                            ids = data[s:e].view(f"<u{width}").astype("<u4")
                            crc[a + i], n[a + i] = zlib.crc32(ids.tobytes()), len(ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), pa.array(n), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"]
            )

    return read


def read_records(index: DataFrame, folder: str, width: int = 2) -> DataFrame:
    """Read the records of an index back: doc_id, start (ids before the document), n_tokens, ids_crc32.

    Lengths and checksums are tested; a record that fails ends the job. ``start`` is the document's place in
    its file plus the ids of all files before, one row per file. ``ids_crc32`` takes the ids as 32-bit integers.
    """
    totals = index.groupBy("file_no").agg(F.sum("n_tokens").alias("_n"))
    before = W.orderBy("file_no").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select("file_no", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    placed = index.join(starts, "file_no").withColumn("start", F.col("start_in_file") + F.col("_from"))
    slim = placed.select("doc_id", "start", "file", "offset", "bytes").sortWithinPartitions("file", "offset")
    return slim.mapInArrow(_reader(f"{folder}/data", width), "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(folder: str, rows: list, width: int = 2) -> list[np.ndarray]:
    """Ids of some records, in any order, by their index rows; for shuffled reading on one machine."""
    store, root = _store(f"{folder}/data")
    out = []
    for r in rows:
        with store.open_input_file(f"{root}/{r['file']}") as f:
            data, starts, ends = unframe(f.read_at(r["bytes"], r["offset"]), np.array([0]))
            out.append(data[starts[0] : ends[0]].view(f"<u{width}").astype(np.uint32))
    return out
