"""Token sequences as length-delimited binary records, with an offset index.

A record file (``.rec``) is a header (``HEADER``: magic and bytes per id) and
records.  A record is framed as

    length of the payload, u32 | masked crc32 of those 4 bytes, u32
    payload                    | masked crc32 of the payload, u32

all little-endian.  The payload is the document's id (i64, with a flag byte
for null) and its token ids, each of 2 bytes if the vocabulary allows it and
of 4 bytes if not.  A masked checksum is the crc32 rotated right by 15 bits
plus a constant, so that data which hold checksums are as safe as others.  The
index file (``.idx``) beside it has for each record its place (u64), the bytes
of its payload (u32) and the number of its ids (u32), so a shuffled read needs
one seek per record; its last 4 bytes are the masked crc32 of the rest.

Records are in ascending order of the document's id over the files in order
of their names.  Ids are cut into ranges of about equal numbers of rows, each range
is sorted and written by one task, and a file ends at ``FILE_BYTES``.  A task
writes under a name of its own and renames at the end, so an attempt that is
lost or repeated leaves no half-written file under a final name.
"""

from __future__ import annotations

import itertools
import posixpath
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from circula.llm.bpe import TOGETHER, WordTokens
from circula.llm.tables import Staging, together
from circula.llm.workers import free, held
from circula.sources.paths import path_exists

HEADER = struct.Struct("<8sI")
MAGIC = b"TOKREC01"
_FRAME = struct.Struct("<II")
_CRC = struct.Struct("<I")
_DOC = struct.Struct("<?q")
DOC_BYTES = _DOC.size
INDEX = np.dtype([("place", "<u8"), ("bytes", "<u4"), ("ids", "<u4")])
FILE_BYTES = 16 << 20
ROWS_PER_RANGE = 2000
MOST_RANGES = 20_000


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    size = _CRC.pack(len(payload))
    return size + _CRC.pack(masked(size)) + payload + _CRC.pack(masked(payload))


def payload_of(doc_id: int | None, ids: bytes, width: int) -> bytes:
    """``ids`` are unsigned 32-bit integers."""
    body = ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()
    return _DOC.pack(doc_id is not None, doc_id or 0) + body


def read_payload(payload: bytes, width: int) -> tuple[int | None, np.ndarray]:
    there, doc_id = _DOC.unpack_from(payload)
    return (doc_id if there else None), np.frombuffer(payload, f"<u{width}", offset=_DOC.size).astype("<u4")


def _checked(data: bytes, at: int) -> bytes:
    """Payload of the record at a place."""
    size, crc = _FRAME.unpack_from(data, at)
    if masked(data[at:at + 4]) != crc:
        raise ValueError(f"wrong checksum of the length at {at}")
    lo = at + _FRAME.size
    payload = data[lo:lo + size]
    if len(payload) < size or masked(payload) != _CRC.unpack_from(data, lo + size)[0]:
        raise ValueError(f"wrong checksum of the record at {at}")
    return payload


def read_file(data: bytes):
    """(document, ids) of each record of a file's bytes."""
    magic, width = HEADER.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("no record file")
    at = HEADER.size
    while at < len(data):
        payload = _checked(data, at)
        yield read_payload(payload, width)
        at += _FRAME.size + len(payload) + _CRC.size


def read_index(data: bytes) -> np.ndarray:
    if masked(data[:-4]) != _CRC.unpack(data[-4:])[0]:
        raise ValueError("wrong checksum of the index")
    return np.frombuffer(data[:-4], INDEX)


def read_at(path: str, rows) -> list[tuple[int | None, np.ndarray]]:
    """Records of one file by their numbers, in the order asked for, by its index."""
    fs, name = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(name.removesuffix(".rec") + ".idx") as f:
        index = read_index(f.read())
    out = []
    with fs.open_input_file(name) as f:
        width = HEADER.unpack(f.read_at(HEADER.size, 0))[1]
        for i in rows:
            place, size = int(index[i]["place"]), int(index[i]["bytes"])
            data = f.read_at(_FRAME.size + size + _CRC.size, place)
            out.append(read_payload(_checked(data, 0), width))
    return out


class _File:
    def __init__(self, fs, folder: str, name: str, width: int):
        self.fs, self.to = fs, posixpath.join(folder, name)
        self.own = posixpath.join(folder, f"_{name}-{uuid.uuid4().hex}")
        self.out = fs.open_output_stream(self.own)
        self.out.write(HEADER.pack(MAGIC, width))
        self.place, self.rows = HEADER.size, []

    def add(self, payload: bytes, n: int) -> None:
        data = framed(payload)
        self.out.write(data)
        self.rows.append((self.place, len(payload), n))
        self.place += len(data)

    def close(self) -> None:
        self.out.close()
        index = np.array(self.rows, INDEX).tobytes()
        with self.fs.open_output_stream(self.own + ".idx") as f:
            f.write(index + _CRC.pack(masked(index)))
        self.fs.move(self.own + ".idx", self.to + ".idx")
        self.fs.move(self.own, self.to + ".rec")


def write(docs: DataFrame, dest: str, tokenizer: str, end_id: int, vocabulary: int,
          names_to: Staging | None = None) -> list[str] | DataFrame:
    """Write the ids of every row's text and ``end_id`` as records under
    ``dest``, a folder that all executors and the driver share, by a URI or path that
    pyarrow can open (local, s3, gs, hdfs).  Null texts are empty; null ids come
    first; rows of one id come by their ids' bytes.  Returns the files by name: as a table (column name) kept by
    ``names_to``, or without it as a list, which grows with the corpus."""
    width = 2 if vocabulary <= 1 << 16 else 4
    n = docs.count()
    ranges = int(min(max(1, -(-n // ROWS_PER_RANGE)), MOST_RANGES))
    bounds: list[int] = []
    if ranges > 1:
        found = docs.select(F.percentile_approx(F.col("doc_id").cast("long"),
                                                [k / ranges for k in range(1, ranges)],
                                                max(10_000, 10 * ranges)).alias("q")).first()["q"]
        bounds = sorted(set(found or []))
    cuts = np.array(bounds, np.int64)
    mark = uuid.uuid4().hex
    last = end_id.to_bytes(4, "little")

    def encode(batches):
        coder = held(mark, lambda: WordTokens(tokenizer, added=True))
        for b in batches:
            ids = b.column(0).to_pylist()
            at = np.searchsorted(cuts, [i or 0 for i in ids], "right")
            at[[i is None for i in ids]] = 0
            said = itertools.chain.from_iterable(map(coder.all_ids, together(b.column(1).cast(pa.binary()), TOGETHER)))
            body = [payload_of(i, x + last, width) for i, x in zip(ids, said, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), b.column(0), pa.array(body, pa.binary())],
                                             ["range", "doc_id", "payload"])

    def store(batches):
        free()
        fs, folder = pafs.FileSystem.from_uri(dest)
        fs.create_dir(folder, recursive=True)
        file, names, held, number = None, [], None, 0
        for b in batches:
            for k, payload in zip(b.column(0).to_pylist(), b.column(2), strict=True):
                if file is None or k != held or file.place > FILE_BYTES:
                    if file is not None:
                        file.close()
                    number = 0 if k != held else number + 1
                    held = k
                    names.append(f"part-{k:06d}-{number:06d}")
                    file = _File(fs, folder, names[-1], width)
                data = payload.as_py()
                file.add(data, (len(data) - DOC_BYTES) // width)
        if file is not None:
            file.close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["name"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        encode, "range int, doc_id long, payload binary")
    made = (rows.repartitionById(len(bounds) + 1, F.col("range"))
            .sortWithinPartitions("range", "doc_id", "payload").mapInArrow(store, "name string"))
    return names_to.keep(made, "names") if names_to is not None else sorted(r["name"] for r in made.collect())


def read(spark: SparkSession, dest: str) -> DataFrame:
    """file, row, doc_id, start (ids of the file's records before), n_tokens
    and ids_crc32 of every record under ``dest``, in which all checksums are verified."""
    names = ["file", "row", "doc_id", "start", "n_tokens", "ids_crc32"]
    schema = "file string, row long, doc_id long, start long, n_tokens long, ids_crc32 long"
    if not path_exists(spark, dest):  # no rows were written
        return spark.createDataFrame([], schema)

    def run(batches):
        free()
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows, start = [], 0
                for i, (doc, ids) in enumerate(read_file(content.as_py())):
                    rows.append((path, i, doc, start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], pa.string() if k == 0 else pa.int64())
                     for k in range(6)], names)

    files = (spark.read.format("binaryFile").option("pathGlobFilter", "part-*.rec").load(dest)
             .select(F.regexp_extract("path", r"(part-[0-9-]+)\.rec", 1).alias("file"), "content"))
    return files.mapInArrow(run, schema)


def placed(records: DataFrame) -> DataFrame:
    """``read``'s rows with ``start`` counted over all files: ids are summed by
    file, the files of a range are ordered by themselves, and the ranges (``MOST_RANGES`` at most) in one window."""
    files = records.groupBy(F.col("file").alias("_file")).agg(F.sum("n_tokens").alias("_n")).withColumn(
        "_range", F.substring_index("_file", "-", 2))
    earlier = Window.unboundedPreceding, -1
    ranges = files.groupBy(F.col("_range").alias("_r")).agg(F.sum("_n").alias("_all"))
    ranges = ranges.select("_r", F.coalesce(F.sum("_all").over(Window.orderBy("_r").rowsBetween(*earlier)), F.lit(0)).alias("_base"))
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy("_range").orderBy("_file").rowsBetween(*earlier)), F.lit(0))
    base = files.withColumn("_inside", inside).join(ranges, F.col("_range") == F.col("_r")).select(
        "_file", (F.col("_inside") + F.col("_base")).alias("_before"))
    return records.join(base, F.col("file") == F.col("_file")).select(
        "doc_id", (F.col("start") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32")
