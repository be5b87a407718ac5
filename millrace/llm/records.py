"""Token-ID output: length-delimited binary records with masked checksums, and a separate offset index.

Data file: records one after another, each
    length (uint64) | masked CRC-32 of those 8 bytes (uint32) | payload | masked CRC-32 of the payload (uint32)
all little-endian; a checksum c is stored as ((c >> 15 | c << 17) + MASK) mod 2**32, so that files which hold files
don't hold their own checksums. Payload: flags (uint8; 1: the document has no id, 2: ids take two bytes instead of
four) | doc_id (int64) | ids. Index file, beside it: for each record doc_id (int64), flags (uint64), offset of the
record (uint64), number of ids before it in this file (uint64), its number of ids (uint64). With the index, records
can be read in any order.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import bound_batches, scratch_path, shuffle_partitions, tidy

#: Fixed value of the masked-checksum convention of record files.
MASK = 0xA282EAD8
HEAD, ID = struct.Struct("<QI"), struct.Struct("<Bq")
#: Bytes of text for each task, and of a data file before a task begins another.
TASK_BYTES, FILE_BYTES = 64 << 20, 256 << 20
INDEX = np.dtype([("doc_id", "<i8"), ("flags", "<u8"), ("offset", "<u8"), ("before", "<u8"), ("n", "<u8")])


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes, offset: int = 0) -> tuple[bytes, int]:
    """The payload of the record at offset, and where the next one starts. Raises ValueError on a wrong checksum."""
    if len(data) < offset + HEAD.size:
        raise ValueError(f"record cut short at {offset}")
    length, check = HEAD.unpack_from(data, offset)
    at = offset + HEAD.size
    if check != masked(data[offset : offset + 8]):
        raise ValueError(f"wrong checksum of the length at {offset}")
    payload = data[at : at + length]
    if len(data) < at + length + 4 or masked(payload) != int.from_bytes(data[at + length : at + length + 4], "little"):
        raise ValueError(f"wrong checksum of the record at {offset}")
    return payload, at + length + 4


def serialize(doc_id: int | None, ids: np.ndarray, narrow: bool) -> tuple[bytes, int]:
    flags = (doc_id is None) | 2 * narrow
    return ID.pack(flags, doc_id or 0) + ids.astype("<u2" if narrow else "<u4").tobytes(), flags


def deserialize(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc_id = ID.unpack_from(payload)
    return None if flags & 1 else doc_id, np.frombuffer(payload, "<u2" if flags & 2 else "<u4", offset=ID.size).astype("<u4")


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_records(docs: DataFrame, encode: Callable[[pa.Array], list[np.ndarray]], end_id: int, vocabulary: int, path: str | None = None) -> tuple[str, DataFrame]:
    """Writes the ids of every text of docs (doc_id, text) and end_id after each, in ascending doc_id order.

    Documents are dealt by ranges of doc_id, in as many parts as their bytes need; each task streams its range, sorted,
    into data files of some FILE_BYTES and an index file beside each. File names hold the attempt, so a task that runs
    again (lost executor) writes files of its own, and the list of files says which count; it stands as ``files.json``
    in the folder too. Only scalars go to the driver: one row a file. Returns the folder and a DataFrame (file, number
    of all ids before it). A null text counts as empty (the record holds end_id alone); a null doc_id sorts first; rows
    with equal doc_id are ordered by a hash of their text, and so don't all have to be in one task; other columns are
    ignored; an empty table writes no data file.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    path = path or scratch_path(spark, "records")
    narrow = max(vocabulary, end_id + 1) <= 1 << 16

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(path)
        context = TaskContext.get()
        # Order by name is order by doc_id: range, then file of the task.
        stem, files, out = f"part-{context.partitionId():06d}", 0, None
        tail = f"-{context.taskAttemptId()}"

        def close() -> pa.RecordBatch:
            out.close()
            index.close()
            return pa.RecordBatch.from_pydict({"file": [name], "n_tokens": pa.array([before], pa.int64())})

        for batch in tidy(batches):
            for at in range(0, batch.num_rows, 512):
                if out is None:
                    store.create_dir(folder, recursive=True)
                    name, offset, before = f"{stem}-{files:06d}{tail}", 0, 0
                    out, index = (store.open_output_stream(f"{folder}/{name}.{kind}") for kind in ("records", "index"))
                    files += 1
                part = batch.slice(at, 512)
                framed, entries = [], []
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encode(part.column("text")), strict=True):
                    payload, flags = serialize(doc_id, np.append(ids, end_id), narrow)
                    record = frame(payload)
                    entries.append((doc_id or 0, flags, offset, before, len(ids) + 1))
                    offset += len(record)
                    before += len(ids) + 1
                    framed.append(record)
                out.write(b"".join(framed))
                index.write(np.array(entries, INDEX).tobytes())
                if offset >= FILE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(shuffle_partitions(spark), -(-size // TASK_BYTES))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    files = rows.repartitionByRange(n, *order).sortWithinPartitions(*order, "text")
    done = sorted(files.mapInArrow(write, "file string, n_tokens long").collect())  # one row a file
    starts, total = [], 0
    for r in done:
        starts.append((r["file"], total))
        total += r["n_tokens"]
    store, folder = _store(path)
    store.create_dir(folder, recursive=True)
    with store.open_output_stream(f"{folder}/files.json") as f:
        f.write(json.dumps([{"file": name, "start": start} for name, start in starts]).encode())
    return path, spark.createDataFrame(starts, "file string, start long")


def read_records(path: str, files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record, read through the index and checked against it and the checksums."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(path)
        for batch in tidy(batches):
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with store.open_input_file(f"{folder}/{name}.index") as entries, store.open_input_file(f"{folder}/{name}.records") as f:
                    size, n = f.size(), entries.size() // INDEX.itemsize
                    for at in range(0, n, 2000):
                        entries.seek(at * INDEX.itemsize)
                        # One entry more, to know where the last record ends.
                        some = np.frombuffer(entries.read(2001 * INDEX.itemsize), INDEX)
                        end = int(some["offset"][2000]) if len(some) > 2000 else size
                        some = some[:2000]
                        begin = int(some["offset"][0])
                        f.seek(begin)
                        data = f.read(end - begin)
                        ids_of, crcs = [], []
                        for offset, count in zip((some["offset"] - begin).tolist(), some["n"].tolist(), strict=True):
                            doc_id, ids = deserialize(unframe(data, offset)[0])
                            if len(ids) != count:
                                raise ValueError(f"{name}: the index doesn't fit the record at {offset + begin}")
                            ids_of.append(doc_id)
                            crcs.append(zlib.crc32(ids.tobytes()))
                        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids_of, pa.int64()), "start": pa.array(start + some["before"].astype(np.int64)), "n_tokens": pa.array(some["n"].astype(np.int64)), "ids_crc32": pa.array(crcs, pa.int64())})

    n = files.count()
    return files.repartition(max(1, n), "file").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
