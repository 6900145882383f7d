"""Packed chunks of rows, and packed messages between chunks and shards of hash values.

Operators that look up every word or window of a corpus would shuffle a row for each. Instead the rows are
packed once into chunks of some MB of text, written to the shared folder, and a chunk sends each shard of the
hash space one sorted, delta-coded array of its distinct values (3 to 4 bytes a value). A shard answers with
arrays too. Both sides are bounded: a chunk by its size, a shard by the number of shards, which grows with the
corpus. As values are distinct within a chunk, a passage that all documents share costs a shard one
value a chunk, however often it occurs.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm import _words as W
from thicket.llm._store import delete_on_exit, shared_dir, written

U64 = np.uint64
CHUNK_BYTES = 4 << 20
SHARD_BYTES = 16 << 20
_SIZES, _HEAD = struct.Struct("<qq"), struct.Struct("<4sqb")  # of a bundle: arrays and bytes; of each array


def bucketed(chunks: DataFrame, n: int) -> DataFrame:
    """The chunks as a table in the shared folder that is divided by chunk: a join by chunk shuffles what it is joined with alone."""
    spark = chunks.sparkSession
    name = f"thicket_chunks_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    chunks.repartition(n, "chunk").write.bucketBy(n, "chunk").options(path=path, compression="none").saveAsTable(name)
    delete_on_exit(spark, path)
    out = spark.table(name)
    spark.sql(f"drop table {name}")  # of the catalog; its files stay
    return out


def packed_rows(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=5))) as w:
        w.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def chunked(rows: DataFrame, name: str, chunk_bytes: int = CHUNK_BYTES, encode=packed_rows) -> tuple[DataFrame, int]:
    """Packs rows (with a column text) into a written table (chunk, n_bytes, blob), and gives the bytes of all texts. encode: what
    makes the blob of a table of rows; `opened` reads that of packed_rows."""

    def run(batches):
        part, k = TaskContext.get().partitionId(), 0
        held, size = [], 0

        def out():
            nonlocal k, held, size
            blob = encode(pa.Table.from_batches(held))
            row = pa.RecordBatch.from_arrays([pa.array([part << 32 | k], pa.int64()), pa.array([size], pa.int64()), pa.array([blob], pa.binary())], names=["chunk", "n_bytes", "blob"])
            k, held, size = k + 1, [], 0
            return row

        for batch in batches:
            for piece in W.slices(batch, chunk_bytes):
                n = int(W.text_bytes(piece.column("text"))[1][-1])
                if held and size + n > chunk_bytes:
                    yield out()
                held.append(piece)
                size += n
                if size >= chunk_bytes:
                    yield out()
        if held:
            yield out()

    table = written(rows.mapInArrow(run, "chunk bigint, n_bytes bigint, blob binary"), name, "none", {"parquet.block.size": str(16 << 20)})
    return table, table.agg(F.sum("n_bytes").alias("n")).first()["n"] or 0


def opened(blob: bytes) -> pa.RecordBatch:
    table = pa.ipc.open_stream(blob).read_all().combine_chunks()
    return table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], table.schema)


def shards(total_bytes: int) -> int:
    return max(1, -(-total_bytes // SHARD_BYTES))


def shard_of(x: np.ndarray, n: int) -> np.ndarray:
    return ((x >> U64(32)) * U64(n)) >> U64(32)


def places(values: np.ndarray) -> np.ndarray:
    """A stable argsort of unsigned integers. They are sorted with their places in the low bits of one number, which takes a fraction
    of an argsort's time. Where both need more than 64 bits, the values' lowest bits are left out, and an argsort is
    taken only if that leaves values out of order."""
    if not len(values):
        return np.zeros(0, np.int64)
    bits = (len(values) - 1).bit_length()
    cut = max(0, int(values.max()).bit_length() + bits - 64)
    both = ((values.astype(U64, copy=False) >> U64(cut)) << U64(bits)) | np.arange(len(values), dtype=U64)
    both.sort()
    order = (both & U64((1 << bits) - 1)).astype(np.int64)
    if cut:
        sorted_ = values[order]
        if (sorted_[1:] < sorted_[:-1]).any():
            return np.argsort(values, kind="stable")
    return order


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values, sorted; a stable order of all; and which of them, in that order, are the first of their value."""
    order = places(values)
    sorted_ = values[order]
    new = np.ones(len(values), bool)
    np.not_equal(sorted_[1:], sorted_[:-1], out=new[1:])
    return sorted_[new], order, new


def numbered(order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The number of each value's own distinct value, from what `distinct` gave."""
    at = np.empty(len(order), np.int64)
    at[order] = np.cumsum(new) - 1
    return at


def _planes(x: np.ndarray, n: int) -> bytes:
    """The lowest n bytes of unsigned integers, each byte of all of them apart."""
    return b"".join((x >> x.dtype.type(8 * k)).astype(np.uint8).tobytes() for k in range(n))


def _joined(data: bytes | memoryview, n: int, dtype: np.dtype) -> np.ndarray:
    """Unsigned integers from what `_planes` gave of n of them."""
    if not len(data):
        return np.zeros(n, dtype)
    planes = np.frombuffer(data, np.uint8).reshape(-1, n)
    out = planes[0].astype(dtype)
    for k in range(1, len(planes)):
        out |= planes[k].astype(dtype) << dtype.type(8 * k)
    return out


def pack(values: np.ndarray, width: int = 8) -> bytes:
    """Sorted unsigned integers below 2**(8*width): differences, by byte planes, compressed."""
    return len(values).to_bytes(8, "little") + pa.compress(_planes(np.diff(values, prepend=U64(0)), width), "zstd", asbytes=True)


def unpack(data: bytes, width: int = 8) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return np.cumsum(_joined(pa.decompress(data[8:], n * width, "zstd", asbytes=True), n, np.dtype(U64)))


def pack_plain(values: np.ndarray) -> bytes:
    """Any array, by byte planes, compressed."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes(), "zstd", asbytes=True)


def unpack_plain(data: bytes, n: int, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(data, n * size, "zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def cuts(sorted_shards: np.ndarray) -> list[tuple[int, int, int]]:
    """(shard, from, to) of each run."""
    if not len(sorted_shards):
        return []
    at = np.flatnonzero(np.concatenate([[True], sorted_shards[1:] != sorted_shards[:-1]]))
    return list(zip(sorted_shards[at].tolist(), at.tolist(), [*at[1:].tolist(), len(sorted_shards)], strict=True))


def member(sorted_set: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values are in the sorted set."""
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    at = np.searchsorted(sorted_set, values)
    at[at == len(sorted_set)] = 0
    return sorted_set[at] == values


def answered(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """chunks with a column `got`: the answers (shard, data) to each chunk; null without any."""
    lists = answers.groupBy("chunk").agg(F.collect_list(F.struct("shard", "data")).alias("got"))
    return chunks.join(lists, "chunk", "left")


def bundle(*arrays: np.ndarray) -> bytes:
    """Several arrays in one value: for each its type, length and the bytes that its largest value needs, then the byte planes of all, compressed at once."""
    heads, planes = [], []
    for a in arrays:
        x = np.ascontiguousarray(a).view(f"<u{a.dtype.itemsize}")
        n = (int(x.max(initial=0)).bit_length() + 7) // 8
        heads.append(_HEAD.pack(a.dtype.str.encode(), len(x), n))
        planes.append(_planes(x, n))
    data = b"".join(planes)
    return b"".join([_SIZES.pack(len(arrays), len(data)), *heads, pa.compress(data, "zstd", asbytes=True) if data else b""])


def unbundle(data: bytes) -> list[np.ndarray]:
    n_arrays, size = _SIZES.unpack_from(data)
    at = _SIZES.size + n_arrays * _HEAD.size
    planes, done, out = memoryview(pa.decompress(data[at:], size, "zstd", asbytes=True) if size else b""), 0, []
    for k in range(n_arrays):
        kind, n, width = _HEAD.unpack_from(data, _SIZES.size + k * _HEAD.size)
        dtype = np.dtype(kind.rstrip(b"\0").decode())
        out.append(_joined(planes[done : done + n * width], n, np.dtype(f"<u{dtype.itemsize}")).view(dtype))
        done += n * width
    return out
