"""Compact binary forms of integer arrays, word lists and row batches inside a shuffled row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard


def pack_ints(values: np.ndarray, level: int = 3) -> bytes:
    """Unsigned integers as compressed byte planes: high bytes are mostly zero and vanish. One plane is copied at a time."""
    if not len(values):
        return b""
    by_byte = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1)
    squeeze = zstandard.ZstdCompressor(level=level).compressobj()
    return b"".join([squeeze.compress(np.ascontiguousarray(by_byte[:, k])) for k in range(by_byte.shape[1])] + [squeeze.flush()])


def unpack_ints(packed: bytes, kind=np.uint32) -> np.ndarray:
    if not packed:
        return np.empty(0, kind)
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompressobj().decompress(packed), np.uint8).reshape(width, -1)
    out = np.empty((planes.shape[1], width), np.uint8)
    for k in range(width):
        out[:, k] = planes[k]
    return out.reshape(-1).view(kind)


def pack_batch(batch: pa.RecordBatch) -> bytes:
    """Any columns of a few rows, as a compressed Arrow stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 5))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack_batch(packed: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(packed).read_next_batch()


def pack_words(words: list[bytes]) -> bytes:
    return pack_batch(pa.RecordBatch.from_arrays([pa.array(words, pa.binary())], names=["w"]))


def unpack_words(packed: bytes) -> pa.Array:
    return unpack_batch(packed).column(0)


def grouped(keys: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of the runs of equal values in sorted ``keys``."""
    if not len(keys):
        return []
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]))


class Index(dict):
    """Numbers new items 0, 1, ... as they are first looked up."""

    def __missing__(self, item):
        n = self[item] = len(self)
        return n
