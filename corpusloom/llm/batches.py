"""Arrow batches of texts as flat byte arrays, cut into pieces of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa

PIECE_BYTES = 4 << 20
# A worker's memory goes back to the system as soon as a batch is done with: Arrow takes it from the C library, which
# maps every large piece by itself (M_MMAP_THRESHOLD, where the library has it) in place of keeping it for later.
pa.set_memory_pool(pa.system_memory_pool())
if hasattr(ctypes.CDLL(None), "mallopt"):
    ctypes.CDLL(None).mallopt(-3, 1 << 18)


# How many blocks of ``reused_memory`` a worker is in.
_inside = [0]


@contextmanager
def reused_memory():
    """Inside, freed memory is kept for the next arrays: with many arrays of some MB, one after the other, mapping each anew costs more than the work on it.

    At the end of the outermost block it goes back to the system.
    """
    library = ctypes.CDLL(None)
    if _inside[0] or not (hasattr(library, "mallopt") and hasattr(library, "malloc_trim")):
        yield
        return
    _inside[0] += 1
    # M_MMAP_THRESHOLD at its largest, and M_TRIM_THRESHOLD.
    library.mallopt(-3, 32 << 20)
    library.mallopt(-1, 256 << 20)
    try:
        yield
    finally:
        _inside[0] -= 1
        library.mallopt(-3, 1 << 18)
        library.mallopt(-1, 1 << 17)
        library.malloc_trim(ctypes.c_size_t(0))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the offsets of each; a null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text; a longer text is a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = flat(column(batch, text))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for every range, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    out += np.arange(total)
    return out


def words8(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number; ``data`` is padded with zeros at its end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded.tobytes(), strides=(1,))
