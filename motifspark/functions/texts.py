"""Arrow texts of single-byte letters as rows of bytes, and back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def padded(texts: pa.Array) -> np.ndarray:
    """A row of bytes for each text, 0 beyond its end; null is empty; the texts are ASCII."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    sizes = np.diff(ends)
    width = int(sizes.max(initial=0))
    if not width:
        return np.zeros((len(sizes), 0), np.uint8)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    if data.size == len(sizes) * width:  # equally long
        return data.reshape(len(sizes), width).copy()
    out = np.zeros((len(sizes), width), np.uint8)
    out[np.arange(width) < sizes[:, None]] = data
    return out


def texts_of(letters: np.ndarray, inside: np.ndarray | None = None) -> pa.Array:
    """A text for each row, of the letters inside, or of those that aren't 0."""
    inside = letters > 0 if inside is None else inside
    return pa.StringArray.from_buffers(len(letters), pa.py_buffer(ends_of(inside.sum(axis=1))), pa.py_buffer(np.ascontiguousarray(letters[inside])))


def ends_of(sizes: np.ndarray) -> np.ndarray:
    """Arrow's offsets of rows of these sizes."""
    return np.append(0, np.cumsum(sizes)).astype(np.int32)
