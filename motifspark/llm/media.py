"""The media column: texts as payloads of lossless WebP images, stored, read back and described."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .webp_lanes import read_payloads, store_payloads


def feature(samples: np.ndarray) -> str:
    """A short text about an image: size, mean of each channel, entropy of all samples and mean step along a row."""
    counts = np.bincount(samples.ravel(), minlength=256)
    share = counts[counts > 0] / samples.size
    means = samples.reshape(-1, 3).mean(0, dtype=np.float64)
    step = np.abs(np.diff(samples.astype(np.int16), axis=1)).mean()
    return f"{samples.shape[1]}x{samples.shape[0]};mean={means[0]:.3f},{means[1]:.3f},{means[2]:.3f};entropy={-(share * np.log2(share)).sum():.4f};step={step:.3f}"


def media_column(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, filled up with spaces to a multiple of 192, as WebP files.

    Null and empty texts are 192 spaces.  Repeated rows are stored each by
    itself, equal texts alike.  Other columns are ignored.
    """

    def work(stream):
        for batch in stream:
            sizes, payloads = [], []
            for text in batch.column("text").to_pylist():
                data = (text or "").encode("utf-8", "surrogatepass")
                sizes.append(len(data))
                payloads.append(data + b" " * (max(192, -(-len(data) // 192) * 192) - len(data)))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": pa.array(sizes, pa.int64()), "media": pa.array(store_payloads(payloads), pa.binary())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, n_bytes long, media binary")


def media_pixels(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, height, width, samples): the stored files decoded to 8-bit red, green, blue samples; a null stays null."""

    def work(stream):
        for batch in stream:
            media = batch.column("media").to_pylist()
            read = iter(read_payloads([x for x in media if x is not None]))
            found = [None if x is None else next(read) for x in media]
            size = lambda k: pa.array([None if x is None else x.shape[k] for x in found], pa.int32())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"), "height": size(0), "width": size(1), "samples": pa.array([None if x is None else x.tobytes() for x in found], pa.binary())})

    return media.select("doc_id", "n_bytes", "media").mapInArrow(work, "doc_id long, n_bytes long, height int, width int, samples binary")


def media_digest(docs: DataFrame) -> DataFrame:
    """What the media column holds, by text: sizes, checksums of the samples read back and of the stored form, and a feature.

    Null texts count as empty ones; equal texts have equal values, and repeated rows are each a row.
    """

    def work(stream):
        for batch in stream:
            rows = []
            stored = batch.column("media").to_pylist()
            for media, samples in zip(stored, read_payloads(stored), strict=True):
                payload = samples.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
            names = (("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes")} | {n: pa.array([r[k] for r in rows], kind) for k, (n, kind) in enumerate(names)})

    return media_column(docs).mapInArrow(work, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
