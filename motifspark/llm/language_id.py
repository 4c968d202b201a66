"""Language identification with a string kernel.

The blended-spectrum presence kernel of two texts is the number of distinct
byte n-grams (n = 1..3, A-Z lower-cased) that both hold, over the root of the
product of how many each holds.  Some training texts are landmarks; kernel
values with them, times the inverse root of the landmarks' own kernel matrix,
are the Nystroem features, and one-versus-rest kernel ridge regression is a
linear solve over them.  Texts are scored in batches by matrix products:
presence by landmark incidence, then by landmark by language weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import crc_column, distinct, free_name, lower_bytes, stored

_PLACES: dict[int, np.ndarray] = {}


def ngrams(text: bytes, most: int = 3) -> np.ndarray:
    """The distinct n-grams of 1..most bytes as numbers; lengths don't mix."""
    data = np.frombuffer(text, np.uint8).astype(np.uint32)
    parts, first = [], 0
    for n in range(1, most + 1):
        if len(data) < n:
            break
        code = np.zeros(len(data) - n + 1, np.uint32)
        for k in range(n):
            code = (code << np.uint32(8)) | data[k : k + len(code)]
        parts.append(code + np.uint32(first))
        first += 256**n
    return distinct(np.concatenate(parts)) if parts else np.zeros(0, np.uint32)


@dataclass
class LanguageModel:
    langs: list[str]
    grams: np.ndarray  # sorted n-grams of the landmarks: the columns
    incidence: np.ndarray  # column by landmark, each landmark divided by its norm
    mapping: np.ndarray  # inverse root of the landmarks' kernel matrix
    weights: np.ndarray  # Nystroem feature by language
    stamp: int

    def features(self, texts: list[bytes]) -> np.ndarray:
        """Nystroem features of a batch of texts."""
        table = _PLACES.get(self.stamp)
        if table is None:
            _PLACES.clear()
            table = _PLACES[self.stamp] = np.full(256 + 256**2 + 256**3, -1, np.int32)
            table[self.grams] = np.arange(len(self.grams), dtype=np.int32)
        out = np.zeros((len(texts), self.incidence.shape[1]), np.float32)
        for a in range(0, len(texts), 256):
            part = texts[a : a + 256]
            present = np.zeros((len(part), len(self.grams)), np.float32)
            for k, text in enumerate(part):
                own = ngrams(text)
                if len(own):
                    at = table[own]
                    present[k, at[at >= 0]] = 1 / np.sqrt(len(own))
            out[a : a + len(part)] = present @ self.incidence
        return out @ self.mapping


def _with_landmarks(texts: list[bytes], langs: list[str], stamp: int) -> LanguageModel:
    sets = [ngrams(x) for x in texts]
    grams = np.unique(np.concatenate(sets))
    incidence = np.zeros((len(grams), len(sets)), np.float32)
    for k, own in enumerate(sets):
        incidence[np.searchsorted(grams, own), k] = 1 / np.sqrt(len(own))
    values, vectors = np.linalg.eigh((incidence.T @ incidence).astype(np.float64))
    used = values > 1e-6
    mapping = (vectors[:, used] / np.sqrt(values[used])).astype(np.float32)
    return LanguageModel(langs, grams, incidence, mapping, np.zeros((mapping.shape[1], len(langs)), np.float32), stamp)


def fit_languages(docs: DataFrame, modulus: int = 4, held_out: int = 2, most_rows: int = 8_000, landmarks: int = 160, ridge: float = 1e-3) -> LanguageModel | None:
    """Fits the model to at most `most_rows` texts of a known language, those of the smallest hashes; equal rows count once.

    Rows with crc32(doc_id as text) mod `modulus` equal to `held_out`, null or
    empty texts and null languages teach nothing.  Landmarks are shared out
    evenly among the languages.  None without any rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    known = rows.filter("doc_id IS NOT NULL AND lang IS NOT NULL").filter(crc_column("doc_id", modulus) != held_out)
    mark = free_name("mark", known.columns)
    known = known.filter("length(text) > 0").withColumn(mark, F.xxhash64("lang", "text"))
    ids = known.select("doc_id", mark).orderBy(F.xxhash64("doc_id"), "doc_id", mark).limit(most_rows).distinct()
    sample = stored(known.join(F.broadcast(ids), ["doc_id", mark]).dropDuplicates(["doc_id", mark]), "language-sample")
    langs = sorted(r[0] for r in sample.select("lang").distinct().collect())
    if not langs:
        return None
    each = -(-landmarks // len(langs))
    chosen = []
    for lang in langs:
        chosen += sample.filter(F.col("lang") == lang).orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id", mark).limit(each).select("text").collect()
    model = _with_landmarks([lower_bytes(r.text) for r in chosen], langs, hash(tuple(r.text for r in chosen)) & 0x7FFFFFFF)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    size = model.mapping.shape[1]

    def equations(stream):
        own = shared.value
        total = np.zeros((size, size + len(langs)))
        for batch in stream:
            x = own.features([lower_bytes(t) for t in batch.column("text").to_pylist()]).astype(np.float64)
            y = np.array([[lang == k for k in own.langs] for lang in batch.column("lang").to_pylist()], np.float64).reshape(-1, len(langs))
            total += x.T @ np.hstack([x, y])
        yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tobytes()], pa.binary())})

    parts = sample.select("text", "lang").repartition(12).mapInArrow(equations, "sums binary").collect()
    total = np.sum([np.frombuffer(p.sums, np.float64).reshape(size, -1) for p in parts], axis=0)
    model.weights = np.linalg.solve(total[:, :size] + ridge * np.trace(total[:, :size]) / size * np.eye(size), total[:, size:]).astype(np.float32)
    return model


def identify(docs: DataFrame, model: LanguageModel | None, modulus: int = 4, held_out: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row; only the whole text is looked at.

    The score is the winning language's regression value, cut to 0..1; of
    equal values the first language in alphabetical order wins.  A text
    that is null or has no letter is `und` with score 0, as is any text
    without a model.  Repeated rows are judged each by itself.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(stream):
        own = shared.value
        for batch in stream:
            texts = batch.column("text").to_pylist()
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            at = [k for k, x in enumerate(texts) if x and own is not None and any(map(str.isalpha, x))]
            for a in range(0, len(at), 1024):
                part = at[a : a + 1024]
                values = own.features([lower_bytes(texts[k]) for k in part]) @ own.weights
                for k, best, top in zip(part, values.argmax(1).tolist(), values.max(1).tolist(), strict=True):
                    langs[k], scores[k] = own.langs[best], min(max(float(top), 0.0), 1.0)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())})

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", (crc_column("doc_id", modulus) == held_out).alias("held_out"), "lang_pred", "score")
