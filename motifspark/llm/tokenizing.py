"""Exact token ids and counts of whole texts.

Pieces: the tokenizer drops white space and never joins what it separates, so
the pieces between spaces are encoded by themselves and remembered; a piece of
letters with punctuation around it goes to the library's model directly, any
other piece through the whole library.

Huge documents are encoded in overlapping chunks by the library, with offsets.
Two neighbours are spliced at a token boundary of both that follows white
space; if their overlap has none, it is widened and the chunk encoded again.
"""

from __future__ import annotations

import re
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import FORGET

#: Letters that the normaliser leaves alone or lower-cases one to one, with ASCII punctuation on both sides.
_PLAIN = re.compile(r"([!-&(-/:;=-@\[-`{-~]*)([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:;=-@\[-`{-~]*)")
MOST_PIECES = 200_000  # some 30 MB a worker
_LOADED: dict[str, Encoder] = {}


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself if printable, else one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Encoder:
    """Encodes texts with a tokenizer file; what it remembers is bounded and never changes a result."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.pieces: dict[str, bytes] = {"": b""}
        self.parts: dict[str, bytes] = {"": b""}

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            if len(self.parts) > MOST_PIECES:
                self.parts = {"": b""}
            word = part if part.isascii() else "".join([self.letters[b] for b in part.encode()])
            found = self.parts[part] = array("I", [t.id for t in self.model.tokenize(word)]).tobytes()
        return found

    def _piece(self, piece: str) -> bytes:
        if len(piece) <= 64 and (plain := _PLAIN.fullmatch(piece)):
            return self._part(plain[1]) + self._part(plain[2].lower()) + self._part(plain[3])
        return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str | None) -> bytes:
        """The ids as packed unsigned 32-bit numbers."""
        pieces = (text or "").replace("\n", " ").split(" ")
        try:
            return b"".join(map(self.pieces.__getitem__, pieces))
        except KeyError:
            pass
        known, fresh = self.pieces, {}
        for p in pieces:
            if p not in known and p not in fresh:
                fresh[p] = self._piece(p)
        if len(known) + len(fresh) > MOST_PIECES:
            self.pieces = known = {p: known.get(p) or fresh.get(p, b"") for p in pieces}
        known.update((p, x) for p, x in fresh.items() if len(p) <= 64)
        return b"".join([known[p] if p in known else fresh[p] for p in pieces])

    def boundaries(self, text: str) -> list[int]:
        """Where each token of the text begins, by the library."""
        return [a for a, _ in self.tokenizer.encode(text, add_special_tokens=False).offsets]


def encoder(path: str) -> Encoder:
    """The encoder of a file; a Python worker keeps it from one batch to the next."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


FORGET.append(_LOADED.clear)


def spliced_count(text: str, boundaries, chunk: int, overlap: int) -> tuple[int, int]:
    """(tokens, widenings) of a huge text from overlapping chunks.

    boundaries(part) gives where a part's tokens begin.  A place is a proven
    boundary if white space comes just before it: no token and no merge of the
    tokenizer crosses white space, so what is before and after don't depend on
    each other.  Both chunks must begin a token there.
    """
    total = widened = 0
    begin, at = 0, 0  # the chunk's first character; the first that isn't counted yet
    end = min(len(text), chunk)
    starts = boundaries(text[begin:end])
    while end < len(text):
        reach = overlap
        while True:
            next_begin = max(at, end - reach)
            next_end = min(len(text), next_begin + max(chunk, 2 * reach))
            next_starts = boundaries(text[next_begin:next_end])
            stable = {next_begin + k for k in next_starts if k and text[next_begin + k - 1].isspace()}
            common = sorted(p for p in (begin + k for k in starts) if p > at and p in stable)
            if common:
                cut = common[len(common) // 2]
                break
            widened += 1
            if next_begin > at:
                reach *= 2
                continue
            end = min(len(text), end + (end - begin))  # the overlap already is all that isn't counted: a longer chunk
            starts = boundaries(text[begin:end])
            if end == len(text):
                return total + sum(begin + k >= at for k in starts), widened
        total += sum(at <= begin + k < cut for k in starts)
        at, begin, end, starts = cut, next_begin, next_end, next_starts
    return total + sum(begin + k >= at for k in starts), widened


def token_counts(docs: DataFrame, path: str, limit: int = 2048, huge: int = 1 << 15, overlap: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, n_widened) for each whole text; a null text counts as the empty one.

    Texts of more than `huge` characters are encoded in overlapping chunks of
    that size, so a task's memory doesn't grow with a text's tokens.  Strings
    of special tokens inside texts are handled as the library does by default.
    Repeated rows are counted each by itself; other columns are ignored.
    """

    def work(stream):
        own = encoder(path)
        for batch in stream:
            texts, counts, widened = batch.column("text").to_pylist(), [], []
            for text in texts:
                n, w = (len(own.ids(text)) // 4, 0) if text is None or len(text) <= huge else spliced_count(text, own.boundaries, huge, overlap)
                counts.append(n)
                widened.append(w)
            sizes = [0 if x is None else len(x.encode("utf-8", "surrogatepass")) for x in texts]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": pa.array(sizes, pa.int64()), "n_tokens": pa.array(counts, pa.int64()), "n_widened": pa.array(widened, pa.int64())})

    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, n_bytes long, n_tokens long, n_widened long")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_widened")
