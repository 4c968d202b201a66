"""Alignment of two tokenizers: groups of tokens that cover the same bytes, and how often ids are linked.

Both tokenizers restart at a single space between two other characters: the
byte-level one splits there by its pattern, and no piece of the other one
holds a space after another character (checked when it is loaded).  So a text
is cut there, and what a piece between cuts gives is remembered.  In a piece,
two pointers go along the cumulative ends of both token lists; where they
meet, a group ends.

One pass over the texts writes each document's digest and its distinct pairs
of ids.  Spark counts the documents of each pair, finds the highest count of
each id of either side, and joins both back to the documents' pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .textops import FORGET, batches, distinct_counts, stored
from .tokenizing import _byte_letters

MOST_PAIRS = 1_000_000  # of the broadcast table: some 60 MB in each executor
MOST_REMEMBERED = 120_000  # pieces of either of two generations that a worker remembers, of LONG_PIECE characters at most: some 50 MB
JOINED = 2048  # pieces that are encoded together
MOST_LISTED = 4096  # links of a group that are listed one by one; those of larger groups are counted by their ids
LONG_PIECE = 64  # characters; longer ones aren't remembered
SHIFT = 32  # a pair of ids is one number: a << SHIFT | b
_CUT = re.compile(r"(?<=\S) (?=\S)")
_LOADED: dict[tuple[str, str], Tokenizers] = {}


def merge_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index in a, index in b) of the tokens that end a group: two pointers over the cumulative ends of tokens of the same bytes.

    Each end of one list is looked for where the pointer of the other stands then, all at once.
    """
    at = np.searchsorted(ends_b, ends_a)
    met = np.flatnonzero(ends_b[at] == ends_a)
    return met, at[met]


FORGET.append(_LOADED.clear)


class Tokenizers:
    """Both tokenizers, and the bytes of each of their ids."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        letters = {x: k for k, x in enumerate(_byte_letters())}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(letters[x] for x in token) if all(x in letters for x in token) else token.encode()
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.sizes_a, self.sizes_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        self.shown = [f"{i}{end}" for i in range(max(len(self.bytes_a), len(self.bytes_b))) for end in ",|;"]
        if any("▁" in x.lstrip("▁") for x in names):
            raise ValueError("a piece of the second tokenizer goes on after a space: texts can't be cut there")

    def ids(self, pieces: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of space + piece by either tokenizer; the second puts the space itself."""
        encoded = self.a.encode_batch_fast([" " + x for x in pieces], add_special_tokens=False)
        return [x.ids for x in encoded], self.b.encode(pieces, num_threads=1)


def tokenizers_of(path_a: str, path_b: str) -> Tokenizers:
    """A Python worker keeps them from one batch to the next."""
    if (path_a, path_b) not in _LOADED:
        _LOADED[path_a, path_b] = Tokenizers(path_a, path_b)
    return _LOADED[path_a, path_b]


#: What a piece gives: (its groups, each with a ; at its end; n_a, n_b, n_groups and n_links as packed int32; its linked pairs as packed
#: int64, each occurrence; None, or packed int64 that tell how often each of these is linked).
Piece = tuple[str, bytes, bytes, bytes | None]


def _flat(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(lists), np.int64, sum(map(len, lists)))


def _large(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, links) of a group of many tokens: its distinct pairs, and how often each is linked."""
    (x, n), (y, m) = distinct_counts(a), distinct_counts(b)
    return (x[:, None] << SHIFT | y).ravel(), (n[:, None] * m).ravel()


def aligned(own: Tokenizers, pieces: list[str]) -> list[Piece | None]:
    """The groups of each piece; None where the bytes of either side aren't those of space + piece.

    Pieces that neither begin nor end with white space are encoded together,
    with a space between them, as neither tokenizer joins across it.
    """
    inner = [not (x[0].isspace() or x[-1].isspace()) for x in pieces]
    together, alone = [x for x, fine in zip(pieces, inner, strict=True) if fine], [x for x, fine in zip(pieces, inner, strict=True) if not fine]
    chunks = [together[lo : lo + JOINED] for lo in range(0, len(together), JOINED)]
    found = _given_back(own, chunks)
    if found is None:
        alone, chunks, found, inner = pieces, [], [], [False] * len(pieces)
    single = []
    for x in alone:
        one = _given_back(own, [[x]])
        single.append(None if one is None else one[0])
    found, single = iter(found), iter(single)
    return [next(found if fine else single) for fine in inner]


def _given_back(own: Tokenizers, chunks: list[list[str]]) -> list[Piece] | None:
    """The groups of all pieces of the chunks; None where a chunk isn't given back by both tokenizers."""
    if not chunks:
        return []
    ids_a, ids_b = own.ids([" ".join(x) for x in chunks])
    whole = [(" " + x).encode("utf-8", "surrogatepass") for x in chain.from_iterable(chunks)]
    joined = b"".join(whole)
    if any(b"".join(map(table.__getitem__, chain.from_iterable(ids))) != joined for table, ids in ((own.bytes_a, ids_a), (own.bytes_b, ids_b))):
        return None
    a, b = _flat(ids_a), _flat(ids_b)
    ends_a, ends_b, size = np.cumsum(own.sizes_a[a]), np.cumsum(own.sizes_b[b]), np.cumsum(list(map(len, whole)))
    last_a, last_b = merge_ends(ends_a, ends_b)
    first_group = np.append(0, np.searchsorted(ends_a[last_a], size, "right"))
    if not np.array_equal(ends_a[last_a[first_group[1:] - 1]], size):
        return None
    from_a, from_b = np.append(0, last_a[:-1] + 1), np.append(0, last_b[:-1] + 1)
    n_a, n_b = last_a + 1 - from_a, last_b + 1 - from_b
    first_a, first_b = np.append(from_a, len(a))[first_group], np.append(from_b, len(b))[first_group]
    # each A token of a group meets all B tokens of it; large groups are left out and added below
    listed = n_a * n_b <= MOST_LISTED
    group = np.repeat(np.arange(len(n_a)), n_a)
    meets = np.where(listed, n_b, 0)[group]
    upto = np.cumsum(meets)
    at_a = np.repeat(np.arange(len(a)), meets)
    at_b = np.repeat(from_b[group] - (upto - meets), meets) + np.arange(len(at_a))
    raw = (a[at_a] << SHIFT | b[at_b]).tobytes()
    first_pair = (np.append(0, upto)[first_a] * 8).tolist()
    n_links = np.append(0, np.cumsum(n_a * n_b))[first_group]
    sizes = np.stack([np.diff(first_a), np.diff(first_b), np.diff(first_group), np.diff(n_links)], axis=1).astype(np.int32).tobytes()
    # the tokens of a group lie next to each other, each with what follows it: a comma, a bar after the last of A, a semicolon after the last of B
    order = np.empty(len(a) + len(b), np.int64)
    follow_a, follow_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    follow_a[last_a], follow_b[last_b] = 1, 2
    order[np.arange(len(a)) + from_b[group]] = a * 3 + follow_a
    order[np.arange(len(b)) + np.repeat(last_a + 1, n_b)] = b * 3 + follow_b
    shown, first_shown = list(map(own.shown.__getitem__, order.tolist())), (first_a + first_b).tolist()
    texts = ["".join(shown[g:h]) for g, h in zip(first_shown, first_shown[1:], strict=False)]
    out = list(zip(texts, [sizes[k : k + 16] for k in range(0, len(sizes), 16)], [raw[p:q] for p, q in zip(first_pair, first_pair[1:], strict=False)], [None] * len(texts), strict=True))
    for g in np.flatnonzero(~listed):
        i = int(np.searchsorted(first_group, g, "right")) - 1
        pairs, links = _large(a[from_a[g] : last_a[g] + 1], b[from_b[g] : last_b[g] + 1])
        text, held, had, often = out[i]
        out[i] = text, held, had + pairs.tobytes(), (often or np.ones(len(had) // 8, np.int64).tobytes()) + links.tobytes()
    return out


class Memory:
    """What pieces gave, in two generations: when the young one is full it becomes the old one, which is dropped."""

    def __init__(self, own: Tokenizers):
        self.own = own
        self.young: dict[str, Piece | None] = {}
        self.old: dict[str, Piece | None] = {}

    def of(self, pieces: set[str]) -> dict[str, Piece | None]:
        """The groups of each piece; None of those that a tokenizer doesn't give back."""
        young, old = self.young, self.old
        found = {x: young[x] for x in pieces & young.keys()}
        rest = pieces - found.keys()
        again = {x: old[x] for x in rest & old.keys()}
        fresh = list(rest - again.keys())
        made = dict(zip(fresh, aligned(self.own, fresh), strict=True))
        if len(young) + len(again) + len(made) > MOST_REMEMBERED:
            self.old, self.young = young, {}
        self.young.update(again)
        self.young.update((x, value) for x, value in made.items() if len(x) <= LONG_PIECE)
        return found | again | made


def documents_of(own: Tokenizers, memory: Memory, texts: list) -> Iterator[list[Piece]]:
    """The pieces of each text; none of texts that are null, empty or not given back by both tokenizers."""
    for begin, end in batches(texts, 1 << 20):
        cut = [_CUT.split(x) if x else [] for x in texts[begin:end]]
        known = memory.of(set().union(*cut))
        lost = {x for x, value in known.items() if value is None}
        for text, pieces in zip(texts[begin:end], cut, strict=True):
            if lost.isdisjoint(pieces):
                yield list(map(known.__getitem__, pieces))
            else:
                # the pieces' bytes might differ and those of the whole be the same
                yield [x for x in aligned(own, [text]) if x is not None]


def _texts(frame: pd.DataFrame) -> list:
    return [x if isinstance(x, str) else None for x in frame["text"]]


DIGEST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
NAMES = [x.split()[0] for x in DIGEST.split(", ")]


def _numbers(column: pd.Series) -> list:
    return [None if pd.isna(x) else int(x) for x in column]


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    made = pd.DataFrame(rows, columns=columns)
    made["doc_id"] = made["doc_id"].astype("Int64")
    return made


def _pairs(pieces: list[Piece]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of a document, and how often it links each."""
    _, _, pairs, often = zip(*pieces, strict=True) if pieces else ((), (), (), ())
    flat = np.frombuffer(b"".join(pairs), np.int64)
    if set(often) <= {None}:
        return distinct_counts(flat)
    each = np.concatenate([np.frombuffer(y, np.int64) if y else np.ones(len(x) // 8, np.int64) for x, y in zip(pairs, often, strict=True)])
    kept, at = np.unique(flat, return_inverse=True)
    links = np.zeros(len(kept), np.int64)
    np.add.at(links, at, each)
    return kept, links


def _digest(pieces: list[Piece]) -> tuple:
    """(n_a, n_b, n_groups, n_links, digest of the groups) of a document."""
    if not pieces:
        return 0, 0, 0, 0, ""
    sizes = np.frombuffer(b"".join([x[1] for x in pieces]), np.int32).reshape(-1, 4).sum(axis=0, dtype=np.int64).tolist()
    return *sizes, sha256("".join([x[0] for x in pieces])[:-1].encode()).hexdigest()


def linked(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The digest columns of each document with its distinct pairs: (doc_id, ..., a, b, links), the last three arrays of equal length."""

    def work(stream):
        own = tokenizers_of(path_a, path_b)
        memory = Memory(own)
        for frame in stream:
            out, held = [], 0
            for doc_id, pieces in zip(_numbers(frame["doc_id"]), documents_of(own, memory, _texts(frame)), strict=True):
                pairs, links = _pairs(pieces)
                out.append((doc_id, *_digest(pieces), (pairs >> SHIFT).astype(np.int32), (pairs & ((1 << SHIFT) - 1)).astype(np.int32), links))
                held += len(pairs)
                if held > 500_000:
                    yield _frame(out, [*NAMES, "a", "b", "links"])
                    out, held = [], 0
            if out:
                yield _frame(out, [*NAMES, "a", "b", "links"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(work, DIGEST + ", a array<int>, b array<int>, links array<long>")


def pair_counts(found: DataFrame) -> DataFrame:
    """(a, b, n, most_a, most_b): how many documents link a pair of ids, and the highest such counts of its A id and of its B id; found: as linked() gives it.

    An id has no more pairs than the other side has ids, which bounds the rows of a window.
    """
    counts = found.select(F.inline(F.arrays_zip("a", "b"))).groupBy("a", "b").agg(F.count("*").alias("n"))
    most = lambda side: F.max("n").over(Window.partitionBy(side))
    return counts.withColumn("most_b", most("b")).withColumn("most_a", most("a"))


def align(docs: DataFrame, path_a: str, path_b: str, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, n_best_b, count_sum) of each document.

    path_a: a byte-level tokenizer file, which encodes space + text; path_b: a
    sentencepiece model, which puts the space itself.  Special tokens' strings
    are plain text.  n_best are the links whose count is the highest of their
    A id, n_best_b of their B id, ties included; count_sum adds up the counts
    of all links.  Null and empty texts and those that a tokenizer doesn't
    give back have zeros and the digest ''.  Repeated rows count each by
    itself, null ids stay null, other columns are ignored, an empty table
    gives no rows.  A text is one row of one task, which holds the text's
    tokens and links.  Counts are broadcast if there are `most_pairs` pairs at
    most, and joined by shuffle beyond.
    """
    found = stored(linked(docs, path_a, path_b).withColumn("row", F.monotonically_increasing_id()), "linked")
    counts = stored(pair_counts(found), "pair-counts")
    few = counts.limit(most_pairs + 1).count() <= most_pairs
    each = found.select("row", F.inline(F.arrays_zip("a", "b", "links"))).join(F.broadcast(counts) if few else counts, ["a", "b"])
    best = lambda most: F.sum(F.when(F.col("n") == F.col(most), F.col("links")).otherwise(0))
    sums = each.groupBy("row").agg(best("most_a").alias("n_best"), best("most_b").alias("n_best_b"), F.sum(F.col("n") * F.col("links")).alias("count_sum"))
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long").alias(x)
    return found.select("row", *NAMES).join(sums, "row", "left").select(*NAMES, zero("n_best"), zero("n_best_b"), zero("count_sum"))


def alignment_groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, group, a_ids, b_ids): the groups themselves, numbered from 0 in each document."""

    def work(stream):
        own = tokenizers_of(path_a, path_b)
        memory = Memory(own)
        for frame in stream:
            for doc_id, pieces in zip(_numbers(frame["doc_id"]), documents_of(own, memory, _texts(frame)), strict=True):
                sides = [x.split("|") for x in "".join([x[0] for x in pieces])[:-1].split(";")] if pieces else []
                yield _frame([(doc_id, k, *([int(y) for y in x.split(",")] for x in pair)) for k, pair in enumerate(sides)], ["doc_id", "group", "a_ids", "b_ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(work, "doc_id long, group long, a_ids array<long>, b_ids array<long>")
