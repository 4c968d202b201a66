"""Column functions on sequences of acgt, with n for an unknown base; positions count from 1."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The bases in index order, and IUPAC's codes with their bases and complements.
BASES = "acgt"
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
COMPLEMENT = ("AGCTYRSWMKBDHVN", "TCGARYSWKMVHDBN")


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def disambiguate(seq: Column | str) -> Column:
    """Lower case, with n for anything but acgtn."""
    return F.regexp_replace(F.lower(_col(seq)), "[^acgtn]", "n")


def strip_unknown(seq: Column | str) -> Column:
    return F.regexp_replace(_col(seq), "^n+|n+$", "")


def mutate(seq: Column | str, pos: Column | str, base: Column | str) -> Column:
    """The sequence with one base replaced."""
    return F.overlay(_col(seq), _col(base), _col(pos), F.lit(1))


def reverse_complement(seq: Column | str) -> Column:
    return F.reverse(F.translate(F.upper(_col(seq)), *COMPLEMENT))


def iupac_pattern(motif: str) -> str:
    """A regular expression for a motif of IUPAC codes."""
    return "".join(f"[{IUPAC[x]}]" for x in motif.upper())


def bound(values: dict[str, Column], use: Callable[[Column], Column]) -> Column:
    """use(struct of the values), with each value computed once a row, however often a lambda of `use` names it."""
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), use)[0]


def differing(a: Column | str, b: Column | str) -> Column:
    """The positions at which two sequences differ."""
    places = lambda x: F.filter(F.sequence(F.lit(1), F.greatest(F.length(x["a"]), F.lit(1))), lambda p: F.substring(x["a"], p, F.lit(1)) != F.substring(x["b"], p, F.lit(1)))
    return bound({"a": _col(a), "b": _col(b)}, places)


def hamming(a: Column | str, b: Column | str) -> Column:
    return F.size(differing(a, b)).cast("long")


def single_difference(a: Column | str, b: Column | str) -> Column:
    """The one position at which two sequences differ; null for none or several."""
    where = differing(a, b)
    return F.when(F.size(where) == 1, where[0])


def known_length(seq: Column | str) -> Column:
    """The number of bases that aren't n."""
    return F.length(F.translate(_col(seq), "n", "")).cast("long")


def mask_both(a: Column | str, b: Column | str) -> Column:
    """The first sequence, with n wherever either one has it."""
    letters = lambda x: F.transform(F.sequence(F.lit(1), F.length(x["a"])), lambda p: F.when(F.substring(x["b"], p, F.lit(1)) == "n", F.lit("n")).otherwise(F.substring(x["a"], p, F.lit(1))))
    return F.when(F.length(_col(a)) > 0, F.array_join(bound({"a": _col(a), "b": _col(b)}, letters), "")).otherwise("")


def unknown_share(seq: Column | str) -> Column:
    """The share of unknown bases between the first and the last known one; 0 where there is none."""
    inner = strip_unknown(seq)
    return F.when(F.length(inner) > 0, 1 - known_length(inner) / F.length(inner)).otherwise(0.0)


def filled(seq: Column | str, key: Column | str) -> Column:
    """Inner unknown bases replaced by bases that a digest of the key and the position picks, so a pair of one key gets the same."""
    digit = lambda k, p: F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(F.concat(k, F.lit("-"), p.cast("string"))), 1, 1)) - 1

    def letters(x):
        base = lambda p: F.substring(x["s"], p, F.lit(1))
        first, last = F.length(F.regexp_extract(x["s"], "^n*", 0)), F.length(x["s"]) - F.length(F.regexp_extract(x["s"], "n*$", 0))
        # the ends are bound too: inside the inner lambda they would be searched for at every place
        return bound({"first": first, "last": last}, lambda y: F.transform(F.sequence(F.lit(1), F.length(x["s"])), lambda p: F.when((base(p) == "n") & (p > y["first"]) & (p <= y["last"]), F.substring(F.lit(BASES), digit(x["k"], p) % 4 + 1, F.lit(1))).otherwise(base(p))))

    return F.when(F.length(_col(seq)) > 0, F.array_join(bound({"s": _col(seq), "k": _col(key).cast("string")}, letters), "")).otherwise("")


def cleaned_pair(a: Column | str, b: Column | str, flank: int, key: Column | str) -> Column:
    """A struct (start, end, unknown): both sequences with unknown ends cut off, inner unknown runs cut to `flank`, and inner unknown bases filled alike.

    A base that either one doesn't know is unknown in both; letters beyond
    acgt are unknown.  `unknown` is the share of inner bases that were, which
    callers may bound.  Pairs of different lengths and pairs without a known
    base give null.
    """
    a, b = disambiguate(a), disambiguate(b)

    def of(x):
        masked = bound({"a": mask_both(x["a"], x["b"]), "b": mask_both(x["b"], x["a"])}, lambda y: F.struct(collapse_unknown(strip_unknown(y["a"]), flank).alias("a"), collapse_unknown(strip_unknown(y["b"]), flank).alias("b"), unknown_share(y["a"]).alias("unknown")))
        return bound({"m": masked, "k": x["k"]}, lambda y: F.struct(filled(y["m"]["a"], y["k"]).alias("start"), filled(y["m"]["b"], y["k"]).alias("end"), y["m"]["unknown"].alias("unknown")))

    found = bound({"a": a, "b": b, "k": _col(key).cast("string")}, of)
    return F.when((F.length(a) == F.length(b)) & (strip_unknown(mask_both(a, b)) != ""), found)


def collapsed_runs(seq: Column | str, flank: int) -> Column:
    """The inner runs of n longer than `flank`, as structs of start and end (from 0, in the sequence without its unknown ends)."""

    def runs(x):
        at = lambda p: F.substring(x["s"], p, F.lit(1)) == "n"
        n = F.length(x["s"])
        places = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
        begins = F.filter(places, lambda p: at(p) & ~at(p - 1) & (p > 1))
        length = lambda p: F.length(F.regexp_extract(F.substring(x["s"], p, n), "^n*", 0))
        return F.filter(F.transform(begins, lambda p: F.struct((p - 1).alias("start"), (p - 1 + length(p)).alias("end"))), lambda r: r["end"] - r["start"] > flank)

    return bound({"s": strip_unknown(seq)}, runs)


def raw_position(pos: Column, offset: Column, runs: Column, flank: int) -> Column:
    """Where a position of a trimmed, collapsed sequence lies in the sequence as it was; runs: see collapsed_runs().

    pos counts from 0 after the left flank, before which `offset` bases (the
    flank and what was cut off) lie.  It moves by what was cut from each run
    that begins at most a flank after it, in places of the collapsed sequence.
    """

    def add(s, r):
        cut = r["end"] - r["start"] - flank
        moved = F.when(pos > r["start"] - s["cut"] - flank, cut).otherwise(0)
        return F.struct((s["cut"] + cut).alias("cut"), (s["moved"] + moved).alias("moved"))

    return (pos + offset + F.aggregate(runs, F.struct(F.lit(0).alias("cut"), F.lit(0).alias("moved")), add, lambda s: s["moved"])).cast("int")


def trimmed(a: Column | str, b: Column | str, left: int, right: int) -> Column:
    """(start, end) from 0 of what lies between the flanks of a pair: each half is scanned from its outer end for conserved known bases.

    What comes before the first `left` conserved bases of the first half is skipped, so are these; likewise from the end.
    """

    def ends(x):
        # what counts from an outer end to the last stop that has fewer than a flank's bases before it; stops are few, so these steps are too
        stops = differing(F.translate(x["a"], "n", "\x01"), F.translate(x["b"], "n", "\x02"))  # unknown bases differ from all
        return bound({"stops": stops, "n": F.length(x["a"]), "half": F.floor(F.length(x["a"]) / 2).cast("int")}, inner)

    def inner(y):
        first = F.aggregate(F.filter(y["stops"], lambda p: p <= y["half"]), F.lit(0), lambda at, p: F.when(p - at <= left, p).otherwise(at))
        last = F.aggregate(F.reverse(F.filter(y["stops"], lambda p: p > y["half"])), y["n"] + 1, lambda at, p: F.when(at - p <= right, p).otherwise(at))
        return F.struct((first + left).alias("start"), (last - 1 - right).alias("end"))

    return bound({"a": _col(a), "b": _col(b)}, ends)


def productive(seq: Column | str, start: Column | str, invariant: Sequence[int]) -> Column:
    """No stop codon, whole codons only, and the codons at the invariant places (numbered from 0) as at the start."""
    codons = lambda t: F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.length(t) / 3).cast("int") - 1, F.lit(0))), lambda i: F.substring(t, 1 + 3 * i, F.lit(3)))

    def test(x):
        same = F.lit(True)
        for k in invariant:
            same = same & (F.substring(x["s"], 1 + 3 * k, 3) == F.substring(x["g"], 1 + 3 * k, 3))
        return ~F.exists(codons(x["s"]), lambda c: c.isin("taa", "tag", "tga")) & (F.length(x["s"]) % 3 == 0) & same

    return bound({"s": _col(seq), "g": _col(start)}, test)


def codon_start(pos: Column | str) -> Column:
    """Where the codon that holds a position begins, both from 1, in the first reading frame."""
    return (_col(pos) - (_col(pos) - 1) % 3).cast("int")


def parse_positions(text: str) -> list[list[int]]:
    """Places that mutate, by motif length: "0,1:1" is [[0, 1], [1]]."""
    return [[int(x) for x in part.split(",")] for part in text.split(":")]


def positions_of(lengths: Sequence[int], positions: Sequence[Sequence[int]]) -> list[tuple[int, int]]:
    """(motif length, bases before the mutating one) of each block; a place outside its motif is an error."""
    if len(lengths) != len(positions) or any(not 0 <= p < k for k, own in zip(lengths, positions, strict=False) for p in own):
        raise ValueError("places must lie inside their motifs")
    return [(k, p) for k, own in zip(lengths, positions, strict=True) for p in own]


def collapse_unknown(seq: Column | str, flank: int) -> Column:
    """Inner runs of n that are longer than `flank` are cut to `flank`; runs at either end stay."""
    seq = _col(seq)
    inner = F.regexp_replace(strip_unknown(seq), f"n{{{flank + 1},}}", "n" * flank)
    ends = F.regexp_extract(seq, "^n*", 0), F.regexp_extract(seq, "n*$", 0)
    return F.when(strip_unknown(seq) == "", seq).otherwise(F.concat(ends[0], inner, ends[1]))


def motif_index(motif: Column | str) -> Column:
    """The motif as a number of base 4, its first base counting most; null if a base is unknown."""
    motif = _col(motif)
    digits = F.translate(motif, BASES, "0123")
    return F.when(motif.rlike(f"^[{BASES}]+$"), F.conv(digits, 4, 10).cast("long"))


def motif_text(index: Column | str, k: int) -> Column:
    """The motif of k bases with this number."""
    return F.translate(F.lpad(F.conv(_col(index).cast("string"), 10, 4), k, "0"), "0123", BASES)


def gene_family(name: Column | str) -> Column:
    """The part of a gene's name before its first *, - or S."""
    return F.split(_col(name), "[*\\-S]")[0]


def soft_threshold(x: Column | str, by: float) -> Column:
    x = _col(x)
    return F.greatest(x - by, F.lit(0.0)) + F.least(x + by, F.lit(0.0))


def rounded(x: Column | str, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(_col(x), digits) + F.lit(0.0)
