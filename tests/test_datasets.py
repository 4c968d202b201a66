"""Scans of annotated families, preparation and sinks, on small files with bad records."""

from __future__ import annotations

import json
import math
import os

import pytest
from pyspark.sql import functions as F

from motifspark.functions.sequences import collapsed_runs, parse_positions, positions_of, raw_position
from motifspark.operators.tables import model_search
from motifspark.sources import datasets, readers

HEAD = "v_gene,d_gene,j_gene,naive_seq,v_gl_seq,unique_ids,seqs,v_qr_seqs,mut_freqs,indel_reversed_seqs,in_frames"


def line(v, germline, ids, texts, freqs, frames, indels=None, as_json=False):
    join = (lambda x: '"' + json.dumps([str(y) for y in x]).replace('"', '""') + '"') if as_json else (lambda x: ":".join(map(str, x)))
    return ",".join([v, "D1-1*01", "J4*02", germline + "AA", germline, join(ids), join([t + "AA" for t in texts]), join(texts), join(freqs), join(indels or [""] * len(ids)), join(frames)])


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("annotations")
    (top / "partitions").mkdir()
    (top / "meta.csv").write_text("dataset,locus,species,subject\nd1,igh,human,s1\nd2,igk,human,s2\nd3,igh,mouse,s3\nd4,igh,human,s4\n")
    write = lambda name, rows: (top / "partitions" / f"{name}-cluster-annotations.csv").write_text("\n".join([HEAD, *rows]) + "\n")
    write("d1", [
        line("V3-1*01", "ACGTACGTAC", ["a", "b", "c"], ["ACGTACGTAA", "ACGTACGTAC", "ANNNNNNNNC"], [0.1, 0.0, 0.0], [False, True, False]),
        line("", "ACGTACGTAC", ["x"], ["ACGTACGTAC"], [0.0], [True]),
        line("V3-2*01", "ACGTACGTAC", ["a", "b"], ["ACGTACGTAC"], [0.0], [True]),
        "V9,only,three",
        line("V4-1*02", "TTTTACGTAC", ["j1", "j2"], ["TTTTACGTAA", "TTTTACGAAA"], [0.1, 0.2], [False, False], ["", "x"], as_json=True),
        line("V5-1*02", "TTTTACGTAC", ["k"], ["TTTTACGTAC"], [0.0], [True]).replace("k,", "[k,", 1),
    ])
    write("d4", [line("V3-1*01", "ACGTACGTAC", ["a"], ["ACGTACGTGG"], [0.2], [True])])
    # not wanted: if it were opened, the read would fail
    bad = top / "partitions" / "d2-cluster-annotations.csv"
    bad.mkdir()
    (bad / "part.csv").symlink_to(top / "gone")
    return str(top)


def test_only_wanted_files_are_opened(spark, root):
    found = datasets.resolve_datasets(spark, f"{root}/meta.csv", root, {"locus": ["igh"], "species": ["human"]})
    assert sorted((r["dataset"], os.path.basename(r["annotations_file"])) for r in found.collect()) == [("d1", "d1-cluster-annotations.csv"), ("d4", "d4-cluster-annotations.csv")]
    scan = datasets.scan_annotations(spark, found)
    assert {r[0] for r in scan.seqs.select("dataset").distinct().collect()} == {"d1", "d4"}
    # files of other datasets aren't there at all (d3), or can't be read (d2)
    with pytest.raises(Exception, match="d3|PATH_NOT_FOUND"):
        datasets.scan_annotations(spark, datasets.resolve_datasets(spark, f"{root}/meta.csv", root, {"dataset": ["d3"]}))


def test_families_and_bad_records(spark, root):
    wanted = datasets.resolve_datasets(spark, f"{root}/meta.csv", root, {"dataset": ["d1", "d4"]})
    scan = datasets.scan_annotations(spark, wanted, suffix="x")
    rows = {(r["dataset"], r["sequence_name"].rsplit("-", 1)[1]): r for r in scan.seqs.collect()}
    assert {k: (r["sequence"], r["v_gene"], r["germline_family"], r["region"], r["subject"]) for k, r in rows.items()} == {
        ("d1", "a"): ("acgtacgtaa", "V3-1*01", "V3-1*", "v", "s1"), ("d1", "b"): ("acgtacgtac", "V3-1*01", "V3-1*", "v", "s1"), ("d1", "c"): ("annnnnnnnc", "V3-1*01", "V3-1*", "v", "s1"),
        ("d1", "j1"): ("ttttacgtaa", "V4-1*02", "V4-1*", "v", "s1"), ("d1", "j2"): ("ttttacgaaa", "V4-1*02", "V4-1*", "v", "s1"), ("d4", "a"): ("acgtacgtgg", "V3-1*01", "V3-1*", "v", "s4"),
    }
    assert all(r["sequence_name"].startswith(r["germline_name"] + "-") and r["germline_name"].startswith(f"clone{k[0]}-") and r["germline_name"].endswith("-x") for k, r in rows.items())
    assert sorted(r["germline_sequence"] for r in scan.genes.collect()) == ["acgtacgtac", "acgtacgtac", "ttttacgtac"]
    assert sorted((r["dataset"], r["reason"]) for r in scan.bad.collect()) == [("d1", "lists of different lengths"), ("d1", "lists of different lengths"), ("d1", "no gene"), ("d1", "not a record")]
    names = lambda **k: sorted(r["sequence_name"].rsplit("-", 1)[1] + "-" + r["dataset"] for r in datasets.scan_annotations(spark, wanted, **k).seqs.collect())
    assert names(max_mutated=0.2) == ["a-d1", "b-d1", "c-d1", "j1-d1"] and names(min_mutated=0.1) == ["a-d1", "a-d4", "j1-d1", "j2-d1"]
    assert names(min_length=2) == ["a-d1", "a-d4", "b-d1", "j1-d1", "j2-d1"] and names(min_family=3) == ["a-d1", "b-d1", "c-d1"]
    assert names(seq_filters={"in_frames": ["False"]}) == ["a-d1", "c-d1", "j1-d1", "j2-d1"]
    assert names(seq_filters={"in_frames": ["False"], "indel_reversed_seqs": [""]}) == ["a-d1", "c-d1", "j1-d1"]
    whole = datasets.scan_annotations(spark, wanted, region="vdj", germline_family="j")
    assert {(r["sequence"], r["germline_family"]) for r in whole.seqs.collect()} >= {("acgtacgtaaaa", "J4*02")} and {r["germline_sequence"] for r in whole.genes.collect()} == {"acgtacgtacaa", "ttttacgtacaa"}
    with pytest.raises(ValueError, match="region"):
        datasets.scan_annotations(spark, wanted, region="x")
    none = datasets.scan_annotations(spark, wanted.limit(0))
    assert none.genes.count() == none.seqs.count() == none.bad.count() == 0 and none.seqs.columns[-3:] == ["locus", "species", "subject"]


FULL = "germline_name string, germline_sequence string, sequence_name string, sequence string, note string"


def families():
    rows = [("f0", "ACGTACGT", f"s{i}", t, "x") for i, t in enumerate(["acgtacgt", "acgtacga", "aagtacga", "aagtacgg", "acg"])]
    return rows + [("f1", "acgt", "t0", "acgt", "y"), ("f2", "acgt", "u0", "ac-a", "z"), ("f3", "acgt", "v0", "aaaaa", "w")]


def test_one_for_each_family(spark):
    full = spark.createDataFrame(families(), FULL).repartition(3)
    picks = set()
    for seed in range(8):
        got = {r["germline_name"]: r for r in datasets.one_for_each_family(full, True, seed).collect()}
        assert set(got) == {"f0", "f2"} and got["f2"]["sequence"] == "acna" and got["f0"]["germline_sequence"] == "acgtacgt"
        picks.add(got["f0"]["sequence_name"])
        some = {r["germline_name"]: r["sequence_name"] for r in datasets.one_for_each_family(full, False, seed).collect()}
        assert set(some) in ({"f2", "f3"}, {"f0", "f2", "f3"}) and some.get("f0") != "s0"
    assert picks == {"s2", "s3"}


def test_imputed_pairs(spark):
    """Two leaves share a change, which goes to their inner node; a leaf with an inner unknown base goes, with the inner node that had no other leaf."""
    full = spark.createDataFrame([("g", "NACGTACGT", n, t, "") for n, t in [("a", "nacgaacgt"), ("b", "acgaacgg"), ("c", "acgtacgt"), ("d", "acgtnccgt"), ("e", "acgtacg")]], FULL)
    edges = spark.createDataFrame([("g", "g", "m"), ("g", "m", "a"), ("g", "m", "b"), ("g", "g", "c"), ("g", "g", "k"), ("g", "k", "l"), ("g", "l", "d"), ("other", "other", "q")], "tree string, parent_id string, child_id string")
    got = {(r["germline_name"], r["sequence_name"]): (r["germline_sequence"], r["sequence"]) for r in datasets.imputed_pairs(full, edges).collect()}
    assert got == {("g", "m"): ("acgtacgt", "acgaacgt"), ("m", "b"): ("acgaacgt", "acgaacgg")}


def test_files_become_observed_pairs(spark, tmp_path):
    """Unknown ends go, the flanks are conserved, metadata stays, unmutated sequences go."""
    (tmp_path / "g.csv").write_text("germline_name,germline_sequence\ng1,NNACGTACGTACGTNN\n")
    (tmp_path / "s.csv").write_text("germline_name,sequence_name,sequence,species\ng1,a,TTACGTAAGTACGTTT,mouse\ng1,b,NNACGTACGTACGTNN,man\ng1,c,ACGT,man\n")
    rows = datasets.read_observed(spark, str(tmp_path / "g.csv"), str(tmp_path / "s.csv"), 2, 2).collect()
    assert [(r["sequence_name"], r["species"], r["gs"], r["es"], [tuple(m) for m in r["mutations"]]) for r in rows] == [("a", "mouse", "acgtacgtacgt", "acgtaagtacgt", [(6, "a")])]


def test_sinks_can_run_again(spark, tmp_path):
    full = spark.createDataFrame(families(), FULL)
    genes, seqs = full.select("germline_name", "germline_sequence").distinct(), full.drop("germline_sequence")
    for kind in ("csv", "parquet"):
        path = str(tmp_path / kind)
        for _ in range(2):
            datasets.write_gene_seqs(genes, seqs, path, "note", kind)
        assert sorted(map(str, datasets.read_parts(spark, f"{path}/seqs", kind).select(seqs.columns).collect())) == sorted(map(str, seqs.collect()))
        assert sorted(map(str, datasets.read_parts(spark, f"{path}/genes", kind).select(genes.columns).collect())) == sorted(map(str, genes.collect()))
        # one part again, changed: the others stay
        datasets.write_parts(seqs.filter("note = 'x'").limit(2), f"{path}/seqs", "note", kind)
        counts = {r[0]: r[1] for r in datasets.read_parts(spark, f"{path}/seqs", kind).groupBy("note").count().collect()}
        assert counts == {"x": 2, "y": 1, "z": 1, "w": 1}


def test_preparation_end_to_end(spark, root, tmp_path):
    full = spark.createDataFrame(families(), FULL)
    full.select("germline_name", "germline_sequence").distinct().write.csv(str(tmp_path / "genes"), header=True)
    full.drop("germline_sequence").write.csv(str(tmp_path / "seqs"), header=True)
    out = str(tmp_path / "out")
    for _ in range(2):
        parts = datasets.prepare(spark, out, str(tmp_path / "genes"), str(tmp_path / "seqs"), pick="most_mutated", held_out=0.5, seed=3)
    assert {r["sequence_name"] for r in parts.collect()} <= {"s2", "s3", "u0"} and parts.count() == 2
    assert datasets.read_parts(spark, f"{out}/seqs").count() == 2
    by = datasets.prepare(spark, out + "2", str(tmp_path / "genes"), str(tmp_path / "seqs"), held_out=0.2, held_out_by="note")
    assert by.count() == 8 and {r[0] for r in by.groupBy("note").agg(F.count_distinct("part")).select("count(DISTINCT part)").collect()} == {1}
    scan = datasets.scan_annotations(spark, datasets.resolve_datasets(spark, f"{root}/meta.csv", root, {"dataset": ["d1"]}))
    assert datasets.prepare(spark, out + "3", annotations=scan).count() == 5
    with pytest.raises(ValueError, match="edges"):
        datasets.prepare(spark, out, pick="imputed")


def test_concatenated_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,x,z\n4,3,5\n")
    got = datasets.read_concatenated(spark, [str(tmp_path / n) for n in ("a.csv", "b.csv")])
    assert sorted(map(tuple, got.select("x", "y", "z").collect())) == [("1", "2", None), ("3", "4", "5")]


# the readers of single files


def test_motif_tables(spark, tmp_path):
    (tmp_path / "wide.csv").write_text('"",AAA,aac,GGT\n"",1.0,NA,0.5\n')
    got = {r[0]: r[1] for r in readers.read_mutability(spark, str(tmp_path / "wide.csv"), wide=True).collect()}
    assert got == {"aaa": 0.0, "aac": -math.inf, "ggt": math.log(0.5)}
    (tmp_path / "sub.csv").write_text('motif A C G T\n"AAA" NA 0.25 0.5 0.25\n"CAC" 0.0 NA 1 0\n')
    got = {(r["motif"], r["target"]): r["theta"] for r in readers.read_substitution(spark, str(tmp_path / "sub.csv")).collect()}
    assert got["aaa", "a"] == got["cac", "a"] == got["cac", "c"] == got["cac", "t"] == -math.inf and got["aaa", "g"] == math.log(0.5) and got["cac", "g"] == 0
    (tmp_path / "zero.csv").write_text("AAA,1,1\naac,2,0\n")
    assert [tuple(r) for r in readers.read_zero_motifs(spark, str(tmp_path / "zero.csv")).collect()] == [("aaa", 1)]
    (tmp_path / "zeros.csv").write_text("aaaaa, 2, 1, 0, 1, 1, 0\nccccc, 1, 1, 1, 0, 1, 1\n")
    assert [tuple(r) for r in readers.read_zero_thetas(spark, str(tmp_path / "zeros.csv")).collect()] == [("aaaaa", 2, ["n", "c", "g"], False), ("ccccc", 1, ["n", "a", "g", "t"], True)]


def test_alleles_in_frame(spark):
    rows = [("a", "acgtnnacg"), ("b", "acgtacgtac"), ("c", "acgtacgtacg"), ("d", "")]
    frame = spark.createDataFrame(rows, "name string, sequence string")
    offsets = set()
    for seed in range(12):
        got = {r[0]: r[1] for r in readers.germline_alleles(frame, seed).collect()}
        assert all(len(got[n]) == len(s) // 3 * 3 and "n" not in got[n] for n, s in rows)
        assert got["a"][:4] == "acgt" and got["a"][6:] == "acg"
        offsets.add(rows[2][1].index(got["c"][:9]) if got["c"] != rows[2][1][1:10] else 1)
    assert offsets == {0, 1, 2}


def test_models_and_specifications(spark, tmp_path):
    theta = spark.createDataFrame([("aaa", 0.5), ("ccc", -math.inf)], "motif string, theta double")
    for _ in range(2):
        readers.write_model(theta, str(tmp_path / "m"), {"k": 3})
    got, notes = readers.read_model(spark, str(tmp_path / "m"))
    assert sorted(map(tuple, got.collect())) == [("aaa", 0.5), ("ccc", -math.inf)] and notes == {"k": 3}
    assert readers.model_spec('[{"feature_type": "motif", "motif_length": 3, "distances_from_motif_start": [1]}]')[0]["motif_length"] == 3
    with pytest.raises(ValueError, match="feature_type"):
        readers.model_spec('[{"feature_type": "other"}]')
    assert parse_positions("0,1:1") == [[0, 1], [1]] and positions_of([2, 3], [[0, 1], [1]]) == [(2, 0), (2, 1), (3, 1)]
    with pytest.raises(ValueError, match="inside"):
        positions_of([2], [[2]])


def test_positions_before_cleaning(spark):
    """Every position of a trimmed, collapsed sequence leads back to the base that it had, by plain Python."""
    texts = ["nnacgtnnnnacgtnngtac", "acgt", "nacnnnnnngtnnnac", "acnnnnngtnnnnnnac"]
    flank = 2
    for raw in texts:
        offset, inner = len(raw) - len(raw.lstrip("n")), raw.strip("n")
        kept = []
        run = 0
        for i, c in enumerate(inner):
            run = run + 1 if c == "n" else 0
            if run <= flank:
                kept.append(i + offset)
        frame = spark.createDataFrame([(raw,)], "s string").select("s", collapsed_runs("s", flank).alias("runs"))
        got = [r[0] for r in frame.select(F.explode(F.sequence(F.lit(0), F.lit(len(kept) - 1 - flank))).alias("p"), "runs").select(raw_position(F.col("p"), F.lit(offset + flank), F.col("runs"), flank)).collect()]
        known = [k for k, at in enumerate(kept) if raw[at] != "n" and k >= flank]
        assert [got[k - flank] for k in known] == [kept[k] for k in known] and known


def test_model_search():
    """Goes on while a model is no worse than the best so far, and asks no further."""
    asked = []

    def ratio(model, best):
        asked.append((model, best))
        return {"b": 0.5, "c": 0.0, "d": -0.1, "e": 9.0}[model]

    assert model_search(["a", "b", "c", "d", "e"], ratio) == "c" and asked == [("b", "a"), ("c", "b"), ("d", "c")]
    assert model_search(["a"], ratio) == "a" and model_search(["a", "b"], lambda m, b: None) == "a"
