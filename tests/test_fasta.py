import gzip
import random

import pytest
from pyspark.sql import functions as F

from helixframe.sources import fasta
from helixframe.sources import readers as rd
from tests.conftest import rows


def plain(text):
    """name -> letters, read in one go."""
    out, name = {}, None
    for line in text.split("\n"):
        if line.startswith(">"):
            name = (line[1:].split() or [""])[0]
            out[name] = ""
        elif name is not None:
            out[name] += "".join(line.split()).upper()
    return out


def genome(seed, end="\n"):
    rng = random.Random(seed)
    out = []
    for i in range(rng.randint(1, 9)):
        seq = "".join(rng.choice("acgtNACGT") for _ in range(rng.choice([0, 1, 7, 60, 61, 500, 1333])))
        width = rng.choice([1, 7, 60, 10_000])
        out += [f">chr{i}{rng.choice(['', ' some words > here', ' ' + 'x' * 90])}", *[seq[j : j + width] for j in range(0, len(seq), width)]]
        out += [""] * rng.randint(0, 2)
    return end.join(out) + end * rng.randint(0, 1)


@pytest.mark.parametrize("seed", range(12))
def test_events_in_ranges_of_any_size(tmp_path, seed, monkeypatch):
    text = genome(seed, "\r\n" if seed % 4 == 3 else "\n")
    (tmp_path / "g.fa").write_bytes(text.encode())
    n = len(text.encode())
    rng = random.Random(seed)
    for size in (1, 2, 3, 10, 64, 1000, 10**6):
        monkeypatch.setattr(fasta, "BLOCK", rng.choice([1, 5, 64, 4096]))
        got, name = {}, None
        for low in range(0, n, size):
            for head, letters in fasta.events(str(tmp_path / "g.fa"), low, min(n, low + size)):
                if head is not None:
                    name, got[head] = head, ""
                else:
                    got[name] += letters.decode().upper()
        assert got == plain(text), size


@pytest.mark.parametrize("seed", [1, 2])
def test_pieces_and_lengths(spark, tmp_path, seed):
    text = genome(seed)
    (tmp_path / "g.fa").write_text(text)
    for size, chunk in ((50, 16), (333, 64), (10**6, 1 << 16)):
        index = fasta.fasta_index(spark, str(tmp_path / "g.fa"), size)
        pieces = fasta.fasta_pieces(spark, index, chunk).collect()
        assert all(r.start // chunk == r.chunk == (r.start + len(r.seq) - 1) // chunk for r in pieces)
        got = {}
        for r in sorted(pieces, key=lambda r: (r.chrom, r.start)):
            assert len(got.setdefault(r.chrom, "")) == r.start
            got[r.chrom] += r.seq
        assert got == {k: v for k, v in plain(text).items() if v}
        assert dict(rows(fasta.fasta_lengths(spark, index), "chrom", "length")) == {k: len(v) for k, v in plain(text).items()}


def test_folders_and_packed_files(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"{i}.fa").write_text(f">a{i}\nACGT\nAC\n")
    with gzip.open(tmp_path / "z.fa.gz", "wt") as f:
        f.write(">z\n" + "ACGTT\n" * 50)
    chunks = rd.fasta_chunks(spark, str(tmp_path), 100, 5)
    got = {}
    for r in chunks.orderBy("chrom", "start").collect():
        got[r.chrom] = got.get(r.chrom, "") + r.seq
    assert got == {"a0": "ACGTAC", "a1": "ACGTAC", "z": "ACGTT" * 50}


def test_filters_choose_the_ranges(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">a\n" + "ACGTACGTAC\n" * 100 + ">b\n" + "TTTTTTTTTT\n" * 100)
    reader = fasta.FastaReader(fasta.fasta_index(spark, str(tmp_path / "g.fa"), 110), 10)
    assert len(reader.partitions()) == 21
    list(reader.pushFilters([fasta.EqualTo(("chrom",), "b"), fasta.GreaterThanOrEqual(("start",), 450), fasta.LessThan(("start",), 520)]))
    assert 1 <= len(reader.partitions()) <= 3
    pieces = fasta.fasta_pieces(spark, reader.index, 10)
    some = pieces.where("chrom = 'b' AND start >= 450 AND start < 520")
    # a range may end within a piece, so more than the seven multiples of ten can begin one
    begins = [r.start for r in some.orderBy("start").collect()]
    assert set(range(450, 520, 10)) <= set(begins) and all(450 <= x < 520 for x in begins) and some.rdd.getNumPartitions() <= 3
    assert pieces.where("chrom IN ('a', 'x') AND start > 980").agg(F.sum(F.length("seq"))).first()[0] == 10


def test_repeated_windows_are_fetched_once(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">chr1\nACGTACGTAC\n")
    w = spark.createDataFrame([("chr1", 1, 6), ("chr1", 1, 6), ("chr1", 4, 4), ("chr1", 8, 99), ("chr1", -5, -1), (None, 0, 3), ("chr1", None, 3)], "chrom string, start long, end long")
    for chunk, size in ((4, 6), (1 << 16, 1 << 20)):
        got = rows(rd.fetch(w, rd.fasta_chunks(spark, str(tmp_path / "g.fa"), chunk, size), chunk), "start", "end", "seq")
        assert got == sorted([(1, 6, "CGTAC")] * 2 + [(4, 4, ""), (8, 99, "AC"), (-5, -1, ""), (0, 3, ""), (None, 3, "")], key=repr)


def test_a_long_line_is_read_in_parallel(spark, tmp_path):
    """A chromosome of 24 MB on one line: no quadratic step, and as many ranges as its size asks for."""
    unit = b"ACGTTGCAAC" * 1000
    with open(tmp_path / "g.fa", "wb") as f:
        f.write(b">c\n")
        for _ in range(2400):
            f.write(unit)
    index = fasta.fasta_index(spark, str(tmp_path / "g.fa"), 2 << 20)
    pieces = fasta.fasta_pieces(spark, index)
    assert pieces.rdd.getNumPartitions() == 12
    assert pieces.agg(F.sum(F.length("seq"))).first()[0] == 24_000_000
    w = spark.createDataFrame([("c", 23_999_990, 24_000_100), ("c", 12_345_678, 12_345_698)], "chrom string, start long, end long")
    assert {r.start: r.seq for r in rd.fetch(w, pieces).collect()} == {23_999_990: "ACGTTGCAAC", 12_345_678: ("ACGTTGCAAC" * 4)[8:28]}
