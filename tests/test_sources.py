import json

import pytest
from pyspark.sql import functions as F

from helixframe.functions import annotation as an
from helixframe.functions import scalar as sc
from helixframe.functions import sequence as sq
from helixframe.plans import interpret as ip
from helixframe.sources import readers as rd
from helixframe.sources import writers as wr
from helixframe.streaming import incremental as inc
from tests.conftest import rows


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_bed(spark, tmp_path):
    p = put(tmp_path, "exons.bed", "# c\ntrack x\n\nchr1\t0\t10\tn\nchr1\t5\nchr1\ta\t9\nchr2\t9\t9\nchr2 1 4\nchr2\t3\t8\n")
    assert rows(rd.bed(spark, p, concept=True)) == [("exons", "chr1", 0, 10), ("exons", "chr2", 3, 8)]
    assert rows(rd.bed(spark, p, length=5)) == [("chr2", 3, 8)]
    loose = put(tmp_path, "loose.bed", "chr2 1 4\nchr2\t9\t9\n")
    assert rows(rd.bed(spark, loose, strict=False)) == [("chr2", 1, 4), ("chr2", 9, 9)]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        rd.bed(spark, p, strict=False).collect()
    assert rows(rd.region(rd.bed(spark, p), "chr1", 4, 6)) == [("chr1", 4, 6)]


def test_gtf_and_annotations(spark, tmp_path):
    line = "chr1\th\t{}\t{}\t{}\t.\t{}\t.\tgene_id \"G\"; transcript_id \"T\";\n"
    p = put(tmp_path, "a.gtf", "# c\n" + line.format("exon", 101, 200, "+") + line.format("transcript", 5001, 9000, "-") + "chr1\th\tgene\t100\t103\t.\t+\t.\tname \"x\";\n")
    g = rd.gtf(spark, p)
    assert rows(g, "feature", "start", "end", "gene_id") == sorted([("exon", 100, 200, "G"), ("transcript", 5000, 9000, "G"), ("gene", 99, 103, None)], key=repr)
    assert rows(an.splice_sites(an.of_type(g, "exon"), 2), "site", "start", "end") == [("acceptor", 98, 102), ("donor", 198, 202)]
    minus = an.of_type(g, "exon").withColumn("strand", F.lit("-"))
    assert rows(an.splice_sites(minus, 2), "site", "start", "end") == [("acceptor", 198, 202), ("donor", 98, 102)]
    assert rows(an.promoters(an.of_type(g, "transcript"), 1000, 100), "start", "end") == [(8899, 10000)]
    plus = an.of_type(g, "transcript").withColumn("strand", F.lit("+"))
    assert rows(an.promoters(plus, 1000, 100), "start", "end") == [(4000, 5101)]
    low = an.of_type(g, "exon").withColumns({"start": F.lit(1), "end": F.lit(50)})
    assert ("acceptor", 0, 3) in rows(an.splice_sites(low, 2), "site", "start", "end")


def test_introns(spark):
    ex = spark.createDataFrame([("T", "c", "+", a, b) for a, b in ((0, 10), (5, 20), (30, 40), (40, 50), (60, 70))] + [(None, "c", "+", 0, 9)], "transcript_id string, chrom string, strand string, start long, end long")
    assert rows(an.introns(ex), "start", "end") == [(20, 30), (50, 60)]


def test_tables_with_hashed_headers(spark, tmp_path):
    p = put(tmp_path, "v.txt", "#AlleleID\tChromosome\tStart\tStop\tAssembly\tOriginSimple\tType\tClinicalSignificance\n1\t7\t100\t103\tGRCh38\tgermline\tDeletion\t Likely   Pathogenic \n2\tchr7\tx\t5\tGRCh38\tgermline\tDeletion\tPathogenic\n")
    df = rd.hashed_table(spark, p)
    steps = an.variant_steps("GRCh38", "germline", ["deletion"], 1000, ["pathogenic", "likely pathogenic"])
    assert rows(an.variants(df, steps)) == [("chr7", 99, 103)]
    from helixframe.operators.statistics import funnel

    assert [r.n for r in funnel(df, steps).orderBy("step").collect()] == [2, 2, 2, 2, 2, 1, 1, 1, 1]
    q = put(tmp_path, "u.csv", '#"bin","chrom"\n1,"chr1"\n')
    assert rd.hashed_table(spark, q, ",").columns == ["bin", "chrom"] and rd.column_of(df, ["Stopp", "STOP"]) == "Stop"


def test_ccre_and_fan_out(spark, tmp_path):
    p = put(tmp_path, "c.bed", "chr1\t0\t9\td\te\tPLS,CTCF-bound\nchr1\t20\t30\td\te\tdELS\n")
    df = rd.ccre(spark, p)
    wr.fan_out_tags(df, str(tmp_path / "tags"), sc.tags(F.col("tags")), ["PLS", "CTCF-bound"])
    assert sorted(x.name for x in (tmp_path / "tags").glob("tag=*")) == ["tag=CTCF-bound", "tag=PLS"]
    with pytest.raises(ValueError):
        rd.ccre(spark, put(tmp_path, "d.bed", "chr1\t0\n"))
    wr.fan_out(df.withColumn("label", sc.file_label(F.lit("a b/c"))), str(tmp_path / "fan"), "label", F.col("start") == "0")
    assert sorted(x.name for x in (tmp_path / "fan").glob("label=*")) == ["label=CORE__a_b_c", "label=a_b_c"]


def test_embl_and_meme(spark, tmp_path):
    p = put(tmp_path, "r.embl", "ID   ALU;  x\nDE   a repeat\nSQ   Sequence\n     acgtn aaa   10\n     rrgg        14\n//\nID   TWO\nDE   d\nSQ   s\n     tt 2\n//\n")
    df = rd.embl(spark, p)
    assert rows(df, "name", "description", "seq") == [("ALU", "a repeat", "ACGTNAAANNGG"), ("TWO", "d", "TT")]
    wr.meme(df.withColumn("rows", sq.pwm(F.col("seq"))), str(tmp_path / "m"), "name", "rows")
    text = spark.read.text(str(tmp_path / "m"), wholetext=True).first()[0]
    assert text.startswith("MEME version 4") and text.index("MOTIF ALU") < text.index("MOTIF TWO") and "w= 12" in text


def test_fasta(spark, tmp_path):
    p = put(tmp_path, "g.fa", ">chr1 x\nacgtacgtac\nggg\n>chr2\nTTTT\n")
    chunks = rd.fasta_chunks(spark, p, 4)
    w = spark.createDataFrame([("chr1", 2, 11), ("chr1", -3, 2), ("chr2", 2, 99), ("chr9", 0, 3)], "chrom string, start long, end long")
    assert {(r.chrom, r.start): r.seq for r in rd.fetch(w, chunks, 4).collect()} == {("chr1", 2): "GTACGTACG", ("chr1", -3): "AC", ("chr2", 2): "TT", ("chr9", 0): ""}


def test_small_formats(spark, tmp_path):
    assert rows(rd.jsonl(spark, put(tmp_path, "a.jsonl", '{"a": 1}\n\n{"a": 2}\n'), "a int")) == [(1,), (2,)]
    a, b = put(tmp_path, "l.json", "[1, 2]"), put(tmp_path, "d.json", json.dumps({"dense": [2, 3], "other": 1}))
    assert rows(rd.index_lists(spark, [a, b], ["dense", "dead"])) == [(1,), (2,), (3,)]
    m = put(tmp_path, "m.yaml", "loss: 0.5\nsparsity:\n  dead: 3\n  name: x\n# c\n")
    assert rd.metrics_file(spark, m).first().metrics == {"loss": 0.5, "sparsity.dead": 3.0}
    assert rd.first_existing(spark, [str(tmp_path / "none"), a]) == a
    df = rd.evolved(spark.createDataFrame([(0.1,)], "baseline double"), "prevalence", ["baseline"])
    assert df.columns == ["prevalence"]


def test_result_tree(spark, tmp_path):
    df = spark.createDataFrame([("c", 1, float("inf")), ("c", 2, 0.5), ("c", 3, None)], "concept string, feature int, mcc double")
    wr.result_tree(df, str(tmp_path / "t"), "mcc", ["mcc"], 1)
    top = spark.read.option("header", True).csv(str(tmp_path / "t/top")).first()
    assert (top.feature, top.mcc, top.concept) == ("2", "0.500000", "c")
    assert [r.mcc for r in wr.metric_rows(df, ["mcc"]).orderBy("feature").collect()] == ["inf", "0.500000", ""]


def test_scalars(spark):
    one = spark.range(1)
    got = one.select(
        sc.int_list(F.lit("```json\n[8, 0, 12]\n```"), 3).alias("a"), sc.int_list(F.lit("[8, 0, 12]"), 4).alias("b"), sc.section(F.lit("HYPOTHESIS: x\ny\nCONFIDENCE: High"), "HYPOTHESIS").alias("h"),
        sc.collapsed(F.lit("  Likely   Pathogenic ")).alias("c"), sc.token_midpoint(F.lit(100), F.lit(612), F.lit(0), 512).alias("m0"), sc.token_midpoint(F.lit(100), F.lit(612), F.lit(511), 512).alias("m1"),
        sc.safe_float(F.lit("x"), 2.0).alias("f"), sc.bounded(F.lit(float("-inf"))).alias("i"), sc.step_of(F.lit("a/layer3/step_800/x")).alias("s"), sc.safe_div(F.lit(1), F.lit(0)).alias("d"),
    ).first()
    assert got.a == [8, 0, 10] and got.b is None and got.h == "x\ny" and got.c == "likely pathogenic" and (got.m0, got.m1) == (100, 611)
    assert (got.f, got.i, got.s, got.d) == (2.0, -1e9, 800, 0.0)
    cats = spark.createDataFrame([(0.5,), (0.2,), (0.19,), (None,)], "r double").select(sc.score_category(F.col("r")).alias("c"))
    assert [r.c for r in cats.collect()] == ["accept", "review", "recluster", "unscored"]


def test_sequences(spark):
    df = spark.createDataFrame([("ACGTACGTACGTACGTACGTA",)], "s string")
    got = df.select(sq.centered(F.col("s"), 9).alias("a"), sq.centered(F.col("s"), 8).alias("b"), sq.highlighted(F.col("s"), F.lit(1)).alias("h"), sq.highlighted(F.col("s"), F.lit(99)).alias("o"), sq.shortened(F.col("s"), 5).alias("t"), sq.centered_window(F.col("s"), F.lit(1), 3).alias("w"), sq.n_fraction(F.lit("")).alias("n"), sq.sanitized(F.lit("acx")).alias("z")).first()
    assert len(got.a) == len(got.b) == 9 and got.h.startswith("A[C]G") and got.o == "ACGTACGTACGTACGTACGTA" and got.t.startswith("...") and got.t.endswith("...")
    assert got.w == "NNACGTA" and got.n == 1.0 and got.z == "ACN"
    two = spark.createDataFrame([("CA",), ("AC",)], "s string")
    assert [r.base for r in sq.consensus(sq.pfm(two, "s")).orderBy("pos").collect()] == ["A", "A"]


def test_streaming(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = inc.arriving(spark, str(tmp_path / "in"), e)
    count = lambda b: b.groupBy("event_type").agg(F.count("*").alias("n"))
    inc.accumulate(stream, count, ["event_type"], str(tmp_path / "acc"), str(tmp_path / "ck")).awaitTermination()
    inc.accumulate(stream, count, ["event_type"], str(tmp_path / "acc"), str(tmp_path / "ck")).awaitTermination()
    assert rows(inc.accumulated(spark, str(tmp_path / "acc"), ["event_type"], ["n"])) == rows(count(e))
    inc.to_table(stream.select("event_id"), str(tmp_path / "out"), str(tmp_path / "ck2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == e.count()
    s = inc.drain(inc.sessions(stream, "ts", "user_id", "1 hour", "9999 days"), "sess", str(tmp_path / "ck3"))
    assert s.agg(F.sum("n")).first()[0] == e.count()


def test_interpretation(spark):
    ex = spark.createDataFrame([(1, r, f"ACGT{r}", float(20 - r)) for r in range(12)], "feature int, rank int, context string, act double")
    p = ip.prompts(ip.normalised(ex), spark.createDataFrame([(1, "exon 90 %")], "feature int, enrichment string"), 3, (5, 9)).first()
    assert p.prompt.startswith("Annotations: exon 90 %") and "01. ACGT0 (10)" in p.prompt and len(p.holdout_sequences) == 5
    df = ip.asked(spark.createDataFrame([p]), "prompt", lambda text: str([9, 8, 7, 6, 5]))
    got = ip.scores(df).first()
    assert got.category == "accept" and got.r > 0.9
    e = ip.explanations(spark.createDataFrame([("HYPOTHESIS: exons\nEVIDENCE: seen\nCONFIDENCE: HIGH",)], "answer string")).first()
    assert (e.hypothesis, e.evidence, e.confidence) == ("exons", "seen", "high")
    done = []
    steps = [(n, lambda n=n: done.append(n)) for n in "abc"]
    assert ip.run_steps(steps, start="b") == ["b", "c"] == done


def test_resumed_parts_without_counts_and_null_parts(spark, tmp_path):
    rows_ = spark.createDataFrame([(p, v) for p in (0, 1, 2, None) for v in (1, 2, 3)], "part int, v int")
    calls = []

    def count(df):
        calls.append(df.select("part").distinct().count())
        return df.where("NOT part <=> 1").groupBy("part", "v").agg(F.count("*").alias("n"))

    got = [inc.resumed(rows_, "part", count, ["v"], ["n"], str(tmp_path / "s"), "f", at_most=1) for _ in range(4)]
    assert got[:3] == [None] * 3 and calls == [1] * 4
    assert rows(got[3]) == [(1, 3), (2, 3), (3, 3)]
    assert rows(inc.resumed(rows_, "part", count, ["v"], ["n"], str(tmp_path / "s"), "f")) == [(1, 3), (2, 3), (3, 3)] and calls[-1] == 0


def test_appends_of_null_keys(spark, tmp_path):
    two = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    for _ in range(3):
        inc.append_new(two, str(tmp_path / "t"), ["k"])
    assert rows(spark.read.schema(two.schema).json(str(tmp_path / "t"))) == rows(two)


def test_exactly_once(spark, tmp_path):
    """Replayed rows, a batch that was written but not noted, a batch run again, and null keys add nothing."""
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    first = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (1, "a")], "k int, v string")
    first.coalesce(1).write.parquet(src)
    stream = inc.arriving(spark, src, first)
    inc.exactly_once(stream, out, ck, ["k"]).awaitTermination()
    assert [r.k for r in inc.committed(spark, out, first).orderBy("k").collect()] == [None, 1, 2]
    spark.createDataFrame([(2, "again"), (None, "again"), (3, "d")], first.schema).coalesce(1).write.mode("append").parquet(src)
    # the next batch was written by a run that died before its manifest entry
    spark.createDataFrame([(9, "dead")], first.schema).write.parquet(f"{out}/data/batch=1")
    assert inc.committed(spark, out, first).count() == 3
    inc.exactly_once(stream, out, ck, ["k"]).awaitTermination()
    assert [r.k for r in inc.committed(spark, out, first).orderBy("k").collect()] == [None, 1, 2, 3]
    # a run whose batch was noted but whose checkpoint was not: the batch runs again
    import os

    for name in ("1", ".1.crc"):
        if os.path.exists(f"{ck}/commits/{name}"):
            os.remove(f"{ck}/commits/{name}")
    inc.exactly_once(stream, out, ck, ["k"]).awaitTermination()
    assert [r.k for r in inc.committed(spark, out, first).orderBy("k").collect()] == [None, 1, 2, 3]
    assert inc.committed(spark, str(tmp_path / "none"), first).count() == 0
