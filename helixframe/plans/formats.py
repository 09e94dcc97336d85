"""Queries over readers, writers and annotation: each renders a driver table as a file of the format in the shared folder and works on what the reader gives back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import annotation, scalar, sequence
from ..operators import association, intervals
from ..sources import readers, writers
from .registry import NEURONS, assoc, neurons, query, read, shared_folder


def new_path(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def as_file(values: DataFrame, name: str) -> str:
    """The path of a text file with the column's values as lines."""
    path = new_path(values.sparkSession, name)
    values.write.text(path)
    return path


def with_lines(values: DataFrame, *more: str) -> DataFrame:
    """The column and some lines more."""
    return values.union(values.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in more]))))


def totals(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends"))


TOTALS = 'count(*) AS n, sum(s)::BIGINT AS starts, sum(e)::BIGINT AS ends'

# ---------------------------------------------------------------- intervals

BED = "b AS (SELECT 'chr' || (l_suppkey % 22 + 1) AS chrom, l_partkey AS s, l_partkey + l_quantity::BIGINT - 10 AS e, l_linenumber AS k, l_returnflag || '_' || l_linestatus AS label, l_returnflag AS flag, l_linestatus AS status, l_quantity AS q FROM lineitem)"


def bed_rows(spark, sf_dir) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    chrom = F.concat(F.lit("chr"), (F.col("l_suppkey") % 22 + 1).cast("string"))
    return li.select(chrom.alias("chrom"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("long") - 10).alias("end"), "l_linenumber", F.concat_ws("_", "l_returnflag", "l_linestatus").alias("label"), F.array("l_returnflag", "l_linestatus", F.when(F.col("l_quantity") > 40, "core")).alias("tags"), "l_quantity")


def bed_file(spark, sf_dir) -> str:
    """Six lines of seven as they should be; of the others one kind lacks a field and one is parted by blanks."""
    cells = [F.col(c).cast("string") for c in ("chrom", "start", "end")]
    k = F.col("l_linenumber")
    value = F.when(k == 7, F.concat_ws(" ", *cells)).when(k == 6, F.concat_ws("\t", *cells[:2])).otherwise(F.concat_ws("\t", *cells))
    return as_file(with_lines(bed_rows(spark, sf_dir).select(value.alias("value")), "# a comment", "track name=x", "browser position", "", "  "), "bed")


@query(f"WITH {BED} SELECT chrom, {TOTALS} FROM b WHERE k NOT IN (6, 7) AND e > s GROUP BY 1")
def bed_strict(spark, sf_dir):
    return totals(readers.bed(spark, bed_file(spark, sf_dir)), "chrom")


@query(f"WITH {BED} SELECT chrom, {TOTALS} FROM b WHERE k <> 6 GROUP BY 1")
def bed_lenient(spark, sf_dir):
    return totals(readers.bed(spark, bed_file(spark, sf_dir), strict=False), "chrom")


@query(f"WITH {BED} SELECT chrom, {TOTALS} FROM b WHERE k NOT IN (6, 7) AND e - s = 20 GROUP BY 1")
def bed_fixed_length(spark, sf_dir):
    return totals(readers.bed(spark, bed_file(spark, sf_dir), length=20), "chrom")


@query(f'WITH {BED} SELECT greatest(s, 100) AS start, least(e, 500) AS "end", count(*) AS n FROM b WHERE k NOT IN (6, 7) AND e > s AND chrom = \'chr3\' AND s < 500 AND e > 100 GROUP BY 1, 2')
def bed_region(spark, sf_dir):
    return readers.region(readers.bed(spark, bed_file(spark, sf_dir)), "chr3", 100, 500).groupBy("start", "end").agg(F.count("*").alias("n"))


@query(f"WITH {BED} SELECT replace(chrom, 'chr', '') AS chrom, {TOTALS} FROM (SELECT DISTINCT chrom, s, e FROM b WHERE e > s) GROUP BY 1")
def bed_written_distinct(spark, sf_dir):
    path = new_path(spark, "bed")
    writers.bed(bed_rows(spark, sf_dir), path, distinct=True)
    return totals(readers.bed(spark, path).withColumn("chrom", intervals.prefixed(F.col("chrom"), False)), "chrom")


@query(f"WITH {BED} SELECT 'exon' AS label, {TOTALS} FROM b")
def bed_written_labelled(spark, sf_dir):
    path = new_path(spark, "bed")
    writers.bed(bed_rows(spark, sf_dir), path, label="exon")
    return totals(spark.read.csv(path, sep="\t", schema="chrom string, start long, end long, label string"), "label")


@query(f"WITH {BED} SELECT label, {TOTALS} FROM b GROUP BY 1 UNION ALL SELECT 'CORE__' || label, {TOTALS} FROM b WHERE q > 40 GROUP BY 1")
def bed_fan_out(spark, sf_dir):
    path = new_path(spark, "classes")
    writers.fan_out(bed_rows(spark, sf_dir), path, "label", F.col("l_quantity") > 40)
    return totals(spark.read.csv(path, sep="\t", schema="chrom string, start long, end long, label string"), "label")


@query(f"WITH {BED}, t AS (SELECT s, e, unnest([flag, status, CASE WHEN q > 40 THEN 'core' END]) AS tag FROM b) SELECT tag, {TOTALS} FROM t WHERE tag IN ('A', 'F', 'core') GROUP BY 1")
def bed_fan_out_tags(spark, sf_dir):
    path = new_path(spark, "tags")
    writers.fan_out_tags(bed_rows(spark, sf_dir), path, F.col("tags"), ["A", "F", "core"])
    return totals(spark.read.csv(path, sep="\t", schema="chrom string, start long, end long, tag string"), "tag")


@query(f"WITH {BED} SELECT CASE WHEN chrom IN ('chr1', 'chr2') THEN 'train' WHEN chrom = 'chr3' THEN 'test' ELSE 'other' END AS split, {TOTALS} FROM b GROUP BY 1")
def split_writer(spark, sf_dir):
    path = new_path(spark, "split")
    rows = bed_rows(spark, sf_dir).withColumn("split", intervals.split_of(F.col("chrom"), ["chr1", "chr2"], ["chr3"]))
    rows.select("chrom", "start", "end", "split").write.partitionBy("split").csv(path, sep="\t")
    return totals(spark.read.csv(path, sep="\t", schema="chrom string, start long, end long, split string"), "split")


# ---------------------------------------------------------------- genes

GTF = """g AS (SELECT 'chr' || (l_suppkey % 22 + 1) AS chrom, ['exon', 'CDS', 'five_prime_UTR', 'three_prime_UTR', 'transcript', 'gene'][l_linenumber % 6 + 1] AS feature, l_partkey AS s, l_partkey + l_quantity::BIGINT * 10 AS e,
['+', '-', '.'][l_orderkey % 3 + 1] AS strand, 'G' || l_suppkey AS gene_id, CASE WHEN l_linenumber <> 7 THEN 'T' || l_orderkey END AS transcript_id FROM lineitem)"""


def gtf(spark, sf_dir) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    pick = lambda names, i: F.element_at(F.array(*[F.lit(x) for x in names]), (i + 1).cast("int"))
    ids = F.concat(F.lit('gene_id "G'), F.col("l_suppkey"), F.lit('";'), F.when(F.col("l_linenumber") != 7, F.concat(F.lit(' transcript_id "T'), F.col("l_orderkey"), F.lit('";'))).otherwise(""))
    cells = [F.concat(F.lit("chr"), F.col("l_suppkey") % 22 + 1), F.lit("src"), pick(annotation.FEATURE_TYPES, F.col("l_linenumber") % 6), F.col("l_partkey") + 1, F.col("l_partkey") + F.col("l_quantity").cast("long") * 10, F.lit("."), pick("+-.", F.col("l_orderkey") % 3), F.lit("."), ids]
    return readers.gtf(spark, as_file(with_lines(li.select(F.concat_ws("\t", *[c.cast("string") for c in cells]).alias("value")), "#!genome-build x"), "gtf"))


@query(f"WITH {GTF} SELECT feature, {TOTALS}, count(DISTINCT gene_id) AS genes, count(*) FILTER (transcript_id IS NULL) AS without FROM g GROUP BY 1")
def gtf_scan(spark, sf_dir):
    missing = F.sum(F.col("transcript_id").isNull().cast("long"))
    return gtf(spark, sf_dir).groupBy("feature").agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends"), F.countDistinct("gene_id").alias("genes"), missing.alias("without"))


@query(f"""WITH {GTF}, x AS (SELECT * FROM g WHERE feature = 'exon' AND transcript_id IS NOT NULL), f AS (SELECT *, CASE WHEN s <= max(e) OVER w THEN 0 ELSE 1 END AS n FROM x WINDOW w AS (PARTITION BY transcript_id, chrom, strand ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
i AS (SELECT *, sum(n) OVER (PARTITION BY transcript_id, chrom, strand ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM f), m AS (SELECT transcript_id, chrom, strand, min(s) AS s, max(e) AS e FROM i GROUP BY transcript_id, chrom, strand, i)
SELECT transcript_id, chrom, strand, e AS start, nx AS "end" FROM (SELECT *, lead(s) OVER (PARTITION BY transcript_id, chrom, strand ORDER BY s) AS nx FROM m) WHERE e < nx""")
def gtf_introns(spark, sf_dir):
    return annotation.introns(annotation.of_type(gtf(spark, sf_dir), "exon"))


@query(f"""WITH {GTF}, p AS (SELECT chrom, unnest(['donor', 'acceptor']) AS site, unnest([CASE WHEN strand = '+' THEN e ELSE s END, CASE WHEN strand = '+' THEN s ELSE e END]) AS pos FROM g WHERE feature = 'exon')
SELECT site, count(*) AS n, sum(greatest(pos - 5, 0))::BIGINT AS starts, sum(pos + 5)::BIGINT AS ends FROM p WHERE greatest(pos - 5, 0) < pos + 5 GROUP BY 1""")
def splice_sites(spark, sf_dir):
    return totals(annotation.splice_sites(annotation.of_type(gtf(spark, sf_dir), "exon"), 5), "site")


@query(f"""WITH {GTF}, p AS (SELECT chrom, CASE WHEN strand = '+' THEN s - 50 ELSE e - 1 - 20 END AS s, CASE WHEN strand = '+' THEN s + 21 ELSE e - 1 + 51 END AS e FROM g WHERE feature = 'transcript')
SELECT chrom, count(*) AS n, sum(greatest(s, 0))::BIGINT AS starts, sum(e)::BIGINT AS ends FROM p WHERE greatest(s, 0) < e GROUP BY 1""")
def promoters(spark, sf_dir):
    return totals(annotation.promoters(annotation.of_type(gtf(spark, sf_dir), "transcript"), 50, 20), "chrom")


@query(f"WITH {GTF} SELECT feature AS label, chrom, {TOTALS} FROM g GROUP BY 1, 2")
def labelled_union(spark, sf_dir):
    rows = gtf(spark, sf_dir)
    return totals(annotation.labelled_union({t: annotation.of_type(rows, t) for t in annotation.FEATURE_TYPES}), "label", "chrom")


# ---------------------------------------------------------------- variants, repeats, regulatory elements

VARIANTS = """v AS (SELECT ['single nucleotide  variant', 'Deletion', 'Indel'][l_linenumber % 3 + 1] AS type, CASE l_returnflag WHEN 'A' THEN 'Pathogenic' WHEN 'N' THEN 'Benign' ELSE 'Likely  pathogenic' END AS sig, CASE WHEN l_linestatus = 'F' THEN 'germline' ELSE 'somatic' END AS origin,
CASE WHEN l_quantity::BIGINT % 2 = 0 THEN 'GRCh38' ELSE 'GRCh37' END AS assembly, CASE WHEN l_linenumber <> 7 THEN (l_suppkey % 22 + 1)::VARCHAR END AS chrom, CASE WHEN l_linenumber <> 6 THEN l_partkey END AS start, l_partkey + l_quantity::BIGINT - 5 AS stop FROM lineitem),
c AS (SELECT *, chrom IS NOT NULL AS c1, assembly = 'GRCh38' AS c2, contains(origin, 'germline') AS c3, type <> 'Indel' AS c4, start IS NOT NULL AS c5, coalesce(stop - start + 1 > 0, false) AS c6, coalesce(stop - start + 1 <= 30, false) AS c7, sig <> 'Benign' AS c8 FROM v)"""
STEPS = "complete assembly origin type numeric length short significance".split()


def variant_table(spark, sf_dir) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    kind = F.element_at(F.array(F.lit("single nucleotide  variant"), F.lit("Deletion"), F.lit("Indel")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    sig = F.when(F.col("l_returnflag") == "A", "Pathogenic").when(F.col("l_returnflag") == "N", "Benign").otherwise("Likely  pathogenic")
    origin = F.when(F.col("l_linestatus") == "F", "germline").otherwise("somatic")
    assembly = F.when(F.col("l_quantity").cast("long") % 2 == 0, "GRCh38").otherwise("GRCh37")
    chrom = F.when(F.col("l_linenumber") != 7, (F.col("l_suppkey") % 22 + 1).cast("string")).otherwise("")
    start = F.when(F.col("l_linenumber") != 6, F.col("l_partkey").cast("string")).otherwise("na")
    cells = [F.col("l_orderkey").cast("string"), kind, sig, origin, assembly, chrom, start, (F.col("l_partkey") + F.col("l_quantity").cast("long") - 5).cast("string")]
    path = as_file(with_lines(li.select(F.concat_ws("\t", *cells).alias("value")), "#AlleleID\tType\t ClinicalSignificance\tOriginSimple\tAssembly\tChromosome\tStart\tStop "), "variants")
    return readers.hashed_table(spark, path)


def variant_steps() -> list:
    return annotation.variant_steps("GRCh38", "germline", ["single nucleotide variant", "Deletion"], 30, ["pathogenic", "likely pathogenic"])


@query(f"WITH {VARIANTS} SELECT 0::INTEGER AS step, 'all' AS name, count(*) AS n FROM c" + "".join(f" UNION ALL SELECT {i}, '{name}', count(*) FILTER ({' AND '.join(f'c{j}' for j in range(1, i + 1))}) FROM c" for i, name in enumerate(STEPS, 1)))
def variant_funnel(spark, sf_dir):
    from ..operators.statistics import funnel

    return funnel(variant_table(spark, sf_dir), variant_steps())


@query(f"WITH {VARIANTS}, d AS (SELECT DISTINCT 'chr' || chrom AS chrom, greatest(start - 1, 0) AS s, stop AS e FROM c WHERE c1 AND c2 AND c3 AND c4 AND c5 AND c6 AND c7 AND c8) SELECT chrom, {TOTALS} FROM d WHERE e > s GROUP BY 1")
def variant_intervals(spark, sf_dir):
    return totals(annotation.variants(variant_table(spark, sf_dir), variant_steps()), "chrom")


def comma_table(spark, sf_dir, header: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    cells = [F.concat(F.lit("chr"), F.col("l_suppkey") % 22 + 1), F.col("l_partkey"), F.col("l_partkey") + F.col("l_quantity").cast("long") - 10, F.col("l_returnflag")]
    return readers.hashed_table(spark, as_file(with_lines(li.select(F.concat_ws(",", *[c.cast("string") for c in cells]).alias("value")), header), "table"), ",")


@query(f"WITH {BED} SELECT flag AS \"repClass\", {TOTALS} FROM b WHERE e > s GROUP BY 1")
def repeat_table(spark, sf_dir):
    rows = comma_table(spark, sf_dir, "#genoName,genoStart,genoEnd,repClass")
    name = readers.column_of(rows, ["class", "repclass"])
    return totals(rows.select(name, F.col("genoStart").cast("long").alias("start"), F.col("genoEnd").cast("long").alias("end")).where("end > start"), name)


@query(f"WITH {BED} SELECT chrom, {TOTALS} FROM b WHERE e > s GROUP BY 1")
def quoted_header_table(spark, sf_dir):
    rows = comma_table(spark, sf_dir, '#"chrom","chromStart","chromEnd","name"')
    return totals(rows.select("chrom", F.col("chromStart").cast("long").alias("start"), F.col("chromEnd").cast("long").alias("end")).where("end > start"), "chrom")


@query(f"WITH {BED}, t AS (SELECT s, e, unnest([flag, status]) AS tag FROM b) SELECT tag, {TOTALS} FROM t GROUP BY 1")
def regulatory_tags(spark, sf_dir):
    rows = bed_rows(spark, sf_dir)
    value = F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), F.lit("d"), F.lit("e"), F.concat_ws(", ", F.col("tags")[0], F.col("tags")[1], F.lit("")))
    table = readers.ccre(spark, as_file(rows.select(value.alias("value")), "ccre"))
    return totals(table.select(F.explode(scalar.tags(F.col("tags"))).alias("tag"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")), "tag")


# ---------------------------------------------------------------- sequences

MOTIFS = "m AS (SELECT 'P' || p_partkey AS name, p_name AS description, regexp_replace(upper(regexp_replace(md5(p_partkey::VARCHAR), '[0-9]', '', 'g')), '[^ACGT]', 'N', 'g') AS seq FROM part)"
WEIGHTS = {b: " ".join("0.785714" if x == b else "0.071429" for x in "ACGT") for b in "ACGT"} | {"N": "0.250000 0.250000 0.250000 0.250000"}


def motifs(spark, sf_dir) -> DataFrame:
    p = read(spark, sf_dir, "part")
    h = F.md5(F.col("p_partkey").cast("string"))
    value = F.concat(F.lit("ID   P"), F.col("p_partkey"), F.lit("; SV 1\nDE   "), F.col("p_name"), F.lit("\nSQ   Sequence\n     "), F.substring(h, 1, 16), F.lit(" "), F.substring(h, 17, 16), F.lit(" 32\n//"))
    return readers.embl(spark, as_file(p.select(value.alias("value")), "embl"))


@query(f"WITH {MOTIFS} SELECT name, description, seq FROM m WHERE seq <> ''")
def embl_records(spark, sf_dir):
    return motifs(spark, sf_dir).select("name", "description", "seq")


@query(f"WITH {MOTIFS} SELECT name, md5('MOTIF ' || name || chr(10) || 'letter-probability matrix: alength= 4 w= ' || length(seq) || chr(10) || array_to_string(list_transform(string_split(seq, ''), lambda x: CASE x " + " ".join(f"WHEN '{b}' THEN '{w}'" for b, w in WEIGHTS.items()) + " END), chr(10)) || chr(10)) AS digest FROM m WHERE seq <> ''")
def motif_text(spark, sf_dir):
    rows = motifs(spark, sf_dir).withColumn("rows", sequence.pwm(F.col("seq")))
    text = writers.meme_text(rows, "name", "rows")
    return text.select(F.regexp_extract("value", r"^MOTIF (\S+)", 1).alias("name"), F.md5("value").alias("digest"))


@query(f"WITH {MOTIFS} SELECT 'motif' AS kind, count(*) AS n FROM m WHERE seq <> '' UNION ALL SELECT 'row', sum(length(seq))::BIGINT FROM m UNION ALL SELECT 'head', 1")
def motif_file(spark, sf_dir):
    path = new_path(spark, "meme")
    writers.meme(motifs(spark, sf_dir).withColumn("rows", sequence.pwm(F.col("seq"))), path, "name", "rows")
    kind = F.when(F.col("value").startswith("MOTIF"), "motif").when(F.col("value").rlike(r"^0\.\d{6} "), "row").when(F.col("value").startswith("MEME version"), "head")
    return readers.lines(spark, path).select(kind.alias("kind")).where("kind IS NOT NULL").groupBy("kind").agg(F.count("*").alias("n"))


CHROMOSOMES = "c AS (SELECT 'chr' || c_nationkey AS chrom, string_agg(substr('ACGTN', (c_custkey % 5)::INTEGER + 1, 1), '' ORDER BY c_custkey) AS seq FROM customer GROUP BY 1)"
WINDOWS = "w AS (SELECT DISTINCT 'chr' || (o_custkey % 27) AS chrom, o_orderkey % 70 - 5 AS s, o_orderkey % 70 + 15 AS e FROM orders)"


def chunks(spark, sf_dir) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    letter = F.substring(F.lit("acgtn"), (F.col("c_custkey") % 5 + 1).cast("int"), F.lit(1))
    seq = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", letter.alias("l")))), lambda x: x["l"]), "")
    rows = c.groupBy("c_nationkey").agg(seq.alias("seq"))
    value = F.concat(F.lit(">chr"), F.col("c_nationkey"), F.lit(" described\n"), F.substring("seq", 1, 20), F.lit("\n"), F.col("seq").substr(F.lit(21), F.length("seq")))
    return readers.fasta_chunks(spark, as_file(rows.select(value.alias("value")), "fasta"), 16)


def fasta_windows(spark, sf_dir) -> DataFrame:
    at = F.col("o_orderkey") % 70
    return read(spark, sf_dir, "orders").select(F.concat(F.lit("chr"), F.col("o_custkey") % 27).alias("chrom"), (at - 5).alias("start"), (at + 15).alias("end")).distinct()


@query(f'WITH {CHROMOSOMES}, {WINDOWS} SELECT chrom, s AS start, e AS "end", coalesce(substr(seq, greatest(s, 0) + 1, e - greatest(s, 0)), \'\') AS seq FROM w LEFT JOIN c USING (chrom)')
def fasta_fetch(spark, sf_dir):
    return readers.fetch(fasta_windows(spark, sf_dir), chunks(spark, sf_dir), 16)


@query(f'WITH {CHROMOSOMES}, {WINDOWS} SELECT replace(chrom, \'chr\', \'\') AS chrom, s AS start, e AS "end", coalesce(substr(seq, greatest(s - 7, 0) + 1, e + 7 - greatest(s - 7, 0)), \'\') AS seq FROM w LEFT JOIN c USING (chrom)')
def fasta_fetch_flanked(spark, sf_dir):
    bare = fasta_windows(spark, sf_dir).withColumn("chrom", intervals.prefixed(F.col("chrom"), False))
    return readers.fetch_flanked(bare, chunks(spark, sf_dir), 7, 16)


@query(f"WITH {CHROMOSOMES}, {WINDOWS} SELECT chrom, s AS pos, rpad(repeat('N', greatest(0, 9 - s)::INTEGER) || coalesce(substr(seq, greatest(s - 9, 0) + 1, greatest(s + 10, 0) - greatest(s - 9, 0)), ''), 19, 'N') AS seq FROM w LEFT JOIN c USING (chrom)")
def fasta_fetch_centered(spark, sf_dir):
    return readers.fetch_centered(fasta_windows(spark, sf_dir).select("chrom", F.col("start").alias("pos")), chunks(spark, sf_dir), 9, chunk=16).select("chrom", "pos", "seq")


# ---------------------------------------------------------------- lists, metrics, result trees


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_type = 'error') GROUP BY 1")
def jsonl_round_trip(spark, sf_dir):
    e, path = read(spark, sf_dir, "events").select("event_id", "event_type", "value"), new_path(spark, "jsonl")
    writers.jsonl(e, path)
    writers.jsonl(e.where("event_type = 'error'"), path, append=True)
    got = readers.jsonl(spark, path, "event_id long, event_type string, value double")
    return got.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT DISTINCT p_size::BIGINT AS feature FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')")
def index_lists(spark, sf_dir):
    sizes = read(spark, sf_dir, "part").where("p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')").groupBy("p_brand").agg(F.to_json(F.sort_array(F.collect_set("p_size"))).alias("l"))
    whole = F.when(F.col("p_brand") == "Brand#1", F.col("l")).when(F.col("p_brand") == "Brand#2", F.concat(F.lit('{"dense_features": '), F.col("l"), F.lit("}"))).otherwise(F.concat(F.lit('{"other": [999], "indices": '), F.col("l"), F.lit("}")))
    path = new_path(spark, "lists")
    sizes.select("p_brand", whole.alias("value")).write.partitionBy("p_brand").text(path)
    return readers.index_lists(spark, [path], ["dense_features", "indices"])


@query("SELECT c_nationkey::VARCHAR AS run, round(avg(c_acctbal), 4) AS mse, count(*)::DOUBLE AS n FROM customer GROUP BY 1")
def metrics_files(spark, sf_dir):
    c = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.round(F.avg("c_acctbal"), 4).alias("mse"), F.count("*").alias("n"))
    text = F.concat(F.lit("# run\ntest:\n  reconstruction:\n    mse: "), F.col("mse").cast("string"), F.lit("\n    kind: 'x'\n  sparsity:\n    n: "), F.col("n").cast("string"), F.lit("\n"))
    path = new_path(spark, "metrics")
    c.select(F.col("c_nationkey").alias("run"), text.alias("value")).write.partitionBy("run").text(path)
    got = readers.metrics_file(spark, f"{path}/run=*")
    m = F.col("metrics")
    return got.select(F.regexp_extract("path", r"run=(\d+)", 1).alias("run"), m["test.reconstruction.mse"].alias("mse"), m["test.sparsity.n"].alias("n"))


@query(f"WITH {NEURONS}, d AS (SELECT feature FROM f WHERE fires > 0.52 * (SELECT count(*) FROM embeddings)), k AS (SELECT concept, feature, mcc, '' AS kind FROM m UNION ALL SELECT concept, feature, mcc, 'excluded' FROM m WHERE feature NOT IN (SELECT feature FROM d)) SELECT kind, concept, feature, CAST(rank AS INTEGER) AS rank, round(mcc, 6) AS mcc FROM (SELECT *, row_number() OVER (PARTITION BY kind, concept ORDER BY mcc DESC, feature) AS rank FROM k) WHERE rank <= 10")
def recompute_tree(spark, sf_dir):
    """Counts from stored rates, metrics anew, and two trees: all features, and without the dense ones."""
    stored = assoc(spark, sf_dir).select("concept", "feature", F.col("tp").cast("double").alias("tp"), "fpr", "n_pos", "n_neg")
    rows = association.with_metrics(association.counts_from_rates(stored).drop("fpr"))
    numbers = ["mcc", "f1", "precision", "recall", "enrichment", "log2_enrichment"]
    rows = rows.select("concept", "feature", "tp", "fp", "n_pos", "n_neg", *numbers)
    e, x, _ = neurons(spark, sf_dir)
    dense = x.where("x > 0").groupBy("feature").agg((F.count("*") / F.lit(e.count())).alias("freq")).where("freq > 0.52")
    out = None
    for kind, part in (("", rows), ("excluded", association.exclude(rows, dense))):
        path = new_path(spark, "tree")
        writers.result_tree(part, path, "mcc", numbers)
        top = spark.read.option("header", True).csv(f"{path}/top")
        got = top.select(F.lit(kind).alias("kind"), F.col("concept").cast("long").alias("concept"), F.col("feature").cast("int").alias("feature"), F.col("rank").cast("int").alias("rank"), F.col("mcc").cast("double").alias("mcc"))
        out = got if out is None else out.unionByName(got)
    return out


@query(f"WITH {NEURONS}, k AS (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY f1 DESC, feature) AS r FROM m) SELECT concept, feature, round(f1, 6) AS f1, NULL::DOUBLE AS loss FROM k WHERE r = 1")
def summary_readback(spark, sf_dir):
    path = new_path(spark, "tree")
    writers.result_tree(assoc(spark, sf_dir).select("concept", "feature", "f1"), path, "f1", ["f1"])
    rows = spark.read.option("header", True).csv(f"{path}/summary")
    return readers.with_columns(readers.required(rows, ["concept", "f1"]), {"concept": "long", "feature": "int", "f1": "double", "loss": "double"})


FINALS = "r AS (SELECT 'layer' || (c_nationkey % 3) AS layer, c_custkey % 4 AS step, c_mktsegment AS concept, round(avg(c_acctbal) / 10000, 6) AS f1 FROM customer GROUP BY 1, 2, 3)"


@query(f"WITH {FINALS}, l AS (SELECT layer, avg(f1) FILTER (step = 3) AS ours, avg(f1) FILTER (step = 0) AS base FROM r WHERE concept <> 'MACHINERY' GROUP BY 1) SELECT layer[6:]::INTEGER AS layer, round(ours, 4) AS feature_f1, round(base, 4) AS neuron_f1, round(ours - base, 4) AS delta FROM l")
def final_layer_table(spark, sf_dir):
    """Summaries of all steps written under layer and step folders; the last step against the first one as baseline, without a degenerate concept."""
    from ..operators.sweeps import final_table

    c, path = read(spark, sf_dir, "customer"), new_path(spark, "sweep")
    rows = c.groupBy((F.col("c_nationkey") % 3).alias("layer"), (F.col("c_custkey") % 4).alias("step"), F.col("c_mktsegment").alias("concept")).agg(F.round(F.avg("c_acctbal") / 10_000, 6).alias("f1"))
    bad = rows.limit(1).select("layer", "step", F.lit("BROKEN").alias("concept"), F.lit("n/a").alias("f1"))
    rows.withColumn("f1", F.col("f1").cast("string")).unionByName(bad).withColumnRenamed("concept", "name").write.partitionBy("layer", "step").option("header", True).csv(path)
    tree = readers.result_tree(spark, path, "name string, f1 string")
    good = tree.select("layer", "step", F.col("name").alias("concept"), F.col("f1").try_cast("double").alias("f1")).where("f1 IS NOT NULL")
    out = final_table(good.where("step > 0"), good.where("step = 0"), ["MACHINERY"])
    return out.select("layer", *[F.round(x, 4).alias(x) for x in ("feature_f1", "neuron_f1", "delta")])


@query("SELECT CAST(list_position(['F', 'O'], l_linestatus) AS INTEGER) AS place, l_linestatus AS split, count(*) AS n, count(DISTINCT l_suppkey % 4) AS layers FROM lineitem WHERE l_linestatus IN ('F', 'O') AND l_suppkey % 4 = 1 GROUP BY 1, 2")
def shard_plan(spark, sf_dir):
    li, path = read(spark, sf_dir, "lineitem"), new_path(spark, "shards")
    li.select(F.col("l_linestatus").alias("split"), (F.col("l_suppkey") % 4).alias("layer"), "l_orderkey").write.partitionBy("split", "layer").parquet(path)
    plan = readers.shards(spark, path, ["F", "O"], 1).groupBy("split", "place").agg(F.countDistinct("shard").alias("files")).where("files > 0")
    rows = readers.embeddings(spark, path, ["F", "O"], 1).groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("layer").alias("layers"))
    return plan.join(rows, "split").select("place", "split", "n", "layers")


@query("SELECT n_name AS label, 'here' AS found, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def input_paths(spark, sf_dir):
    """Customers stored by nation in one of several layouts: the first that exists is read, with labels from its path arguments."""
    path = new_path(spark, "layout")
    nations = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").write.partitionBy("c_nationkey").parquet(f"{path}/here")
    found = readers.first_existing(spark, [f"{path}/gone", f"{path}/here", f"{path}/later"])
    names = {r.n_nationkey: r.n_name for r in nations.collect()}  # 25 rows
    held = sorted(r.c_nationkey for r in spark.read.parquet(found).select("c_nationkey").distinct().collect())
    labels = readers.labelled_paths([f"{names[k]}={found}/c_nationkey={k}" for k in held])
    parts = [spark.read.parquet(p).select(F.lit(label).alias("label"), "c_custkey") for label, p in labels.items()]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionAll(part)
    return rows.groupBy("label").agg(F.lit(found.rsplit("/", 1)[-1]).alias("found"), F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))


@query("SELECT user_id, count(*) + count(*) FILTER (event_type = 'click') AS n FROM events GROUP BY 1")
def appended_csv(spark, sf_dir):
    e, path = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), new_path(spark, "csv")
    writers.append_csv(e, path)
    writers.append_csv(e.where("event_type = 'click'"), path)
    return readers.evolved(spark.read.option("header", True).schema("event_id long, user long, event_type string").csv(path), "user_id", ["user"]).groupBy("user_id").agg(F.count("*").alias("n"))
