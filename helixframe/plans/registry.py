"""Every query over the driver's tables, with the SQL that checks it.

The tables stand in for the domain's: suppliers' shipment spans and order dates are intervals and points,
embedding dimensions are neurons, labels are concepts, events are activations. Doubles are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import shared_folder
from ..functions import scalar, sequence
from ..operators import association, blocks, encoders, intervals, nullmodel, statistics, steering, sweeps, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def day(c: str) -> Column:
    return F.datediff(F.col(c), F.lit("1970-01-01").cast("date")).cast("long")


# ---------------------------------------------------------------- association

NEURONS = """x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS feature FROM embeddings),
p AS (SELECT label AS concept, count(*) AS n_pos FROM embeddings GROUP BY 1), f AS (SELECT feature, count(*) AS fires FROM x WHERE v > 0 GROUP BY 1),
t AS (SELECT label AS concept, feature, count(*) AS tp FROM x WHERE v > 0 GROUP BY 1, 2),
c AS (SELECT p.concept, f.feature::INTEGER AS feature, coalesce(tp, 0) AS tp, fires - coalesce(tp, 0) AS fp, n_pos, (SELECT count(*) FROM embeddings) - n_pos AS n_neg FROM p CROSS JOIN f LEFT JOIN t ON t.concept = p.concept AND t.feature = f.feature),
r AS (SELECT *, CASE WHEN n_pos > 0 THEN tp::DOUBLE / n_pos ELSE 0 END AS recall, CASE WHEN n_neg > 0 THEN fp::DOUBLE / n_neg ELSE 0 END AS fpr, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS precision FROM c),
m AS (SELECT *, CASE WHEN (tp + fp)::DOUBLE * n_pos * n_neg * (n_pos - tp + n_neg - fp) > 0 THEN (tp::DOUBLE * (n_neg - fp) - fp::DOUBLE * (n_pos - tp)) / sqrt((tp + fp)::DOUBLE * n_pos * n_neg * (n_pos - tp + n_neg - fp)) ELSE 0 END AS mcc,
 CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1, 2 * recall / (1 + recall + fpr) AS balanced_f1, n_pos::DOUBLE / (n_pos + n_neg) AS prevalence, CASE WHEN fpr > 0 THEN recall / fpr END AS enrichment FROM r)"""


def neurons(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = read(spark, sf_dir, "embeddings")
    x = encoders.long_form(e, "vec_id", "embedding", "feature")
    return e, x, e.select("vec_id", F.col("label").alias("concept"))


def assoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, x, labels = neurons(spark, sf_dir)
    total = e.count()
    return association.with_metrics(association.counts(x.where("x > 0").select("vec_id", "feature"), labels, total, "vec_id"))


@query(f"WITH {NEURONS} SELECT concept, feature, tp, fp, n_pos, n_neg, round(mcc, 6) AS mcc, round(f1, 6) AS f1, round(precision, 6) AS precision, round(recall, 6) AS recall, round(fpr, 6) AS fpr, round(balanced_f1, 6) AS balanced_f1, round(prevalence, 6) AS prevalence, round(enrichment, 6) AS enrichment, round(CASE WHEN enrichment > 0 THEN log2(enrichment) END, 6) AS log2_enrichment FROM m")
def assoc_raw_neuron(spark, sf_dir):
    df = assoc(spark, sf_dir).withColumns({c: association.finite(F.col(c)) for c in ("enrichment", "log2_enrichment")})
    return rounded(df, "mcc", "f1", "precision", "recall", "fpr", "balanced_f1", "prevalence", "enrichment", "log2_enrichment").drop("specificity", "fnr")


@query(SQL["assoc_raw_neuron"])
def assoc_count_blocks(spark, sf_dir):
    """The same from blocks of counts: no token is shuffled, as each holds its label."""
    e = read(spark, sf_dir, "embeddings").select("embedding", F.col("label").cast("string").alias("labels"))
    counts = blocks.association_counts(e, 64, vector="embedding").withColumn("concept", F.col("concept").cast("int"))
    df = association.with_metrics(counts).withColumns({c: association.finite(F.col(c)) for c in ("enrichment", "log2_enrichment")})
    return rounded(df, "mcc", "f1", "precision", "recall", "fpr", "balanced_f1", "prevalence", "enrichment", "log2_enrichment").drop("specificity", "fnr")


@query(f"WITH {NEURONS} SELECT concept, feature, rank, round(mcc, 6) AS mcc FROM (SELECT *, CAST(row_number() OVER (PARTITION BY concept ORDER BY mcc DESC NULLS LAST, feature) AS INTEGER) AS rank FROM m) WHERE rank <= 10")
def assoc_top_features(spark, sf_dir):
    return rounded(association.ranked(assoc(spark, sf_dir), "mcc", top=10).select("concept", "feature", "rank", "mcc"), "mcc")


@query(f"WITH {NEURONS} SELECT concept, feature AS best_feature, round(enrichment, 6) AS enrichment FROM (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY enrichment DESC NULLS LAST, feature) AS r FROM m) WHERE r = 1")
def assoc_best_feature(spark, sf_dir):
    best = association.ranked(assoc(spark, sf_dir), "enrichment", top=1)
    return rounded(best.select("concept", F.col("feature").alias("best_feature"), association.finite(F.col("enrichment")).alias("enrichment")), "enrichment")


@query(f"WITH {NEURONS} SELECT concept, feature, tp, round(f1, 6) AS f1 FROM m WHERE feature NOT IN (SELECT feature FROM f WHERE fires > 0.52 * (SELECT count(*) FROM embeddings))")
def assoc_excl_dense(spark, sf_dir):
    e, x, _ = neurons(spark, sf_dir)
    n = e.count()
    freq = encoders.frequencies(x.select("vec_id", "feature", F.greatest("x", F.lit(0.0)).alias("act")), x.select("feature").distinct(), n)
    return rounded(association.exclude(assoc(spark, sf_dir), freq.where(F.col("freq") > 0.52)).select("concept", "feature", "tp", "f1"), "f1")


@query(f"WITH {NEURONS} SELECT concept, feature, tp, CAST(round_even(fpr * n_neg, 0) AS BIGINT) AS fp FROM m")
def counts_from_rates(spark, sf_dir):
    stored = assoc(spark, sf_dir).select("concept", "feature", F.col("tp").cast("double").alias("tp"), "fpr", "n_neg")
    return association.counts_from_rates(stored).select("concept", "feature", "tp", "fp")


@query(f"WITH {NEURONS} SELECT concept, feature, round((tp + fp)::DOUBLE / (n_pos + n_neg), 6) AS rate, round(1 - recall, 6) AS fnr, round(1 - fpr, 6) AS specificity FROM m")
def firing_rates(spark, sf_dir):
    df = assoc(spark, sf_dir).withColumn("rate", association.firing_rate())
    return rounded(df.select("concept", "feature", "rate", "fnr", "specificity"), "rate", "fnr", "specificity")


# ---------------------------------------------------------------- encoders

NEURON_X = "x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)"


@query(f"WITH {NEURON_X}, a AS (SELECT dim, count(*) FILTER (v > 0) AS n FROM x GROUP BY 1), q AS (SELECT n, n::DOUBLE / (SELECT count(*) FROM embeddings) AS freq FROM a) SELECT round(sum(n)::DOUBLE / (SELECT count(*) FROM embeddings), 6) AS l0, round(100 * sum(n)::DOUBLE / ((SELECT count(*) FROM embeddings) * count(*)), 6) AS l0_pct, count(*) FILTER (freq = 0) AS n_dead, count(*) FILTER (freq > 0.5) AS n_always_on, count(*) FILTER (freq > 0.52) AS n_dense, round(100 * avg(freq), 6) AS mean_freq_pct FROM q")
def sparsity_metrics(spark, sf_dir):
    e, x, _ = neurons(spark, sf_dir)
    n = e.count()
    freq = encoders.frequencies(x.withColumn("act", encoders.relu(F.col("x"))), x.select("feature").distinct(), n)
    return rounded(encoders.sparsity(freq, n, 0.52), "l0", "l0_pct", "mean_freq_pct")


@query(f"WITH {NEURON_X}, w AS (SELECT f AS feature, d AS dim, ((f * 7 + d * 3) % 11 - 5) / 10.0::DOUBLE AS w FROM range(32) a(f), range(64) b(d)), h AS (SELECT vec_id, feature, greatest(sum(v * w) + 0.01 * feature, 0) AS act FROM x JOIN w USING (dim) GROUP BY 1, 2) SELECT vec_id, CAST(feature AS INTEGER) AS feature, round(act, 6) AS act FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY act DESC, feature) AS r FROM h WHERE act > 0) WHERE r <= 4")
def sae_encode_topk(spark, sf_dir):
    return rounded(encoders.encode(read(spark, sf_dir, "embeddings"), toy_weights(spark), 4, "vec_id", "embedding"), "act")


def toy_weights(spark: SparkSession) -> DataFrame:
    """A dictionary of 32 features over 64 dimensions from whole-number arithmetic."""
    ids = spark.range(32 * 64).select((F.col("id") / 64).cast("int").alias("feature"), (F.col("id") % 64).cast("int").alias("dim"))
    return ids.withColumns({"w": ((F.col("feature") * 7 + F.col("dim") * 3) % 11 - 5) / F.lit(10.0), "b": 0.01 * F.col("feature")})


@query(f"WITH {NEURON_X}, s AS (SELECT vec_id, avg(v) AS m, stddev_samp(v) AS s, sqrt(sum(v * v)) AS n FROM x GROUP BY 1), z AS (SELECT x.vec_id, dim, (v - m) / (s + 1e-5) AS z FROM x JOIN s USING (vec_id)) SELECT vec_id, round(n, 6) AS norm, round((SELECT sum(z * (dim + 1)) FROM z WHERE z.vec_id = s.vec_id), 4) AS checksum FROM s")
def unit_norm(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").withColumn("z", encoders.unit_norm(F.col("embedding")))
    check = F.aggregate(F.transform("z", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return e.select("vec_id", F.round(encoders.norm(F.col("embedding")), 6).alias("norm"), F.round(check, 4).alias("checksum"))


@query(f"WITH {NEURON_X}, h AS (SELECT dim, v, CASE WHEN abs(v) >= 0.1 THEN v ELSE 0 END AS y FROM x), d AS (SELECT dim, avg((v - y) * (v - y)) AS m, var_samp(v - y) AS vr, var_samp(v) AS vx FROM h GROUP BY 1) SELECT round(avg(m), 9) AS mse, round(stddev_samp(m), 9) AS mse_std, round(max(m), 9) AS mse_max, round(1 - sum(vr) / sum(vx), 6) AS variance_explained FROM d")
def recon_variance_explained(spark, sf_dir):
    x = encoders.long_form(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    out = statistics.reconstruction(x.withColumn("y", F.when(F.abs("x") >= 0.1, F.col("x")).otherwise(0.0)), "x", "y", "dim")
    return out.select(*[F.round(c, 9).alias(c) for c in ("mse", "mse_std", "mse_max")], F.round("variance_explained", 6).alias("variance_explained"))


@query(f"WITH {NEURON_X}, b AS (SELECT vec_id // 16 AS batch, vec_id * 64 + dim AS id, v FROM x WHERE v > 0), k AS (SELECT batch, v FROM (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY v DESC, id) AS r FROM b) WHERE r <= 64) SELECT round(avg(m), 6) AS theta FROM (SELECT min(v) AS m FROM k GROUP BY batch)")
def batch_topk_threshold(spark, sf_dir):
    x = encoders.long_form(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    rows = x.select((F.col("vec_id") / 16).cast("long").alias("batch"), (F.col("vec_id") * 64 + F.col("dim")).alias("id"), F.col("x").alias("act"))
    return rounded(topk.threshold(topk.batch_top(rows, "batch", 64, "act", "id"), "batch", "act"), "theta")


@query("WITH g AS (SELECT user_id, event_id, value < 50 AS z FROM events), c AS (SELECT *, sum(CASE WHEN z THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS grp FROM g) SELECT event_id, CAST(sum(CASE WHEN z THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, grp ORDER BY event_id) AS BIGINT) AS run FROM c")
def dead_counter(spark, sf_dir):
    return topk.runs(read(spark, sf_dir, "events"), ["user_id"], "event_id", F.col("value") < 50).select("event_id", F.col("run").cast("long").alias("run"))


# ---------------------------------------------------------------- intervals

SPANS = """spans AS (SELECT l_suppkey AS key, date_diff('day', DATE '1970-01-01', l_shipdate::DATE) AS s, date_diff('day', DATE '1970-01-01', l_shipdate::DATE) + l_quantity::BIGINT AS e FROM lineitem),
fl AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM spans),
isl AS (SELECT *, sum(n) OVER (PARTITION BY key ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM fl),
merged AS (SELECT key, min(s) AS s, max(e) AS e FROM isl GROUP BY key, i)"""
POINTS = "pts AS (SELECT o_orderkey, o_custkey % 100 + 1 AS key, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS pos FROM orders)"


def spans(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    return li.select(*more, F.col("l_suppkey").alias("key"), day("l_shipdate").alias("start"), (day("l_shipdate") + F.col("l_quantity").cast("long")).alias("end"))


def order_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select("o_orderkey", (F.col("o_custkey") % 100 + 1).alias("key"), day("o_orderdate").alias("pos"))


# By part, spans leave gaps, so that hits and misses both occur; by supplier they cover nearly all. Orders meet parts by customer key.
FINE = SPANS.replace("SELECT l_suppkey AS key", "SELECT l_partkey AS key")
FINE_POINTS = POINTS.replace("o_custkey % 100 + 1 AS key", "o_custkey AS key")


def fine_spans(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    return li.select(*more, F.col("l_partkey").alias("key"), day("l_shipdate").alias("start"), (day("l_shipdate") + F.col("l_quantity").cast("long")).alias("end"))


def fine_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("key"), day("o_orderdate").alias("pos"))


@query(f'WITH {SPANS} SELECT key, s AS start, e AS "end" FROM merged')
def interval_merge(spark, sf_dir):
    return intervals.merge_intervals(spans(spark, sf_dir), bin_width=512)


@query(f'WITH {FINE} SELECT key, e AS start, nx AS "end" FROM (SELECT *, lead(s) OVER (PARTITION BY key ORDER BY s) AS nx FROM merged) WHERE e < nx')
def gaps_between(spark, sf_dir):
    return intervals.gaps(fine_spans(spark, sf_dir))


@query(f"WITH {FINE}, {FINE_POINTS} SELECT o_orderkey FROM pts WHERE EXISTS (SELECT 1 FROM spans WHERE spans.key = pts.key AND s <= pos AND pos < e)")
def interval_overlap_semi(spark, sf_dir):
    rows = fine_points(spark, sf_dir).withColumns({"start": F.col("pos"), "end": F.col("pos") + 1})
    return intervals.overlap_semi(rows, fine_spans(spark, sf_dir)).select("o_orderkey")


@query(f"WITH {FINE}, {FINE_POINTS} SELECT o_orderkey, pos FROM pts WHERE NOT EXISTS (SELECT 1 FROM spans WHERE spans.key = pts.key AND s < pos + 20 AND pos < e)")
def interval_overlap_anti(spark, sf_dir):
    rows = fine_points(spark, sf_dir).withColumns({"start": F.col("pos"), "end": F.col("pos") + 20})
    return intervals.overlap_anti(rows, fine_spans(spark, sf_dir)).select("o_orderkey", "pos")


@query(f"WITH {FINE}, {FINE_POINTS}, d AS (SELECT key, s, max(e) AS e FROM spans GROUP BY 1, 2) SELECT o_orderkey, coalesce(pos < e, false) AS hit FROM pts ASOF LEFT JOIN d ON pts.key = d.key AND pts.pos >= d.s")
def asof_containment(spark, sf_dir):
    return intervals.asof_contains(fine_points(spark, sf_dir), fine_spans(spark, sf_dir)).select("o_orderkey", "hit")


@query(f"WITH {FINE}, {FINE_POINTS} SELECT o_orderkey, EXISTS (SELECT 1 FROM spans WHERE spans.key = pts.key AND s <= pos AND pos < e) AS hit FROM pts")
def true_containment(spark, sf_dir):
    return intervals.asof_contains(fine_points(spark, sf_dir), fine_spans(spark, sf_dir), mode="overlap").select("o_orderkey", "hit")


@query(f"WITH {FINE_POINTS} SELECT DISTINCT o_orderkey, l_returnflag AS concept FROM pts JOIN lineitem ON l_partkey = key WHERE date_diff('day', DATE '1970-01-01', l_shipdate::DATE) <= pos AND pos < date_diff('day', DATE '1970-01-01', l_shipdate::DATE) + l_quantity::BIGINT")
def label_tokens(spark, sf_dir):
    rows = fine_spans(spark, sf_dir, F.col("l_returnflag").alias("concept"))
    return intervals.label_points(fine_points(spark, sf_dir), rows).select("o_orderkey", "concept")


# The same operators by supplier: few keys with many spans each.


@query(f'WITH {SPANS} SELECT key, e AS start, nx AS "end" FROM (SELECT *, lead(s) OVER (PARTITION BY key ORDER BY s) AS nx FROM merged) WHERE e < nx')
def gaps_between_whole(spark, sf_dir):
    return intervals.gaps(spans(spark, sf_dir))


@query(f"WITH {SPANS}, {POINTS} SELECT o_orderkey FROM pts WHERE EXISTS (SELECT 1 FROM spans WHERE spans.key = pts.key AND s <= pos AND pos < e)")
def interval_overlap_semi_whole(spark, sf_dir):
    rows = order_points(spark, sf_dir).withColumns({"start": F.col("pos"), "end": F.col("pos") + 1})
    return intervals.overlap_semi(rows, spans(spark, sf_dir)).select("o_orderkey")


@query(f"WITH {SPANS}, {POINTS} SELECT o_orderkey, pos FROM pts WHERE NOT EXISTS (SELECT 1 FROM spans WHERE spans.key = pts.key AND s < pos + 20 AND pos < e)")
def interval_overlap_anti_whole(spark, sf_dir):
    rows = order_points(spark, sf_dir).withColumns({"start": F.col("pos"), "end": F.col("pos") + 20})
    return intervals.overlap_anti(rows, spans(spark, sf_dir)).select("o_orderkey", "pos")


@query(f"WITH {SPANS}, {POINTS}, d AS (SELECT key, s, max(e) AS e FROM spans GROUP BY 1, 2) SELECT o_orderkey, coalesce(pos < e, false) AS hit FROM pts ASOF LEFT JOIN d ON pts.key = d.key AND pts.pos >= d.s")
def asof_containment_whole(spark, sf_dir):
    return intervals.asof_contains(order_points(spark, sf_dir), spans(spark, sf_dir)).select("o_orderkey", "hit")


@query(f"WITH {SPANS}, {POINTS} SELECT o_orderkey, EXISTS (SELECT 1 FROM spans WHERE spans.key = pts.key AND s <= pos AND pos < e) AS hit FROM pts")
def true_containment_whole(spark, sf_dir):
    return intervals.asof_contains(order_points(spark, sf_dir), spans(spark, sf_dir), mode="overlap").select("o_orderkey", "hit")


@query(f"WITH {POINTS} SELECT DISTINCT o_orderkey, l_returnflag AS concept FROM pts JOIN lineitem ON l_suppkey = key WHERE date_diff('day', DATE '1970-01-01', l_shipdate::DATE) <= pos AND pos < date_diff('day', DATE '1970-01-01', l_shipdate::DATE) + l_quantity::BIGINT")
def label_tokens_whole(spark, sf_dir):
    rows = spans(spark, sf_dir, F.col("l_returnflag").alias("concept"))
    return intervals.label_points(order_points(spark, sf_dir), rows).select("o_orderkey", "concept")


@query(f"WITH {SPANS} SELECT key, sum(e - s)::BIGINT AS covered, (SELECT sum(e - s)::BIGINT FROM spans x WHERE x.key = merged.key) AS raw FROM merged GROUP BY key")
def coverage_sums(spark, sf_dir):
    return intervals.coverage(spans(spark, sf_dir))


@query(f'WITH {SPANS} SELECT key, greatest(s, 8000) AS start, least(e, 9000) AS "end", count(*) AS n FROM spans WHERE s < 9000 AND e > 8000 GROUP BY 1, 2, 3')
def region_clamp(spark, sf_dir):
    return intervals.clamp(spans(spark, sf_dir), 8000, 9000).groupBy("key", "start", "end").agg(F.count("*").alias("n"))


@query('SELECT o_orderkey AS key, x AS start, x + 16384 AS "end" FROM (SELECT o_orderkey, unnest(range(0, greatest(o_totalprice::BIGINT - 16384 + 1, 0), 16384)) AS x FROM orders)')
def tumbling_coord_windows(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.bround("o_totalprice", 0).cast("long").alias("length"))
    return intervals.tumble(o, 16_384)


@query('SELECT o_orderkey AS key, x AS start, least(x + 16384, len) AS "end" FROM (SELECT o_orderkey, o_totalprice::BIGINT AS len, unnest(range(0, o_totalprice::BIGINT, 16384)) AS x FROM orders)')
def coord_windows_with_tail(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.bround("o_totalprice", 0).cast("long").alias("length"))
    return intervals.tumble(o, 16_384, keep_tail=True)


NATION_BINS = "b AS (SELECT DISTINCT s_nationkey AS nation, l_orderkey // 7 AS bin FROM lineitem JOIN supplier ON l_suppkey = s_suppkey), z AS (SELECT nation, count(*) AS n FROM b GROUP BY 1), i AS (SELECT x.nation AS a, y.nation AS b, count(*) AS \"both\" FROM b x JOIN b y USING (bin) GROUP BY 1, 2), j AS (SELECT p.nation AS a, q.nation AS b, p.n AS n_a, q.n AS n_b, coalesce(\"both\", 0) AS \"both\" FROM z p CROSS JOIN z q LEFT JOIN i ON i.a = p.nation AND i.b = q.nation)"


def nation_bins(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = li.select(F.col("s_nationkey").alias("nation"), F.col("l_orderkey").alias("start"), (F.col("l_orderkey") + 1).alias("end"))
    return intervals.set_overlap(intervals.bins_of(rows, 7, "nation", distinct=False), "nation", ["bin"])


@query(f"WITH {NATION_BINS} SELECT a, b, n_a, n_b, \"both\", round(\"both\"::DOUBLE / (n_a + n_b - \"both\"), 6) AS jaccard, round(\"both\"::DOUBLE / n_a, 6) AS b_given_a FROM j")
def interval_jaccard(spark, sf_dir):
    return rounded(nation_bins(spark, sf_dir), "jaccard", "b_given_a")


@query(f"WITH {NATION_BINS} SELECT DISTINCT CASE WHEN length(a::VARCHAR) > length(b::VARCHAR) THEN a ELSE b END AS dropped FROM j WHERE a < b AND \"both\"::DOUBLE / (n_a + n_b - \"both\") >= 0.5")
def redundant_concepts(spark, sf_dir):
    return intervals.redundant(nation_bins(spark, sf_dir), 0.5)


@query(f'WITH {FINE}, pos AS (SELECT DISTINCT key, unnest(range(s - 8000, e - 8000)) AS p FROM spans), h AS (SELECT key, p // 30 AS bin, count(*) AS n FROM pos WHERE p >= 0 AND p < 1000 GROUP BY 1, 2), k AS (SELECT key, bin FROM (SELECT DISTINCT key FROM spans), range(34) t(bin)) SELECT key, bin, CAST(coalesce(n, 0) > 0 AS INTEGER) AS "any", CAST(coalesce(n, 0) = 30 AS INTEGER) AS "all", round(coalesce(n, 0) / 30.0::DOUBLE, 6) AS frac FROM k LEFT JOIN h USING (key, bin)')
def base_mask_bins(spark, sf_dir):
    rows = fine_spans(spark, sf_dir).withColumns({"start": F.col("start") - 8000, "end": F.col("end") - 8000})
    return rounded(intervals.mask_bins(rows, 1000, 30), "frac")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'chr' || c_nationkey ELSE c_nationkey::VARCHAR END AS name, 'chr' || c_nationkey AS with_chr, c_nationkey::VARCHAR AS without_chr, CASE WHEN c_nationkey IN (1, 2, 3) THEN 'train' WHEN c_nationkey = 4 THEN 'test' ELSE 'other' END AS split, (SELECT sum(CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END) * 2 >= count(*) FROM customer) AS use_chr FROM customer")
def chromosome_names(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("chr"), F.col("c_nationkey").cast("string"))).otherwise(F.col("c_nationkey").cast("string")).alias("name"))
    bare = intervals.prefixed(F.col("name"), False)
    vote = F.broadcast(intervals.uses_prefix(c, "name"))
    return c.select("c_custkey", "name", intervals.prefixed(F.col("name"), True).alias("with_chr"), bare.alias("without_chr"), intervals.split_of(bare, ["1", "2", "3"], ["4"]).alias("split")).crossJoin(vote)


# ---------------------------------------------------------------- top-k, crosstabs, matching


@query("WITH a AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events), w AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY value DESC, event_id) AS k FROM a WHERE r <= 50) SELECT event_type, user_id, event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) - 1 AS INTEGER) AS rank, round(value, 6) AS value FROM w WHERE k = 1")
def topn_dedup_windows(spark, sf_dir):
    out = topk.top_windows(read(spark, sf_dir, "events"), 50, "event_type", ["user_id"], "value", "event_id")
    return rounded(out.select("event_type", "user_id", "event_id", "rank", "value"), "value")


def memberships(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    base = [F.when(F.col("c_acctbal") > 5000, "rich"), F.when(F.col("c_nationkey") < 10, "low"), F.when(F.col("c_custkey") % 3 == 0, "third")]
    members = c.select(F.col("c_custkey").alias("token"), F.explode(F.array(*base)).alias("concept")).where("concept IS NOT NULL")
    return c.select(F.col("c_custkey").alias("token"), F.col("c_mktsegment").alias("feature")), members


MEMBERS = "t AS (SELECT c_custkey AS token, c_mktsegment AS feature, c_acctbal > 5000 AS rich, c_nationkey < 10 AS low, c_custkey % 3 = 0 AS third FROM customer)"


@query(f"WITH {MEMBERS}, l AS (SELECT feature, 'rich' AS concept, rich AS h FROM t UNION ALL SELECT feature, 'low', low FROM t UNION ALL SELECT feature, 'third', third FROM t) SELECT feature, concept, count(*) AS n_total, count(*) FILTER (h) AS n, round(100.0::DOUBLE * count(*) FILTER (h) / count(*), 6) AS pct FROM l GROUP BY 1, 2")
def concept_crosstab(spark, sf_dir):
    return rounded(topk.crosstab(*memberships(spark, sf_dir)), "pct")


@query(f"WITH {MEMBERS} SELECT feature, count(*) FILTER (rich) AS n_rich, count(*) FILTER (low) AS n_low, count(*) FILTER (third) AS n_third, round(100.0::DOUBLE * count(*) FILTER (rich) / count(*), 6) AS pct_rich, round(100.0::DOUBLE * count(*) FILTER (low) / count(*), 6) AS pct_low, round(100.0::DOUBLE * count(*) FILTER (third) / count(*), 6) AS pct_third, count(*) FILTER (NOT rich AND NOT low AND NOT third) AS n_neither FROM t GROUP BY 1")
def concept_crosstab_wide(spark, sf_dir):
    tokens, members = memberships(spark, sf_dir)
    wide = topk.wide(rounded(topk.crosstab(tokens, members), "pct"), "feature", "concept", ["n", "pct"], ["rich", "low", "third"])
    return wide.join(topk.neither(tokens, members), "feature")


@query(f"WITH {MEMBERS}, l AS (SELECT feature, 'low' AS a, 'rich' AS b, low AS x, rich AS y FROM t UNION ALL SELECT feature, 'low', 'third', low, third FROM t UNION ALL SELECT feature, 'rich', 'third', rich, third FROM t) SELECT feature, a, b, count(*) AS n_total, count(*) FILTER (x AND NOT y) AS n_a_only, count(*) FILTER (y AND NOT x) AS n_b_only, count(*) FILTER (x AND y) AS n_both, count(*) FILTER (NOT x AND NOT y) AS n_neither FROM l GROUP BY 1, 2, 3")
def pairwise_venn(spark, sf_dir):
    tokens, members = memberships(spark, sf_dir)
    return topk.venn(tokens, members, topk.concept_pairs(members))


@query("SELECT event_id, CAST(CASE WHEN max(greatest(value, 0)) OVER (PARTITION BY event_type) > 0 THEN round_even(10 * greatest(value, 0) / max(greatest(value, 0)) OVER (PARTITION BY event_type), 0) ELSE 0 END AS INTEGER) AS norm FROM events")
def norm_0_10(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", topk.scaled_0_10(F.col("value"), "event_type").alias("norm"))


@query("SELECT user_id, event_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank BETWEEN 4 AND 8")
def holdout_slice(spark, sf_dir):
    return topk.rank_slice(read(spark, sf_dir, "events"), ["user_id"], [F.desc("value"), F.asc("event_id")], 4, 8).select("user_id", "event_id", "rank")


PARTS = "t AS (SELECT p_partkey AS id, p_size AS size, p_retailprice / 10000 AS rate, (p_partkey % 21 - 10) / 100.0::DOUBLE AS mcc FROM part)"
#: The next pool row below and above each rate, and the lowest other id at the rate itself.
CONTROLS = """p AS (SELECT id, rate FROM t WHERE rate > 0 AND abs(mcc) <= 0.05), g AS (SELECT rate, min(id) AS id, CASE WHEN count(*) > 1 THEN (list_sort(list(id)))[2] END AS id2 FROM p GROUP BY 1),
lo AS (SELECT t.id AS target, g.id AS control, t.rate - g.rate AS gap FROM t ASOF JOIN g ON t.rate > g.rate), hi AS (SELECT t.id AS target, g.id AS control, g.rate - t.rate AS gap FROM t ASOF JOIN g ON t.rate < g.rate),
eq AS (SELECT t.id AS target, CASE WHEN g.id <> t.id THEN g.id ELSE g.id2 END AS control, 0.0::DOUBLE AS gap FROM t JOIN g ON t.rate = g.rate), c AS (SELECT * FROM lo UNION ALL SELECT * FROM hi UNION ALL SELECT * FROM eq WHERE control IS NOT NULL)"""


def part_rates(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size", (F.col("p_retailprice") / 10_000).alias("rate"), ((F.col("p_partkey") % 21 - 10) / 100.0).alias("mcc"))


@query(f"WITH {PARTS}, {CONTROLS} SELECT target, control, round(gap, 6) AS gap FROM c QUALIFY row_number() OVER (PARTITION BY target ORDER BY gap, control) = 1")
def nearest_rate_control(spark, sf_dir):
    return rounded(topk.nearest_controls(part_rates(spark, sf_dir), 0.05), "gap")


@query(SQL["nearest_rate_control"])
def nearest_rate_control_whole(spark, sf_dir):
    """The same, under the name that it had while nearest_rate_control took a part of the targets."""
    return nearest_rate_control(spark, sf_dir)


@query(f"WITH {PARTS} SELECT target, control, round(gap, 6) AS gap FROM (SELECT a.id AS target, b.id AS control, abs(a.rate - b.rate) AS gap, row_number() OVER (PARTITION BY a.id ORDER BY abs(a.rate - b.rate), b.id) AS k FROM t a JOIN t b ON a.size = b.size AND b.id <> a.id AND b.rate > 0 AND abs(b.mcc) <= 0.05) WHERE k = 1")
def nearest_control_by_size(spark, sf_dir):
    pool = part_rates(spark, sf_dir)
    return rounded(topk.nearest_controls(pool, 0.05, keys=["p_size"]).select("target", "control", "gap"), "gap")


# Of each size, the parts with a high mcc are the group, those with a low one the pool.
@query(f"""WITH RECURSIVE {PARTS}, w AS (SELECT *, row_number() OVER (PARTITION BY size ORDER BY id) AS k FROM t WHERE mcc >= 0.08), want AS (SELECT * FROM w WHERE k <= 5), f AS (SELECT * FROM t WHERE rate > 0 AND abs(mcc) <= 0.05),
ok AS (SELECT size FROM (SELECT size, count(*) AS n FROM want GROUP BY 1) JOIN (SELECT size, count(*) AS free FROM f GROUP BY 1) USING (size) WHERE free >= n),
step(size, k, target, control, used) AS (
  SELECT size, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, []::BIGINT[] FROM ok
  UNION ALL
  SELECT s.size, want.k, want.id, c.id, list_append(s.used, c.id) FROM step s JOIN want ON want.size = s.size AND want.k = s.k + 1,
  LATERAL (SELECT arg_min(f.id, (abs(f.rate - want.rate), f.id)) AS id FROM f WHERE f.size = s.size AND NOT list_contains(s.used, f.id)) c)
SELECT size AS p_size, target, control FROM step WHERE k > 0""")
def greedy_group_control(spark, sf_dir):
    pool = part_rates(spark, sf_dir)
    return topk.greedy_controls(pool.where("mcc >= 0.08").select(F.col("id").alias("target"), "p_size", "rate"), pool, 5, 0.05, ["p_size"])


@query("SELECT c_mktsegment, c_custkey, CAST(dense_rank() OVER (ORDER BY f) - 1 AS INTEGER) AS code FROM (SELECT *, min(c_custkey) OVER (PARTITION BY c_mktsegment) AS f FROM customer)")
def ordinal_codes(spark, sf_dir):
    return topk.ordinal(read(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey").select("c_mktsegment", "c_custkey", "code")


@query("WITH o AS (SELECT *, sum(c_acctbal) OVER (ORDER BY c_custkey) AS hi, sum(c_acctbal) OVER () AS total FROM customer WHERE c_acctbal > 0) SELECT c_custkey, CAST(ceil(hi / total * 500 - 0.5) - ceil((hi - c_acctbal) / total * 500 - 0.5) AS BIGINT) AS draws FROM o WHERE ceil(hi / total * 500 - 0.5) - ceil((hi - c_acctbal) / total * 500 - 0.5) > 0")
def weighted_draws(spark, sf_dir):
    return topk.weighted_sample(read(spark, sf_dir, "customer").where("c_acctbal > 0"), 500, "c_acctbal", "c_custkey").groupBy("c_custkey").agg(F.count("*").alias("draws"))


@query("SELECT c_custkey FROM customer ORDER BY substr(md5('7|' || c_custkey::VARCHAR), 1, 15), c_custkey LIMIT 100")
def seeded_sample(spark, sf_dir):
    return topk.seeded_sample(read(spark, sf_dir, "customer").select("c_custkey"), 100, ["c_custkey"], 7)


@query("SELECT l.doc_id, CASE WHEN coalesce(d.n_chars % 2 = 0 AND d.n_chars > 1000, false) THEN d.n_chars ELSE l.quality * 10 END::BIGINT AS score, coalesce(d.n_chars % 2 = 0 AND d.n_chars > 1000, false) AS overridden FROM labels l LEFT JOIN documents d USING (doc_id)")
def merge_explanations(spark, sf_dir):
    first = read(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 10).cast("long").alias("score"))
    again = read(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("score"))
    return topk.override(first, again, "doc_id", (F.col("r.score") % 2 == 0) & (F.col("r.score") > 1000), ["score"])


# ---------------------------------------------------------------- statistics and null models

SEGMENTS = "g AS (SELECT c_nationkey AS id, c_mktsegment AS grp, (1 + count(*) FILTER (c_acctbal > 5000))::DOUBLE / (2 + count(*)) AS p FROM customer GROUP BY 1, 2)"


def segment_p(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    rich = F.sum((F.col("c_acctbal") > 5000).cast("long"))
    return c.groupBy(F.col("c_nationkey").alias("id"), F.col("c_mktsegment").alias("grp")).agg(((1 + rich) / (2 + F.count("*"))).alias("p"))


@query(f"WITH {SEGMENTS}, s AS (SELECT *, p * count(*) OVER (PARTITION BY grp) / row_number() OVER (PARTITION BY grp ORDER BY p, id) AS s FROM g) SELECT id, grp, round(p, 6) AS p, round(least(1, min(s) OVER (PARTITION BY grp ORDER BY p, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM s")
def bh_fdr(spark, sf_dir):
    return rounded(statistics.bh(segment_p(spark, sf_dir), "p", ["grp"], "id"), "p", "q")


@query("SELECT o_orderstatus, count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, round(min(o_totalprice), 4) AS min, round(max(o_totalprice), 4) AS max, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.9), 4) AS p90, round(quantile_cont(o_totalprice, 0.99), 4) AS p99, round(quantile_cont(o_totalprice, 0.999), 4) AS p99_9 FROM orders GROUP BY 1")
def percentile_summary(spark, sf_dir):
    out = statistics.summary(read(spark, sf_dir, "orders"), "o_totalprice", ["o_orderstatus"])
    return out.withColumns({c: F.round(c, 4) for c in out.columns if c not in ("o_orderstatus", "n")})


@query("SELECT l_suppkey, count(*) AS n, round(CASE WHEN count(*) >= 3 AND var_pop(l_quantity) > 0 AND var_pop(l_extendedprice) > 0 THEN corr(l_quantity, l_extendedprice) ELSE 0 END, 6) AS r FROM lineitem GROUP BY 1")
def running_corr(spark, sf_dir):
    out = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), statistics.correlation("l_quantity", "l_extendedprice", 3, 0.0).alias("r"))
    return rounded(out, "r")


@query("SELECT p_type, n FROM (SELECT p_type, count(*) AS n FROM part GROUP BY 1) ORDER BY n DESC, p_type LIMIT 20")
def value_counts(spark, sf_dir):
    return statistics.value_counts(read(spark, sf_dir, "part"), "p_type", 20)


@query("WITH s AS (SELECT count(*) AS c0, count(*) FILTER (l_quantity > 10) AS c1, count(*) FILTER (l_quantity > 10 AND l_returnflag = 'R') AS c2, count(*) FILTER (l_quantity > 10 AND l_returnflag = 'R' AND l_discount > 0.05) AS c3 FROM lineitem) SELECT 0::INTEGER AS step, 'all' AS name, c0 AS n FROM s UNION ALL SELECT 1, 'quantity', c1 FROM s UNION ALL SELECT 2, 'returned', c2 FROM s UNION ALL SELECT 3, 'discounted', c3 FROM s")
def filter_funnel(spark, sf_dir):
    return statistics.funnel(read(spark, sf_dir, "lineitem"), [("quantity", F.col("l_quantity") > 10), ("returned", F.col("l_returnflag") == "R"), ("discounted", F.col("l_discount") > 0.05)])


TOKENS = "ev AS (SELECT user_id AS w, (event_id % 64) AS tok, event_type AS concept, (value * 10)::BIGINT % 4 AS feature FROM events), a AS (SELECT DISTINCT w, tok, feature FROM ev), l AS (SELECT DISTINCT w, tok, concept FROM ev)"


def null_tables(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("window"), (F.col("event_id") % 64).alias("tok"), F.col("event_type").alias("concept"), (F.bround(F.col("value") * 10, 0).cast("long") % 4).alias("feature"))
    return e.select("window", "tok", "feature").distinct(), e.select("window", "tok", "concept").distinct()


@query(f"WITH {TOKENS}, obs AS (SELECT concept, feature, count(*) AS tp FROM a JOIN l USING (w, tok) GROUP BY 1, 2), sh AS (SELECT perm, w, (tok + 7 * perm + 3 * w) % 64 AS tok, concept FROM l, range(20) p(perm)), nl AS (SELECT perm, concept, feature, count(*) AS tp FROM a JOIN sh USING (w, tok) GROUP BY 1, 2, 3) SELECT concept, feature, obs.tp AS observed, round(avg(nl.tp), 6) AS null_mean, round(stddev_pop(nl.tp), 6) AS null_std, round(quantile_cont(nl.tp, 0.95), 6) AS null_q95, count(*) FILTER (nl.tp >= obs.tp) AS exceed, round((1 + count(*) FILTER (nl.tp >= obs.tp)) / 21.0::DOUBLE, 6) AS p FROM nl JOIN obs USING (concept, feature) GROUP BY 1, 2, 3")
def null_circular_shift(spark, sf_dir):
    active, labels = null_tables(spark, sf_dir)
    shifted = nullmodel.circular_shift(labels, 20, F.lit(64), 7 * F.col("perm") + 3 * F.col("window"))
    null = nullmodel.true_positives(active, shifted, ["window", "tok"], ["concept", "feature"])
    observed = active.join(labels, ["window", "tok"]).groupBy("concept", "feature").agg(F.count("*").alias("tp"))
    return rounded(nullmodel.summarize(null, observed, ["concept", "feature"], "tp", 20), "null_mean", "null_std", "null_q95", "p")


@query(f"WITH {TOKENS}, pr AS (SELECT DISTINCT concept, feature FROM a JOIN l USING (w)), sh AS (SELECT perm, w, (tok + perm + 3 * w) % 64 AS tok, concept FROM l, range(64) p(perm)), nl AS (SELECT perm, concept, feature, count(*) AS tp FROM a JOIN sh USING (w, tok) GROUP BY 1, 2, 3) SELECT concept, feature, CAST(p.perm AS INTEGER) AS perm, coalesce(tp, 0) AS tp FROM (SELECT * FROM pr, range(64) p(perm)) p LEFT JOIN nl USING (concept, feature, perm)")
def null_all_shifts(spark, sf_dir):
    """The hits of all 64 circular shifts, each window by a step of its own, without a row a shift."""
    active, labels = null_tables(spark, sf_dir)
    windows = labels.select("window").distinct()
    shifts = windows.select("window", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda p: p + 3 * F.col("window")).alias("shifts"))
    return blocks.shift_hits(active, labels, shifts, 64)


BLOCKS = TOKENS + ", win AS (SELECT DISTINCT w % 5 AS shard, w FROM l), pw AS (SELECT perm, shard, w, row_number() OVER (PARTITION BY shard, perm ORDER BY w) AS r, row_number() OVER (PARTITION BY shard, perm ORDER BY (w * 7919 + perm * 104729) % 1009, w) AS k FROM win, range(10) p(perm)), mv AS (SELECT x.perm, x.w, y.w AS to_w FROM pw x JOIN pw y ON x.perm = y.perm AND x.shard = y.shard AND x.r = y.k), sh AS (SELECT perm, to_w AS w, tok, concept FROM l JOIN mv USING (w)), nl AS (SELECT perm, concept, feature, count(*) AS tp FROM a JOIN sh USING (w, tok) GROUP BY 1, 2, 3)"


def block_null(spark, sf_dir):
    active, labels = null_tables(spark, sf_dir)
    sharded = labels.withColumn("shard", F.col("window") % 5)
    order = (F.col("window") * 7919 + F.col("perm") * 104_729) % 1009
    moved = nullmodel.block_permutation(sharded, sharded, 10, order)
    return nullmodel.true_positives(active, moved, ["window", "tok"], ["concept", "feature"])


@query(f"WITH {BLOCKS} SELECT CAST(perm AS INTEGER) AS perm, concept, feature, tp FROM nl")
def null_block_permutation(spark, sf_dir):
    return block_null(spark, sf_dir)


@query(f"WITH {BLOCKS}, m AS (SELECT concept, perm, max(tp) AS m FROM nl GROUP BY 1, 2) SELECT concept, round(avg(m), 6) AS max_mean, round(quantile_cont(m, 0.95), 6) AS max_q95 FROM m GROUP BY 1")
def null_max_over_candidates(spark, sf_dir):
    return rounded(nullmodel.max_over(block_null(spark, sf_dir), "concept", "tp"), "max_mean", "max_q95")


@query("SELECT o_orderkey, round(CASE WHEN abs(z - o) > 1e-12 THEN 100 * greatest(0, least(1, 1 - (s - o) / (z - o))) ELSE 0 END, 6) AS recovered FROM (SELECT o_orderkey, 1.0::DOUBLE AS o, 1 + o_totalprice / 100000 AS z, 1 + (o_orderkey % 100) / 50.0::DOUBLE AS s FROM orders)")
def loss_recovered(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.round(statistics.recovered(F.lit(1.0), 1 + F.col("o_totalprice") / 100_000, 1 + (F.col("o_orderkey") % 100) / 50.0), 6).alias("recovered"))


# ---------------------------------------------------------------- sweeps


@query(f"WITH {NEURONS}, tau AS (SELECT unnest([0.1, 0.15, 0.2, 0.25]::DOUBLE[]) AS tau), c2 AS (SELECT tau, feature, count(*) FILTER (f1 >= tau) AS n FROM m, tau GROUP BY 1, 2) SELECT tau, round(avg(n), 6) AS mean_concepts, round(avg(n) FILTER (n > 0), 6) AS mean_interpretable, count(*) FILTER (n > 0) AS n_interpretable, count(*) FILTER (n = 1) AS n_mono, count(*) FILTER (n >= 2) AS n_poly FROM c2 GROUP BY 1")
def poly_sweep(spark, sf_dir):
    return rounded(sweeps.polysemanticity(assoc(spark, sf_dir), sweeps.grid(spark, tau=(0.1, 0.15, 0.2, 0.25))), "mean_concepts", "mean_interpretable")


SIDES = NEURONS + ", ours AS (SELECT concept, max(f1) AS v FROM m WHERE feature % 2 = 0 GROUP BY 1), base AS (SELECT concept, max(f1) AS b FROM m WHERE feature % 2 = 1 GROUP BY 1)"


def sides(spark, sf_dir):
    a = assoc(spark, sf_dir)
    best = lambda r: a.where(F.col("feature") % 2 == r).groupBy("concept").agg(F.max("f1").alias("f1"))
    return best(0), best(1)


@query(f"WITH {SIDES}, tau AS (SELECT unnest([0.1, 0.18, 0.2]::DOUBLE[]) AS tau) SELECT tau, count(*) FILTER (v > b + 1e-4 AND v >= tau AND b >= tau) AS wins, count(*) FILTER (abs(v - b) <= 1e-4) AS ties, count(*) AS n FROM ours JOIN base USING (concept), tau GROUP BY 1")
def sae_vs_neuron(spark, sf_dir):
    return sweeps.wins(*sides(spark, sf_dir), sweeps.grid(spark, tau=(0.1, 0.18, 0.2)))


@query(f"WITH {SIDES} SELECT round(avg(v), 6) AS mean_best, round(max(v), 6) AS max_best, round(avg(v - b), 6) AS mean_delta, count(*) FILTER (abs(v - 2 / 3.0::DOUBLE) <= 1e-3 + 1e-5 * 2 / 3.0::DOUBLE) AS n_trivial FROM ours LEFT JOIN base USING (concept)")
def sweep_cell(spark, sf_dir):
    return rounded(sweeps.cell(*sides(spark, sf_dir)), "mean_best", "max_best", "mean_delta")


@query(f"WITH {NEURONS} SELECT feature, round(median(recall * prevalence + fpr * (1 - prevalence)), 6) AS rate FROM m WHERE concept NOT IN (0, 9) GROUP BY 1")
def rate_recovery(spark, sf_dir):
    return rounded(sweeps.rate_of_features(assoc(spark, sf_dir), [0, 9]), "rate")


@query("WITH g AS (SELECT p_brand, p_size, count(*) AS dead FROM part GROUP BY 1, 2) SELECT p_brand, arg_min(p_size, dead * 1000 + p_size) AS best_step FROM g GROUP BY 1")
def best_epoch(spark, sf_dir):
    g = read(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("dead"))
    return sweeps.best_step(g, "p_brand", "p_size", "dead")


@query("WITH g AS (SELECT c_mktsegment AS concept, c_nationkey AS layer, avg(c_acctbal) AS v FROM customer GROUP BY 1, 2) SELECT concept, arg_min(layer, (-v, layer)) AS best_layer, round(max(v), 4) AS best_value FROM g GROUP BY 1")
def best_layer(spark, sf_dir):
    g = read(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("concept"), F.col("c_nationkey").alias("layer")).agg(F.avg("c_acctbal").alias("v"))
    out = sweeps.best_layer(g, "concept", "layer", "v")
    return out.withColumn("best_value", F.round("best_value", 4))


@query("SELECT c_mktsegment, " + ", ".join(f'round(avg(c_acctbal) FILTER (c_nationkey = {i}), 4) AS "{i}"' for i in range(25)) + " FROM customer GROUP BY 1")
def layer_step_pivot(spark, sf_dir):
    g = read(spark, sf_dir, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.round(F.avg("c_acctbal"), 4).alias("v"))
    return sweeps.pivoted(g, "c_mktsegment", "c_nationkey", "v", list(range(25)))


@query("SELECT * FROM (SELECT c_nationkey, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) = 1)")
def last_step_rows(spark, sf_dir):
    return sweeps.last_of(read(spark, sf_dir, "customer").select("c_nationkey", "c_custkey"), "c_nationkey", "c_custkey")


@query(f"WITH {NEURONS}, k AS (SELECT feature, concept, row_number() OVER (PARTITION BY feature ORDER BY f1 DESC, concept) AS r FROM m) SELECT feature, string_agg(concept::VARCHAR, '|' ORDER BY r) AS names FROM k WHERE r <= 3 GROUP BY 1")
def feature_top_concepts(spark, sf_dir):
    rows = assoc(spark, sf_dir).select("feature", F.col("concept").cast("string").alias("name"), "concept", "f1")
    return sweeps.listed(rows, "feature", "name", "f1", 3)


@query("WITH b AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2), s AS (SELECT p_brand, count(*) AS size FROM b GROUP BY 1), k AS (SELECT size FROM (SELECT size, count(*) AS c FROM s GROUP BY 1) ORDER BY c DESC, size LIMIT 1) SELECT p_brand, size FROM s WHERE size IN (SELECT size FROM k)")
def canonical_runs(spark, sf_dir):
    s = read(spark, sf_dir, "part").groupBy("p_brand").agg(F.countDistinct("p_type").alias("size"))
    return sweeps.canonical(s, "p_brand", "size").select("p_brand", "size")


# ---------------------------------------------------------------- steering


@query(f"WITH {NEURONS} SELECT DISTINCT feature FROM m WHERE mcc >= 0.08")
def feature_group(spark, sf_dir):
    return steering.feature_group(assoc(spark, sf_dir), 0.08)


@query(f"WITH {NEURONS}, o AS (SELECT *, mcc >= 0.08 AND row_number() OVER (PARTITION BY concept ORDER BY mcc DESC, feature) <= 3 AS own FROM m) SELECT concept, feature, tp FROM o WHERE own OR concept NOT IN (SELECT concept FROM o WHERE own)")
def own_candidates(spark, sf_dir):
    table = assoc(spark, sf_dir)
    own = steering.candidates(association.ranked(table, "mcc").where("mcc >= 0.08"), 3)
    return steering.own_candidates(table.select("concept", "feature", "tp"), own)


@query(f"WITH {FINE}, w AS (SELECT o_orderkey AS id, key, pos AS s, pos + 24 AS e FROM (SELECT o_orderkey, o_custkey AS key, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS pos FROM orders)) SELECT id FROM w WHERE EXISTS (SELECT 1 FROM spans, (SELECT unnest([0, 8, 16]) AS k) WHERE spans.key = w.key AND spans.s <= w.s + k AND w.s + k < spans.e) ORDER BY id LIMIT 200")
def probed_windows(spark, sf_dir):
    w = fine_points(spark, sf_dir).select(F.col("o_orderkey").alias("id"), "key", F.col("pos").alias("start"), (F.col("pos") + 24).alias("end"))
    return steering.probed_windows(w, fine_spans(spark, sf_dir), 200).select("id")


@query(f"WITH {SPANS}, w AS (SELECT o_orderkey AS id, key, pos AS s, pos + 24 AS e FROM (SELECT o_orderkey, o_custkey % 100 + 1 AS key, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS pos FROM orders)) SELECT id FROM w WHERE EXISTS (SELECT 1 FROM spans, (SELECT unnest([0, 8, 16]) AS k) WHERE spans.key = w.key AND spans.s <= w.s + k AND w.s + k < spans.e) ORDER BY id LIMIT 200")
def probed_windows_whole(spark, sf_dir):
    w = order_points(spark, sf_dir).select(F.col("o_orderkey").alias("id"), "key", F.col("pos").alias("start"), (F.col("pos") + 24).alias("end"))
    return steering.probed_windows(w, spans(spark, sf_dir), 200).select("id")


@query("WITH m AS (SELECT event_type, user_id % 3 AS factor, avg(value) AS ce_all, avg(value) FILTER (value > 50) AS ce_active, avg(value) FILTER (event_id % 2 = 0) AS ce_concept FROM events GROUP BY 1, 2) SELECT a.event_type, CAST(a.factor AS INTEGER) AS factor, round(a.ce_all, 6) AS ce_all, round(a.ce_active, 6) AS ce_active, round(a.ce_concept, 6) AS ce_concept, round(a.ce_all - b.ce_all, 6) AS dce_all, round(a.ce_active - b.ce_active, 6) AS dce_active, round(a.ce_concept - b.ce_concept, 6) AS dce_concept FROM m a JOIN m b ON a.event_type = b.event_type AND b.factor = 1")
def steering_losses(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 3).cast("int").alias("factor"), F.col("value").alias("loss"), (F.col("value") > 50).alias("active"), (F.col("event_id") % 2 == 0).alias("inside"))
    out = steering.loss_changes(e, ["event_type"])
    return rounded(out, *[c for c in out.columns if "ce_" in c])


@query("WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS id, unnest(['l_discount', 'l_quantity', 'l_tax']) AS \"column\", unnest([l_discount, l_quantity, l_tax]) AS value FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY value DESC, \"column\") AS rank FROM l) SELECT id, \"column\", value, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 2")
def top_columns(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_discount", "l_quantity", "l_tax")
    return steering.top_columns(li, "id", ["l_discount", "l_quantity", "l_tax"], 2)


@query("SELECT event_id, round(CASE WHEN event_id < 100 THEN 0.5 * (event_id + 1) / 100 ELSE 0.25 * (1 + cos(least(1, (event_id - 100) / 900.0::DOUBLE) * pi())) END, 6) AS rate FROM events")
def rate_schedule(spark, sf_dir):
    """The rate of every event, taken as a training step."""
    return read(spark, sf_dir, "events").select("event_id", F.round(steering.warm_then_cosine(F.col("event_id"), 100, 1000, 0.5), 6).alias("rate"))


# ---------------------------------------------------------------- sequences, text, sets


@query("SELECT doc_id, round(CASE WHEN length(text) > 0 THEN (length(text) - length(replace(replace(text, 'N', ''), 'n', '')))::DOUBLE / length(text) ELSE 1 END, 6) AS n_fraction, length(regexp_replace(upper(coalesce(lang, '')), '[^ACGTN]', 'N', 'g')) AS n_clean, regexp_replace(upper(coalesce(source, '')), '[^ACGTN]', 'N', 'g') AS clean FROM documents")
def sequence_cleaning(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.round(sequence.n_fraction(F.col("text")), 6).alias("n_fraction"), F.length(sequence.sanitized(F.coalesce("lang", F.lit("")))).cast("long").alias("n_clean"), sequence.sanitized(F.coalesce("source", F.lit(""))).alias("clean"))


@query("WITH c AS (SELECT unnest(string_split(p_type, '')) AS base, generate_subscripts(string_split(p_type, ''), 1) - 1 AS pos FROM part), n AS (SELECT pos, base, count(*) AS n FROM c WHERE base <> '' GROUP BY 1, 2) SELECT CAST(pos AS INTEGER) AS pos, base, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY pos), 6) AS freq FROM n")
def seq_pfm(spark, sf_dir):
    return rounded(sequence.pfm(read(spark, sf_dir, "part"), "p_type"), "freq")


@query("SELECT kmer, count(*) AS n FROM (SELECT substr(p_name, length(p_name) // 2 - 4 + 1, 9) AS kmer FROM part WHERE length(p_name) >= 9) GROUP BY 1 ORDER BY n DESC, kmer LIMIT 10")
def kmer_counts(spark, sf_dir):
    return sequence.centered_kmers(read(spark, sf_dir, "part"), "p_name", 9, 10)


@query("SELECT p_partkey, CASE WHEN p_size - 1 < length(p_name) THEN substr(p_name, 1, p_size - 1) || '[' || substr(p_name, p_size, 1) || ']' || substr(p_name, p_size + 1) ELSE p_name END AS shown FROM part")
def highlight(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", sequence.highlighted(F.col("p_name"), F.col("p_size") - 1).alias("shown"))


@query("SELECT event_id, TRY_CAST(nullif(regexp_extract(props, '\"k\": ?(\\d+)', 1), '') AS BIGINT) AS k, nullif(regexp_extract(props, '\"missing\": ?(\\d+)', 1), '') AS missing FROM events")
def regex_ids(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select("event_id", scalar.extracted(F.col("props"), '"k": ?(\\d+)').try_cast("long").alias("k"), scalar.extracted(F.col("props"), '"missing": ?(\\d+)').alias("missing"))


@query("SELECT event_id, least(10, event_id % 17)::VARCHAR || ',' || greatest(0, event_id % 5 - 2)::VARCHAR || ',3' AS scores FROM events WHERE event_id % 2 = 0")
def json_scores(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    answer = F.concat(F.lit("The list:\n```json\n["), (F.col("event_id") % 17).cast("string"), F.lit(", "), (F.col("event_id") % 5 - 2).cast("string"), F.when(F.col("event_id") % 2 == 0, ", 3]\n```").otherwise("]\n```"))
    got = e.select("event_id", scalar.int_list(answer, 3).alias("s")).where("s IS NOT NULL")
    return got.select("event_id", F.array_join(F.transform("s", lambda x: x.cast("string")), ",").alias("scores"))


@query("SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS tag FROM part) WHERE trim(tag) <> '' GROUP BY 1")
def tag_split_fanout(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.explode(scalar.tags(F.col("p_type"), " ")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CASE WHEN r >= 0.5 THEN 'accept' WHEN r >= 0.2 THEN 'review' WHEN r IS NULL THEN 'unscored' ELSE 'recluster' END AS category, CASE WHEN r IS NULL THEN 'unscored' WHEN r >= 0.5 AND o_orderkey % 3 > 0 THEN 'high_quality' WHEN r >= 0.2 THEN 'needs_review' ELSE 'low_quality' END AS flag FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 > 0 THEN (o_orderkey % 100) / 100.0::DOUBLE END AS r FROM orders)")
def score_categories(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 > 0, (F.col("o_orderkey") % 100) / 100.0).alias("r"))
    return o.select("o_orderkey", scalar.score_category(F.col("r")).alias("category"), scalar.quality_flag(F.col("r"), F.col("o_orderkey") % 3 > 0).alias("flag"))


@query("SELECT p_partkey, regexp_replace(p_type, '[^\\w\\-.]+', '_', 'g') AS label, lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS name, CAST(trunc(p_size + (3 + 0.5) * (p_partkey - p_size) / 8) AS BIGINT) AS mid FROM part")
def labels_and_midpoints(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", scalar.file_label(F.col("p_type")).alias("label"), scalar.collapsed(F.col("p_name")).alias("name"), scalar.token_midpoint(F.col("p_size"), F.col("p_partkey"), F.lit(3), 8).alias("mid"))


@query("SELECT event_id FROM events WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = event_id)")
def resume_anti(spark, sf_dir):
    from ..streaming.incremental import remaining

    return remaining(read(spark, sf_dir, "events").select("event_id"), read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id")), ["event_id"])


@query("SELECT event_id FROM events INTERSECT SELECT o_orderkey FROM orders")
def completed_keys(spark, sf_dir):
    from ..streaming.incremental import completed

    return completed(read(spark, sf_dir, "events"), read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id")), ["event_id"])


@query("SELECT role, count(*) AS n, count(DISTINCT conv_id) AS n_conv, round(avg(length(text)), 6) AS mean_chars FROM conversations GROUP BY 1")
def conversation_summary(spark, sf_dir):
    return rounded(read(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("n_conv"), F.avg(F.length("text")).alias("mean_chars")), "mean_chars")


@query()
def kmeans_annot(spark, sf_dir):
    from .interpret import cluster_summary, clusters

    e = read(spark, sf_dir, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"v{i}") for i in range(64)])
    return cluster_summary(clusters(e, [f"v{i}" for i in range(64)], 3), "label", "v0", ["cluster"])


@query("SELECT ts::DATE AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_daily_counts(spark, sf_dir):
    """Files as they arrive, each batch's counts written as its own part; nothing is kept in memory between batches."""
    import uuid

    from ..streaming.incremental import accumulate, accumulated, arriving

    def count(batch: DataFrame) -> DataFrame:
        return batch.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))

    at = stream_checkpoint(spark, f"daily-{uuid.uuid4().hex}")
    stream = arriving(spark, f"{sf_dir}/events.parquet*", read(spark, sf_dir, "events"))
    accumulate(stream, count, ["day", "event_type"], f"{at}/counts", f"{at}/checkpoint").awaitTermination()
    return accumulated(spark, f"{at}/counts", ["day", "event_type"], ["n", "total"]).withColumn("total", F.round("total", 4))


def stream_checkpoint(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}"


from . import formats, records  # noqa: E402, F401  (they add their queries)
