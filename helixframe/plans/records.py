"""Queries over encoders, losses, tables of runs, interpretation records and resumed work."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import stored
from ..functions import scalar, sequence
from ..operators import association, blocks, clustering, encoders, statistics, steering, sweeps, topk
from ..sources import arrays
from ..streaming import incremental, permuted, state
from . import interpret
from .registry import NEURON_X, NEURONS, SQL, assoc, neurons, query, read, rounded, shared_folder, toy_weights

# ---------------------------------------------------------------- encoders and losses

TOY = "w AS (SELECT f AS feature, d AS dim, ((f * 7 + d * 3) % 11 - 5) / 10.0::DOUBLE AS w FROM range(32) a(f), range(64) b(d)), h AS (SELECT vec_id, feature, sum(v * w) + 0.01 * feature AS pre FROM x JOIN w USING (dim) GROUP BY 1, 2)"


def pre(spark, sf_dir) -> DataFrame:
    return encoders.pre_activations(encoders.long_form(read(spark, sf_dir, "embeddings"), "vec_id", "embedding"), toy_weights(spark), "vec_id")


@query(f"WITH {NEURON_X}, {TOY}, a AS (SELECT vec_id, feature, CASE WHEN pre > exp(-0.5) THEN pre ELSE 0 END AS jump, CASE WHEN pre - 0.2 > 0 THEN greatest(pre * 0.5, 0) ELSE 0 END AS gated FROM h) SELECT feature::INTEGER AS feature, count(*) FILTER (jump > 0) AS n_jump, count(*) FILTER (gated > 0) AS n_gated, round(sum(jump), 4) AS jump, round(sum(gated), 4) AS gated FROM a GROUP BY 1")
def gate_activations(spark, sf_dir):
    x = pre(spark, sf_dir).withColumns({"jump": encoders.jump_relu(F.col("pre"), F.lit(-0.5)), "gated": encoders.gated(F.col("pre") - 0.2, F.col("pre") * 0.5)})
    n = lambda c: F.sum((F.col(c) > 0).cast("long")).alias(f"n_{c}")
    return x.groupBy("feature").agg(n("jump"), n("gated"), *[F.round(F.sum(c), 4).alias(c) for c in ("jump", "gated")])


@query(f"WITH {NEURON_X}, {TOY}, k AS (SELECT * FROM (SELECT vec_id, feature, pre AS act, row_number() OVER (PARTITION BY vec_id ORDER BY pre DESC, feature) AS r FROM h WHERE pre > 0) WHERE r <= 4) SELECT vec_id, dim::INTEGER AS dim, round(sum(act * w), 4) + 0.0::DOUBLE AS x_hat FROM k JOIN w USING (feature) GROUP BY 1, 2")
def decoded_vectors(spark, sf_dir):
    """Sparse activations back to vectors, in all dimensions."""
    acts = encoders.top_k(pre(spark, sf_dir).withColumn("act", encoders.relu(F.col("pre"))), 4, "vec_id")
    return encoders.decode(acts, toy_weights(spark).withColumnRenamed("w", "w_dec"), "vec_id").withColumn("x_hat", F.round("x_hat", 4) + F.lit(0.0))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding[1:8], lambda v: v::DOUBLE * v))) / (sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v))) + 1e-12), 6) AS share, round(list_sum(list_transform(range(1, 65), lambda i: (embedding[i]::DOUBLE - embedding[65 - i]) ** 2)), 6) AS error FROM embeddings")
def energy_and_error(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    v = F.col("embedding")
    return e.select("vec_id", F.round(encoders.energy_share(v, list(range(8))), 6).alias("share"), F.round(encoders.squared_error(v, F.reverse(v)), 6).alias("error"))


@query("SELECT vec_id, round(ln(list_sum(list_transform(embedding, lambda v: exp(v::DOUBLE)))) - embedding[vec_id % 64 + 1], 6) AS loss FROM embeddings")
def cross_entropy(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(encoders.log_softmax_loss(F.col("embedding"), (F.col("vec_id") % 64).cast("int")), 6).alias("loss"))


@query("SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: (embedding[i]::DOUBLE + (3 - 1) * 0.5 * embedding[65 - i]) * i)), 4) AS checksum FROM embeddings")
def steered_vectors(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    steered = encoders.steer(F.col("embedding"), F.reverse("embedding"), F.lit(0.5), F.lit(3.0))
    return e.select("vec_id", F.round(F.aggregate(F.transform(steered, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v), 4).alias("checksum"))


@query(f"WITH {NEURON_X}, f AS (SELECT dim, count(*) FILTER (v > 0)::DOUBLE / (SELECT count(*) FROM embeddings) AS freq FROM x GROUP BY 1) SELECT dim::INTEGER AS feature, round(freq, 6) AS freq FROM (SELECT *, row_number() OVER (ORDER BY freq DESC, dim) AS r FROM f) WHERE r <= 8 OR freq > 0.52")
def dense_features(spark, sf_dir):
    e, x, _ = neurons(spark, sf_dir)
    freq = encoders.frequencies(x.withColumn("act", encoders.relu(F.col("x"))), x.select("feature").distinct(), e.count())
    return rounded(encoders.dense_features(freq, 8, 0.52).select("feature", "freq"), "freq")


@query(f"WITH {NEURON_X} SELECT label, dim::INTEGER AS dim, round(avg(v), 6) AS x FROM x GROUP BY 1, 2")
def mean_pooled(spark, sf_dir):
    x = encoders.long_form(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", keep=("label",))
    return rounded(encoders.mean_pool(x, ["label"]), "x")


@query(f"WITH {NEURON_X} SELECT vec_id, dim::INTEGER AS tok, round(v, 6) AS x, CAST(trunc(vec_id * 100 + (dim + 0.5) * 512 / 64) AS BIGINT) AS mid FROM x")
def token_scan(spark, sf_dir):
    """Token rows with their place in the window and on the genome; NaN counts as 0."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.when(v == 0, F.lit(float("nan"))).otherwise(v)).alias("v"))
    x = encoders.long_form(e, "vec_id", "v", "tok")
    start = F.col("vec_id") * 100
    return rounded(x.select("vec_id", "tok", "x", scalar.token_midpoint(start, start + 512, F.col("tok"), 64).alias("mid")), "x")


@query(f"WITH {NEURON_X}, c AS (SELECT label AS concept, dim AS feature, count(*) FILTER (v > 0) AS tp, round(avg((v - CASE WHEN abs(v) >= 0.1 THEN v ELSE 0 END) ** 2), 9) AS mse FROM x GROUP BY 1, 2) SELECT concept, feature::INTEGER AS feature, tp, sum(tp) OVER (PARTITION BY feature)::BIGINT AS fires, mse FROM c")
def fused_pass(spark, sf_dir):
    """Counts by concept, counts by feature and reconstruction error in one pass over the tokens."""
    x = encoders.long_form(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", "feature", keep=("label",))
    rebuilt = F.when(F.abs("x") >= 0.1, F.col("x")).otherwise(0.0)
    out = encoders.fused(x.withColumnRenamed("label", "concept").withColumn("x_hat", rebuilt))
    return out.select("concept", "feature", "tp", "fires", F.round("mse", 9).alias("mse"))


@query(SQL["fused_pass"])
def fused_count_blocks(spark, sf_dir):
    """The same pass with counts and errors kept in blocks."""
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(F.abs(x) >= 0.1, x).otherwise(0.0))
    e = read(spark, sf_dir, "embeddings").select("embedding", v.alias("rebuilt"), F.col("label").cast("string").alias("labels"))
    out = blocks.count_blocks(e, 64, vector="embedding", rebuilt="rebuilt")
    return out.select(F.col("concept").cast("int").alias("concept"), "feature", "tp", "fires", F.round("mse", 9).alias("mse"))


@query(f"WITH {NEURON_X}, w AS (SELECT label AS feature, dim, avg(v) AS w FROM x GROUP BY 1, 2), h AS (SELECT vec_id, feature, greatest(sum(v * w) + 0.01 * feature, 0) AS act FROM x JOIN w USING (dim) GROUP BY 1, 2) SELECT vec_id, feature::INTEGER AS feature, round(act, 5) AS act FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY act DESC, feature) AS r FROM h WHERE act > 0) WHERE r <= 3")
def encoded_by_stored_weights(spark, sf_dir):
    """The mean vector of each label as a feature: stored as an array file, read back as weights, and encoded with."""
    e = read(spark, sf_dir, "embeddings")
    x = encoders.long_form(e, "vec_id", "embedding", keep=("label",))
    means = x.groupBy("label", "dim").agg(F.avg("x").alias("w")).groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "w"))), lambda s: s["w"]).alias("values"))
    w = means.select(F.lit("w_enc").alias("member"), F.col("label").alias("row"), "values")
    b = means.select(F.lit("b_enc").alias("member"), F.col("label").alias("row"), F.array(0.01 * F.col("label")).alias("values"))
    path = f"{shared_folder(spark)}/weights-{uuid.uuid4().hex}"
    arrays.write_npz(w.unionByName(b).withColumn("file", F.lit("model")), path).collect()
    return encoders.encode(e, arrays.weights(spark, path), 3, "vec_id", "embedding").withColumn("act", F.round("act", 5))


# ---------------------------------------------------------------- scalars and displays


@query("SELECT o_orderkey, coalesce(TRY_CAST(CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE o_totalprice::VARCHAR END AS DOUBLE), -1) AS safe, CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1e9 WHEN 2 THEN -1e9 ELSE o_totalprice END::DOUBLE AS finite, CASE o_orderkey % 4 WHEN 0 THEN 'nan' WHEN 1 THEN 'inf' WHEN 2 THEN '-inf' ELSE printf('%.2f', o_totalprice) END AS shown FROM orders")
def safe_numbers(spark, sf_dir):
    k = F.col("o_orderkey")
    odd = F.when(k % 4 == 0, float("nan")).when(k % 4 == 1, float("inf")).when(k % 4 == 2, float("-inf")).otherwise(F.col("o_totalprice"))
    text = F.when(k % 3 == 0, "x").otherwise(F.col("o_totalprice").cast("string"))
    return read(spark, sf_dir, "orders").select("o_orderkey", scalar.safe_float(text, -1.0).alias("safe"), scalar.bounded(odd).alias("finite"), scalar.number_text(odd, 2).alias("shown"))


@query("SELECT p_partkey, CASE WHEN length(p_name) <= 6 THEN p_name ELSE CASE WHEN s > 1 THEN '...' ELSE '' END || substr(p_name, s, 6) || CASE WHEN s + 6 <= length(p_name) THEN '...' ELSE '' END END AS short, rpad(repeat('N', greatest(0, 4 - p_size)) || substr(p_name, greatest(0, p_size - 4) + 1, greatest(0, 9 - greatest(0, 4 - p_size))), 9, 'N') AS around FROM (SELECT *, greatest(1, least(length(p_name) // 2 + 1 - 3, length(p_name) - 6 + 1)) AS s FROM part)")
def shortened_names(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", sequence.shortened(F.col("p_name"), 6).alias("short"), sequence.centered_window(F.col("p_name"), F.col("p_size"), 4).alias("around"))


@query("SELECT p_partkey, sha256(coalesce(p_name, chr(0)) || chr(31) || p_size::VARCHAR) AS id, (p_size * 1000)::BIGINT AS step, (p_size % 12)::BIGINT AS layer FROM part")
def fingerprints_and_steps(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    path = F.concat(F.lit("/runs/layer_"), F.col("p_size") % 12, F.lit("/step"), F.col("p_size") * 1000, F.lit("/summary.csv"))
    return p.select("p_partkey", scalar.fingerprint(F.col("p_name"), F.col("p_size")).alias("id"), scalar.step_of(path).alias("step"), scalar.step_of(path, "layer").alias("layer"))


@query("SELECT base, pos::INTEGER AS pos, count(*) AS n FROM (SELECT unnest(string_split(p_type, '')) AS base, generate_subscripts(string_split(p_type, ''), 1) - 1 AS pos FROM part) WHERE base IN ('A', 'C', 'N', 'O') AND pos < 4 GROUP BY 1, 2")
def profile_text(spark, sf_dir):
    """A profile as text, and its counts read back from the text."""
    profile = sequence.pfm(read(spark, sf_dir, "part"), "p_type").where("pos < 4")
    text = sequence.pfm_text(profile, bases="ACNO")
    lines = text.select(F.posexplode(F.split("text", "\n")).alias("line", "cells")).where("line < 4")
    cells = lines.select(F.substring("cells", 1, 1).alias("base"), F.posexplode(F.slice(F.split("cells", "\t"), 2, 4)).alias("pos", "n"))
    return cells.select("base", "pos", F.col("n").cast("long").alias("n")).where("n > 0")


@query("SELECT c_nationkey, string_agg(printf('Seq %02d: %s', k, c_name), chr(10) ORDER BY k) AS block FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) AS k FROM customer) GROUP BY 1")
def numbered_sequences(spark, sf_dir):
    names = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.sort_array(F.collect_list("c_name")).alias("s"))
    return names.select("c_nationkey", steering.numbered(F.col("s")).alias("block"))


@query("SELECT o_orderkey, 'chr' || o_custkey || ':' || (o_orderkey * 10) || '-' || (o_orderkey * 10 + 512) AS place, o_orderkey * 10 + CAST(trunc((o_orderkey % 64 + 0.5) * 512 / 64) AS BIGINT) AS start FROM orders WHERE o_orderkey % 5 < 3")
def coordinate_windows(spark, sf_dir):
    """Windows from a triple, a list of token triples or neither, and each token's interval of one base."""
    k = F.col("o_orderkey")
    chrom = F.concat(F.lit("chr"), F.col("o_custkey"))
    triple = lambda s, e: F.struct(chrom.alias("chrom"), s.alias("start"), e.alias("end"))
    one = F.when(k % 5 == 0, triple(k * 10, k * 10 + 512)).when(k % 5 == 3, F.struct(F.lit("").alias("chrom"), (k * 10).alias("start"), (k * 10).alias("end")))
    many = F.when((k % 5 == 1) | (k % 5 == 2), F.array(triple(k * 10, k * 10 + 8), triple(k * 10 + 100, k * 10 + 108), triple(k * 10 + 504, k * 10 + 512)))
    o = read(spark, sf_dir, "orders").select("o_orderkey", (k % 64).alias("tok"), steering.window_of(one, many).alias("w"))
    rows = o.where("w IS NOT NULL").select("o_orderkey", "tok", "w.*", steering.place_text(F.col("w")).alias("place"))
    return steering.token_bases(rows, 64).select("o_orderkey", "place", "start")


# ---------------------------------------------------------------- tables of runs


@query("WITH g AS (SELECT c_nationkey AS id, count(*) FILTER (c_acctbal > 5000) AS exceed, avg(c_acctbal) AS v FROM customer GROUP BY 1) SELECT id, round((1 + exceed) / 201.0::DOUBLE, 6) AS p, round(CASE WHEN exceed > 30 THEN (v - 4000) / 100 ELSE 0 END, 4) AS z FROM g")
def empirical_tests(spark, sf_dir):
    g = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.sum((F.col("c_acctbal") > 5000).cast("long")).alias("exceed"), F.avg("c_acctbal").alias("v"))
    std = F.when(F.col("exceed") > 30, 100.0).otherwise(1e-13)
    return g.select("id", F.round(statistics.empirical_p(F.col("exceed"), 200), 6).alias("p"), F.round(statistics.z_score(F.col("v"), F.lit(4000.0), std), 4).alias("z"))


@query("WITH v AS (SELECT event_type, CASE WHEN event_id % 9 > 0 THEN value END AS x FROM events) SELECT event_type, round(max(x), 4) AS max, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, round(median(x), 4) AS median FROM v GROUP BY 1")
def activation_summary(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_type", F.when(F.col("event_id") % 9 > 0, F.col("value")).otherwise(F.lit(float("nan"))).alias("x"))
    return rounded4(statistics.score_summary(e, "x", ["event_type"]))


def rounded4(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c, t in df.dtypes if t == "double"})


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2 ORDER BY n DESC, c_nationkey, c_mktsegment LIMIT 10")
def group_sizes(spark, sf_dir):
    return statistics.group_sizes(read(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], 10)


@query("WITH g AS (SELECT c_mktsegment AS concept, max(c_acctbal) AS best, max(c_acctbal) FILTER (c_nationkey = 0) AS base FROM customer GROUP BY 1) SELECT concept, round(best, 4) AS best, round(base, 4) AS base, round(best - base, 4) AS delta, concept = 'MACHINERY' AS degenerate, CAST(row_number() OVER (ORDER BY best DESC, concept) AS INTEGER) AS place FROM g")
def baseline_deltas(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("concept"), F.col("c_acctbal").alias("f1"), "c_nationkey")
    return rounded4(sweeps.baseline_delta(c, c.where("c_nationkey = 0"), ["MACHINERY"]))


@query("SELECT c_mktsegment AS concept, string_agg(c_nationkey || '=' || n, ';' ORDER BY c_nationkey) AS series FROM (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY 1, 2) GROUP BY 1")
def step_series(spark, sf_dir):
    g = read(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("concept"), F.col("c_nationkey").alias("step")).agg(F.count("*").alias("n"))
    s = sweeps.series(g, "concept", "step", "n")
    return s.select("concept", F.array_join(F.transform("series", lambda x: F.concat_ws("=", x["step"].cast("string"), x["n"].cast("string"))), ";").alias("series"))


@query("SELECT name, CAST(row_number() OVER (ORDER BY name) AS INTEGER) AS place, step FROM (SELECT DISTINCT p_type AS name, NULL::BIGINT AS step FROM part UNION SELECT DISTINCT p_brand, NULL FROM part) UNION ALL SELECT NULL, CAST(row_number() OVER (ORDER BY step) AS INTEGER), step FROM (SELECT DISTINCT p_size::BIGINT AS step FROM part)")
def names_and_steps(spark, sf_dir):
    """The sorted union of the names of two runs, and the steps of folder names in numeric order."""
    p = read(spark, sf_dir, "part")
    names = sweeps.name_union([p.select(F.col("p_type").alias("name")), p.select(F.col("p_brand").alias("name"))], "name").withColumn("step", F.lit(None).cast("long"))
    steps = sweeps.step_list(p.select(F.concat(F.lit("step"), F.col("p_size")).alias("dir")), "dir")
    return names.unionByName(steps.withColumn("name", F.lit(None).cast("string")))


@query("WITH g AS (SELECT c_nationkey AS concept, avg(c_acctbal) AS observed, median(c_acctbal) AS q, count(*) AS n FROM customer GROUP BY 1) SELECT concept, round(observed, 4) AS observed, CASE WHEN concept % 3 = 0 THEN true WHEN concept % 3 = 1 THEN false ELSE observed > q END AS significant, CAST(row_number() OVER (ORDER BY observed, concept) - 1 AS INTEGER) AS place FROM g")
def null_plot_table(spark, sf_dir):
    g = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("concept")).agg(F.avg("c_acctbal").alias("observed"), F.median("c_acctbal").alias("q95"))
    flag = F.when(F.col("concept") % 3 == 0, F.when(F.col("concept") % 2 == 0, "True").otherwise("1")).when(F.col("concept") % 3 == 1, "False")
    return rounded4(sweeps.plot_rows(g.withColumn("significant_bh", flag)).select("concept", "observed", "significant", "place"))


@query("""WITH s AS (SELECT DISTINCT p_brand || CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN ':' || p_size % 7 ELSE ':' || p_size % 7 || ':' || p_size END AS spec FROM part),
b AS (SELECT p_brand AS concept, (p_size % 7)::INTEGER AS layer, arg_max(p_partkey, (p_retailprice, -p_partkey))::INTEGER AS feature FROM part GROUP BY 1, 2),
t AS (SELECT string_split(spec, ':') AS p FROM s)
SELECT p[1] AS concept, coalesce(p[2]::INTEGER, 5) AS layer, coalesce(p[3]::INTEGER, b.feature) AS feature FROM t LEFT JOIN b ON b.concept = p[1] AND b.layer = coalesce(p[2]::INTEGER, 5)""")
def steering_targets(spark, sf_dir):
    """Targets named by brand, brand and layer, or in full; what is left out is looked up in each brand's best part by layer."""
    p = read(spark, sf_dir, "part")
    layer, size = (F.col("p_size") % 7).cast("int"), F.col("p_size").cast("string")
    best = p.groupBy(F.col("p_brand").alias("concept"), layer.alias("layer")).agg(F.max_by("p_partkey", F.struct("p_retailprice", -F.col("p_partkey"))).cast("int").alias("feature"))
    more = F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, F.concat(F.lit(":"), layer.cast("string"))).otherwise(F.concat(F.lit(":"), layer.cast("string"), F.lit(":"), size))
    return steering.resolved_targets(p.select(F.concat("p_brand", more).alias("spec")).distinct(), best, 5)


@query("SELECT event_id, user_id, CASE WHEN event_id % 2 = 0 THEN value END AS value FROM events")
def appended_results(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return topk.appended([e.where("event_id % 2 = 0").select("event_id", "user_id", "value"), e.where("event_id % 2 = 1").select("event_id", "user_id")])


@query("SELECT count(*) AS n FROM events WHERE event_type = 'click'")
def stored_state(spark, sf_dir):
    """Rows of a state table under the run's fingerprint."""
    e = read(spark, sf_dir, "events").withColumn("fingerprint", scalar.fingerprint(F.col("event_type")))
    import hashlib

    return incremental.valid_state(e, hashlib.sha256(b"click").hexdigest()).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- resumed work


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def resumed_counts(spark, sf_dir):
    """Counts by part in three calls, after a state of another fingerprint was left there; the state goes at the end."""
    e = read(spark, sf_dir, "events").withColumn("part", F.col("event_id") % 5)
    count = lambda df: df.groupBy("part", "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    state = f"{shared_folder(spark)}/state-{uuid.uuid4().hex}"
    incremental.resumed(e, "part", count, ["event_type"], ["n", "total"], state, "old", at_most=1)
    for n in (2, 2, None):
        out = incremental.resumed(e, "part", count, ["event_type"], ["n", "total"], state, "new", at_most=n)
    kept = f"{state}-result"
    out.write.parquet(kept)
    incremental.cleared(spark, state)
    return spark.read.parquet(kept).withColumn("total", F.round("total", 4))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def idempotent_append(spark, sf_dir):
    e, path = read(spark, sf_dir, "events").select("event_id", "user_id"), f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
    for part in (e.where("event_id % 3 = 0"), e.where("event_id % 2 = 0"), e, e):
        incremental.append_new(part, path, ["event_id"])
    return spark.read.schema(e.schema).json(path).groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT k % 10 AS k, count(*) AS n FROM (SELECT DISTINCT CASE WHEN event_id % 50 = 0 THEN NULL ELSE event_id END AS k FROM events) GROUP BY 1")
def exactly_once_append(spark, sf_dir):
    """Events delivered twice through a stream, some without a key, in two runs of the query."""
    e = read(spark, sf_dir, "events").select(F.when(F.col("event_id") % 50 != 0, F.col("event_id")).alias("k"), "user_id")
    path = f"{shared_folder(spark)}/once-{uuid.uuid4().hex}"
    e.where("user_id % 2 = 0").write.parquet(f"{path}/in")
    stream = incremental.arriving(spark, f"{path}/in", e)
    incremental.exactly_once(stream, f"{path}/out", f"{path}/state", ["k"]).awaitTermination()
    e.write.mode("append").parquet(f"{path}/in")
    incremental.exactly_once(stream, f"{path}/out", f"{path}/state", ["k"]).awaitTermination()
    return incremental.committed(spark, f"{path}/out", e).groupBy((F.col("k") % 10).alias("k")).agg(F.count("*").alias("n"))


def lloyd_sql(rounds: int) -> str:
    """Standardised customers of each nation in three clusters: seeds by hash, then so many rounds, each from the one before."""
    out = """WITH p AS (SELECT c_nationkey AS g, c_custkey AS id, c_acctbal AS x, length(c_name) + c_custkey % 17 AS y FROM customer),
m AS (SELECT g, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy FROM p GROUP BY g),
z AS (SELECT g, id, p.x AS act, CASE WHEN sx > 0 THEN (p.x - mx) / sx ELSE 0 END AS x, CASE WHEN sy > 0 THEN (p.y - my) / sy ELSE 0 END AS y FROM p JOIN m USING (g)),
s AS (SELECT g, x, y, min(id) AS id FROM z GROUP BY g, x, y),
c0 AS (SELECT g, k, x, y FROM (SELECT g, x, y, row_number() OVER (PARTITION BY g ORDER BY md5('42|0|' || id), id) - 1 AS k FROM s) WHERE k < 3)"""
    pick = "SELECT z.g, id, act, z.x, z.y, arg_min(c.k, ((z.x - c.x) ** 2 + (z.y - c.y) ** 2, c.k)) AS k FROM z JOIN {c} c ON z.g = c.g GROUP BY ALL"
    for i in range(rounds):
        out += f",\na{i} AS ({pick.format(c=f'c{i}')}),\nc{i + 1} AS (SELECT g, k, coalesce(a.x, c.x) AS x, coalesce(a.y, c.y) AS y FROM c{i} c LEFT JOIN (SELECT g, k, avg(x) AS x, avg(y) AS y FROM a{i} GROUP BY g, k) a USING (g, k))"
    return out + f",\nf AS ({pick.format(c=f'c{rounds}')}) SELECT g AS nation, k::INTEGER AS cluster, count(*) AS n, round(avg(act), 4) AS mean_act, sum(id)::BIGINT AS ids FROM f GROUP BY g, k"


@query(lloyd_sql(4))
def kmeans_by_feature(spark, sf_dir):
    """Nations as features, customers as their examples: all features are clustered in the same four rounds."""
    c = read(spark, sf_dir, "customer")
    v = F.array(F.col("c_acctbal"), (F.length("c_name") + F.col("c_custkey") % 17).cast("double"))
    points = c.select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("id"), "c_acctbal", v.alias("v"))
    out = clustering.kmeans(clustering.standardised(points, "nation", "v"), "nation", "v", 3, rounds=4, starts=1)
    return out.groupBy("nation", "cluster").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean_act"), F.sum("id").alias("ids"))


@query(SQL["dead_counter"])
def dead_counter_stream(spark, sf_dir):
    """Runs kept as state of a stream of four files, by a query that is stopped after two of them and started again."""
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "value")
    path = f"{shared_folder(spark)}/silence-{uuid.uuid4().hex}"
    bounds = e.select(F.percentile_approx("event_id", [0.25, 0.5, 0.75])).first()[0]
    part = F.lit(0)
    for b in bounds:
        part = part + (F.col("event_id") > b).cast("int")
    e = e.withColumn("part", part)
    for parts in ((0, 1), (2, 3)):
        for p in parts:
            e.where(F.col("part") == p).drop("part").repartition(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(e.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        state.silent_runs(stream, "user_id", "event_id", "value < 50").writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").select("event_id", "run")


@query("SELECT count(*) AS n, count(DISTINCT place) AS places, count(DISTINCT event_id) AS events, (max(place) + 1)::BIGINT AS stop, (max(batch) + 1)::BIGINT AS batches FROM (SELECT event_id, row_number() OVER () - 1 AS place, (row_number() OVER () - 1) // 4000 AS batch FROM events)")
def permuted_epoch(spark, sf_dir):
    """A shuffled epoch as a stream, stopped in its middle and continued: every event once, at a place of its own."""
    rows, n = permuted.numbered(read(spark, sf_dir, "events").select("event_id"))
    path = f"{shared_folder(spark)}/epoch-{uuid.uuid4().hex}"
    for stop in (n // 2, n):
        batches = permuted.stream_epoch(rows, n, 4000, 7, stop=stop)
        q = batches.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").start()
        q.processAllAvailable()
        q.stop()
    out = spark.read.parquet(f"{path}/out")
    return out.agg(F.count("*").alias("n"), F.countDistinct("place").alias("places"), F.countDistinct("event_id").alias("events"), (F.max("place") + 1).alias("stop"), (F.max("batch") + 1).alias("batches"))


# ---------------------------------------------------------------- interpretation


def feature_rows(spark, sf_dir) -> DataFrame:
    """Segments as features, customers as their examples."""
    c = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("feature"), F.col("c_acctbal").alias("act"), F.col("c_name").alias("context"), F.concat(F.lit("chr"), F.col("c_nationkey"), F.lit(":"), F.col("c_custkey")).alias("place"), F.col("c_custkey"), "c_nationkey")
    return interpret.normalised(topk.top_n(c, ["feature"], [F.desc("act"), F.asc("c_custkey")], 40))


EXAMPLES = "r AS (SELECT c_mktsegment AS feature, greatest(c_acctbal, 0) AS act, c_name AS context, c_nationkey, c_custkey, 'chr' || c_nationkey || ':' || c_custkey AS place, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer), n AS (SELECT *, round_even(10 * act / max(act) OVER (PARTITION BY feature), 0)::INTEGER AS norm FROM r WHERE rank <= 40)"


@query(f"WITH {EXAMPLES}, s AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY norm DESC, rank) AS k FROM n) SELECT feature, 'Annotations: ' || CASE WHEN feature < 'C' THEN 'none known' ELSE 'in ' || feature END || chr(10) || 'Examples:' || chr(10) || string_agg(printf('%02d. %s (%d)', k, context, norm), chr(10) ORDER BY k) FILTER (k <= 5) AS prompt, string_agg(context, ',' ORDER BY rank) FILTER (rank BETWEEN 21 AND 30) AS held, sum(norm) FILTER (rank BETWEEN 21 AND 30)::BIGINT AS total FROM s GROUP BY feature")
def prompt_records(spark, sf_dir):
    rows = feature_rows(spark, sf_dir)
    enrichment = rows.select("feature").distinct().where("feature >= 'C'").withColumn("enrichment", F.concat(F.lit("in "), F.col("feature")))
    p = interpret.prompts(rows, enrichment, 5, (21, 30))
    return p.select("feature", "prompt", F.array_join("holdout_sequences", ",").alias("held"), F.aggregate("holdout_activations", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 < 2 THEN 'pattern ' || p_partkey END AS hypothesis, CASE WHEN p_partkey % 4 < 2 THEN 'seen' || chr(10) || 'twice' END AS evidence, CASE p_partkey % 4 WHEN 0 THEN 'high' END AS confidence, coalesce(p_partkey % 4 = 0, false) AS parse_ok, CASE p_partkey % 4 WHEN 2 THEN 'busy' WHEN 3 THEN 'no' END AS error, CASE p_partkey % 4 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 1 END AS attempts FROM part")
def explain_records(spark, sf_dir):
    """A model that answers, answers at the second try, is always busy, or fails."""
    tried: dict[str, int] = {}

    def model(prompt: str) -> str:
        key = int(prompt.rsplit(" ", 1)[1])
        tried[prompt] = tried.get(prompt, 0) + 1
        if key % 4 == 3:
            raise ValueError("no")
        if key % 4 == 2 or key % 4 == 1 and tried[prompt] % 2:
            raise ConnectionError("busy")
        return f"HYPOTHESIS: pattern {key}\nEVIDENCE: seen\ntwice" + ("\nCONFIDENCE: High" if key % 4 == 0 else "")

    p = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("Feature "), F.col("p_partkey")).alias("prompt"))
    out = interpret.explanations(interpret.asked(p, "prompt", model, transient=ConnectionError))
    return out.select("p_partkey", "hypothesis", "evidence", "confidence", "parse_ok", "error", "attempts")


SCORED = "o AS (SELECT c_nationkey AS feature, list(c_custkey % 11 ORDER BY c_custkey) AS real, list(CASE WHEN c_nationkey % 5 = 0 THEN 4 ELSE (c_custkey * (c_nationkey % 3 + 1)) % 11 END ORDER BY c_custkey) AS said FROM customer GROUP BY 1), z AS (SELECT feature, unnest(real) AS a, unnest(said) AS p FROM o WHERE feature % 7 > 0), c AS (SELECT feature, count(*) AS n, corr(p, a) AS r, var_pop(p) AS vp, var_pop(a) AS va FROM z GROUP BY 1), s AS (SELECT o.feature, CASE WHEN n < 3 OR vp = 0 OR va = 0 THEN 0 ELSE r END AS r FROM o LEFT JOIN c USING (feature))"


def scored(spark, sf_dir) -> DataFrame:
    """Held-out activations by nation, and answers that guess them, or cannot be read."""
    c = read(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "feature")
    said = F.when(F.col("feature") % 5 == 0, 4).otherwise((F.col("c_custkey") * (F.col("feature") % 3 + 1)) % 11).cast("int")
    rows = c.groupBy("feature").agg(F.sort_array(F.collect_list(F.struct("c_custkey", (F.col("c_custkey") % 11).cast("int").alias("a"), said.alias("p")))).alias("z"))
    listed = F.array_join(F.transform("z", lambda x: x["p"].cast("string")), ", ")
    answer = F.when(F.col("feature") % 7 == 0, "I cannot say.").otherwise(F.concat(F.lit("Here:\n```json\n["), listed, F.lit("]\n```")))
    return interpret.scores(rows.select("feature", F.transform("z", lambda x: x["a"]).alias("holdout_activations"), answer.alias("answer")))


@query(f"WITH {SCORED} SELECT feature, round(r, 6) AS r, CASE WHEN r IS NULL THEN 'unscored' WHEN r >= 0.5 THEN 'accept' WHEN r >= 0.2 THEN 'review' ELSE 'recluster' END AS category FROM s")
def simulate_scores(spark, sf_dir):
    return rounded(scored(spark, sf_dir).select("feature", "r", "category"), "r")


@query("SELECT c_nationkey AS feature, md5('Hypothesis: h' || c_nationkey || chr(10) || count(*) || ' sequences:' || chr(10) || string_agg(printf('Seq %02d: %s', k, c_name), chr(10) ORDER BY k) || chr(10) || 'Answer with a JSON list of ' || count(*) || ' numbers.') AS digest FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) AS k FROM customer) GROUP BY 1")
def simulate_prompts(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("feature")).agg(F.sort_array(F.collect_list("c_name")).alias("holdout_sequences"))
    out = interpret.simulations(rows.withColumn("hypothesis", F.concat(F.lit("h"), F.col("feature"))))
    return out.select("feature", F.md5("prompt").alias("digest"))


@query(f"WITH {EXAMPLES}, g AS (SELECT *, c_nationkey % 3 AS cluster, row_number() OVER (PARTITION BY feature, c_nationkey % 3 ORDER BY norm DESC, place) AS k FROM n), b AS (SELECT feature, cluster, printf('Sub-cluster %d (%d examples, mean activation %.2f):', cluster + 1, count(*), round(avg(norm), 2)) || chr(10) || string_agg(printf('  [%d] activation %d/10 | %s', k, norm, place) || chr(10) || '      ' || context, chr(10) ORDER BY k) FILTER (k <= 4) AS block FROM g GROUP BY 1, 2) SELECT feature, count(*) AS n_clusters, md5('Feature ' || feature || ' scored 0.1 with: h' || chr(10) || string_agg(block, chr(10) || chr(10) ORDER BY cluster) || chr(10) || 'For each group write SUBCLUSTER n: and then HYPOTHESIS, EVIDENCE and CONFIDENCE.') AS digest FROM b GROUP BY 1")
def recluster_prompts(spark, sf_dir):
    rows = feature_rows(spark, sf_dir).withColumn("cluster", F.col("c_nationkey") % 3)
    explained = rows.select("feature").distinct().withColumns({"hypothesis": F.lit("h"), "score": F.lit("0.1")})
    return interpret.recluster_prompts(rows, explained, 4).select("feature", "n_clusters", F.md5("prompt").alias("digest"))


@query("SELECT p_partkey AS feature, c::INTEGER AS cluster, 'part ' || (p_partkey + c) AS hypothesis, CASE c WHEN 1 THEN 'low' WHEN 2 THEN 'medium' END AS confidence, c < 3 AS parse_ok FROM part, range(1, 4) t(c) WHERE c <= 1 + p_partkey % 3")
def recluster_answers(spark, sf_dir):
    k, parts = F.col("p_partkey"), []
    for c, sure in ((1, "LOW"), (2, "Medium"), (3, "none")):
        parts.append(F.when(F.lit(c) <= 1 + k % 3, F.concat(F.lit(f"SUBCLUSTER {c}:\nHYPOTHESIS: part "), k + c, F.lit(f"\nEVIDENCE: e{c}\nCONFIDENCE: {sure}\n"))).otherwise(""))
    rows = read(spark, sf_dir, "part").select(k.alias("feature"), F.concat(F.lit("Well.\n"), *parts).alias("answer"))
    return interpret.recluster_answers(rows).select("feature", "cluster", "hypothesis", "confidence", "parse_ok")


@query("WITH f AS (SELECT c_custkey AS feature, CASE WHEN c_custkey % 4 > 0 THEN c_acctbal END AS r FROM customer), s AS (SELECT o_custkey AS feature, o_orderkey AS cluster, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice / 40 END AS r FROM orders), b AS (SELECT feature, coalesce(r, -2) AS r, cluster FROM s QUALIFY row_number() OVER (PARTITION BY feature ORDER BY coalesce(r, -2) DESC, cluster) = 1) SELECT f.feature, coalesce(b.r > coalesce(f.r, -2), false) AS improved, CASE WHEN coalesce(b.r > coalesce(f.r, -2), false) THEN b.r ELSE f.r END AS r, CASE WHEN coalesce(b.r > coalesce(f.r, -2), false) THEN 's' || cluster ELSE 'first' END AS hypothesis FROM f LEFT JOIN b USING (feature)")
def best_hypotheses(spark, sf_dir):
    first = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("feature"), F.lit("first").alias("hypothesis"), F.when(F.col("c_custkey") % 4 > 0, F.col("c_acctbal")).alias("r"))
    parts = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("feature"), F.col("o_orderkey").alias("cluster"), F.concat(F.lit("s"), F.col("o_orderkey")).alias("hypothesis"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice") / 40).alias("r"))
    return interpret.best_of(first, parts)


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'YES' WHEN 1 THEN 'NO' WHEN 2 THEN 'PARTIAL' ELSE 'UNKNOWN' END AS verdict, CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS consistent, CASE WHEN o_orderkey % 4 < 3 THEN 'i' || o_custkey ELSE '' END AS issues, CASE o_orderkey % 4 WHEN 1 THEN 'new ' || o_orderkey ELSE 'old' END AS revised FROM orders")
def consistency_answers(spark, sf_dir):
    k = F.col("o_orderkey")
    said = F.when(k % 4 == 0, "yes").when(k % 4 == 1, "No").otherwise("PARTIAL")
    answer = F.when(k % 4 == 3, "Sorry").otherwise(F.concat(F.lit("CONSISTENT: "), said, F.lit("\nISSUES: i"), F.col("o_custkey"), F.when(k % 4 == 1, F.concat(F.lit("\nREVISED_HYPOTHESIS: new "), k)).otherwise("")))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.lit("old").alias("hypothesis"), answer.alias("answer"))
    return interpret.consistency(rows).select("o_orderkey", "verdict", "consistent", "issues", "revised")


@query("WITH k AS (SELECT c_nationkey AS cluster, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer), p AS (SELECT cluster, count(*) AS n, 'Group ' || cluster || ' of ' || count(*) || ' features:' || chr(10) || string_agg(printf('  [%d] %s', r, c_name), chr(10) ORDER BY r) FILTER (r <= 15) || chr(10) || 'Answer with LABEL and DESCRIPTION.' AS prompt FROM k GROUP BY 1) SELECT cluster, n, CASE WHEN cluster % 2 = 0 THEN 'even ' || cluster ELSE 'Cluster ' || cluster END AS label, CASE WHEN cluster % 2 = 0 THEN 'd ' || length(prompt) ELSE '' END AS description FROM p")
def cluster_names(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("cluster"), F.col("c_custkey").alias("feature"), F.col("c_name").alias("hypothesis"))
    prompts = interpret.label_prompts(c)
    answer = F.when(F.col("cluster") % 2 == 0, F.concat(F.lit("LABEL: even "), F.col("cluster"), F.lit("\nDESCRIPTION: d "), F.length("prompt"))).otherwise("?")
    return interpret.cluster_labels(prompts.withColumn("answer", answer)).select("cluster", "n", "label", "description")


@query("SELECT c_custkey AS feature, c_acctbal AS r, n, s_acctbal, CASE WHEN c_acctbal >= 0.5 AND n > 0 THEN 'high_quality' WHEN c_acctbal >= 0.5 AND n IS NULL THEN 'high_quality' WHEN c_acctbal >= 0.2 THEN 'needs_review' ELSE 'low_quality' END AS flag FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS n FROM orders GROUP BY 1) USING (c_custkey) LEFT JOIN (SELECT s_suppkey AS c_custkey, s_acctbal FROM supplier) USING (c_custkey)")
def feature_atlas(spark, sf_dir):
    features = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("feature"), F.col("c_acctbal").alias("r"))
    n = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("feature")).agg(F.count("*").alias("n"))
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("feature"), "s_acctbal")
    return interpret.atlas(interpret.star(features, {"orders": n, "suppliers": s}).withColumn("consistent", F.col("n") > 0)).drop("consistent")


@query("WITH m AS (SELECT c_custkey AS feature, c_acctbal AS r, 'h' || c_custkey AS hypothesis FROM customer) SELECT m.feature, CASE WHEN t.r > m.r THEN 'again' ELSE hypothesis END AS hypothesis, CASE WHEN t.r > m.r THEN t.r ELSE m.r END AS r, coalesce(t.r > m.r, false) AS overridden FROM m LEFT JOIN (SELECT s_suppkey AS feature, s_acctbal AS r FROM supplier WHERE s_nationkey < 12) t USING (feature)")
def merged_hypotheses(spark, sf_dir):
    first = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("feature"), F.concat(F.lit("h"), F.col("c_custkey")).alias("hypothesis"), F.col("c_acctbal").alias("r"))
    again = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("feature"), F.lit("again").alias("hypothesis"), F.col("s_acctbal").alias("r"), (F.col("s_nationkey") < 12).alias("improved"))
    return interpret.merged(first, again)


@query("SELECT 3 AS done, 'score' AS last, true AS halted")
def step_runner(spark, sf_dir):
    """Steps run in order from a given one; a step that raises halts the run."""
    log: list[str] = []

    def fails():
        raise RuntimeError("stop")

    steps = [(n, lambda n=n: log.append(n)) for n in ("annotate", "normalise", "explain", "score")]
    done = interpret.run_steps(steps, start="normalise")
    try:
        interpret.run_steps([*steps, ("broken", fails), ("after", lambda: log.append("after"))], start="broken")
        halted = False
    except RuntimeError:
        halted = "after" not in log
    return spark.range(1).select(F.lit(len(done)).alias("done"), F.lit(done[-1]).alias("last"), F.lit(halted).alias("halted"))


@query("WITH " + "s AS (SELECT unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS feature, label FROM embeddings) SELECT label AS concept, count(*) FILTER (v > 0) AS n_active, count(DISTINCT feature) AS n_features FROM s GROUP BY 1")
def activation_dispatch(spark, sf_dir):
    """Activations by what the model is: raw neurons are the vector itself."""
    e = read(spark, sf_dir, "embeddings").withColumnRenamed("label", "concept")
    x = encoders.activations("raw_neuron", encoders.long_form(e, "vec_id", "embedding", "feature", keep=("concept",)))
    return x.groupBy("concept").agg(F.sum((F.col("act") > 0).cast("long")).alias("n_active"), F.countDistinct("feature").alias("n_features"))


@query("SELECT concept, tp FROM (SELECT label AS concept, count(*) AS tp FROM embeddings GROUP BY 1)")
def label_tracks(spark, sf_dir):
    """Which rows of a track of flags, one array a window, belong to a concept, counted from the stored track."""
    from ..sources.writers import label_tracks as write_tracks

    e = read(spark, sf_dir, "embeddings").select((F.col("vec_id") / 16).cast("long").alias("window"), (F.col("vec_id") % 16).cast("int").alias("bin"), F.col("label").alias("concept"))
    path = f"{shared_folder(spark)}/tracks-{uuid.uuid4().hex}"
    write_tracks(e, path, 16)
    got = spark.read.parquet(path).select("concept", F.explode("track").alias("t"))
    return got.groupBy("concept").agg(F.sum("t").alias("tp"))



QC = "k AS (SELECT * FROM lineitem WHERE l_quantity > 10 AND l_returnflag = 'R'), t AS (SELECT count(*) AS c0, count(*) FILTER (l_quantity > 10) AS c1, count(*) FILTER (l_quantity > 10 AND l_returnflag = 'R') AS c2 FROM lineitem), c AS (SELECT unnest(['all', 'quantity', 'returned']) AS name, unnest([c0, c1, c2]) AS n, c0 FROM t)"


@query(f"WITH {QC} SELECT 'rows' AS section, name, n::DOUBLE AS value FROM c UNION ALL SELECT 'share', name, round(n / c0, 4) FROM c UNION ALL SELECT 'l_linenumber', l_linenumber::VARCHAR, count(*)::DOUBLE FROM k GROUP BY 2 UNION ALL SELECT 'l_quantity', unnest(['n', 'mean', 'std', 'min', 'max', 'p50', 'p90', 'p99', 'p99_9']), unnest([count(*)::DOUBLE, round(avg(l_quantity), 4), round(stddev_samp(l_quantity), 4), min(l_quantity), max(l_quantity), quantile_cont(l_quantity, 0.5), quantile_cont(l_quantity, 0.9), round(quantile_cont(l_quantity, 0.99), 4), round(quantile_cont(l_quantity, 0.999), 4)]) FROM k")
def qc_report(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    steps = [("quantity", F.col("l_quantity") > 10), ("returned", F.col("l_returnflag") == "R")]
    return rounded4(statistics.qc_report(li, steps, ["l_linenumber"], "l_quantity"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY substr(md5('5|' || c_custkey), 1, 15), c_custkey) - 1 AS place, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) SELECT c_nationkey, c_custkey, place::INTEGER AS place, (place // 8)::INTEGER AS batch FROM r WHERE (place // 8 + 1) * 8 <= n")
def shuffled_batches(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_nationkey", "c_custkey")
    return topk.shuffled_batches(c, "c_nationkey", ["c_custkey"], 8, 5)


@query("SELECT c_mktsegment AS feature, c_name AS example, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) - 1 AS INTEGER) AS rank FROM customer QUALIFY rank < 20")
def top_examples(spark, sf_dir):
    """Examples stored as one array a feature, scanned back as rows."""
    c = read(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "feature")
    best = topk.top_n(c, ["feature"], [F.desc("c_acctbal"), F.asc("c_custkey")], 20)
    path = f"{shared_folder(spark)}/examples-{uuid.uuid4().hex}"
    best.groupBy("feature").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "c_name"))), lambda x: x["c_name"]).alias("examples")).write.parquet(path)
    return spark.read.parquet(path).select("feature", F.posexplode("examples").alias("rank", "example"))


@query("SELECT (SELECT count(*) FROM customer) AS n_candidates, (SELECT count(DISTINCT c_nationkey) FROM customer) AS n_concepts, 20 AS permutations, 'seven' AS seed")
def null_table_files(spark, sf_dir):
    from ..sources.writers import null_tables

    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    path = f"{shared_folder(spark)}/null-{uuid.uuid4().hex}"
    null_tables(c, c.groupBy("c_nationkey").agg(F.max("c_acctbal").alias("best")), path, {"permutations": 20, "seed": "seven"})
    rows = [spark.read.option("header", True).csv(f"{path}/{n}").agg(F.count("*").alias(f"n_{n}")) for n in ("candidates", "concepts")]
    about = spark.read.schema("permutations int, seed string").json(f"{path}/metadata")
    return rows[0].crossJoin(F.broadcast(rows[1])).crossJoin(F.broadcast(about))  # one row each


@query(f"WITH {NEURONS}, q AS (SELECT concept, feature, f1, (tp + fp)::DOUBLE / (n_pos + n_neg) AS rate FROM m), rk AS (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY f1 DESC NULLS LAST, feature) AS k FROM q), g AS (SELECT feature, any_value(rate) AS rate, max(f1) AS f1, arg_max(concept::VARCHAR, (f1, concept::VARCHAR)) AS best, count(*) FILTER (k <= 10) AS n, string_agg(concept::VARCHAR, ', ' ORDER BY concept::VARCHAR) FILTER (k <= 10) AS named FROM rk GROUP BY feature), d AS (SELECT *, CASE WHEN rate > 0.5 THEN 'dense' ELSE 'sparse' END AS kind FROM g) SELECT feature, kind, CAST(row_number() OVER (ORDER BY kind DESC, f1 DESC, feature) AS INTEGER) AS place, printf('## Feature %d (%s, fires on %.2f %% of tokens)', feature, kind, round(100 * rate, 2)) || chr(10) || printf('Best match: %s, F1 %.3f', best, round(f1, 3)) || chr(10) || CASE WHEN n > 0 THEN printf('Among the first 10 of %d concepts: %s', n, named) ELSE 'Among the first of no concept' END AS report FROM d")
def feature_report(spark, sf_dir):
    """The reports of all features, written as a text file in their order and read again."""
    table = assoc(spark, sf_dir).withColumn("rate", association.firing_rate()).select("concept", "feature", "f1", "rate")
    reports = stored(interpret.feature_reports(table, 0.5), "reports")
    path = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}"
    reports.orderBy("place").coalesce(1).select("report").write.option("lineSep", "\n\n").text(path)
    number = F.regexp_extract("value", "Feature (\\d+) ", 1).try_cast("int")
    text = spark.read.option("lineSep", "\n\n").text(path).select(F.col("value").alias("report"), number.alias("feature"))
    return text.join(reports.drop("report"), "feature")
