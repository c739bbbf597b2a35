"""Queries over the driver's tables, by name; SQL for those that SQL can express is in binmine.plans.sql."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binmine.functions import bits
from binmine.operators import bubble, factor, itemset, kmedoids, leader, metrics, neighbours, simulate, sketch, trees, tune
from binmine.plans import sql
from binmine.session import checkpointed
from binmine.sources import tables

QUERIES: dict = {}
ORACLE_SQL = sql.ORACLE_SQL

P, CLASSES, MINSUP = sql.P, sql.CLASSES, sql.MINSUP


def query(f):
    QUERIES[f.__name__] = f
    return f


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*(F.round(F.col(c).cast("double"), 6).alias(c) if c in cols or not cols else F.col(c) for c in df.columns))


def _joined(c: str):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """Sign bits with a labelling by their first three bits."""
    v = F.col("v")
    return tables.sign_bits(spark, d).withColumn("result", (v[0] * 4 + v[1] * 2 + v[2]).cast("int"))


def _basket_labels(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    b = tables.baskets(spark, d)
    return b, b.select("id").distinct().withColumn("cluster", (F.col("id") % 8 + 1).cast("int"))


def _probes(b: DataFrame) -> DataFrame:
    """The stated query set: ids divisible by 20."""
    return b.where("id % 20 = 0")


def _class_reps(spark: SparkSession, d: str, rank: int = 1) -> DataFrame:
    """cand, cluster, v: for each class the rows of the lowest ids."""
    from pyspark.sql.window import Window

    rn = F.row_number().over(Window.partitionBy("orig").orderBy("id"))
    return tables.sign_bits(spark, d).withColumn("cand", rn).where(F.col("cand") <= rank).select("cand", F.col("orig").alias("cluster"), "v")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MinHash clusters of sign bits, scored by pairs."""
    obs = tables.sign_bits(spark, sf_dir)
    found = sketch.minhash_clusters(sketch.signatures(tables.to_items(obs), sketch.coefficients(4, P), P))
    return metrics.rec_pre_f1(obs.join(found.withColumnRenamed("cluster", "result"), "id"))


# ---- evaluation


@query
def pair_metrics(s, d):
    return _rounded(metrics.rec_pre_f1(_labelled(s, d)))


@query
def pair_metrics_exact(s, d):
    return _rounded(metrics.rec_pre_f1(_labelled(s, d), exact=True))


@query
def cluster_entropy(s, d):
    return _rounded(metrics.entropy(_labelled(s, d)))


@query
def rand_index(s, d):
    return _rounded(metrics.rand_index(_labelled(s, d)))


@query
def purity_blocks(s, d):
    return _rounded(metrics.purity_blocks(_labelled(s, d), 7))


@query
def purity(s, d):
    return _rounded(metrics.purity(_labelled(s, d)))


# ---- supports


@query
def popcount_rows(s, d):
    return tables.sign_bits(s, d).select("id", bits.popcount("v").cast("long").alias("ones"))


@query
def item_support(s, d):
    return trees.item_support(tables.sign_bits(s, d)).select("j", F.col("s").cast("long").alias("s"), "n")


@query
def balanced_variable(s, d):
    return trees.balanced_variables(tables.sign_bits(s, d)).select(F.concat(F.lit("V"), "j").alias("variable"))


# ---- hash blocking


def _doc_sigs(s, d):
    return sketch.signatures_long(tables.word_numbers(s, d), sql.DOC_COEFS, sql.DOC_P)


@query
def minhash_signature(s, d):
    return _doc_sigs(s, d).select("id", _joined("sig"))


@query
def minhash_clusters(s, d):
    return sketch.minhash_clusters(checkpointed(_doc_sigs(s, d))).select("id", F.col("cluster").cast("long").alias("cluster"))


@query
def minhash_bits(s, d):
    return sketch.signatures(tables.to_items(tables.sign_bits(s, d)), sql.BIT_COEFS, P).select("id", _joined("sig"))


@query
def lsh_buckets(s, d):
    return sketch.buckets(_doc_sigs(s, d), 20, 5).select("band", _joined("h"), "id")


@query
def lsh_candidate_pairs(s, d):
    return sketch.signature_pairs(checkpointed(_doc_sigs(s, d)), 20, 5, p=sql.DOC_P)


def _bit_buckets(s, d):
    return sketch.buckets(sketch.signatures(tables.to_items(tables.sign_bits(s, d)), sql.BIT_COEFS, P), 20, 10)


@query
def lsh_pair_metrics(s, d):
    obs = tables.sign_bits(s, d)
    n, ids = obs.agg(F.count(F.lit(1)), F.count_distinct("id")).first()
    if ids < n:  # rows of one id are one end of a pair, and missing ids are none
        return _rounded(metrics.pair_metrics(sketch.candidate_pairs(_bit_buckets(s, d)), obs.select("id", "orig"), n, CLASSES))
    sigs = checkpointed(sketch.signatures(tables.to_items(obs, "orig"), sql.BIT_COEFS, P, "orig"))
    return _rounded(metrics.pair_scores(sketch.pair_counts(sigs, 20, 10, P, CLASSES), n, CLASSES))


@query
def lsh_eval_sample(s, d):
    obs = tables.sign_bits(s, d).select("id", "orig")
    n = obs.count()
    some = sketch.eval_sample(_bit_buckets(s, d), n, CLASSES, 200)
    return _rounded(metrics.pair_metrics(sketch.candidate_pairs(some), obs, 200, CLASSES))


# ---- distances and medoids


@query
def hamming_topk(s, d):
    x = tables.sign_bits(s, d).select("id", "v")
    return neighbours.hamming_neighbours(x, _probes(x), 5)


@query
def nearest_medoid(s, d):
    return bits.nearest(tables.sign_bits(s, d), _class_reps(s, d))


@query
def medoid_cost(s, d):
    return bits.nearest(tables.sign_bits(s, d), _class_reps(s, d)).agg(F.sum("d").alias("cost"))


@query
def clarans_candidate_cost(s, d):
    return kmedoids.candidate_costs(tables.sign_bits(s, d), _class_reps(s, d, 5))


@query
def cluster_medoid(s, d):
    obs = tables.sign_bits(s, d)
    return kmedoids.cluster_medoids(obs.select("id", "v"), obs.select("id", F.col("orig").alias("cluster")))


# ---- canopies and sorted neighbourhoods


@query
def canopy_first_pass(s, d):
    obs = tables.sign_bits(s, d)
    first = obs.orderBy(bits.seeded(1), "id").first()
    return leader.canopy_pass(obs, first.v, 0.45)


@query
def sn_edges(s, d):
    return leader.neighbour_edges(tables.sign_bits(s, d), 30, 0.45, 1, "popcount")


@query
def sn_clusters(s, d):
    return leader.sorted_neighborhood(tables.sign_bits(s, d), 30, 0.42, 1, False)


# ---- itemsets


@query
def clope_features(s, d):
    return itemset.features(*_basket_labels(s, d)).select("cluster", "n", "s", "w", "occ2")


@query
def clope_delta_add(s, d):
    b, lab = _basket_labels(s, d)
    return _rounded(itemset.clope_delta_add(b, lab, b, 2.0), "delta")


@query
def clope_merge_delta(s, d):
    return _rounded(itemset.clope_delta_merge(*_basket_labels(s, d), 2.0), "delta")


@query
def clope_profit(s, d):
    return _rounded(itemset.clope_profit(*_basket_labels(s, d), 2.0))


def _row_costs(s, d):
    b, lab = _basket_labels(s, d)
    return itemset.largeitem_row_costs(b, lab, b, sql.MINSUP, 1.0)


def _feature_costs(s, d):
    b, lab = _basket_labels(s, d)
    group = b.select((F.col("id") % 5).cast("long").alias("g"), "id", "j")
    added = group.groupBy("g", "j").agg(F.count(F.lit(1)).alias("occ")).join(group.groupBy("g").agg(F.count_distinct("id").alias("n")), "g").select(F.col("g").alias("id"), "j", "occ", "n")
    return itemset.largeitem_costs(b, lab, added, sql.MINSUP, 1.0)


@query
def largeitem_cost_add(s, d):
    return _rounded(_row_costs(s, d).where("target > 0"), "cost")


@query
def largeitem_cost_new(s, d):
    return _rounded(_row_costs(s, d).where("target = 0").select("id", "cost"), "cost")


@query
def largeitem_cost_merge(s, d):
    return _rounded(_feature_costs(s, d).where("target > 0"), "cost")


@query
def largeitem_cost_merge_new(s, d):
    return _rounded(_feature_costs(s, d).where("target = 0").select("id", "cost"), "cost")


@query
def largeitem_total(s, d):
    return _rounded(itemset.largeitem_total(*_basket_labels(s, d), sql.MINSUP, 1.0))


@query
def scale_wcd(s, d):
    return _rounded(itemset.scale_wcd(*_basket_labels(s, d)), "wcd")


@query
def scale_ewcd_add(s, d):
    b, lab = _basket_labels(s, d)
    return _rounded(itemset.scale_ewcd_add(b, lab, b, lab.count()), "ewcd")


@query
def scale_batch_features(s, d):
    b, lab = _basket_labels(s, d)
    batch = lab.withColumn("cluster", F.col("cluster") * 100 + (F.col("id") % 3).cast("int"))
    return itemset.features(b, batch).select("cluster", "n", "s", "occ2")


# ---- trees


@query
def mbt_level_partitions(s, d):
    return trees.mbt_partitions(tables.sign_bits(s, d), 1 << 30).select("id", "part")


@query
def mona_information_gain(s, d):
    return _rounded(trees.information_gain(tables.sign_bits(s, d)), "gain")


@query
def mona_splits(s, d):
    return trees.mona_splits(tables.sign_bits(s, d), 2)[1]


# ---- factor models


def _orig(s, d):
    obs = tables.sign_bits(s, d)
    return obs.select("id", "v"), obs.select("id", F.col("orig").alias("cluster"))


@query
def binmodel_patterns(s, d):
    return factor.patterns(*_orig(s, d), CLASSES).select("cluster", _joined("v"))


@query
def binmodel_assign(s, d):
    obs, lab = _orig(s, d)
    return bits.nearest(obs, factor.patterns(obs, lab, CLASSES))


@query
def binmodel_objective(s, d):
    obs, lab = _orig(s, d)
    return factor.pattern_objective(obs, lab, factor.patterns(obs, lab, CLASSES))


def _blocks(s, d):
    obs = tables.sign_bits(s, d).select("id", "v")
    lab, cols = factor.first_blocks(obs, 5, 4)
    return obs, lab, cols, factor.block_means(obs, lab, cols)


@query
def blockmodel_means(s, d):
    return _rounded(_blocks(s, d)[3].select("rowcluster", "colcluster", "mean", F.col("n").cast("long").alias("n")), "mean")


@query
def blockmodel_step(s, d):
    obs, _, cols, means = _blocks(s, d)
    return factor.block_rows(obs, cols, means)


@query
def blockmodel_columns(s, d):
    obs, lab, _, means = _blocks(s, d)
    return factor.block_columns(obs, lab, means)


@query
def blockmodel_objective(s, d):
    return _rounded(factor.block_objective(*_blocks(s, d)))


# ---- samples, chunks, labels


@query
def stratified_sample(s, d):
    return bits.stratified(tables.sign_bits(s, d), 200, CLASSES, 1).select("id", "orig")


@query
def chunk_assign(s, d):
    return bits.chunked(tables.sign_bits(s, d).select("id"), 7).select("id", "chunk")


@query
def label_union(s, d):
    x = bits.chunked(_labelled(s, d).select("id", "result"), 3)
    firsts = bits.ranked(x.groupBy("chunk", "result").agg(F.min("id").alias("first")), "first", "cluster")
    return x.join(F.broadcast(firsts), ["chunk", "result"]).select("id", "cluster")


# ---- whole algorithms (rows only)


def _obs(s, d):
    return tables.sign_bits(s, d).select("id", "v")


def _basket_obs(s, d):
    return tables.from_long(tables.baskets(s, d), 25)


@query
def clara(s, d):
    return kmedoids.clara(_obs(s, d), CLASSES)


@query
def clarans(s, d):
    return kmedoids.clarans(_obs(s, d), CLASSES)[1]


@query
def canopy(s, d):
    return leader.canopy(_obs(s, d), 0.45, 0.4)


@query
def canopy_par(s, d):
    return leader.canopy_par(_obs(s, d), 0.45, 0.4, CLASSES, 4)


@query
def sorted_neighborhood(s, d):
    return leader.sorted_neighborhood(_obs(s, d))


@query
def sorted_neighborhood_near(s, d):
    return leader.sorted_neighborhood(_obs(s, d), threshold=0.36)


@query
def clope(s, d):
    return itemset.clope(_obs(s, d), 2.0, 4)


@query
def largeitem(s, d):
    return itemset.largeitem(_obs(s, d), 1.0, 0.6, 4)


@query
def scale(s, d):
    return itemset.scale(_obs(s, d), CLASSES, chunks=2, batches=5)


@query
def clope_baskets(s, d):
    return itemset.clope(_basket_obs(s, d), 2.0, 8)


@query
def largeitem_baskets(s, d):
    return itemset.largeitem(_basket_obs(s, d), 1.0, MINSUP, 8)


@query
def scale_baskets(s, d):
    return itemset.scale(_basket_obs(s, d), CLASSES, chunks=8, batches=4)


@query
def mbt(s, d):
    return trees.mbt(_obs(s, d), 50, CLASSES)


@query
def mbt_parts(s, d):
    return trees.mbt_partitions(_obs(s, d), 50).select("id", "part")


@query
def mbt_par(s, d):
    return trees.mbt_par(_obs(s, d), 20, CLASSES, 4)


@query
def mona(s, d):
    return trees.mona(_obs(s, d), 7)


@query
def binmodel(s, d):
    return factor.binary_model(_obs(s, d), CLASSES)


@query
def binmodel_par(s, d):
    return factor.binary_model_par(_obs(s, d), CLASSES, 4)


@query
def blockmodel(s, d):
    return factor.block_model(_obs(s, d), 5, 4)[0]


@query
def blockmodel_par(s, d):
    return factor.block_model_par(_obs(s, d), 5, 4, 4)


@query
def proximus(s, d):
    return factor.proximus(_obs(s, d), 24.0, CLASSES, 4)


@query
def proximus_whole(s, d):
    return factor.proximus_whole(_obs(s, d), 24.0, CLASSES)


@query
def bubble_clusters(s, d):
    return bubble.bubble_clusters(_obs(s, d), 0.4, 10, 4, CLASSES)


@query
def bubble_clustroids(s, d):
    return bubble.bubble(_obs(s, d), 0.4, 10, 4)[1]


@query
def corrbinary(s, d):
    sigma = simulate.simcor(4, [4] * 4, [0.6] * 4, delta=0.1, epsilon=0.01)
    return simulate.corrbinary(s, 2000, [0.4] * 16, sigma)


@query
def simcor(s, d):
    m = simulate.simcor(4, [8] * 4, [0.6] * 4)
    return s.createDataFrame([(i + 1, j + 1, float(m[i, j])) for i in range(32) for j in range(32)], "i int, j int, r double")


def _best(s, best, scores, grid) -> DataFrame:
    return s.createDataFrame([(str(g), float(x), g == best) for g, x in zip(grid, scores, strict=True)], "setting string, score double, best boolean")


def _sampled(s, d, *p) -> tuple:
    """The tuners' arguments: sign bits, classes, p and the size of the sample."""
    obs = tables.sign_bits(s, d)
    return obs, CLASSES, *p, tune.feasible(obs, CLASSES)


@query
def tune_minhash(s, d):
    grid = tune.MINHASH_GRID
    return _best(s, *tune.tune_minhash(*_sampled(s, d, P), grid=grid), grid)


@query
def tune_lsh(s, d):
    grid = tune.LSH_GRID
    return _best(s, *tune.tune_lsh(*_sampled(s, d, P), grid=grid), grid)


@query
def tune_canopy(s, d):
    grid = tune.CANOPY_GRID
    return _best(s, *tune.tune_canopy(*_sampled(s, d), grid=grid), grid)


@query
def tune_sorted(s, d):
    grid = tune.SORTED_GRID
    return _best(s, *tune.tune_sorted(*_sampled(s, d), grid=grid), grid)


@query
def tune_proximus(s, d):
    grid = tune.PROXIMUS_GRID
    _, scores = tune.tune_proximus(*_sampled(s, d), grid=grid)
    return _best(s, grid[max(range(len(grid)), key=lambda i: (scores[i], -i))], scores, grid)


@query
def tune_bubble(s, d):
    grid = tune.BUBBLE_GRID
    return _best(s, *tune.tune_bubble(*_sampled(s, d), grid=grid), grid)
