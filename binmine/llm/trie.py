"""Prefix trie of conversations by preorder intervals.

Conversations are compared turn by turn through fixed-width labels of (role, text). Distinct sequences are ranked
lexicographically, 64 labels at a time: ranks of blocks are the letters of the next level, so no row ever holds a whole
long conversation. A node is the set of sequences with a common prefix, a range of ranks [lo, hi]; ordered by (lo,
depth) nodes stand in preorder, a subtree is the stretch from its top to the last node first made by sequence hi. Leaves
and savings of a subtree are then differences of running sums over that order. A prefix is known by the running sum of
four hashes of (depth, label) along its conversation, 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, map_texts, table, written
from .ordered import running

#: Letters of a block, ids in a piece of a node's list.
BLOCK, PIECE = 64, 4096
#: Conversations borrow from the first of so many ids at most so many turns less one.
FAMILY, HEADS = 20, 4
WORD = "[^\\x20\\x09-\\x0D]+"
LANES = ("a", "b", "c", "d")


def _turns(conversations: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
    return said.withColumn("label", F.base64(F.substring(F.unhex(digest), 1, 15))).withColumn("words", F.regexp_count("text", F.lit(WORD)).cast("long"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Rows conv_id, depth (from 1), label, words of all rebuilt conversations, the ids of all, and the tables written.

    A conversation is the first h turns of the one whose id ends its block of 20, then its own after its first h.
    """
    t, path = running(_turns(conversations), "conv_id", ["turn", "role", "text"], ["label", "words"], tag="turns")
    heads = t.where(f"conv_id % {FAMILY} = 0 and at < {HEADS}").groupBy(F.col("conv_id").alias("src")).agg(F.sort_array(F.collect_list(F.struct("at", "label", "words"))).alias("heads"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    convs = t.where("at = 1").select("conv_id", h.alias("h"), F.expr(f"conv_id - conv_id % {FAMILY}").alias("src")).join(heads, "src", "left")
    convs, convs_path = written(convs.select("conv_id", "h", "heads", F.expr("if(heads is null, 0, least(h, size(heads)))").alias("k")), "conversations")
    own = t.join(convs.select("conv_id", "h", "k"), "conv_id").where("at > h").select("conv_id", F.expr("at - h + k").alias("depth"), "label", "words")
    lent = convs.where("k > 0").select("conv_id", F.explode(F.expr("slice(heads, 1, cast(k as int))")).alias("x")).select("conv_id", F.col("x.at").alias("depth"), "x.label", "x.words")
    both, rows_path = written(own.unionByName(lent), "rebuilt")
    discard(t.sparkSession, path)
    return both, convs.select("conv_id"), [convs_path, rows_path]


def sequences(rows: DataFrame, convs: DataFrame) -> tuple[DataFrame, list[str]]:
    """conv_id, rank (of its sequence among the distinct ones, in lexicographic order, from 1), at (number among its equals)."""
    spark, most = rows.sparkSession, rows.agg(F.max("depth")).first()[0] or 0
    letters = rows.select("conv_id", (F.col("depth") - 1).alias("place"), F.col("label").alias("letter"))
    paths, old = [], None
    while True:
        block, inside = F.expr(f"place div {BLOCK}"), F.expr(f"place % {BLOCK}")
        keys = letters.groupBy("conv_id", block.alias("place")).agg(F.sort_array(F.collect_list(F.struct(inside.alias("i"), "letter"))).alias("l")).select("conv_id", "place", F.array_join("l.letter", "").alias("key"))
        most = (most + BLOCK - 1) // BLOCK
        if most <= 1:
            none = convs.join(keys, "conv_id", "left_anti").select("conv_id", F.lit("").alias("key"))
            found, path = running(keys.select("conv_id", "key").unionByName(none), "key", ["conv_id"], ["conv_id"], tag="sequences")
            discard(spark, *paths)
            return found.drop("key"), [path]
        found, path = running(keys, "key", ["conv_id", "place"], ["conv_id", "place"], tag="blocks")
        paths.append(path)
        letters = found.select("conv_id", "place", F.lpad(F.col("rank").cast("string"), 15, "0").alias("letter"))


def _joined_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each rank's pieces, which come in order, joined by commas; the state of one hash is all that is held."""
    at, h = None, None
    for b in batches:
        ranks, hashes = [], []
        for rank, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if rank != at:
                if h:
                    ranks.append(at)
                    hashes.append(h.hexdigest())
                at, h = rank, hashlib.sha256(piece.encode())
            else:
                h.update(b"," + piece.encode())
        yield pa.RecordBatch.from_arrays([pa.array(ranks, pa.int64()), pa.array(hashes, pa.string())], ["rank", "ends_sha256"])
    if h:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([h.hexdigest()], pa.string())], ["rank", "ends_sha256"])


def _ends(found: DataFrame) -> DataFrame:
    """rank, ends_sha256. A hash reads its ids in order, so those of one sequence end in one task, but as pieces of many ids."""
    pieces = found.groupBy("rank", F.expr(f"(at - 1) div {PIECE}").alias("piece")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    lists = pieces.select("rank", "piece", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))
    return map_texts(lists.repartition("rank").sortWithinPartitions("rank", "piece").select("rank", "ids"), _joined_hash, "rank long, ends_sha256 string")


def _lane(n: int) -> Column:
    """32 bits of a hash of (depth, label)."""
    h = F.xxhash64(F.lit(n // 2), "depth", "label")
    return (F.shiftrightunsigned(h, 32) if n % 2 else h.bitwiseAND(0xFFFFFFFF)).alias(LANES[n])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations, with its place (pos, from 1) and subtree_end in preorder.

    conversations: conv_id, turn, role, text; other columns are ignored. Turns are taken by turn (nulls first), then role
    and text, so ties have one order, and repeated rows are turns of their own. A null role or text counts as empty. Rows
    with a null conv_id belong to no conversation. Without conversations there is no node, not even a root.
    """
    spark = conversations.sparkSession
    rows, convs, paths = rebuilt(conversations)
    found, seq_paths = sequences(rows, convs)
    reps, reps_path = written(found.groupBy("rank").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("weight")), "distinct")
    told = rows.join(reps, "conv_id").select(F.col("rank").alias("seq"), "conv_id", "weight", "depth", "words", *(_lane(n) for n in range(4)))
    chained, chained_path = running(told, "seq", ["depth"], ["conv_id", "weight", "depth", "words", *LANES], LANES, tag="prefixes")
    discard(spark, *paths)
    up = [(F.col(f"run_{x}") - F.col(x)).alias(f"up_{x}") for x in LANES]
    runs = [f"run_{x}" for x in LANES]
    nodes = (
        chained.select("seq", "conv_id", "weight", "depth", "words", *runs, *up)
        .groupBy("depth", *runs)
        .agg(F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.max("words").alias("words"), F.min("seq").alias("lo"), F.max("seq").alias("hi"), *(F.min(f"up_{x}").alias(f"up_{x}") for x in LANES))
    )
    nodes, nodes_path = written(nodes, "nodes")
    discard(spark, chained_path)
    zero = [F.lit(0).cast("long").alias(c) for c in (*runs, *(f"up_{x}" for x in LANES))]
    root = reps.agg(F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.min("rank").alias("lo"), F.max("rank").alias("hi")).where("conv_id is not null")
    root = root.select(F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("words"), "lo", "hi", *zero)
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), *(F.col(f"up_{x}").alias(f"run_{x}") for x in LANES)).agg(F.count(F.lit(1)).alias("n_children"))
    whole = nodes.unionByName(root).join(children, ["depth", *runs], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    whole = whole.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("saves", (F.col("n_convs") - 1) * F.col("words"))
    keep = ["depth", "conv_id", "n_convs", "n_children", "lo", "hi", *runs, *(f"up_{x}" for x in LANES)]
    pre, _ = running(whole, None, ["lo", "depth"], keep, ("leaf", "saves"), tag="preorder")
    discard(spark, nodes_path)
    last = pre.groupBy(F.col("lo").alias("s")).agg(F.max("at").alias("subtree_end"), F.max("run_leaf").alias("end_leaf"), F.max("run_saves").alias("end_saves"), F.max("depth").alias("depth"))
    ends = _ends(found).withColumnRenamed("rank", "s").join(last.select("s", "depth"), "s").withColumnRenamed("s", "lo")
    above = pre.select((F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"), *(F.col(f"run_{x}").alias(f"up_{x}") for x in LANES))
    return (
        pre.join(last.drop("depth").withColumnRenamed("s", "hi"), "hi")
        .join(ends, ["lo", "depth"], "left")
        .join(above, ["depth", *(f"up_{x}" for x in LANES)], "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            "n_children",
            (F.col("end_leaf") - F.col("run_leaf") + F.col("leaf")).alias("n_leaves"),
            (F.col("end_saves") - F.col("run_saves") + F.col("saves")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
            F.col("at").alias("pos"),
            "subtree_end",
        )
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations. pos is left out: labels, and so the order of siblings, are this operator's own."""
    return prefix_trie(table(spark, sf_dir, "conversations")).drop("pos", "subtree_end")
