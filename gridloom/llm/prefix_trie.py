"""The prefix trie of conversations, with totals of every subtree by parallel tree contraction.

Conversations are rebuilt from another one's first turns and their own later ones.  A
node of the trie is a distinct sequence of first turns, known by 128 bits: the exclusive
or of hashes of (place, role, text), which composes, so long conversations are handled
in parts.

Contraction alternates two steps in rounds of joins on node keys.  Rake: leaves add their
totals to their parents and go.  Compress: of nodes with one child some that don't touch
each other are taken out; their child hangs from their parent and carries what they
held.  Rounds grow with the logarithm of the nodes, whatever the depth.  Then the rounds
are undone in reverse: a node taken out has its child's total and what it held itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import remove
from .common import columns, new_path, written

#: A conversation c takes the first crc32(c) % HEADS turns of conversation c - c % FAMILY.
FAMILY, HEADS = 5, 9
#: Turns of a conversation that are handled together.
PART = 256
#: Rounds are logarithmic; this many mean a fault.
MAX_ROUNDS = 400
#: Rounds undone in one job.
UNDONE = 4


def _hash(*parts: Column) -> Column:
    """128 bits as a struct of two longs."""
    return F.struct(F.xxhash64(F.lit(1), *parts).alias("a"), F.xxhash64(F.lit(2), *parts).alias("b"))


def _xor(one: Column, two: Column) -> Column:
    return F.struct(one["a"].bitwiseXOR(two["a"]).alias("a"), one["b"].bitwiseXOR(two["b"]).alias("b"))


def _root() -> Column:
    """The key of the sequence without turns."""
    return F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))


def placed(turns: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv_id, place, size, digest) and conversations (conv_id, n_turns).

    Own turns are sorted over the cluster and numbered by parts, so that no task holds a
    conversation of any length.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))
    rows = turns.where("conv_id is not null").select("conv_id", "turn", said.alias("said"), F.octet_length(text).cast("long").alias("size"))
    # the last sort key lets equal rows be dealt to several tasks
    rows = rows.withColumn("tie", F.monotonically_increasing_id()).orderBy("conv_id", F.col("turn").asc_nulls_first(), "said", "tie")
    rows = written(rows.select("conv_id", "said", "size", F.monotonically_increasing_id().alias("at")).withColumn("part", F.floor(F.col("at") / PART)), "turns", folder)

    parts = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    whole = Window.partitionBy("conv_id")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("conv_id", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(whole).alias("n_own"))
    parts = parts.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).withColumn("from", F.col("conv_id") - F.col("conv_id") % FAMILY)
    lengths = parts.where((F.col("conv_id") % FAMILY == 0) & (F.col("base") == 0)).select(F.col("conv_id").alias("from"), F.col("n_own").alias("n_from"))
    parts = parts.join(lengths, "from", "left").withColumn("taken", F.least("h", F.coalesce("n_from", F.lit(0))))
    parts = written(parts.withColumn("n_turns", F.col("taken") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))), "parts", folder)

    numbered = rows.join(parts, ["conv_id", "part"]).withColumn("own", F.col("base") + F.col("at") - F.col("first"))
    # each row goes on as an own turn, and as a head of its family's conversations if it is one
    kept = numbered.where(F.col("own") >= F.col("h")).select("conv_id", (F.col("taken") + F.col("own") - F.col("h")).alias("place"), "size", "said")
    heads = numbered.where((F.col("conv_id") % FAMILY == 0) & (F.col("own") < HEADS - 1)).select(F.col("conv_id").alias("from"), F.col("own").alias("place"), "size", "said")
    convs = parts.where("base = 0").select("conv_id", "from", "taken", "n_turns")
    lent = convs.where("taken > 0").join(heads, "from").where(F.col("place") < F.col("taken")).select("conv_id", "place", "size", "said")
    return kept.unionByName(lent).select("conv_id", "place", "size", _hash("place", "said").alias("digest")), convs.select("conv_id", "n_turns")


def prefixes(rows: DataFrame, folder: str) -> DataFrame:
    """(conv_id, depth, node, parent, size) of every rebuilt turn: the prefix that ends there and the one before."""
    rows = rows.withColumn("part", F.floor(F.col("place") / PART))
    upto = Window.partitionBy("conv_id", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = F.struct(F.bit_xor("digest.a").over(upto).alias("a"), F.bit_xor("digest.b").over(upto).alias("b"))
    inside = written(rows.select("conv_id", "part", "place", "size", "digest", running.alias("inner")), "prefixes", folder)
    totals = inside.groupBy("conv_id", "part").agg(F.bit_xor("digest.a").alias("a"), F.bit_xor("digest.b").alias("b"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = F.struct(F.coalesce(F.bit_xor("a").over(before), F.lit(0)).alias("a"), F.coalesce(F.bit_xor("b").over(before), F.lit(0)).alias("b"))
    long = totals.join(totals.where("part > 0").select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", "part", base.alias("base"))
    found = inside.join(long, ["conv_id", "part"], "left").withColumn("node", _xor(F.col("inner"), F.coalesce("base", _root())))
    return found.select("conv_id", (F.col("place") + 1).alias("depth"), "node", _xor(F.col("node"), F.col("digest")).alias("parent"), "size")


def _digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): the digest of ascending conv_ids of each node that conversations end at.

    Ids are put in order over the cluster; a task joins those it has of a node, and the
    pieces of a node are then joined: the text of a node's ids is one value.
    """
    dealt = ends.repartitionByRange("node", "conv_id").withColumn("task", F.spark_partition_id())
    pieces = dealt.groupBy("node", "task").agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    piece = F.struct(F.col("ids")[0].alias("least"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("text"))
    whole = pieces.select("node", piece.alias("piece")).groupBy("node").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    return whole.select("node", F.sha2(F.array_join("pieces.text", ",").cast("binary"), 256).alias("ends_sha256"))


def subtree_totals(tree: DataFrame, *weights: str, parent: str = "parent") -> DataFrame:
    """(node, each of `weights` summed over the node's subtree) by rake and compress.

    `tree` has node, its parent (null: a root; there may be several) and long weights.
    Keys may have any type that can be compared; a parent that isn't a node is an error of
    the caller: its subtree is left out.  Tables of the rounds are deleted at the end.
    """
    spark = tree.sparkSession
    folder = new_path(spark, "contraction")
    held, carried = [f"h_{w}" for w in weights], [f"c_{w}" for w in weights]
    nodes = tree.select("node", F.col(parent).alias("parent"), *[F.col(w).cast("long").alias(h) for w, h in zip(weights, held, strict=True)])
    kids = nodes.groupBy("parent").agg(F.count("*").alias("kids")).withColumnRenamed("parent", "of")
    eaten = F.struct("node", *held)
    alive = nodes.join(kids, F.col("node") == F.col("of"), "left").select("node", "parent", F.coalesce("kids", F.lit(0)).alias("kids"), *held, *[F.lit(0).cast("long").alias(c) for c in carried])
    alive = written(alive.withColumn("eaten", F.when(F.lit(False), eaten)), "alive", folder)
    rounds: list[DataFrame] = []
    while alive.where("parent is not null").limit(1).count():
        if len(rounds) > MAX_ROUNDS:
            raise RuntimeError(f"the tree isn't contracted after {MAX_ROUNDS} rounds")
        rounds.append(alive)
        leaf = F.col("kids") == 0
        given = [F.sum(F.when(leaf, F.col(h) + F.col(c)).otherwise(0)).alias(f"g_{w}") for w, h, c in zip(weights, held, carried, strict=True)]
        up = alive.where("parent is not null").groupBy(F.col("parent").alias("of")).agg(F.count(F.when(~leaf, 1)).alias("left"), F.min(F.when(~leaf, F.col("node"))).alias("only"), *given)
        raked = alive.where((F.col("kids") > 0) | F.col("parent").isNull()).drop("kids", "eaten").join(up, F.col("node") == F.col("of"), "left")
        raked = raked.select(
            "node", "parent", F.coalesce("left", F.lit(0)).alias("kids"), "only",
            *[(F.col(h) + F.coalesce(f"g_{w}", F.lit(0))).alias(h) for w, h in zip(weights, held, strict=True)], *carried,
        )
        draw = lambda x: F.xxhash64(F.lit(len(rounds)), x)  # noqa: E731, B023
        own = draw(F.col("node"))
        out = (F.col("kids") == 1) & F.col("parent").isNotNull() & (own < draw(F.col("only"))) & (own < draw(F.col("parent")))
        raked = written(raked.withColumn("out", F.coalesce(out, F.lit(False))), "raked", folder)
        gone = raked.where("out").select(F.col("only").alias("to"), F.col("parent").alias("up"), F.col("node").alias("e_node"), *[F.col(h).alias(f"e_{h}") for h in held], *[F.col(c).alias(f"e_{c}") for c in carried])
        joined = raked.where("not out").join(gone, F.col("node") == F.col("to"), "left")
        # what the node taken out has beside its child's total, and what the child carries from now on
        beside = F.struct(F.col("e_node").alias("node"), *[(F.col(f"e_{h}") + F.col(c)).alias(h) for h, c in zip(held, carried, strict=True)])
        more = [(F.col(c) + F.coalesce(F.col(f"e_{h}") + F.col(f"e_{c}"), F.lit(0))).alias(c) for h, c in zip(held, carried, strict=True)]
        alive = joined.select("node", F.when(F.col("to").isNotNull(), F.col("up")).otherwise(F.col("parent")).alias("parent"), "kids", *held, *more, F.when(F.col("to").isNotNull(), beside).alias("eaten"))
        alive = written(alive, "alive", folder)
    known = alive.select("node", *held)
    after = [*rounds[1:], alive]
    for k in reversed(range(len(rounds))):
        taken = after[k].where("eaten is not null").select(F.col("node").alias("by"), "eaten")
        both = known.join(taken, F.col("node") == F.col("by"), "left")
        made = F.struct(F.col("eaten.node").alias("node"), *[(F.col(h) + F.col(f"eaten.{h}")).alias(h) for h in held])
        both = both.select(F.explode(F.when(F.col("by").isNull(), F.array(F.struct("node", *held))).otherwise(F.array(F.struct("node", *held), made))).alias("x")).select("x.*")
        known = both.unionByName(rounds[k].where("kids = 0 and parent is not null").select("node", *held))
        if k % UNDONE == 0 and k:
            known = written(known, "known", folder)
    done = written(known.select("node", *[F.col(h).alias(w) for w, h in zip(weights, held, strict=True)]), "totals")
    remove(spark, folder)
    return done


def trie(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each node of the trie of rebuilt conversations; see the columns below.

    conv_id (the least member), depth, parent_conv_id, n_convs, n_children, n_leaves and
    saved_tokens of the subtree, ends_sha256.  Turns are ordered by number (null first),
    turns of one number by the MD5 of role and text; repeated turns stay.  Rows without a
    conv_id belong to no conversation and are left out.  A null role or text is empty.
    An empty table has no root: the result is empty.
    """
    spark = turns.sparkSession
    folder = new_path(spark, "trie")
    rows, convs = placed(columns(turns, conv_id=conv_id, turn=turn, role=role, text=text).withColumn("conv_id", F.col("conv_id").cast("long")), folder)
    paths = written(prefixes(rows, folder), "paths", folder)
    n_convs, least = convs.agg(F.count("*"), F.min("conv_id")).first()
    if not n_convs:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    nodes = paths.groupBy("node", "depth").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("parent").alias("parent"), F.min("size").alias("size"))
    top = spark.range(1).select(_root().alias("node"), F.lit(0).cast("long").alias("depth"), F.lit(least).cast("long").alias("conv_id"), F.lit(n_convs).cast("long").alias("n_convs"), F.when(F.lit(False), _root()).alias("parent"), F.lit(0).cast("long").alias("size"))
    nodes = nodes.unionByName(top)
    kids = nodes.where("parent is not null").groupBy(F.col("parent").alias("of")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(kids, F.col("node") == F.col("of"), "left").drop("of").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = written(nodes.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("size")}), "nodes")
    totals = subtree_totals(nodes, "leaf", "saved").select("node", F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    last = paths.join(convs, "conv_id").where(F.col("depth") == F.col("n_turns")).select("node", "conv_id")
    ends = written(_digests(last.unionByName(convs.where("n_turns = 0").select(_root().alias("node"), "conv_id"))), "ends")
    remove(spark, folder)
    # the root's children may be most nodes: they don't join
    parents = nodes.select(F.col("node").alias("of"), F.col("conv_id").alias("parent_conv_id"))
    deep = nodes.where("depth > 1").join(parents, F.col("parent") == F.col("of")).drop("of")
    flat = nodes.where("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(least).cast("long")))
    found = reduce(lambda x, y: x.join(y, "node", "left"), (totals, ends), deep.unionByName(flat))
    none = F.sha2(F.lit("").cast("binary"), 256)
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))
