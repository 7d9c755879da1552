"""A trie of conversations, built by prefix doubling.

1. Order: turns are ranked in their conversation by a range sort over all partitions and the counts of the partitions before, so a
   conversation of any length is many tasks. Each conversation then borrows its first turns (see ``rebuilt``).
2. Blocks: equal turns get equal dense names. Round by round, two blocks of 2^k turns on end make one of 2^(k+1), named by the pair
   of their names: log2(longest) joins, half as many rows each time.
3. Prefixes: the first d turns are the first d - 2^k (2^k: the lowest bit of d) and a block of 2^k after them; so from the highest
   bit down, each round names the prefixes with that lowest bit by pairs of names, in one join.
4. Nodes: equal prefix names are one node. A node's owner is its smallest member. A conversation owns the nodes from some depth on, so
   what a subtree sums is its owner's sum from there on, and the whole sums of the other members' own nodes.

A name's rows may be a third of all; names that many rows carry are broadcast (HOT_KEYS at most), the others joined by shuffle. Ids
that end at a node are joined in pieces of ID_RANGE ids and hashed as a stream.

Nulls: rows without a conv_id belong to no conversation; null roles and texts are empty; null turns come first. Turns of the same
number are ordered by role, then text; repeated rows are turns of their own. An empty table gives an empty trie. Extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tachygraph.llm.scratch import is_small, small, table
from tachygraph.llm.textwords import count_words

#: Names that are broadcast where not all can be: each is carried by more than one in so many rows.
HOT_KEYS = 100_000
#: Depths in a piece of a conversation, and ids in a piece of a node's ids.
DEPTHS, ID_RANGE = 4096, 1024
#: Characters of roles and texts by which rows are dealt to partitions; within one they are sorted whole.
SORT_CHARS = 64
FAMILY, MOST_BORROWED = 20, 4


def _part(mid: str = "mid") -> Column:
    return F.shiftright(mid, 33)


def ranked(rows: DataFrame) -> DataFrame:
    """(conv_id, mid, key, words): turns in order; the high bits of ``mid`` are the partition, the low ones the place in it."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    own = rows.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role"), text("text"))
    dealt = own.repartitionByRange("conv_id", "turn", F.substring("role", 1, SORT_CHARS), F.substring("text", 1, SORT_CHARS)).sortWithinPartitions("conv_id", "turn", "role", "text")
    key = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    return table(dealt.select("conv_id", F.monotonically_increasing_id().alias("mid"), key.alias("key"), count_words(F.col("text")).alias("words")), "turns")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, length) and their turns (conv_id, at, key, words), ``at`` from 0.

    Conversation c has the first h turns of c - c % FAMILY, then its own after its first h; h is the crc32 of c modulo MOST_BORROWED.
    """
    pieces = turns.groupBy("conv_id", _part().alias("part")).agg(F.min("mid").alias("first"), F.count("*").alias("n"))
    pieces = table(pieces, "pieces")
    lengths = pieces.groupBy("conv_id").agg(F.sum("n").alias("own"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_BORROWED).alias("h")
    lengths = lengths.select("conv_id", "own", h, (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    bases = lengths.filter("conv_id = base").select("base", F.col("own").alias("base_own"))
    borrowed = F.least(F.col("h"), F.coalesce("base_own", F.lit(0)))
    convs = lengths.join(bases, "base", "left").select("conv_id", "base", "h", borrowed.alias("borrowed"), (borrowed + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))
    convs = table(convs, "conversations")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = table(pieces.select("conv_id", "part", (before - F.col("first")).alias("shift")).join(convs.select("conv_id", "h", "borrowed"), "conv_id"), "pieces")
    placed = turns.withColumn("part", _part()).join(small(pieces), ["conv_id", "part"]).withColumn("place", F.col("mid") + F.col("shift"))
    placed = table(placed.select("conv_id", "place", "h", "borrowed", "key", "words"), "places")
    own = placed.filter("place >= h").select("conv_id", (F.col("place") - F.col("h") + F.col("borrowed")).alias("at"), "key", "words")
    heads = placed.filter((F.col("place") < MOST_BORROWED) & (F.col("conv_id") % FAMILY == 0)).select(F.col("conv_id").alias("base"), F.col("place").alias("at"), "key", "words")
    lent = convs.filter("borrowed > 0").select("conv_id", "base", "borrowed").join(heads, "base").filter("at < borrowed").select("conv_id", "at", "key", "words")
    return convs, own.unionByName(lent)


def join_unique(rows: DataFrame, dim: DataFrame, on: list[str], is_small_: bool) -> DataFrame:
    """``rows`` with the columns of ``dim``, whose keys are unique and whose ``weight`` is how many of the rows carry the key.

    Where ``dim`` is too large to broadcast, keys with more than one in HOT_KEYS of all rows are (they are fewer than HOT_KEYS), and
    only the others' rows are shuffled.
    """
    if is_small_:
        return rows.join(F.broadcast(dim.drop("weight")), on)
    total = dim.agg(F.sum("weight")).first()[0] or 0
    hot = F.broadcast(dim.filter(F.col("weight") > total / HOT_KEYS).drop("weight"))
    cold = dim.filter(F.col("weight") <= total / HOT_KEYS).drop("weight")
    return rows.join(hot, on).unionByName(rows.join(hot.select(*on), on, "left_anti").join(cold, on))


def named(rows: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` with ``name``: equal keys have equal names, 0 to their number less one."""
    raw = table(rows.groupBy(*on).agg(F.count("*").alias("weight")).withColumn("mid", F.monotonically_increasing_id()), "names")
    #: One row for each file of ``raw``.
    starts = raw.groupBy(_part().alias("part")).agg(F.count("*").alias("n"))
    starts = starts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    place = F.col("start") + F.col("mid").bitwiseAND(F.lit((1 << 33) - 1))
    dim = raw.withColumn("part", _part()).join(F.broadcast(starts), "part").select(*on, "weight", place.alias("name"))
    return join_unique(rows, dim, on, is_small(raw))


def blocks(turns: DataFrame, longest: int) -> list[DataFrame]:
    """(conv_id, at, name) of the blocks of 2^k turns, for each k: block ``at`` begins at turn at * 2^k."""
    levels = [table(named(turns, ["key"]).select("conv_id", "at", "name", "words"), "blocks")]
    for _ in range(1, longest.bit_length()):
        half = lambda odd: F.max(F.when(F.col("at") % 2 == odd, F.col("name")))
        pairs = levels[-1].groupBy("conv_id", F.floor(F.col("at") / 2).alias("at")).agg(half(0).alias("one"), half(1).alias("other")).filter("one is not null and other is not null")
        levels.append(table(named(pairs, ["one", "other"]).select("conv_id", "at", "name"), "blocks"))
    return levels


def prefixes(convs: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(conv_id, depth, node): the name of each prefix of each conversation; the empty one is node 0."""
    done = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("node"))
    for k in reversed(range(len(levels))):
        ends = levels[k].filter("at % 2 = 0").select("conv_id", F.shiftleft("at", k).alias("before"), F.col("name").alias("last"))
        pairs = ends.join(done.select("conv_id", F.col("depth").alias("before"), F.col("node").alias("rest")), ["conv_id", "before"])
        #: Rounds have name spaces of their own, told apart by the lowest six bits.
        node = F.shiftleft("name", 6) + k + 1
        done = done.unionByName(table(named(pairs, ["rest", "last"]).select("conv_id", (F.col("before") + (1 << k)).alias("depth"), node.alias("node")), "prefixes"))
    return done


def _hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The hash of each node's ids, which come in pieces in order."""
    node, digest = None, None
    for pdf in batches:
        out = []
        for at, ids in zip(pdf["node"].tolist(), pdf["ids"].tolist(), strict=True):
            if at == node:
                digest.update(b",")
            else:
                if digest:
                    out.append((node, digest.hexdigest()))
                node, digest = at, hashlib.sha256()
            digest.update(ids.encode())
        yield pd.DataFrame(out, columns=["node", "sha"])
    if digest:
        yield pd.DataFrame([(node, digest.hexdigest())], columns=["node", "sha"])


def end_hashes(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """(node, sha): the SHA-256 of the ids of the conversations that end at a node."""
    last = paths.join(convs.select("conv_id", F.col("length").alias("depth")), ["conv_id", "depth"])
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    pieces = last.groupBy("node", F.floor(F.col("conv_id") / ID_RANGE).alias("piece")).agg(ids.alias("ids"))
    return pieces.repartition("node").sortWithinPartitions("node", "piece").mapInPandas(_hashes, "node long, sha string")


def prefix_trie(rows: DataFrame) -> DataFrame:
    """One row for each node; see the module's text. (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)."""
    convs, turns = rebuilt(ranked(rows))
    longest = convs.agg(F.max("length")).first()[0] or 0
    levels = blocks(turns, longest) if longest else []
    #: One table, so that later plans hold one scan and not one for each round.
    paths = table(prefixes(convs, levels), "paths")
    nodes = table(paths.groupBy("node").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("owner"), F.min("depth").alias("depth")), "nodes")

    #: The first own node of a conversation hangs on another one's.
    starts = nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.min("depth").alias("start")).filter("start > 0")
    hung = table(starts.withColumn("depth", F.col("start") - 1).join(paths, ["conv_id", "depth"]).select("conv_id", "start", "node"), "hung")
    arms = table(hung.groupBy("node").agg(F.count("*").alias("weight")).join(nodes.select("node", F.col("owner").alias("parent")), "node"), "arms")
    parents = join_unique(hung, arms, ["node"], is_small(arms)).select(F.col("conv_id").alias("owner"), F.col("start").alias("depth"), "parent")

    at = ["owner", "depth"]
    words = levels[0].select(F.col("conv_id").alias("owner"), (F.col("at") + 1).alias("depth"), "words") if levels else None
    last = convs.select(F.col("conv_id").alias("owner"), F.col("length").alias("depth"), F.lit(0).alias("follows"))
    full = nodes.join(words, at, "left") if levels else nodes.withColumn("words", F.lit(0))
    full = full.join(last, at, "left").join(parents, at, "left").join(arms.select("node", "weight"), "node", "left").join(end_hashes(paths, convs), "node", "left")
    children = F.coalesce("weight", F.lit(0)) + F.coalesce("follows", F.lit(1))
    parent = F.when(F.col("depth") > 0, F.coalesce("parent", "owner"))
    saved = (F.col("n_convs") - 1) * F.coalesce("words", F.lit(0))
    full = full.select(*at, "node", "n_convs", parent.alias("parent_conv_id"), children.cast("long").alias("n_children"), saved.alias("saves"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
    full = table(full.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("piece", F.floor(F.col("depth") / DEPTHS)), "full")

    #: Sums from each node on, over the owner's own nodes: in pieces of DEPTHS, and over the sums of the pieces after.
    pieces = full.groupBy("owner", "piece").agg(F.sum("saves").alias("saves_in"), F.sum("leaf").alias("leaves_in"), F.min("depth").alias("start"))
    pieces = table(pieces, "sums")
    after = Window.partitionBy("owner").orderBy(F.col("piece").desc()).rowsBetween(Window.unboundedPreceding, -1)
    later = pieces.select("owner", "piece", F.coalesce(F.sum("saves_in").over(after), F.lit(0)).alias("saves_after"), F.coalesce(F.sum("leaves_in").over(after), F.lit(0)).alias("leaves_after"))
    on = Window.partitionBy("owner", "piece").orderBy(F.col("depth").desc())
    summed = full.join(later, ["owner", "piece"]).withColumn("own_saves", F.sum("saves").over(on) + F.col("saves_after")).withColumn("own_leaves", F.sum("leaf").over(on) + F.col("leaves_after"))

    #: What a conversation's own nodes give to the nodes before them, which others own.
    gifts = pieces.groupBy(F.col("owner").alias("conv_id")).agg(F.min("start").alias("start"), F.sum("saves_in").alias("saves"), F.sum("leaves_in").alias("leaves"))
    gifts = gifts.filter("start > 0 and (saves > 0 or leaves > 0)").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("start") - 1) / DEPTHS))))
    given = paths.withColumn("piece", F.floor(F.col("depth") / DEPTHS)).join(gifts, ["conv_id", "piece"]).filter("depth < start")
    given = given.groupBy("node").agg(F.sum("saves").alias("given_saves"), F.sum("leaves").alias("given_leaves"))
    out = summed.join(given, "node", "left")
    total = lambda own, more: (F.col(own) + F.coalesce(more, F.lit(0))).cast("long")
    return out.select(
        F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", total("own_leaves", "given_leaves").alias("n_leaves"),
        total("own_saves", "given_saves").alias("saved_tokens"), "ends_sha256",
    )
