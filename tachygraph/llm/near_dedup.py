"""MinHash near-duplicate groups by tensored banding.

Two collections of TUPLES short minhash tuples each are computed for a text; the table keys are all pairs of a tuple of the
first and a tuple of the second. So TUPLES * TUPLES tables of keys of 2 * WIDTH minhashes cost 2 * TUPLES * WIDTH
minhashes, about the square root. At similarity 0.85 a link is missed with a chance of about 7e-5. Candidates are confirmed
on full shingle sets.

Texts with equal shingle sets form a class, linked whole without a pair. Among classes, each table's bucket is linked in
rounds: first every member with the bucket's least id, then, in buckets that still hold more than one component, every
member with the one that shares most of those buckets, and at last all pairs whose components still differ, those within
a bucket's largest component left out. A group of thousands of near copies so costs a few comparisons for each member, and no
link between components is lost.

Nulls: a null or wordless text has an empty set and is linked with nothing; a row with null doc_id is linked with
nothing, has a null component_id and is kept. Rows that share a doc_id count as one node, whatever their texts, and each get a
row: a link of one of them is a link of all. ``keep_one`` judges texts instead. Empty tables give empty ones. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tachygraph.llm import shingles
from tachygraph.llm.components import components
from tachygraph.llm.scratch import small, table

TUPLES = 8
WIDTH = 2
MIN_SIMILARITY = (85, 100)
#: Further rounds of one leader for each bucket before all remaining pairs are compared.
LEADER_ROUNDS = 1
#: Sketches of some bits for each bin drop candidates that are far from the least similarity before their texts are fetched.
BINS = 512
PLANES = 4
SIGMAS = 4.0

_rng = np.random.default_rng(7)
_N = 2 * TUPLES * WIDTH
_XOR = _rng.integers(0, 1 << 63, _N, dtype=np.uint64) * np.uint64(2) + _rng.integers(0, 2, _N, dtype=np.uint64)
_MUL = _rng.integers(0, 1 << 63, _N, dtype=np.uint64) | np.uint64(1)
_BLOCK = 4096


def minhashes(shingle_set: np.ndarray) -> np.ndarray:
    """2 * TUPLES * WIDTH minhashes of a set of shingle hashes, in blocks of bounded memory."""
    least = np.full(_N, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingle_set), _BLOCK):
        np.minimum(least, ((shingle_set[k : k + _BLOCK, None] ^ _XOR) * _MUL).min(axis=0), out=least)
    return least


def tuple_keys(least: np.ndarray) -> np.ndarray:
    """The 2 * TUPLES tuples, each mixed into one long; the first TUPLES are the first collection."""
    parts = shingles.mix(least).reshape(2 * TUPLES, WIDTH)
    out = np.zeros(2 * TUPLES, np.uint64)
    for k in range(WIDTH):
        out = shingles.mix(out * np.uint64(31) + parts[:, k] + np.uint64(k + 1))
    return out.view(np.int64)


def sketch(shingle_set: np.ndarray) -> np.ndarray:
    """PLANES * BINS bits: shingles fall into BINS bins by their hash; PLANES bits of a bin's least shingle, 0 if it is empty, stand one in each plane."""
    bins = (shingle_set >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)  # sorted, as the set is
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    least = np.zeros(BINS, np.uint64)
    least[bins[first]] = shingles.mix(shingle_set[first])
    return np.packbits(np.stack([(least >> np.uint64(k)) & np.uint64(1) for k in range(PLANES)]).astype(np.uint8), axis=1).view(np.int64).ravel()


_SIGNATURES = "doc_id long, n_shingles long, set_hash string, tuples array<long>, bits array<long>, tid long"


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_hash, tuples, bits, tid) of each row; ``tid`` is the text's hash; equal sets have equal set_hash. Empty sets have nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sets, keys, bits = [], [], [], []
            for own in shingles.shingle_sets(batch.column("text")):
                n.append(len(own))
                if len(own):
                    mixed = shingles.mix(own + np.uint64(len(own)))
                    sets.append(f"{int(mixed.sum(dtype=np.uint64)):016x}{int(np.bitwise_xor.reduce(shingles.mix(mixed))):016x}")
                    keys.append(tuple_keys(minhashes(own)))
                    bits.append(sketch(own))
                else:
                    sets.append(None)
                    keys.append(None)
                    bits.append(None)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(sets, pa.string()), pa.array(keys, longs), pa.array(bits, longs), batch.column("tid")],
                ["doc_id", "n_shingles", "set_hash", "tuples", "bits", "tid"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tid")).mapInArrow(run, _SIGNATURES)


def buckets(classes: DataFrame) -> DataFrame:
    """(key, id, i, j): TUPLES * TUPLES table keys of each class, from its tuples."""
    first = F.posexplode(F.slice("tuples", 1, TUPLES)).alias("i", "x")
    second = F.posexplode(F.slice("tuples", TUPLES + 1, TUPLES)).alias("j", "y")
    return classes.select("id", "tuples", first).select("id", "i", "x", second).select(
        F.xxhash64("i", "x", "j", "y").alias("key"), "id", F.col("i").cast("byte").alias("i"), F.col("j").cast("byte").alias("j"),
    )


def confirm(pairs: DataFrame, docs: DataFrame, least: tuple[int, int] = MIN_SIMILARITY) -> DataFrame:
    """The rows (a, b) of ``pairs`` whose texts' full shingle sets are similar enough; ``docs``: doc_id, text."""
    ids = table(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = texts.join(small(ids), texts["doc_id"] == ids["id"], "left_semi")
    rows = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    part, whole = least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(shingles.shingle_sets(batch.column("text_a")), shingles.shingle_sets(batch.column("text_b")), strict=True):
                common = 0
                if min(len(x), len(y)) * whole >= part * max(len(x), len(y)):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                near.append(common > 0 and whole * common >= part * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(near, pa.bool_()))

    return rows.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def can_link(x: str, y: str, least: tuple[int, int] = MIN_SIMILARITY) -> str:
    """SQL: sets with the size and bits of ``x`` and ``y`` can be similar enough.

    The sizes' bound is exact. Sets differ at most in as many bins as their symmetric difference has shingles, and with
    chance (1 - s)(1 - 1 / 2^PLANES) in a bin that holds a shingle of either, s being their similarity. A pair is dropped
    if it differs in more bins than the first allows, or in SIGMAS standard deviations more than the second makes likely
    at the least similarity (a chance of about 3e-5, below that of the banding).
    """
    part, whole = least
    share = (1 - part / whole) * (1 - 0.5**PLANES)
    bins = f"{BINS}D * (1D - exp(-greatest({x}size, {y}size) * {whole / part / BINS}D))"
    words = BINS // 64
    differ = " + ".join("bit_count(" + " | ".join(f"({x}b{p * words + k} ^ {y}b{p * words + k})" for p in range(PLANES)) + ")" for k in range(words))
    likely = f"1D + {share}D * ({bins}) + {SIGMAS * (share * (1 - share)) ** 0.5}D * sqrt({bins})"
    return f"({whole} * least({x}size, {y}size) >= {part} * greatest({x}size, {y}size) and {differ} <= least({likely}, ({x}size + {y}size) * {(whole - part) / (whole + part)}D + 1e-6D))"


def first_table(x: str, y: str) -> str:
    """SQL: table (i, j) is the first one that ``x`` and ``y`` share, so that a pair comes out once."""
    earlier = [f"(i > {k} and {x}t{k} = {y}t{k})" for k in range(TUPLES)] + [f"(j > {k} and {x}t{TUPLES + k} = {y}t{TUPLES + k})" for k in range(TUPLES)]
    return f"not ({' or '.join(earlier)})"


def side(classes: DataFrame, name: str, tuples: bool) -> DataFrame:
    """The classes with their sketch (and tuples) in flat columns, all prefixed with ``name`` and _ (the id: ``name``)."""
    flat = [F.col("size").alias(f"{name}_size")] + [F.col("bits")[k].alias(f"{name}_b{k}") for k in range(PLANES * BINS // 64)]
    return classes.select(F.col("id").alias(name), *flat, *[F.col("tuples")[k].alias(f"{name}_t{k}") for k in range(2 * TUPLES if tuples else 0)])


def class_links(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) that hold the components of the classes (id, size, tuples, bits) together; ``docs`` has their texts."""
    keys = buckets(classes)
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("leader")).filter("n > 1")
    members = table(keys.join(shared.select("key", "leader"), "key"), "members")
    stars = members.filter("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    pairs = table(stars.join(side(classes, "b", False), "b").join(side(classes, "a", False), "a").filter(can_link("a_", "b_")).select("a", "b"), "pairs")
    tested = pairs
    links = table(confirm(pairs, docs), "links")
    rows = members.select("key", "id", "i", "j")
    for turn in range(LEADER_ROUNDS + 1):
        labels = components(links)
        placed = rows.join(small(labels), "id", "left").select("key", "id", "i", "j", F.coalesce("component", "id").alias("component"))
        mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
        placed = table(placed.join(mixed, "key", "left_semi"), "mixed")
        if placed.isEmpty():
            return links
        if turn < LEADER_ROUNDS:
            popular = placed.groupBy("id").agg(F.count("*").alias("weight"))
            leader = placed.join(popular, "id").groupBy("key").agg(F.max(F.struct("weight", "id")).alias("x")).select("key", F.col("x.id").alias("lead"))
            lead = placed.select(F.col("id").alias("lead"), F.col("component").alias("lead_component")).distinct()
            leader = leader.join(lead, "lead")
            pairs = placed.join(leader, "key").filter("component <> lead_component").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
            pairs = pairs.join(side(classes, "a", False), "a").join(side(classes, "b", False), "b").filter(can_link("a_", "b_")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        else:
            #: Members of a bucket's largest component meet only those of others, so that a large family with a few strangers stays linear.
            sizes = placed.groupBy("key", "component").agg(F.count("*").alias("size"))
            largest = sizes.groupBy("key").agg(F.max(F.struct("size", "component")).alias("x")).select("key", F.col("x.component").alias("largest"))
            known = placed.join(largest, "key").withColumn("strange", F.col("component") != F.col("largest"))
            full = known.filter("strange").select("key", F.col("id").alias("a"), "i", "j", "component").join(side(classes, "a", True), "a")
            other = known.select("key", F.col("id").alias("b"), F.col("component").alias("other"), "strange").join(side(classes, "b", True), "b")
            pairs = full.join(other, "key").filter(f"(a < b or not strange) and component <> other and {first_table('a_', 'b_')} and {can_link('a_', 'b_')}")
            pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = table(pairs.distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = tested.union(pairs)
        links = table(links.union(confirm(pairs, docs)), "links")
        rows = placed.select("key", "id", "i", "j")
    return links


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text)."""
    rows, classes, links = _linked(docs)
    #: A doc_id of several sets is one node, so its classes are linked; each class is named by its least doc_id.
    several = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce("set_hash", F.lit(""))).alias("lo"), F.max(F.coalesce("set_hash", F.lit(""))).alias("hi")).filter("lo <> hi")
    several = table(several.select(F.col("doc_id").alias("shared_id")), "several")
    if several.isEmpty():
        return _placed(rows, classes, components(links)).select("doc_id", "n_shingles", "component_id", "kept")
    own = rows.join(small(several), F.col("doc_id") == F.col("shared_id"), "left_semi").filter("set_hash is not null").select("doc_id", "set_hash").distinct()
    ends = table(own.join(classes.select("set_hash", "id"), "set_hash").select(F.col("doc_id").alias("a"), F.col("id").alias("b")).filter("a <> b"), "shared")
    labels = components(links.select("a", "b").union(ends))
    out = _placed(rows, classes, labels)
    #: Also rows without words of such a doc_id belong to its component.
    named = several.join(labels, F.col("shared_id") == F.col("id"), "left").select("shared_id", F.coalesce("component", "shared_id").alias("shared_component"))
    out = out.join(small(table(named, "named")), F.col("doc_id") == F.col("shared_id"), "left")
    component = F.coalesce("shared_component", "component_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _linked(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows' signatures, the classes of equal sets, and the links (a, b) between classes."""
    rows = table(signatures(docs), "signatures")
    classes = table(
        rows.filter("doc_id is not null and set_hash is not null").groupBy("set_hash").agg(
            F.min("doc_id").alias("id"), F.first("n_shingles").alias("size"), F.first("tuples").alias("tuples"), F.first("bits").alias("bits"), F.count("*").alias("n"),
        ),
        "classes",
    )
    return rows, classes, class_links(classes.select("id", "size", "tuples", "bits"), docs)


def _placed(rows: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, tid): each row with the component of its own set."""
    placed = classes.join(small(labels), "id", "left").select(
        "set_hash", F.coalesce("component", "id").alias("component_id"), F.col("n").alias("copies"), F.col("component").isNotNull().alias("linked"),
    )
    #: Only classes that are larger than one row or linked with others need a lookup.
    placed = table(placed.filter("copies > 1 or linked").select("set_hash", "component_id"), "placed")
    out = rows.select("doc_id", "n_shingles", "set_hash", "tid").join(small(placed), "set_hash", "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"), "tid")


def keep_one(docs: DataFrame, repeats: bool = True) -> DataFrame:
    """One document of each group of near duplicates (its smallest doc_id), with all columns.

    Each row is judged by its own text, so a row stays if only another text of its doc_id goes. Rows that repeat a doc_id and text are
    all kept, or one of them without ``repeats``.
    """
    rows, classes, links = _linked(docs)
    found = table(_placed(rows, classes, components(links)), "groups")
    gone = table(found.filter("not kept").select(F.col("doc_id").alias("gone_id"), F.col("tid").alias("gone_tid")).distinct(), "gone")
    tid = F.xxhash64("text")
    out = docs.join(small(gone), (docs["doc_id"] == gone["gone_id"]) & (tid == gone["gone_tid"]), "left_anti")
    if repeats:
        return out
    twice = table(found.filter("kept").groupBy(F.col("doc_id").alias("twice_id"), F.col("tid").alias("twice_tid")).count().filter("count > 1").drop("count"), "twice")
    if twice.isEmpty():
        return out
    same = F.col("doc_id").eqNullSafe(F.col("twice_id")) & (tid == F.col("twice_tid"))
    place = F.row_number().over(Window.partitionBy("doc_id", "text").orderBy(*[c for c in docs.columns if c not in ("doc_id", "text")], F.lit(0)))
    one = out.join(small(twice), same, "left_semi").withColumn("place_", place).filter("place_ = 1").drop("place_")
    return out.join(small(twice), same, "left_anti").unionByName(one)
