r"""Quotation linking of conversations, in DataFrame functions only.

1. Lines that begin with ``>`` are quoted; their level is the number of ``>`` before the text. Lines of one level on end are a
   passage.
2. A passage is normalised (case, white space) and hashed. Messages are hashed whole, by paragraph and by line, without what
   they quote themselves; and, where a passage of several lines or paragraphs may begin, by as many consecutive ones.
3. A passage of GRAM words or more may be any stretch of words of a message: the rarest of its runs of GRAM words leads to
   places in distinct message bodies, where the passage's words are compared whole. Shorter ones must be whole lines.
4. A passage is joined to the originals of its hash: the latest earlier turn of its own conversation, else the first message
   of any other one. Only hashes that are quoted are looked up, and each hash is one row for each conversation and turn, so a
   common line costs no pairs.
5. A message replies to the original of its first passage of the lowest level that has one in its own conversation. Links
   are followed to the root by pointer jumping; a message without a link begins a thread.
6. Within a thread, ``place`` numbers the messages depth first, replies to one message in the order of their turns: the
   tour that goes down and up the tree is a list, whose ranks are found by pointer jumping. Ordered by conv_id, thread and
   place, a conversation is in reply order, and every message's replies follow it at once.

Nulls: a null text is empty; rows with a null conv_id or turn are kept and linked with nothing. Rows that share conv_id and
turn are all kept, and count as one message in links. Empty tables give empty ones. Columns beyond conv_id, turn, role and
text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tachygraph.llm.scratch import small, table

#: Words from which on a passage may be any part of a message.
GRAM = 5
#: Turns within which replies to one message are ordered by one task.
_TURNS = 4096

_MARK = r"^[ \t]*>"
_PARAGRAPH = r"\n[ \t]*\n"
_MARKS = r"(?s)^((?:[ \t]*>)++)[ \t]?(.*)$"


def normal(text: Column) -> Column:
    """Lower case, white space runs as one space, no space at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\s ]+", " "))


def _hash(text: Column) -> Column:
    return F.sha2(normal(text), 256)


def without_quotes(text: Column) -> Column:
    """``text`` without its quoted lines, and without the white space that is then at its ends."""
    return F.btrim(F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.rlike(_MARK)), "\n"), F.lit(" \t\r\n"))


def passages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, at, level, passage): runs of quoted lines of one level, in order, of messages that quote at all."""
    quoting = messages.filter(F.col("text").rlike("(?m)" + _MARK)).select("conv_id", "turn", F.col("text")).distinct()
    lines = quoting.select("conv_id", "turn", F.sha2("text", 256).alias("message"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    marks = F.regexp_extract("line", _MARKS, 1)
    lines = lines.select(
        "conv_id", "turn", "message", "at", F.length(F.translate(marks, " \t", "")).alias("level"),
        F.when(F.col("line").rlike(_MARK), F.regexp_extract("line", _MARKS, 2)).alias("words"),
    )
    by = Window.partitionBy("conv_id", "turn", "message").orderBy("at")
    begins = (F.col("level") != F.lag("level", 1, 0).over(by)).cast("int")
    lines = lines.withColumn("run", F.sum(begins).over(by))
    runs = lines.filter("level > 0").groupBy("conv_id", "turn", "message", "run", "level").agg(
        F.min("at").alias("at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda x: x["words"]), "\n").alias("passage"),
    )
    return runs.filter(normal(F.col("passage")) != "").select("conv_id", "turn", "at", "level", "passage")


def _sequences(text: Column) -> Column:
    """The normalised lines of ``text`` and its normalised paragraphs: two arrays without empty ones."""
    return F.array(*[F.filter(F.transform(F.split(text, by), normal), lambda u: u != "") for by in ("\n", _PARAGRAPH)])


def _stretch_key(units: Column) -> Column:
    """Key of consecutive units; a line feed is in no key of one unit."""
    return F.sha2(F.array_join(units, "\n"), 256)


def _stretches(own: DataFrame, quoted: DataFrame) -> DataFrame:
    """(conv_id, turn, key): stretches of two or more consecutive lines or paragraphs of ``own`` (body) that begin and are as long as a passage's.

    Two units lead to the places where a stretch begins, so that each place meets only the lengths that are asked for there.
    """
    asked = quoted.select(F.explode(_sequences(F.col("passage"))).alias("units")).filter("size(units) > 1")
    asked = table(asked.select(_stretch_key(F.slice("units", 1, 2)).alias("begin"), F.size("units").alias("n")).distinct(), "asked")
    pieces = own.select("conv_id", "turn", F.sha2("body", 256).alias("message"), F.posexplode(_sequences(F.col("body"))).alias("grain", "units")).filter("size(units) > 1")
    begins = F.zip_with(F.slice("units", F.lit(1), F.size("units") - 1), F.slice("units", F.lit(2), F.size("units") - 1), lambda a, b: _stretch_key(F.array(a, b)))
    places = pieces.select("conv_id", "turn", "message", "grain", F.posexplode(begins).alias("place", "begin")).join(small(asked), "begin")
    places = table(places.select("conv_id", "turn", "message", "grain", "place", "n").distinct(), "places")
    whole = pieces.join(small(places), ["conv_id", "turn", "message", "grain"]).filter(F.col("place") + F.col("n") <= F.size("units"))
    return whole.select("conv_id", "turn", _stretch_key(F.slice("units", F.col("place") + 1, F.col("n"))).alias("key"))


def _grams(words: Column) -> Column:
    """The hashes of every GRAM words on end."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - (GRAM - 1)), lambda k: F.xxhash64(F.slice(words, k, GRAM)))


def _contained(own: DataFrame, quoted: DataFrame) -> DataFrame:
    """(conv_id, turn, key): messages of ``own`` (body) that contain the words of a passage of GRAM words or more, by the passage's key."""
    words = lambda x: F.split(normal(F.col(x)), " ")
    asked = quoted.select(_hash(F.col("passage")).alias("key"), words("passage").alias("words")).filter(F.size("words") >= GRAM).dropDuplicates(["key"])
    asked = table(asked.select("key", F.size("words").alias("n"), F.posexplode(_grams(F.col("words"))).alias("offset", "gram")), "asked")
    wanted = table(asked.select("gram").distinct(), "grams")
    #: Equal bodies are looked at once.
    bodies = own.select(F.sha2("body", 256).alias("message"), words("body").alias("words")).filter(F.size("words") >= GRAM)
    runs = bodies.select("message", F.posexplode(_grams(F.col("words"))).alias("at", "gram"))
    postings = table(runs.join(small(wanted), "gram", "left_semi").distinct(), "postings")
    counts = table(postings.groupBy("gram").agg(F.count("*").alias("df")), "gram_counts")
    rated = asked.join(small(counts), "gram", "left")
    #: A passage of which no message holds some run is in none.
    rarest = rated.groupBy("key").agg(F.min("n").alias("n"), F.min(F.coalesce("df", F.lit(0))).alias("least"), F.min(F.struct("df", "offset", "gram")).alias("best")).filter("least > 0")
    rarest = table(rarest.select("key", "n", "best.offset", "best.gram"), "rarest")
    places = postings.join(small(rarest), "gram").select("message", "key", "n", (F.col("at") - F.col("offset")).alias("begin")).filter("begin >= 0")
    places = table(places, "places")
    whole = bodies.join(small(places), "message")
    found = whole.filter(F.sha2(F.array_join(F.slice("words", F.col("begin") + 1, F.col("n")), " "), 256) == F.col("key")).select("message", "key").distinct()
    found = table(found, "contained")
    return own.select("conv_id", "turn", F.sha2("body", 256).alias("message")).join(small(found), "message").select("conv_id", "turn", "key")


def links(messages: DataFrame, quoted: DataFrame) -> DataFrame:
    """``quoted`` with the original's origin_conv and origin_turn, null where none is found.

    A passage is found as a whole message, paragraph or line, as consecutive lines or paragraphs, or, from GRAM words on, as any
    stretch of a message's words.
    """
    many = F.filter(_sequences(F.col("passage")), lambda units: F.size(units) > 1)
    keys = F.array_distinct(F.concat(F.array(_hash(F.col("passage"))), F.transform(many, _stretch_key)))
    keyed = quoted.withColumn("keys", keys).select(*quoted.columns, F.size("keys").alias("n_keys"), F.explode("keys").alias("key"))
    wanted = table(keyed.select("key").distinct(), "wanted")
    own = messages.filter("conv_id is not null and turn is not null").select("conv_id", "turn", without_quotes(F.col("text")).alias("body")).filter("body <> ''")
    units = F.array_distinct(F.transform(F.concat(F.array("body"), F.split("body", _PARAGRAPH), F.split("body", "\n")), normal))
    originals = own.select("conv_id", "turn", F.explode(units).alias("unit")).filter("unit <> ''").select("conv_id", "turn", F.sha2("unit", 256).alias("key"))
    originals = originals.unionByName(_stretches(own, quoted)).join(small(wanted), "key", "left_semi")
    originals = table(originals.unionByName(_contained(own, quoted)).distinct(), "originals")
    #: Quotes and originals of one hash in one conversation in the order of turns: the last original before a quote is its own.
    both = originals.select(
        "key", "conv_id", "turn", F.col("turn").alias("origin"), F.lit(None).cast("int").alias("at"),
    ).unionByName(keyed.select("key", "conv_id", "turn", F.lit(None).cast(originals.schema["turn"].dataType).alias("origin"), F.col("at")))
    before = Window.partitionBy("key", "conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("near", F.max("origin").over(before)).filter("at is not null and near is not null").select("key", "conv_id", "turn", "at", F.col("near").alias("near_turn")).distinct()
    first = table(originals.groupBy("key").agg(F.min(F.struct("conv_id", "turn")).alias("first")), "first")
    joined = keyed.join(near, ["key", "conv_id", "turn", "at"], "left").join(small(first), "key", "left")
    #: The keys of a passage as one row again; equal passages of several messages stay as many.
    joined = joined.groupBy(*quoted.columns).agg(F.max("near_turn").alias("near_turn"), F.min("first").alias("first"), F.try_divide(F.count("*"), F.first("n_keys")).cast("int").alias("copies"))
    joined = joined.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
    other = F.col("near_turn").isNull() & (F.col("first.conv_id") != F.col("conv_id"))
    return joined.select(
        "conv_id", "turn", "at", "level", "passage", F.when(F.col("near_turn").isNotNull(), F.col("conv_id")).when(other, F.col("first.conv_id")).alias("origin_conv"),
        F.coalesce("near_turn", F.when(other, F.col("first.turn"))).alias("origin_turn"),
    )


def threads(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, root, depth) of messages with a parent (conv_id, turn, parent), by pointer jumping; each round is a written table."""
    found = table(parents.select("conv_id", "turn", F.col("parent").alias("root"), F.lit(1).alias("depth")), "threads")
    while True:
        above = found.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("root").alias("next"), F.col("depth").alias("more"))
        moved = found.join(above, (F.col("conv_id") == F.col("c")) & (F.col("root") == F.col("t")), "left")
        moved = table(
            moved.select("conv_id", "turn", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")),
            "threads",
        )
        found = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            return found


def places(nodes: DataFrame) -> DataFrame:
    """(conv_id, turn, place) of the messages (conv_id, turn, root, parent; a root's parent is null): 0 for a root, then depth first.

    Each message is entered and left once. What follows an entry is the entry of the first reply, or else the exit; what follows an
    exit is the entry of the next reply to the same message, or else the exit of that one. Entries from one on to the end
    are summed by pointer jumping, each round a written table.
    """
    #: The next reply, within some turns, or else the first one of the next turns that have any: no task orders all replies to one message.
    kin = nodes.filter("parent is not null").withColumn("block", F.floor(F.col("turn") / _TURNS))
    blocks = kin.groupBy("conv_id", "parent", "block").agg(F.min("turn").alias("lowest"))
    blocks = blocks.select("conv_id", "parent", "block", "lowest", F.lead("lowest").over(Window.partitionBy("conv_id", "parent").orderBy("block")).alias("later"))
    near = F.lead("turn").over(Window.partitionBy("conv_id", "parent", "block").orderBy("turn"))
    kin = kin.withColumn("near", near).join(blocks, ["conv_id", "parent", "block"]).select("conv_id", "turn", F.coalesce("near", "later").alias("sibling"))
    eldest = blocks.groupBy("conv_id", F.col("parent").alias("turn")).agg(F.min("lowest").alias("child"))
    known = nodes.join(eldest, ["conv_id", "turn"], "left").join(kin, ["conv_id", "turn"], "left")
    entry, out = F.lit(0), F.lit(1)
    down = F.when(F.col("child").isNotNull(), F.struct(F.col("child").alias("turn"), entry.alias("side"))).otherwise(F.struct(F.col("turn").alias("turn"), out.alias("side")))
    up = F.when(
        F.col("sibling").isNotNull(), F.struct(F.col("sibling").alias("turn"), entry.alias("side")),
    ).when(F.col("parent").isNotNull(), F.struct(F.col("parent").alias("turn"), out.alias("side")))
    steps = F.explode(F.array(
        F.struct(entry.alias("side"), F.lit(1).cast("long").alias("entries"), down.alias("next")),
        F.struct(out.alias("side"), F.lit(0).cast("long").alias("entries"), up.alias("next")),
    ))
    tour = known.select("conv_id", "turn", "root", steps.alias("s")).select(
        "conv_id", "turn", "root", "s.side", "s.entries", F.col("s.next.turn").alias("next_turn"), F.col("s.next.side").alias("next_side"),
    )
    tour = table(tour, "tour")
    while not tour.filter("next_turn is not null").isEmpty():
        ahead = tour.select(
            F.col("conv_id").alias("c"), F.col("turn").alias("next_turn"), F.col("side").alias("next_side"), F.col("entries").alias("more"),
            F.col("next_turn").alias("far_turn"), F.col("next_side").alias("far_side"),
        )
        met = tour.join(ahead.withColumnRenamed("c", "conv_id"), ["conv_id", "next_turn", "next_side"], "left")
        tour = table(
            met.select(
                "conv_id", "turn", "root", "side", (F.col("entries") + F.coalesce("more", F.lit(0))).alias("entries"), F.col("far_turn").alias("next_turn"),
                F.col("far_side").alias("next_side"),
            ),
            "tour",
        )
    entered = tour.filter("side = 0")
    sizes = entered.filter("turn = root").select("conv_id", "root", F.col("entries").alias("size"))
    return entered.join(sizes, ["conv_id", "root"]).select("conv_id", "turn", (F.col("size") - F.col("entries")).alias("place"))


def reply_order(messages: DataFrame) -> DataFrame:
    """One row for each message: (conv_id, turn, role, text, thread, place, depth, parent_turn, n_quotes, n_linked).

    ``text`` is without quotes, ``thread`` the turn of the thread's root. Ordered by conv_id, thread and place, a conversation
    is in reply order.
    """
    rows = messages.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    quoted = table(passages(rows), "passages")
    linked = table(links(rows, quoted), "links")
    own = F.col("origin_conv").eqNullSafe(F.col("conv_id"))
    best = F.struct("level", "at", F.col("origin_turn").alias("turn"))
    found = linked.groupBy("conv_id", "turn").agg(F.count("*").alias("n_quotes"), F.count("origin_turn").alias("n_linked"), F.min(F.when(own, best)).alias("best"))
    found = table(found.select("conv_id", "turn", "n_quotes", "n_linked", F.col("best.turn").alias("parent_turn")), "found")
    rooted = threads(found.filter("parent_turn is not null").select("conv_id", "turn", F.col("parent_turn").alias("parent")))
    found = table(found.join(rooted, ["conv_id", "turn"], "left"), "found")
    replies = found.filter("root is not null").select("conv_id", "turn", "root", F.col("parent_turn").alias("parent"))
    roots = replies.select("conv_id", F.col("root").alias("turn"), "root").distinct().withColumn("parent", F.lit(None).cast(replies.schema["parent"].dataType))
    found = table(found.join(places(table(replies.unionByName(roots), "nodes")), ["conv_id", "turn"], "left"), "found")
    out = rows.join(small(found), ["conv_id", "turn"], "left")
    return out.select(
        "conv_id", "turn", "role", without_quotes(F.col("text")).alias("text"), F.coalesce("root", "turn").alias("thread"),
        F.coalesce("place", F.lit(0)).cast("long").alias("place"), F.coalesce("depth", F.lit(0)).alias("depth"), "parent_turn",
        F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
    )
