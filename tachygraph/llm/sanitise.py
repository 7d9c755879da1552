r"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

Base: e-mail addresses, IP addresses, card and phone numbers by pattern, each kind leftmost and without overlap. They are
the protected entities, and so are their classes: a mail domain, a network, a card's issuer, a block of phone numbers, each of which
stands in many texts. Method: the corpus tells how strongly a term reveals an entity. A term co-occurs with an entity in a text
if it stands in the entity's context there, the CONTEXT characters before and after it (up to the next match of its kind). With
n_e, n_t and n_et the numbers of distinct texts that hold entity e, hold term t, and hold t in a context of e, of n in all,

    p(e) = n_e / n        p(e|t) = n_et / n_t        disclosure(t, e) = the lower bound of p(e|t) at CONFIDENCE (Wilson's)
    PMI(t; e) = log2 disclosure(t, e) / p(e)

Terms that disclose an entity with MIN_DISCLOSURE at least, and tell MIN_BITS of information about it at least, become spans
of kind ``term`` wherever they stand: at or above REMOVE they are removed, below it generalised to their class. The bound rises with the
number of texts that agree: a term of one or two texts is no evidence, one of three that all agree is. Neither threshold moves with
the size of the corpus. All counts are over distinct texts, so copies add no evidence.

To count pairs without forming all of them: only terms of contexts are paired; the number of texts in whose contexts a term
stands bounds p(e|t) from above and leaves few terms; only they are counted in the whole corpus.

Nulls: a null text is empty (no spans). A null doc_id keeps its row. Repeated rows each get theirs; an empty table gives
an empty one. Patterns are written so that no text makes them backtrack beyond its own runs. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tachygraph.llm.scratch import small, table

KINDS = ("email", "ip", "card", "phone")
#: Possessive and anchored forms of the contract's patterns: a match can only begin where a run of its first class does, or
#: where the last match ended, so no run is read twice. They match the same spans.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What stands for an entity, and for a generalised term.
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
TERM_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM_CHAR = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

#: Characters on either side of an entity.
CONTEXT = 80
#: Standard deviations that the bound lies below a share: 95 of 100 true shares are above it.
CONFIDENCE = 1.645
MIN_DISCLOSURE = 0.5
MIN_BITS = 3.0
REMOVE = 0.8
#: Texts with disclosing terms up to which their lists are broadcast.
LIST_ROWS = 100_000
#: Matches that are laid out at once; two levels keep a text of very many matches linear.
_BLOCK = 256
_SPAN = "struct<start:int,rank:int,end:int,value:string>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` uses it, in inner lambdas too."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def _near(before: Column, after: Column, width: int) -> Column:
    """The last ``width`` characters of ``before`` and the first of ``after``, without words that are cut."""
    left = F.when(F.length(before) > width, F.regexp_replace(F.right(before, F.lit(width)), r"^\S*+", "")).otherwise(before)
    right = F.when(F.length(after) > width, F.regexp_replace(F.left(after, F.lit(width)), r"\S+$", "")).otherwise(after)
    return F.concat_ws(" ", left, right)


def spans_of(text: str, pattern: Column, rank: int, context: int = 0) -> Column:
    """Array of (start, rank, end, value) of the pattern's matches in the column ``text``, in order; code points, end exclusive.

    Splitting gives the gaps between the matches, so the lengths of both, added up, give the places. With a ``context``,
    ``value`` is followed by what stands so many characters before and after it.
    """
    t = F.col(text)
    kind = _SPAN[:-1] + ",near:string>" if context else _SPAN
    empty = F.array().cast(f"array<{kind}>")
    matched = F.struct(F.regexp_extract_all(t, pattern, F.lit(0)).alias("found"), F.split(t, pattern, -1).alias("gaps"))

    def pieces_of(m: Column) -> Column:
        n = F.size(m["found"])
        if not context:
            return F.zip_with(F.slice(m["gaps"], F.lit(1), n), m["found"], lambda g, v: F.struct(F.length(g).alias("g"), F.length(v).alias("l"), v.alias("v")))
        gaps = F.zip_with(F.slice(m["gaps"], F.lit(1), n), F.slice(m["gaps"], F.lit(2), n), lambda g, h: F.struct(F.length(g).alias("g"), _near(g, h, context).alias("near")))
        return F.zip_with(gaps, m["found"], lambda x, v: F.struct(x["g"].alias("g"), F.length(v).alias("l"), v.alias("v"), x["near"].alias("near")))

    def blocks_of(pieces: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / _BLOCK).cast("int")), lambda b: F.slice(pieces, b * _BLOCK + 1, _BLOCK))

    def sums_of(blocks: Column) -> Column:
        return F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + y["g"] + y["l"]))

    def laid(blocks: Column, sums: Column) -> Column:
        def lay(x: Column, i: Column) -> Column:
            start = F.aggregate(F.slice(sums, F.lit(1), i), F.lit(0), lambda a, y: a + y)
            more = lambda y: [y["near"].alias("near")] if context else []
            span = lambda a, y: F.struct((a["p"] + y["g"]).alias("start"), F.lit(rank).alias("rank"), (a["p"] + y["g"] + y["l"]).alias("end"), y["v"].alias("value"), *more(y))
            step = lambda a, y: F.struct((a["p"] + y["g"] + y["l"]).alias("p"), F.concat(a["out"], F.array(span(a, y))).alias("out"))
            return F.aggregate(x, F.struct(start.alias("p"), empty.alias("out")), step, lambda a: a["out"])

        return F.flatten(F.transform(blocks, lay))

    return _let(matched, lambda m: _let(pieces_of(m), lambda pieces: _let(blocks_of(pieces), lambda blocks: _let(sums_of(blocks), lambda sums: laid(blocks, sums)))))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.transform(F.split(F.reverse(_digits(value)), ""), lambda x: x.cast("int"))
    doubled = F.transform(digits, lambda x, i: F.when(i % 2 == 0, x).otherwise(F.when(x > 4, x * 2 - 9).otherwise(x * 2)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """A match of ``kind`` is a real one."""
    n = F.length(_digits(value))
    if kind == "ip":
        bare = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(value, r"\."), lambda p: (F.length(bare(p)) < 3) | ((F.length(bare(p)) == 3) & (bare(p) <= "255")))
    if kind == "card":
        return n.between(14, 19) & F.when(n.between(14, 19), _luhn(value)).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def _span_valid(kind: str, span: Column) -> Column:
    return valid(kind, span["value"])


def base_spans(docs: DataFrame, context: int = 0) -> DataFrame:
    """``docs`` (with a column ``text``) and a column for each kind: its array of spans (``spans_of``), null where no match is."""
    out = docs
    #: What every match holds; plain searches that spare most texts the patterns.
    hints = {"email": F.contains("text", F.lit("@")), "ip": F.col("text").rlike(r"[0-9]\.[0-9]"), "card": F.col("text").rlike("[0-9]"), "phone": F.contains("text", F.lit("+"))}
    for rank, kind in enumerate(KINDS):
        pattern = F.lit(PATTERNS[kind])
        own = F.filter(spans_of("text", pattern, rank, context), partial(_span_valid, kind))
        out = out.withColumn(f"{kind}_spans", F.when(hints[kind] & F.col("text").rlike(PATTERNS[kind]), own))
    return out


def _all_spans(*arrays: str) -> Column:
    empty = F.array().cast(f"array<{_SPAN}>")
    return F.array_sort(F.concat(*[F.coalesce(F.col(a), empty) for a in arrays]))


def _entity(kind: str, span: Column) -> Column:
    value = span["value"]
    return F.concat(F.lit(f"{kind}:"), {"email": F.lower(value), "ip": value}.get(kind, _digits(value)))


def _class(kind: str, span: Column) -> Column:
    """What an entity has in common with others of its kind."""
    value = span["value"]
    part = {"email": F.lower(F.substring_index(value, "@", -1)), "ip": F.substring_index(value, ".", 3)}.get(kind, F.left(_digits(value), F.lit(6)))
    return F.concat(F.lit(f"class of {kind}:"), part)


def _mentions() -> Column:
    """(entities, near) of each span of a row: the entity by kind and normal form and its class, and its context."""
    empty = F.array().cast("array<struct<entities:array<string>,near:string>>")
    mention = lambda kind, x: F.struct(F.array(_entity(kind, x), _class(kind, x)).alias("entities"), x["near"].alias("near"))
    return F.concat(*[F.coalesce(F.transform(f"{k}_spans", partial(mention, k)), empty) for k in KINDS])


def lower_bound(k: Column, n: Column) -> Column:
    """The lower bound, at CONFIDENCE, of the share that ``k`` of ``n`` say."""
    z, p = CONFIDENCE, F.least(k / n, F.lit(1.0))
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _terms(text: Column) -> Column:
    """The distinct terms of ``text`` outside anything that is shaped like an entity."""
    masked = text
    for kind in KINDS:
        masked = F.regexp_replace(masked, PATTERNS[kind], " ")
    #: Each kind needs a digit or an @.
    shaped = F.when(text.rlike("[0-9@]"), masked).otherwise(text)
    return F.array_distinct(F.split(shaped, TERM_GAP))


def disclosing_terms(docs: DataFrame, min_disclosure: float = MIN_DISCLOSURE) -> DataFrame:
    """(tid, term, disclosure) for each text (by hash) of ``docs`` (text) and each disclosing term in it."""
    by_hash = docs.filter(F.col("text").isNotNull()).select(F.xxhash64("text").alias("tid"), "text")
    texts = base_spans(by_hash, CONTEXT)
    holds = texts.filter(" or ".join(f"size({k}_spans) > 0" for k in KINDS)).select("tid", F.explode(_mentions()).alias("x"))
    mentions = table(holds.select("tid", "x.entities", "x.near"), "mentions")
    entities = table(mentions.select("tid", F.explode("entities").alias("entity")).distinct().groupBy("entity").agg(F.count("*").alias("n_e")), "entities")
    #: A context's terms are found once, for the entity and its class.
    met = mentions.select("tid", "entities", F.explode(_terms(F.col("near"))).alias("term")).filter("term <> ''").select("tid", "term", F.explode("entities").alias("entity"))
    met = table(met.distinct(), "met")
    pairs = table(met.groupBy("entity", "term").agg(F.count("*").alias("n_et")), "pairs")
    n_texts = by_hash.select("tid").distinct().count()

    inside = met.select("tid", "term").distinct().groupBy("term").agg(F.count("*").alias("n_in"))
    most = pairs.groupBy("term").agg(F.max("n_et").alias("most"))
    wanted = table(inside.join(most, "term").filter(lower_bound(F.col("most"), F.col("n_in")) >= min_disclosure).select("term"), "wanted")
    #: A text that stands in n rows counts 1 / n in each, so that no distinct is needed over the corpus. An inner join stays above the sums.
    copies = by_hash.groupBy("tid").agg(F.count("*").alias("n")).filter("n > 1")
    copies = table(copies.select(F.col("tid").alias("copied"), (1.0 / F.col("n")).alias("weight")), "copies")
    weighed = by_hash.join(small(copies), F.col("tid") == F.col("copied"), "left").select(F.coalesce("weight", F.lit(1.0)).alias("weight"), F.explode(_terms(F.col("text"))).alias("term"))
    counts = weighed.groupBy("term").agg(F.sum("weight").alias("n"))
    counts = table(counts.join(small(wanted), "term").select("term", F.greatest(F.round("n"), F.lit(1.0)).alias("n_t")), "counts")
    rated = pairs.join(small(counts), "term").join(small(entities), "entity").select("term", lower_bound(F.col("n_et"), F.col("n_t")).alias("disclosure"), (F.col("n_e") / F.lit(n_texts)).alias("p_e"))
    rated = rated.filter((F.col("disclosure") >= min_disclosure) & (F.log2(F.col("disclosure") / F.col("p_e")) >= MIN_BITS))
    told = rated.groupBy("term").agg(F.max("disclosure").alias("disclosure"))
    told = table(told, "told_terms")
    places = by_hash.select("tid", F.explode(_terms(F.col("text"))).alias("term")).join(small(told), "term").distinct()
    return places.select("tid", "term", "disclosure")


def personal_data(docs: DataFrame, min_disclosure: float = MIN_DISCLOSURE) -> DataFrame:
    """``docs`` in a struct ``doc`` with the kinds' spans, ``base`` and ``spans`` (arrays of start, rank, end, value; rank 4 is a term), and ``risks``."""
    told = table(disclosing_terms(docs, min_disclosure), "told")
    lists = table(told.groupBy("tid").agg(F.collect_list(F.struct("term", "disclosure")).alias("risks")), "lists")
    rows = docs.select(F.struct("*").alias("doc"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("doc_tid"))
    rows = base_spans(rows.join(small(lists, LIST_ROWS), F.col("doc_tid") == F.col("tid"), "left").drop("tid", "doc_tid"))
    rows = rows.withColumn("base", _all_spans(*(f"{k}_spans" for k in KINDS)))
    words = F.array_join(F.array_sort(F.transform("risks", lambda x: x["term"])), "|")
    pattern = F.concat(F.lit(f"(?<!{_TERM_CHAR})(?:"), words, F.lit(f")(?!{_TERM_CHAR})"))
    rows = rows.withColumn("pattern", F.when(F.size("risks") > 0, pattern))
    laid = spans_of("text", F.col("pattern"), len(KINDS))
    free = _let(F.col("base"), lambda base: F.filter(laid, lambda t: ~F.exists(base, lambda b: (t["start"] < b["end"]) & (b["start"] < t["end"]))))
    rows = rows.withColumn("term_spans", F.when(F.col("pattern").isNotNull() & F.rlike("text", F.col("pattern")), free))
    return rows.withColumn("spans", _all_spans("base", "term_spans"))


def sanitised(found: DataFrame) -> DataFrame:
    """``personal_data``'s rows with ``clean``: entities masked, terms removed or generalised to [WORD] or [NUMBER].

    Spans that overlap are masked as the first of them. A block of spans is cut out of the text first, so that a text of very many
    spans is not read again for each.
    """
    text, masks = F.col("text"), F.array(*[F.lit(v) for v in MASKS.values()], F.lit(""))

    def done(risk: Column) -> Column:
        term = lambda x: F.when(risk[x["value"]] >= REMOVE, "").when(x["value"].rlike("^[0-9]+$"), "[NUMBER]").otherwise("[WORD]")
        shown = lambda x: F.when(x["rank"] < len(KINDS), F.element_at(masks, x["rank"] + 1)).otherwise(term(x))

        def block(x: Column, start: Column, end: Column) -> Column:
            def cut(own: Column) -> Column:
                put = lambda a, y: F.concat(a["out"], F.array(F.substring(own, a["p"] - start + 1, y["start"] - a["p"]), shown(y)))
                step = lambda a, y: F.when(
                    y["start"] < a["p"], F.struct(F.greatest(a["p"], y["end"]).alias("p"), a["out"].alias("out")),
                ).otherwise(F.struct(y["end"].alias("p"), put(a, y).alias("out")))
                return F.array_join(F.aggregate(x, F.struct(start.alias("p"), F.array().cast("array<string>").alias("out")), step, lambda a: a["out"]), "")

            return _let(F.substring(text, start + 1, end - start), cut)

        def whole(blocks: Column) -> Column:
            def laid(ends: Column) -> Column:
                parts = F.transform(blocks, lambda x, i: block(x, F.when(i == 0, 0).otherwise(ends[i - 1]), ends[i]))
                return F.concat(F.array_join(parts, ""), F.substring(text, F.element_at(ends, -1) + 1, F.length(text)))

            most = F.transform(blocks, lambda x: F.array_max(F.transform(x, lambda y: y["end"])))
            return _let(_let(most, lambda m: F.transform(m, lambda _, i: F.array_max(F.slice(m, F.lit(1), i + 1)))), laid)

        cuts = F.sequence(F.lit(0), F.floor((F.size("spans") - 1) / _BLOCK).cast("int"))
        return _let(F.transform(cuts, lambda b: F.slice(F.col("spans"), b * _BLOCK + 1, _BLOCK)), whole)

    return found.withColumn("clean", F.when(F.size("spans") == 0, text).otherwise(_let(F.map_from_entries("risks"), done)))


def span_text(array: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    return F.array_join(F.transform(array, lambda x: F.concat_ws(":", F.element_at(names, x["rank"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
