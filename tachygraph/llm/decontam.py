"""Benchmark decontamination with a positional inverted index, in DataFrame functions only.

1. Windows: every 13 words on end of an item, or all words of a shorter one.
2. Counts: how often each word of the items stands in the documents (all of them).
3. Index: postings (term, text, position) of the probe terms: for each window, its PROBES rarest terms of those that the documents hold.
   Windows overlap, so a place of an item is a probe once, for all its windows.
4. Intersection: a posting less the term's place in the item is where the item would begin. Where two probes of an item, less than a
   window apart, agree on that within SLOP words, the windows that hold them are candidates. A window of 13 words that has NEAR_PERCENT of
   them in order has two of its four probes at least, so it is met; one that stands there exactly has them all.
5. Confirmation, on the document's whole text: an exact phrase has the window's words, one by one. A proximity match has
   NEAR_PERCENT of the window's distinct words, in any order, in the window's place and SLOP words before and after it.

The index folds the case of each word by itself, wholly, which leads to more; step 5 folds A-Z only and decides. Postings name
a text by a hash of 64 bits, so copies share them; step 5 tells texts apart by SHA-256. The largest lists are those of the rarest terms of
windows, and a task holds one document's candidates at most. Proximity matches are counted in ``n_near``; only exact phrases contaminate.

Nulls: a null text has no words and no hits; null or wordless items have no windows. Repeated documents each get their
row, repeated item_ids count as one item. With an empty benchmark nothing is contaminated; an empty documents table gives
an empty one. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tachygraph.llm.scratch import is_small, small, table
from tachygraph.llm.textwords import ANY_CASE_INDEX_GAP, INDEX_GAP, count_pieces, lower_ascii

WINDOW = 13
#: Terms of a window whose lists are asked for; two of them must agree.
PROBES = 4
#: Words by which a proximity match may be displaced, and the hundredths of a window's distinct words that it must have.
SLOP = 3
NEAR_PERCENT = 80
#: Words in a block of places.
BLOCK = 256
#: Windows up to which their words are broadcast.
WINDOW_ROWS = 100_000
#: A document is contaminated if this many hundredths of its words, one at least, are hit.
MIN_HIT_PERCENT = 5


def _words(text: Column) -> Column:
    """The words of ``text`` in order; ``text`` must have A-Z folded already."""
    return F.filter(F.split(text, INDEX_GAP), lambda x: x != "")


def _folded_tokens(docs: DataFrame) -> DataFrame:
    """(tid, pos, term) of each word, its case folded wholly; ``tid`` is the text's hash.

    Words are folded one by one: the lower case of some letters hangs on what stands around them.
    """
    #: A text that begins with a break has an empty first piece.
    shift = F.when(F.col("text").rlike("^" + ANY_CASE_INDEX_GAP), 1).otherwise(0)
    rows = docs.filter(F.col("text").isNotNull()).select(F.xxhash64("text").alias("tid"), shift.alias("shift"), F.split("text", ANY_CASE_INDEX_GAP).alias("words"))
    rows = rows.select("tid", "shift", F.posexplode("words").alias("pos", "word"))
    return rows.select("tid", (F.col("pos") - F.col("shift")).alias("pos"), F.lower("word").alias("term"))


def item_words(items: DataFrame) -> DataFrame:
    """(iid, item_id, words) of each different item with words, A-Z folded; ``iid`` names its id and words."""
    rows = items.select("item_id", _words(lower_ascii(F.col("text"))).alias("words")).filter("size(words) > 0").distinct()
    return rows.select(F.xxhash64("item_id", "words").alias("iid"), "item_id", "words")


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): occurrences in ``docs`` of each of ``terms`` that occurs. Terms that are too many to broadcast meet sums, not words."""
    counts = lambda x: x.groupBy("term").agg(F.count("*").alias("n"))
    if is_small(terms):
        return counts(_folded_tokens(docs).join(F.broadcast(terms), "term"))
    return counts(_folded_tokens(docs)).join(terms, "term")


def index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings (term, tid, pos) of ``terms`` in ``docs``; copies of a text share them."""
    return _folded_tokens(docs).join(small(terms), "term").select("term", "tid", "pos")


def probes(its: DataFrame, counts: DataFrame, width: int = WINDOW) -> DataFrame:
    """(iid, p, term, alone): the places of each item that are among the PROBES of a window whose terms are rarest in the documents; whether it has one word only.

    Terms that the documents lack have no list.
    """
    last = F.greatest(F.size("words") - F.lit(width), F.lit(0))
    wins = its.select("iid", (F.size("words") == 1).alias("alone"), "words", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    places = wins.select("iid", "alone", "at", F.posexplode(F.slice("words", F.col("at") + 1, width)).alias("offset", "word"))
    rated = places.select("iid", "alone", "at", (F.col("at") + F.col("offset")).alias("p"), F.lower("word").alias("term")).join(small(counts), "term")
    best = rated.groupBy("iid", "alone", "at").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "term", "p"))), 1, PROBES).alias("best"))
    return best.select("iid", "alone", F.explode("best").alias("x")).select("iid", "x.p", "x.term", "alone").distinct()


def candidates(postings: DataFrame, rare: DataFrame, width: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """(tid, iid, begin, ps): where two probes of an item, less than ``width`` apart, put its begin within ``slop`` words of each other, and the probes that put it just there.

    Begins are dealt into blocks of BLOCK words, and into the next block too where they are near an edge. An item of one word is found
    by that.
    """
    near = postings.join(small(rare), "term").select("tid", "iid", "alone", "p", (F.col("pos") - F.col("p")).alias("begin"))
    block = lambda x: F.floor(x / BLOCK)
    #: One shuffle, on the item and the block; a block holds a few places of one text.
    blocks = F.array_distinct(F.array(block(F.col("begin")), block(F.col("begin") + slop)))
    #: Copies of a text repeat its places; both ways drop repeats before the shuffle.
    alone = near.filter("alone").select("tid", "iid", "begin", F.array("p").alias("ps")).distinct()
    more = near.filter("not alone").select("tid", "iid", "p", "begin", F.explode(blocks).alias("block"))
    held = more.groupBy("tid", "iid", "block").agg(F.collect_set(F.struct("begin", "p")).alias("xs")).filter("size(xs) > 1")
    apart = lambda x, y, c: F.abs(y[c] - x[c])
    agrees = lambda x: F.exists("xs", lambda y: (y["p"] != x["p"]) & (apart(x, y, "p") < width) & (apart(x, y, "begin") <= slop))
    met = held.select("tid", "iid", F.explode(F.filter("xs", agrees)).alias("x"))
    return met.groupBy("tid", "iid", "x.begin").agg(F.collect_set("x.p").alias("ps")).unionByName(alone)


def phrase_candidates(docs: DataFrame, items: DataFrame, width: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """(tid, found): for each text with candidates, an array of (item_id, begin, ps, words)."""
    its = table(item_words(items), "items")
    terms = table(its.select(F.explode("words").alias("word")).select(F.lower("word").alias("term")).distinct(), "terms")
    counts = table(term_counts(docs, terms), "counts")
    rare = table(probes(its, counts, width), "probes")
    postings = table(index(docs, table(rare.select("term").distinct(), "probe_terms")), "postings")
    met = candidates(postings, rare, width, slop)
    full = met.join(small(its, WINDOW_ROWS), "iid")
    return full.groupBy("tid").agg(F.collect_list(F.struct("item_id", "begin", "ps", "words")).alias("found"))


def confirmed(docs: DataFrame, found: DataFrame, width: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """(tid, sha, n_hit, n_items, items_sha256, n_near) of the texts in which a candidate of ``found`` (tid, found) holds, word by word."""
    tids = table(found.select(F.col("tid").alias("wanted")), "tids")
    rows = docs.filter(F.col("text").isNotNull()).select(F.xxhash64("text").alias("tid"), "text")
    #: Words come before the grouping, so that they are split once for each text and not again for each candidate.
    own = rows.join(small(tids), F.col("tid") == F.col("wanted"), "left_semi").select("tid", F.sha2("text", 256).alias("sha"), _words(lower_ascii(F.col("text"))).alias("own"))
    own = own.groupBy("tid", "sha").agg(F.first("own").alias("own")).join(found, "tid")
    size = lambda x: F.least(F.size(x["words"]), F.lit(width))
    window = lambda x, at: F.slice(x["words"], at + 1, size(x))
    #: The windows that hold a probe of the candidate.
    ats = lambda x: F.filter(F.sequence(F.lit(0), F.size(x["words"]) - size(x)), lambda at: F.exists(x["ps"], lambda p: (p >= at) & (p < at + size(x))))
    place = lambda b, n, reach: F.slice(F.col("own"), F.greatest(b - reach, F.lit(0)) + 1, F.least(b, F.lit(reach)) + n + reach)
    exact = lambda x: F.filter(ats(x), lambda at: (x["begin"] + at >= 0) & (place(F.greatest(x["begin"] + at, F.lit(0)), size(x), 0) == window(x, at)))

    def is_near(x: Column) -> Column:
        def there(at: Column) -> Column:
            b = x["begin"] + at
            shared = F.size(F.array_intersect(place(b, size(x), slop), window(x, at)))
            return F.when(b + size(x) > 0, 100 * shared >= NEAR_PERCENT * F.size(F.array_distinct(window(x, at)))).otherwise(False)

        return F.exists(ats(x), there)

    begins = lambda x: F.transform(exact(x), lambda at: x["begin"] + at)
    checked = F.transform("found", lambda x: F.struct(x["item_id"].alias("item_id"), size(x).alias("size"), begins(x).alias("begins"), is_near(x).alias("near")))
    held = own.select("tid", "sha", F.filter(checked, lambda c: c["near"] | (F.size(c["begins"]) > 0)).alias("held")).filter("size(held) > 0")
    holds = F.filter("held", lambda c: F.size(c["begins"]) > 0)
    spots = F.flatten(F.transform(holds, lambda c: F.flatten(F.transform(c["begins"], lambda b: F.sequence(b, b + c["size"] - 1)))))
    ids = lambda a: F.array_sort(F.array_distinct(F.transform(a, lambda c: c["item_id"].cast("string"))))
    held = held.select("tid", "sha", F.size(F.array_distinct(spots)).alias("n_hit"), ids(holds).alias("ids"), F.size(ids(F.filter("held", lambda c: c["near"]))).alias("n_near"))
    return held.select("tid", "sha", "n_hit", F.size("ids").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"), "n_near")


def contamination(docs: DataFrame, items: DataFrame, width: int = WINDOW, percent: int = MIN_HIT_PERCENT, slop: int = SLOP) -> DataFrame:
    """All columns of ``docs`` in a struct ``doc``, with n_words, n_hit, n_items, items_sha256, contaminated and n_near (items with a proximity match)."""
    hits = table(confirmed(docs, table(phrase_candidates(docs, items, width, slop), "candidates"), width, slop), "hits")
    #: The few texts of a hash as one row, so that only rows that meet one are told apart.
    by_hash = table(hits.groupBy("tid").agg(F.collect_list(F.struct(*[c for c in hits.columns if c != "tid"])).alias("texts")), "hits_by_hash")
    rows = docs.select(F.struct("*").alias("doc"), F.xxhash64("text").alias("doc_tid"))
    joined = rows.join(small(by_hash), F.col("doc_tid") == F.col("tid"), "left")
    sha = F.sha2(F.col("doc.text"), 256)
    own = F.when(F.col("texts").isNotNull(), F.try_element_at(F.filter("texts", lambda x: x["sha"] == sha), F.lit(1)))
    joined = joined.withColumn("own", own).select("doc", "own.*")
    text = F.col("doc.text")
    n_words = F.when(text.isNull(), F.lit(0).cast("long")).otherwise(count_pieces(text, ANY_CASE_INDEX_GAP))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = joined.select("doc", n_words.alias("n_words"), count("n_hit"), count("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), count("n_near"))
    contaminated = (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))
    return out.select("doc", "n_words", "n_hit", "n_items", "items_sha256", contaminated.alias("contaminated"), "n_near")


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns."""
    return contamination(docs, items).filter("not contaminated").select(*[F.col("doc")[c].alias(c) for c in docs.columns])
