"""Toxicity by a learned lexicon, Levenshtein automata and context windows.

1. A bounded sample of labelled rows (SAMPLE_ROWS, by hash, training folds only) gives for each word and each beginning of
   a word the numbers of toxic and other texts that hold it. Those that stand out become the lexicon's terms and stems.
2. A trie of them is intersected with the Levenshtein automaton of each word, so that words at distance 1 from a term (of
   four letters, a stem of six) are found too. Words of the sample that stand in other texts as often are no misspellings; nor is
   a stem looked for with an edit if its near words do.
3. A window of words around each hit says whether it stands in quotation or reported speech, and whether it is addressed to
   someone. The model's inputs are sums over nested sets of hits: all, the exact ones, those that are not quoted, and
   those of them that are addressed. Their weights are bounded from below by LEAST, so that by construction a quoted hit
   counts more than none and less than an open one, and a misspelled one more than none and less than an exact one.
4. The model is logistic, fitted on the sample and on three changed copies of each of its toxic texts: one with every hit
   misspelled, which stays toxic, one with only the strongest of its open hits, which does too, and one with every hit quoted, which
   is not.

Labels, language, source and doc_id are no inputs of a score. Nulls: a null text is scored as an empty one; a label row
with a null doc_id or a null label is not used; a document with a null doc_id is not held out. A document with several label
rows is toxic if one says so. With no toxic rows in the sample, all scores are the share of toxic rows (0). Repeated rows
score alike; an empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tachygraph.llm.lexicon import Lexicon, Term
from tachygraph.llm.logistic import fit_above
from tachygraph.llm.scratch import small, table

#: Bounds of what is learned: labelled rows, texts that a term must stand in, and its log-odds.
SAMPLE_ROWS = 8_000
MIN_TEXTS = 5
MIN_TEXTS_SHARE = 0.01
MIN_WEIGHT = 2.5
STEM_LETTERS = range(3, 9)
HELD_OUT = 1
FOLDS = 3
THRESHOLD = 0.7
WINDOW = 6
#: Words that a quotation may be long; a mark without its like in so many words opens none.
QUOTE_WORDS = 60
#: What a hit adds at least (in log-odds, for a unit of its input), and what a misspelled one's weight is multiplied by.
LEAST = 0.05
FUZZY = 0.7
#: Words remembered by a worker.
CACHE_WORDS = 200_000

_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")
_OPEN, _CLOSE = "\"'“„«‹‘”", "\"'”“»›’"
#: Words that report speech, and words that address someone, in the corpus' languages.
REPORTING = frozenset("said says wrote writes quote quoted called calls sagte schrieb nannte dit écrit appelé dijo escribió llamó".split())
ADDRESSING = frozenset("you your you're yourself u ur du dich dir dein deine ihr euch tu toi vous votre ton ta tú usted ustedes te su vosotros".split())


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; 0 for null."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS, F.lit(0))


def bare(word: str) -> str:
    """A lower-case word without what is not a letter at its ends."""
    return word if word.isalpha() else _EDGE.sub("", word)


def learn_terms(texts: list[str], toxic: list[int]) -> tuple[list[Term], frozenset[str]]:
    """The terms and stems that tell toxic texts from others, with their log-odds, and the words that are no misspellings of them.

    A stem's counts are its words' added up, so that each word is looked at once. A stem begins several words, and is
    drawn out as long as hardly any of them drops off.
    """
    counts = (Counter(), Counter())
    for text, y in zip(texts, toxic, strict=True):
        counts[1 if y else 0].update({b for w in set(text.lower().split()) if len(b := bare(w)) > 2})
    n1 = sum(1 for y in toxic if y)
    n0 = len(toxic) - n1
    least = max(MIN_TEXTS, MIN_TEXTS_SHARE * n1)
    stems: tuple[Counter, Counter] = (Counter(), Counter())
    forms: Counter = Counter()
    for y in (0, 1):
        for word, n in counts[y].items():
            for k in STEM_LETTERS:
                if k < len(word):
                    stems[y][word[:k]] += n
                    forms[word[:k]] += y
    weight = lambda a, b: float(np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1)))
    heirs: dict[str, str] = {}
    for s, n in stems[1].items():
        if n > stems[1].get(heirs.get(s[:-1], ""), 0):
            heirs[s[:-1]] = s
    kept: dict[str, float] = {}
    out: list[Term] = []
    for s in sorted((s for s, n in stems[1].items() if n >= 2 * least), key=lambda s: (len(s), s)):
        w = weight(stems[1][s], stems[0][s])
        above = max((kept[s[:k]] for k in range(3, len(s)) if s[:k] in kept), default=None)
        if w < MIN_WEIGHT + 1 or above is not None and w <= above + 0.5:
            continue
        kept[s] = w
        while s in heirs and stems[1][heirs[s]] >= 0.95 * stems[1][s]:
            s = heirs[s]
        kept[s] = w
        if forms[s] >= 3:
            out.append((s, True, w, True))
    for term, n in counts[1].items():
        if n >= least and (w := weight(n, counts[0][term])) >= MIN_WEIGHT:
            out.append((term, False, w, True))
    #: Several stems may be drawn out to the same one, which keeps its greatest weight.
    best = {(t, stem): w for t, stem, w, _ in sorted(out, key=lambda x: x[2])}
    out = sorted(((t, stem, w, True) for (t, stem), w in best.items()), key=lambda x: (-x[2], x[0]))
    #: Near words that clean texts hold as well: a word is left out by itself, a stem with all its near words.
    lexicon, never, near = Lexicon(out), set(), Counter()
    for word in counts[0].keys() | counts[1].keys():
        if lexicon.exact(word) is None and (found := lexicon.fuzzy(word)):
            a, b = counts[1][word], counts[0][word]
            near[found[0], 1] += a
            near[found[0], 0] += b
            if b and weight(a, b) < MIN_WEIGHT:
                never.add(word)
    barred = {t for t, stem, _, _ in out if stem and near[t, 0] and weight(near[t, 1], near[t, 0]) < MIN_WEIGHT}
    return [(t, stem, w, not (stem and t in barred)) for t, stem, w, _ in out], frozenset(never)


@dataclass(frozen=True)
class Hit:
    """A hit of the word at ``at``: exact or with one edit, its term's weight, and its context."""

    at: int
    exact: bool
    weight: float
    quoted: bool
    addressed: bool


def quoted_places(words: list[str]) -> set[int]:
    """Places of the words between quotation marks that open and close within QUOTE_WORDS."""
    inside: set[int] = set()
    opened: int | None = None
    for i, w in enumerate(words):
        if opened is not None and i - opened >= QUOTE_WORDS:
            opened = None
        if opened is None and w[0] in _OPEN:
            opened = i
        if opened is not None and (bare_end := w.rstrip(".,;:!?"))[-1:] and bare_end[-1] in _CLOSE and (i > opened or len(bare_end) > 1):
            inside.update(range(opened, i + 1))
            opened = None
    return inside


class Scorer:
    """Finds the hits of texts, with what has been found for each word kept for the next text."""

    def __init__(self, terms: list[Term], never: frozenset[str] = frozenset()):
        self.lexicon = Lexicon(terms, never)
        self.cache: dict[str, tuple[bool, float] | None] = {}

    def hit(self, word: str) -> tuple[bool, float] | None:
        """(whether exact, weight) of a lower-case token, or none."""
        try:
            return self.cache[word]
        except KeyError:
            pass
        if len(self.cache) >= CACHE_WORDS:
            self.cache.clear()
        letters, found = bare(word), None
        if len(letters) > 2:
            exact = self.lexicon.exact(letters)
            if exact:
                found = (True, exact[1])
            elif near := self.lexicon.fuzzy(letters):
                found = (False, near[1])
        self.cache[word] = found
        return found

    def hits(self, words: list[str]) -> list[Hit]:
        """The hits among a text's lower-case tokens, in order."""
        found = {w: h for w in set(words) if (h := self.hit(w)) is not None}
        if not found:
            return []
        quoted = quoted_places(words)
        out = []
        for i, w in enumerate(words):
            if w in found:
                near = words[max(0, i - WINDOW) : i + WINDOW + 1]
                out.append(Hit(i, *found[w], i in quoted or not REPORTING.isdisjoint(near), not ADDRESSING.isdisjoint(near)))
        return out


def inputs(words: list[str], hits: list[Hit]) -> list[float]:
    """Inputs of the model: numbers and weights of hits in nested sets, and the text's length."""
    strength = lambda h: h.weight if h.exact else FUZZY * h.weight
    top: dict[str, float] = {}
    for h in hits:
        if not h.quoted:
            top[words[h.at]] = strength(h)
    #: Squares: many terms that hardly tell texts apart are less than one that does.
    weights = sorted((w * w / 10 for w in top.values()), reverse=True)
    free = [h for h in hits if not h.quoted]
    sums = [sum(strength(h) for h in hits), sum(h.exact for h in hits), len(free), sum(h.exact for h in free), sum(h.addressed for h in free)]
    return [*(float(np.log1p(x)) for x in sums), weights[0] if weights else 0.0, float(sum(weights[1:4])), min(20.0, 100 * len(free) / max(len(words), 1)), float(np.log1p(len(words)))]


#: The last input, the length, is the only one whose weight may have either sign.
N_INPUTS = 9


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic): up to ``rows`` labelled documents of the training folds, those with the smallest hashes of their ids."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = table(known.filter(fold(F.col("doc_id")) != HELD_OUT).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).withColumnRenamed("doc_id", "labelled"), "labelled")
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(small(chosen), F.col("doc_id") == F.col("labelled")).select(
        "doc_id", "text", F.col("toxic").cast("int").alias("toxic"),
    )


def examples(scorer: Scorer, text: str, toxic: int) -> list[tuple[list[float], int]]:
    """The inputs and label of a text, and of a toxic one's misspelled and quoted copies."""
    words = text.lower().split()
    hits = scorer.hits(words)
    out = [(inputs(words, hits), toxic)]
    if toxic and hits:
        out.append((inputs(words, [replace(h, exact=False) for h in hits]), 1))
        out.append((inputs(words, [replace(h, quoted=True) for h in hits]), 0))
        #: One open hit of the text's strongest term is enough.
        if free := [h for h in hits if not h.quoted]:
            out.append((inputs(words, [max(free, key=lambda h: h.weight)]), 1))
    return out


Model = tuple[list[Term], frozenset[str], list[float]]


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """(terms, words that are no misspellings, weights) from a bounded sample, which is brought to the driver."""
    got = sample(docs, labels, rows).orderBy("doc_id", "text").limit(rows).collect()
    texts, toxic = [r["text"] for r in got], [r["toxic"] for r in got]
    if not any(toxic):
        return [], frozenset(), [0.0] * N_INPUTS + [-30.0]
    #: Weights are fitted where the terms were not chosen: each half is scored with the other half's terms.
    halves = [[i for i in range(len(texts)) if i % 2 == k] for k in (0, 1)]
    made = []
    for one, other in (halves, halves[::-1]):
        scorer = Scorer(*learn_terms([texts[i] for i in one], [toxic[i] for i in one]))
        for i in other:
            made += examples(scorer, texts[i], toxic[i])
    return *learn_terms(texts, toxic), fit_above(np.array([x for x, _ in made]), np.array([y for _, y in made], float), np.array([LEAST] * (N_INPUTS - 1) + [-np.inf])).tolist()


_scorers: dict[int, Scorer] = {}


def scored(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_exact, n_fuzzy, n_quoted) of each row of ``docs``; one pass without a shuffle after training.

    model: what ``train`` gave; without one it is trained from ``labels``.
    """
    terms, never, weights = train(docs, labels, rows) if model is None else model
    w = np.array(weights)
    name = hash((tuple(terms), never, tuple(weights)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = _scorers.get(name) or _scorers.setdefault(name, Scorer(terms, never))
        for pdf in frames:
            x, n = [], []
            for text in pdf["text"]:
                words = (text or "").lower().split()
                hits = scorer.hits(words)
                x.append(inputs(words, hits))
                n.append((sum(h.exact for h in hits), sum(not h.exact for h in hits), sum(h.quoted for h in hits)))
            score = 1 / (1 + np.exp(-np.clip(np.array(x).reshape(-1, N_INPUTS) @ w[:-1] + w[-1], -30, 30)))
            counts = np.array(n, np.int64).reshape(-1, 3)
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "score": score, "predicted": (score >= THRESHOLD).astype("int32"), "n_exact": counts[:, 0],
                "n_fuzzy": counts[:, 1], "n_quoted": counts[:, 2],
            })

    rows_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "text")
    return rows_.mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int, n_exact long, n_fuzzy long, n_quoted long")
