"""A trie of terms and stems, and its intersection with the Levenshtein automaton of a word."""

from __future__ import annotations

from collections.abc import Iterable

#: The fewest letters with which a whole word and a stem are looked for with one edit; shorter ones are matched exactly only.
MIN_FUZZY = 4
MIN_FUZZY_STEM = 6

Term = tuple[str, bool, float, bool]


def shorter(word: str) -> list[str]:
    """``word`` without each of its letters in turn."""
    return [word[:k] + word[k + 1 :] for k in range(len(word))]


class Lexicon:
    """Terms (whole words) and stems (beginnings of words): tables for exact hits, a trie of the fuzzy ones for hits with one edit."""

    def __init__(self, terms: Iterable[Term], never: frozenset[str] = frozenset()):
        """terms: (letters, whether a stem, weight, whether one edit is allowed). never: words that are no misspelling of a term, whatever their letters."""
        self.never = never
        self.words: dict[str, tuple[str, float]] = {}
        self.stems: dict[str, tuple[str, float]] = {}
        self.root: dict = {}
        self.heads: set[str] = set()
        self.seconds: set[str] = set()
        self.near_words: set[str] = set()
        self.near_stems: dict[int, set[str]] = {}
        for term, stem, weight, fuzzy in terms:
            (self.stems if stem else self.words)[term] = term, weight
            if not fuzzy or len(term) < (MIN_FUZZY_STEM if stem else MIN_FUZZY):
                continue
            node = self.root
            for letter in term:
                node = node.setdefault(letter, {})
            node["stem" if stem else "word"] = (term, weight)
            self.heads.add(term[:2])
            self.seconds.add(term[2:4])
            (self.near_stems.setdefault(len(term), set()) if stem else self.near_words).update((term, *shorter(term)))
        self.lengths = sorted({len(x) for x in self.stems})
        self.longest_word = max((len(x) for x in self.words), default=0)
        self.longest = max((len(x) for x in (*self.stems, *self.words)), default=0)

    def exact(self, word: str) -> tuple[str, float] | None:
        """The heaviest term that ``word`` is, or stem that it begins with."""
        best = self.words.get(word)
        for n in self.lengths:
            found = self.stems.get(word[:n])
            if found is not None and (best is None or found[1] > best[1]) and n <= len(word):
                best = found
        return best

    def _may(self, word: str) -> bool:
        """One edit leaves a term's first two letters or the next two whole, and words at distance 1 are equal once one or both lose a letter; others are spared the walk."""
        if word[:2] not in self.heads and self.seconds.isdisjoint((word[1:3], word[2:4], word[3:5])):
            return False
        if len(word) <= self.longest_word + 1 and (word in self.near_words or any(x in self.near_words for x in shorter(word))):
            return True
        for n, near in self.near_stems.items():
            if word[: n - 1] in near or any(x in near for x in shorter(word[:n])) or any(x in near for x in shorter(word[: n + 1])):
                return True
        return False

    def fuzzy(self, word: str) -> tuple[str, float] | None:
        """The heaviest term that is long enough and at distance 1 from ``word`` (a stem: from a beginning of it)."""
        if len(word) < MIN_FUZZY - 1 or word in self.never or not self._may(word):
            return None
        #: What stands beyond the longest term and one edit can't matter to a stem, and rules out a word.
        cut = len(word) > self.longest + 1
        word = word[: self.longest + 1]
        best, n = None, len(word)
        todo = [(self.root, [min(k, 2) for k in range(n + 1)])]
        while todo:
            node, row = todo.pop()
            for letter, below in node.items():
                if letter in ("stem", "word"):
                    weight = below[1]
                    near = min(row) if letter == "stem" else 2 if cut else row[n]
                    if near == 1 and (best is None or weight > best[1]):
                        best = below
                    continue
                new = [min(row[0] + 1, 2)]
                for k in range(1, n + 1):
                    new.append(min(row[k] + 1, new[k - 1] + 1, row[k - 1] + (word[k - 1] != letter), 2))
                if min(new) < 2:
                    todo.append((below, new))
        return best
