"""Dictionary hits in one text, for dictionaries that are small enough to travel with the tasks.

The same hits as the joins of `dictionary` give; `plans.pipeline` takes these where a
dictionary has at most SMALL_TERMS terms and SMALL_CHARS characters, and the joins beyond.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import regex
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions import spans as S

SMALL_TERMS, SMALL_CHARS = 20_000, 1 << 20
WORD = regex.compile(r"[\p{L}\p{N}][\p{L}\p{N}\p{M}'’.-]*")
TRAILING = ".'’-"
FOLD = str.maketrans(S.FOLD_FROM, S.FOLD_TO)
SPACE = regex.compile(r"\s+")
UPPER, UPPER_OR_DIGIT = regex.compile(r"\p{Lu}"), regex.compile(r"[\p{Lu}\p{N}]")


def small(terms: DataFrame | None, text: str) -> list[Row] | None:
    """The rows of a dictionary if it is small, else None. At most SMALL_TERMS + 1 rows are read."""
    if terms is None:
        return None
    rows = terms.select(F.length(text).alias("n")).limit(SMALL_TERMS + 1).agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("chars")).first()
    return terms.collect() if rows["rows"] <= SMALL_TERMS and (rows["chars"] or 0) <= SMALL_CHARS else None


def plain(text: str) -> str:
    """text.translate(FOLD); most texts have nothing to fold, and a plain search finds that out much faster."""
    return text.translate(FOLD) if any(c in text for c in S.FOLD_FROM) else text


def folded(text: str) -> str:
    return SPACE.sub(" ", plain(text).strip(" ")).lower()


class Lexicon:
    """Folded terms with what belongs to them, found as runs of whole words of a line."""

    def __init__(self, terms: Iterable[tuple[str, object]]):
        self.of: dict[str, list] = {}
        for term, what in terms:
            self.of.setdefault(term, []).append(what)
        self.sizes: dict[str, set[int]] = {}  # words of the terms, by their first word
        for term in self.of:
            words = WORD.findall(term)
            if words:
                first = words[0] if len(words) > 1 else words[0].rstrip(TRAILING)
                self.sizes.setdefault(first, set()).add(len(words))

    def hits(self, text: str, begins: regex.Pattern | None = None) -> Iterator[tuple[int, int, str, list]]:
        """(start, end, surface, what belongs to the term) of a text that `translate(FOLD)` has been applied to.

        begins: what the first character must be; other words aren't looked up.
        """
        if not self.sizes:
            return
        places = [m.span() for m in WORD.finditer(text)]
        for i, (a, b) in enumerate(places):
            if begins and not begins.match(text, a):
                continue
            word = text[a:b].lower()
            bare = word.rstrip(TRAILING)
            sizes = self.sizes.get(word, set()) | (self.sizes.get(bare, set()) if bare != word else set())
            for n in sorted(sizes):
                if i + n <= len(places):
                    surface = text[a : places[i + n - 1][1]].rstrip(TRAILING)
                    if "\n" not in surface and (what := self.of.get(folded(surface))) is not None:
                        yield a, a + len(surface), surface, what


def runs(text: str, most: int, begins: regex.Pattern) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of 1 to `most` words of a line whose first character is as wanted, as dictionary.ngrams() cuts them."""
    places = [m.span() for m in WORD.finditer(text)]
    for i, (a, _) in enumerate(places):
        if begins.match(text, a):
            for _, b in places[i : i + most]:
                surface = text[a:b]
                if "\n" in surface:
                    break
                yield a, a + len(surface.rstrip(TRAILING))


def deny_list(text: str, lexicon: Lexicon, stopwords: set[str]) -> list[tuple[int, int, str]]:
    """(start, end, label) of curated hits: must begin in upper case; a stopword and a hit inside a longer one lose."""
    found = [(a, -b, label) for a, b, surface, labels in lexicon.hits(text, UPPER_OR_DIGIT) if folded(surface) not in stopwords for many in labels for label in many]
    out, reach = [], (-1, 0)
    for a, b, label in sorted(found):
        if not (-b < reach[0] or (-b == reach[0] and a > -reach[1])):
            out.append((a, -b, label))
        reach = max(reach, (-b, -a))
    return out
