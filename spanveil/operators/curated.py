"""What curated dictionary hits of one text become: filters, person chains, city districts, name forms."""

from __future__ import annotations

from collections.abc import Iterable

import regex

from ..functions import vocab as V
from .scanner import CHAIN, LAST, TITLES, Entity, any_of, entity

#: Characters around an ambiguous place in which its evidence must stand.
EVIDENCE = 60
AMBIGUOUS = {w.lower() for w in [*V.FIRST_NAMES, *V.SURNAMES]} | {m for months in V.MONTHS.values() for m in months} | {"nice", "bath", "reading", "most", "split", "of"}
#: Scores of a chain of several names, and of a lone one.
SURE, LONE = 0.9, 0.5

CAPITAL = regex.compile(r"\p{Lu}[\p{L}\p{M}'’-]*")
GAP = regex.compile(r"[ \t ]{1,4}")
DEFINED = regex.compile(r"\((?:[^()\n]{0,40} )?[\"“„]([^\"“”„\n]{2,60})[\"”“]\)")
DISTRICT = regex.compile(r"[ -](?:\d{1,2}|[IVX]{1,5})\b(?![.,]?\d)|-\p{L}{3,}")
POSTAL_BEFORE = regex.compile(r"(?:\d{3} \d{2}|\d{5}|\d{2}-\d{3}) $")
PLACE = regex.compile(rf"\b\d{{5}}(?:-\d{{4}})?\b|\b\d{{3}} \d{{2}}\b|\b\d{{2}}-\d{{3}}\b|, (?:{any_of(V.STATES)})\b|(?<!\w)(?:{any_of(V.STREETS)})(?!\w)|\p{{L}}+(?:{'|'.join(V.STREET_ENDINGS)})\b")


def evident(text: str, start: int, end: int) -> bool:
    """Whether a postal code, a state or a street stands near a place."""
    return PLACE.search(text, max(0, start - EVIDENCE), start) is not None or PLACE.search(text, end, end + EVIDENCE) is not None


def district(text: str, start: int, end: int) -> tuple[int, int]:
    """A place with the number or name of its district after it and the postal code before it."""
    after, before = DISTRICT.match(text, end), POSTAL_BEFORE.search(text, max(0, start - 8), start)
    return (before.start() if before else start), (after.end() if after else end)


def chains(text: str, hits: list[Entity]) -> list[Entity]:
    """Neighbouring names are one person, with a title before them and capitalised words after them, up to CHAIN names.

    A lone name counts if a capitalised word or a title stands beside it.
    """
    out, i = [], 0
    while i < len(hits):
        run = [hits[i]]
        while i + len(run) < len(hits) and len(run) < CHAIN and GAP.fullmatch(text, run[-1].end, hits[i + len(run)].start):
            run.append(hits[i + len(run)])
        i += len(run)
        start, end, names = run[0].start, run[-1].end, len(run)
        title = regex.search(rf"(?<!\w)(?:{any_of(sorted(TITLES))})[ \t]{{1,2}}$", text[max(0, start - 16) : start])
        led = title is not None
        if title:
            start -= len(title.group())
        while names < CHAIN and (gap := GAP.match(text, end)) and (word := CAPITAL.match(text, gap.end())) and word.group().lower() not in V.PERSON_STOP and word.group() not in V.LEGAL_FORMS:
            end, names = word.end(), names + 1
        if led or names > 1:
            out.append(entity(text, start, end, "person", SURE if led or len(run) > 1 or text[run[0].end : end].strip().isupper() else LONE, "deny-list"))
    return out


def curated(text: str, hits: Iterable[Entity]) -> list[Entity]:
    """Entities of curated hits.

    Defined terms in quotes, words in capitals and parts of hyphenated names are none. Places
    that are also a name or a word need evidence near by and take their district; names are
    joined to persons. Other labels stay.
    """
    quoted = [m.span(1) for m in DEFINED.finditer(text)] if "(" in text else []
    persons, out = [], []
    for e in sorted(hits, key=lambda x: (x.start, x.end)):
        inside = any(a <= e.start and e.end <= b for a, b in quoted)
        shouting = e.label != "organization" and e.size > 3 and e.text.isupper() and e.text not in LAST
        hyphened = e.label == "person" and ((e.start > 1 and text[e.start - 1] == "-" and text[e.start - 2].isalpha()) or text[e.end : e.end + 1] == "-" and text[e.end + 1 : e.end + 2].isalpha())
        if inside or (shouting and e.label != "person") or hyphened:
            continue
        if e.label == "person":
            persons.append(e)
        elif e.label == "address":
            start, end = district(text, e.start, e.end)
            if e.text.lower() not in AMBIGUOUS or (start, end) != (e.start, e.end) or evident(text, start, end):
                out.append(entity(text, start, end, e.label, e.score, e.source, source_detail=e.source_detail))
        else:
            out.append(e)
    return out + chains(text, persons)


def declensions(name: str) -> set[str]:
    """Case forms of a Czech or Slovak name, made from its nominative ending."""
    stem = name[:-1]
    if name.endswith("ová"):
        return {name, stem + "é", stem + "ou"}
    if name.endswith("ý"):
        return {name, stem + "ého", stem + "ému", stem + "ém", stem + "ým"}
    if name.endswith("á"):
        return {name, stem + "é", stem + "ou"}
    if name.endswith("a"):
        soft = stem[-1:] in "cčjřšťďňž"
        return {name, stem + ("i" if soft else "y"), stem + ("e" if soft else "ě"), stem + "u", stem + "o", stem + "ou", stem + "ovi"}
    if name.endswith("ek") and len(name) > 3:
        short = name[:-2] + "k"
        return {name, short + "a", short + "ovi", short + "em", short + "u"}
    if name.endswith("el") and len(name) > 3:
        short = name[:-2] + "l"
        return {name, short + "a", short + "ovi", short + "em", name + "a", name + "ovi", name + "em"}
    if name[-1:] in "cčjřšťďňž":
        return {name, name + "e", name + "i", name + "ovi", name + "em"}
    return {name, name + "a", name + "ovi", name + "em", name + "e", name + "u"} if name[-1:].isalpha() and name[-1:] not in "eéiíoóuúyě" else {name}
