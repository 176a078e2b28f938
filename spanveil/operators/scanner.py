"""Sequential detectors and resolution of one document, in plain Python.

These operators walk over a text from left to right and depend on what stands before, which
column expressions can't say. `plans.pipeline` runs them with mapInArrow: a document is read
once, all detectors run on it, nothing is shuffled. Offsets are code points.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from dataclasses import dataclass, replace
from functools import lru_cache

import regex

from ..functions import vocab as V
from .filters import PRIORITY

DIGIT = re.compile("[0-9]")
FOLD = str.maketrans("   –—“”„", '   --"""')


@dataclass(frozen=True)
class Entity:
    start: int
    end: int
    label: str
    text: str
    score: float
    source: str
    source_detail: str | None = None
    kind: str = "detected"
    source_text: str | None = None

    @property
    def size(self) -> int:
        return self.end - self.start


def entity(text: str, start: int, end: int, label: str, score: float, source: str, **more) -> Entity:
    return Entity(start, end, label, text[start:end], score, source, **more)


@lru_cache(maxsize=None)
def _any_of(words: tuple[str, ...]) -> str:
    return "|".join(map(regex.escape, sorted(set(words), key=lambda w: (-len(w), w))))


def any_of(words) -> str:
    """Alternation of literal words, the longest first."""
    return _any_of(tuple(words))


@lru_cache(maxsize=None)
def compiled(pattern: str, flags: int = 0) -> regex.Pattern:
    return regex.compile(pattern, flags)


@lru_cache(maxsize=None)
def _lowered(words: tuple[str, ...]) -> tuple[str, ...]:
    """Lower-case words without those that hold another one."""
    low = sorted({w.lower() for w in words}, key=len)
    return tuple(w for i, w in enumerate(low) if not any(v in w for v in low[:i]))


def holds(low: str, words) -> bool:
    """Whether a lower-case text holds one of the words at all: a plain search that spares most texts the patterns."""
    return any(w in low for w in _lowered(tuple(words)))


def outermost(spans) -> list[tuple[int, int]]:
    """The spans that lie in no other, in order: one sweep."""
    out, reach = [], -1
    for a, b in sorted(set(spans), key=lambda x: (x[0], -x[1])):
        if b > reach:
            out.append((a, b))
            reach = b
    return out


class Covered:
    """Disjoint or overlapping spans that answer whether a span touches one of them."""

    def __init__(self, spans):
        self.starts, self.reach = [], []
        for a, b in sorted(spans):
            self.starts.append(a)
            self.reach.append(max(b, self.reach[-1]) if self.reach else b)

    def touches(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b)
        return k > 0 and self.reach[k - 1] > a


# --- dates, money -------------------------------------------------------------------------


@lru_cache
def _month(languages: tuple[str, ...]) -> str:
    return any_of([m for lang in languages for m in V.MONTHS[lang]])


def dates(text: str, languages: tuple[str, ...] = tuple(V.MONTHS)) -> list[Entity]:
    """Dates with a month name: day first, month first, month and year; the longest of each anchor."""
    if not DIGIT.search(text) or not holds(text.lower(), [m for lang in languages for m in V.MONTHS[lang]]):
        return []
    month, year, day = _month(languages), r"(?:1[89]|20|21)\d{2}", r"(?:0?[1-9]|[12]\d|3[01])"
    # Fixed part: a day can be an ordinal; Romance languages say "de".
    forms = [
        rf"\b{day}(?:st|nd|rd|th|º|\.|er)?(?: of| de| del)?[ .]{{0,2}}(?:{month})\b\.?(?:(?:,| de| del)? {{0,1}}{year}\b)?",
        rf"\b(?:{month})\b\.? {day}(?:st|nd|rd|th)?(?:,? {{0,1}}{year}\b)?(?!\d)",
        rf"\b(?:{month})\b\.?(?:,| de| del)? {year}\b",
        rf"\b{year}[ .]{{1,2}}(?:{month})\b(?:[ .]{{1,2}}{day}\b)?",
    ]
    found = []
    for form in forms:
        for m in compiled(form, regex.I).finditer(text):
            name = compiled(rf"\b(?:{month})\b", regex.I).search(m.group())
            lower = name and name.group() == name.group().lower() and name.group() in V.AMBIGUOUS_MONTHS
            if lower and not regex.search(year, m.group()) and not compiled(r"\s*(?:[.,;:)\n]|$)").match(text, m.end()):
                continue
            end = m.end()
            time = compiled(r",? (?:at )?\d{1,2}:\d{2}(?::\d{2})?(?: ?[ap]\.?m\.?)?", regex.I).match(text, end, end + 20)
            found.append((m.start(), time.end() if time else end))
    return [entity(text, a, b, "date", 1.0, "regex") for a, b in outermost(found)]


def money(text: str) -> list[Entity]:
    """Amounts with a currency before or after, magnitudes, written numbers and their repetition in words."""
    low = text.lower()
    named = holds(low, V.CURRENCY_NAMES)
    marked = DIGIT.search(text) is not None and (named or holds(low, V.CURRENCY_SYMBOLS) or compiled(rf"\b(?:{any_of(V.CURRENCY_CODES)})\b", regex.I).search(text) is not None)
    if not named and not marked:
        return []
    number = r"\d{1,3}(?:[ ,.'’]\d{3})+(?:[.,]\d{1,2})?|\d+(?:[.,]\d+)?"
    magnitude = rf"(?: ?(?:{any_of(V.MAGNITUDES)})\b)?"
    unit = any_of(V.CURRENCY_SYMBOLS) + "|" + "|".join(rf"\b{c}\b" for c in V.CURRENCY_CODES)
    name = any_of(V.CURRENCY_NAMES)
    written = rf"(?:\b(?:{any_of(V.NUMBER_WORDS)})\b[ -]?(?:and )?)+"
    forms = [rf"(?:{unit}) ?(?:{number}){magnitude}", rf"(?<![\w.,])(?:{number}){magnitude} ?(?:{unit}|(?:{name})\b)", rf"{written}(?:{name})\b"]
    found = [m.span() for f, may in zip(forms, (marked, marked, named), strict=True) if may for m in compiled(f, regex.I).finditer(text) if not compiled(r" ?(?:shares|stück|akcií|actions)\b", regex.I).match(text, m.end(), m.end() + 20)]
    repeated = compiled(r" ?\((?:in words|in figures|slovy|in Worten|en lettres|en letras)[: ][^()\n]{3,120}\)", regex.I)
    out = []
    for a, b in outermost(found):
        words = repeated.match(text, b)
        out.append(entity(text, a, words.end() if words else b, "monetary amount", 0.9, "regex"))
    return out


def extend_money(text: str, found: list[Entity]) -> list[Entity]:
    """Amounts of a cue phrase take in a magnitude and a currency that follow."""
    if not any(e.label == "monetary amount" and e.source == "trigger" for e in found):
        return found
    tail = compiled(rf"(?: ?(?:{any_of(V.MAGNITUDES)})\b)?(?: ?(?:{any_of(V.CURRENCY_SYMBOLS)}|(?:{any_of(V.CURRENCY_CODES + V.CURRENCY_NAMES)})\b))?", regex.I)
    out = []
    for e in found:
        m = tail.match(text, e.end) if e.label == "monetary amount" and e.source == "trigger" else None
        out.append(entity(text, e.start, m.end(), e.label, e.score, e.source) if m and m.end() > e.end else e)
    return out


# --- cue phrases --------------------------------------------------------------------------

SCAN, PATTERN_SCAN = 2048, 512


STOPS = regex.compile(r"(?<!\d),|,(?!\d)|[\n()\[\]{}]|[.!?](?=\s+\p{Lu}|\s*$)|(?= (?:hereinafter|whose|acting|residing|born|with its)\b)")
TITLE_END = regex.compile(rf"(?<!\w)(?:{any_of(V.TITLES)})$")


def trigger_value(text: str, at: int, strategy: str, p: dict) -> tuple[int, int] | None:
    """The span of the value after a cue."""
    at += len(regex.match(r"[ \t]*[:;#=]?[ \t]*", text[at : at + 40]).group())
    window = text[at : at + SCAN]
    if strategy == "comma":
        stop = next((m for m in STOPS.finditer(window) if not (m.group() == "," and GOES_ON.match(window, m.end() + 1)) and not (m.group() == "." and TITLE_END.search(window[: m.end()]))), None)
        if stop is None and len(window) == SCAN:
            return None  # fail closed
        size = min(stop.start() if stop else len(window), p.get("most", SCAN))
        cut = window[:size]
        if stop is None or size < stop.start():
            cut = cut[: cut.rfind(" ")] if " " in cut and len(window) > size else cut
    elif strategy == "line":
        cut = regex.match(r"[^\n\t]*", window).group()[: p.get("most", SCAN)]
    elif strategy == "words":
        cut = ""
        for m in regex.finditer(r"\S+", regex.match(r"[^\n\t]*", window).group()):
            cut = window[: m.end()]
            p = p | {"n": p["n"] - bool(regex.search(r"\w", m.group()))}
            if not p["n"]:
                break
    elif strategy == "id":
        m = regex.match(r"(?:(?:No|Nr|č|n)\.?[ :]{0,2})?((?:[A-Z]{1,4}[ -]?)?[A-Z0-9][A-Z0-9./-]*(?: [0-9]{2,6})*)", window[:128])
        if not m or regex.search(r"[A-Za-z]{13}", m.group(1)):
            return None
        at, cut = at + m.start(1), m.group(1)
    elif strategy == "address":
        cut = regex.split(r"\n\n|[;()\[\]]|\b(?:represented|vertreten|zastoupen\w*|hereinafter|born|and its)\b|,? (?:and|und|et|y) (?=\p{Lu})|\.(?=\s+\p{Lu}\p{Ll}{3,} )", window[: p.get("most", 120)])[0]
    else:
        m = regex.match(rf"(?:{p['re']})", window[:PATTERN_SCAN])
        if not m:
            return None
        cut = m.group()
    cut = cut.rstrip(" \t,;:.-")
    lead = len(cut) - len(cut.lstrip())
    return (at + lead, at + len(cut)) if cut.strip() else None


#: After a comma, these go on with a value: degrees, and the currencies of decimal amounts.
GOES_ON = regex.compile(r"(?:Ph\.?D|MBA|LL\.?M|CSc|DrSc|Esq|Jr|Sr|M\.?D|Inc|Ltd|LLC|GmbH|a\.s|s\.r\.o)\b\.?")


def expand_triggers(rules, extensions: tuple[str, ...] = ("add-colon", "normalize-spaces")):
    """Rules with variants of their cues: a colon after them, a space after them or both, no-break spaces. The first rule with a cue keeps it."""
    made = {"add-colon": lambda c: c + ":", "add-trailing-space": lambda c: c + " ", "add-colon-space": lambda c: c + ": ", "normalize-spaces": lambda c: c.replace(" ", "\u00a0")}
    seen, out = set(), []
    for cues, *rest in rules:
        mine = []
        for cue in cues:
            for form in dict.fromkeys([cue, *(made[x](cue) for x in extensions)]):
                if form.lower() not in seen:
                    seen.add(form.lower())
                    mine.append(form)
        out.append((mine, *rest))
    return out


def valid(value: str, checks: list[str]) -> bool:
    tests = {"upper": lambda v: regex.match(r"[\p{Lu}\p{N}\"„“]", v), "digit": lambda v: regex.search(r"\d", v), "no-digit": lambda v: not regex.search(r"\d", v), "phone": lambda v: len(regex.sub(r"\D", "", v)) >= 5 and not regex.match(r"\d{4}-\d{2}-\d{2}$", v)}
    for check in checks:
        name, _, given = check.partition(":")
        if name == "min-length":
            ok = len(value) >= int(given)
        elif name == "max-length":
            ok = len(value) <= int(given)
        elif name == "matches":
            ok = regex.search(given, value) is not None
        elif name == "valid-id":
            ok = regex.search(r"\d", value) is not None and regex.fullmatch(r"[\p{L}\d][\p{L}\d ./-]{2,40}", value) is not None
        else:
            ok = bool(tests[name](value))
        if not ok:
            return False
    return True


def triggers(text: str, rules=V.TRIGGERS) -> list[Entity]:
    """Values after cue phrases, 0.95."""
    out, low = [], text.lower()
    for cues, label, strategy, p, checks in rules:
        if not holds(low, cues):
            continue
        for m in compiled(rf"(?<!\w)(?:{any_of(cues)})(?!\w)", regex.I).finditer(text):
            span = trigger_value(text, m.end(), strategy, dict(p))
            if span is None or not valid(text[slice(*span)], checks):
                continue
            a, b = span
            real = label
            if label == "person":
                if regex.search(rf"(?:^|\s)(?:{any_of(V.LEGAL_FORMS)})$", text[a:b]):
                    real = "organization"
                else:
                    run = regex.match(r"(?:[\p{Lu}][\p{L}.'’-]*|" + any_of(V.PARTICLES) + r")(?: (?:[\p{Lu}][\p{L}.'’-]*|" + any_of(V.PARTICLES) + r"))*", text[a:b])
                    b = a + run.end() if run else b
            out.append(entity(text, m.start() if p.get("include") else a, b, real, 0.95, "trigger"))
    return out


# --- signatures ---------------------------------------------------------------------------


def name_shape(name: str) -> bool:
    """Two to five words of 3 to 60 characters, capitalised but for particles, and no legal form."""
    name = regex.sub(r",? (?:Ph\.?D\.?|MBA|LL\.?M\.?|CSc\.|Esq\.?|Jr\.?|Sr\.?)\.?$", "", name)
    parts = name.split()
    if not 3 <= len(name) <= 60 or not 2 <= len(parts) <= 5 or parts[-1] in V.LEGAL_FORMS:
        return False
    return bool(regex.match(r"\p{Lu}", parts[0])) and all(len(w) <= 31 and (w.lower() in V.PARTICLES or regex.match(r"\p{Lu}[\p{L}.'’-]*$", w)) for w in parts)


FIELD = r"\b(?:By|Name|Jméno|Nom|Nombre)[ \t]*:"
WITNESS = r"(?i)in witness whereof|zu urkund|na důkaz"


def signatures(text: str) -> list[Entity]:
    """Names at /s/ marks, after 'By:' and 'Name:', and under witness clauses."""
    out: list[Entity] = []
    if "/s/" not in text and not (":" in text and compiled(FIELD).search(text)) and not compiled(WITNESS).search(text):
        return out
    lines, at = [], 0
    for line in text.split("\n"):
        lines.append((at, line))
        at += len(line) + 1

    def add(k: int, value: str, column: int, score: float) -> bool:
        clean = value.strip(" \t_-–,;:")
        if not name_shape(clean):
            return False
        a = lines[k][0] + lines[k][1].index(clean, column)
        out.append(entity(text, a, a + len(clean), "person", score, "trigger"))
        return True

    for k, (_, line) in enumerate(lines):
        if (m := regex.search(r"/s/", line)) is not None:
            rest = line[m.end() :]
            if not add(k, rest, m.end(), 0.95):
                after = any(add(j, lines[j][1], 0, 0.9) for j in range(k + 1, min(k + 5, len(lines))))
                if not after and k:
                    add(k - 1, lines[k - 1][1], 0, 0.85)
        for m in regex.finditer(r"\b(?:By|Name|Jméno|Nom|Nombre)[ \t]*:[ \t]*([^\t\n]*?)(?=\s{2,}|\t|\b(?:Title|Date|By|Name)[ \t]*:|$)", line):
            value = m.group(1)
            if value.strip(" _"):
                for part in value.split(";"):
                    add(k, part, m.start(1), 0.95)
            else:
                any(add(j, lines[j][1], 0, 0.9) for j in range(k + 1, min(k + 4, len(lines))))
        if compiled(WITNESS).search(line):
            for j in range(k + 1, min(k + 7, len(lines))):
                add(j, lines[j][1], 0, 0.85)
    return out


# --- organisations ------------------------------------------------------------------------

# Words of a name before its legal form, and lower-case words between them.
HEAD_TOKENS, BRIDGES = 20, 4
FORMS = frozenset(V.LEGAL_FORMS)
JURISDICTION = regex.compile(r"\((?:[A-Z]{2,3}|\p{Lu}\p{Ll}+)\)")
#: Parts of documents, with letters or Roman numerals: no names.
STRUCTURE = regex.compile(r"(?:Section|Article|Annex|Part|Schedule|Chapter|Title|Appendix|Exhibit) [A-Z0-9.]+|(?:(?:Section|Article|Chapter|Title|Part) )?[IVXLCDM]+|[A-Z]")
#: Words that lead into a name and aren't part of it.
LEADING = regex.compile(r"(?:(?:The|This|Between|And|Whereas|By|With|From|For|When|While|Where|If|Under|Both|Neither|Either|Dear|Re) )+(?=\p{Lu})")


def legal_forms(text: str) -> list[Entity]:
    """Organisations that end in a legal form, walked to the left over capitalised words; institutional heads, walked to the right."""
    out: dict[int, int] = {}
    form = compiled(rf"(?<=[\s,])(?:{any_of(V.LEGAL_FORMS)})(?![\p{{L}}\p{{N}}])")
    for m in form.finditer(text) if any(f in text for f in V.LEGAL_FORMS) else ():
        begin, tokens, bridges, compound, wrapped = m.start(), 0, 0, False, False
        gap = text[max(0, begin - 2) : begin]
        if regex.search(r"[.;:!?] $", gap) and not text[max(0, begin - 16) : begin - 1].endswith(tuple(V.LEGAL_FORMS)):
            continue
        start = None
        for w in reversed(list(compiled(r"\S+").finditer(text, max(0, begin - 300), begin))):
            word, a, b = w.group(), w.start(), w.end()
            between = text[b : start if start is not None else begin]
            if "\n\n" in between or (start is not None and ("\n" in between or regex.search(r"[.;:!?)]$", word) and not regex.match(r"(?:\p{Lu}\.)+$", word))):
                break
            bare = word.strip("\"'“”„(),")
            if start is None and JURISDICTION.fullmatch(word):
                continue  # "Acme (UK) LLP"
            if start is not None and (word.endswith(",") or (bare in FORMS and not compound)):
                break  # the end of another name in a list
            if bare.lower() in V.CONNECTORS and start is not None and bridges < BRIDGES:
                bridges += 1
            elif regex.match(r"[\p{Lu}\p{N}&]", bare) and bare.lower() not in V.ROLES:
                start, tokens, bridges = a + word.index(bare), tokens + 1, 0
                compound = bare in FORMS  # "GmbH & Co. KG"
                wrapped = wrapped or "\n" in between
                if tokens >= HEAD_TOKENS or word[0] in "\"“„(":
                    break
            else:
                break
        if start is None:
            continue
        name = text[start : m.start()].strip(" ,")
        if STRUCTURE.fullmatch(name) or len(name) < 2:
            continue
        if wrapped and tokens == 1 and text.rfind("\n", 0, start) + 1 == start:
            continue  # a word alone on the line above isn't evidence of a name that was wrapped
        clip = LEADING.match(text, start, m.end())
        start = clip.end() if clip else start
        out[start] = max(out.get(start, 0), m.end())
    formed, heads = Covered(out.items()), {}
    word = r"(?:\p{Lu}[\p{L}'’-]+|" + any_of(V.CONNECTORS) + ")"
    head = compiled(rf"(?<!\w)(?:{any_of(V.INSTITUTIONS)}) (?:of|for|de|du|für|der|des|del)(?: (?:the|la|le|l'))?(?: {word}){{1,12}}|(?:\p{{Lu}}[\p{{L}}'’-]+ ){{1,4}}(?:{any_of(V.INSTITUTIONS)})(?!\w)")
    for m in head.finditer(text) if any(i in text for i in V.INSTITUTIONS) else ():
        end = m.start() + len(regex.sub(rf"(?: (?:{any_of(V.CONNECTORS)}))+$", "", m.group()))
        if m.start() not in out and not formed.touches(m.start(), m.start() + 1):
            heads[m.start()] = end
    return [entity(text, a, b, "organization", 0.95, "legal-form") for a, b in outermost([*out.items(), *heads.items()])]


# --- persons ------------------------------------------------------------------------------

CHAIN = 5
BLANK = regex.compile(r"[ \t\u00a0]{1,4}")
FIRST, LAST, TITLES, PARTICLES, STOP = (frozenset(x) for x in (V.FIRST_NAMES, V.SURNAMES, V.TITLES, V.PARTICLES, V.PERSON_STOP))
HAN = regex.compile(r"\p{Han}")


def names(text: str, first: set[str] | None = None, last: set[str] | None = None, mode: str = "full") -> list[Entity]:
    """Chains of name words; see SCORES for what they earn. Lone first names don't count at a sentence's start or in capitals."""
    first, last = first or FIRST, last or LAST
    lower = tuple(sorted(w for w in {*V.PARTICLES, *TITLES, *first, *last} if w[0].islower()))
    tokens: list[tuple[int, int, str, bool]] = []
    lone = rf"|(?:{any_of(lower)})(?![\p{{L}}\p{{M}}'’-])\.?" if lower else ""
    # Other lower-case words need no token: the gap that they leave ends a chain.
    for m in compiled(rf"(?<![\p{{L}}\p{{M}}'’-])(?:\p{{Lu}}[\p{{L}}\p{{M}}'’-]*\.?{lone})").finditer(text):
        word = m.group()
        bare = word.rstrip(".")
        dotted = len(bare) < len(word)
        if word in TITLES or bare in TITLES:
            kind = "title"
        elif bare in first:
            kind = "name"
        elif bare in last or (bare.isupper() and bare.title() in last):
            kind = "surname"
        elif dotted and len(bare) == 1:
            kind = "abbreviation"
        elif bare in PARTICLES:
            kind = "particle"
        else:
            kind = "capital" if bare[1:2].islower() and bare.lower() not in STOP else "other"
        tokens.append((m.start(), m.end() if kind in ("title", "abbreviation") else m.start() + len(bare), kind, dotted))
    if not any(t[2] in ("name", "surname", "title") for t in tokens):
        return cjk_names(text)
    out, i = [], 0
    while i < len(tokens):
        chain = []
        for t in tokens[i : i + CHAIN + 1]:
            if t[2] == "other" or len(chain) == CHAIN or (chain and not regex.fullmatch(r"[ \t ]{1,4}", text[chain[-1][1] : t[0]])):
                break
            chain.append(t)
        i += max(1, len(chain))
        while chain and chain[-1][2] == "particle":
            chain.pop()
        kinds = [t[2] for t in chain]
        known = kinds.count("name") + kinds.count("surname")
        # A capitalised word before the first known one isn't part of a name.
        while chain and kinds[0] in ("capital", "particle") and known:
            chain, kinds = chain[1:], kinds[1:]
        body = [t for t in chain if t[2] != "title"]
        if not body or not (known or ("title" in kinds and any(k == "capital" for k in kinds))):
            continue
        if "title" in kinds:
            score = 0.95
        elif known >= 2:
            score = 0.9
        elif len(body) > 1:
            score = 0.7
        else:
            before = text[: body[0][0]].rstrip()
            whole = text[body[0][0] : body[-1][1]]
            if kinds != ["name"] or not before or before[-1] in ".!?\n" or whole.isupper():
                continue
            score = 0.5
        if mode == "full" or score >= 0.9:
            out.append(entity(text, chain[0][0], body[-1][1], "person", score, "deny-list"))
    return out + cjk_names(text)


def cjk_names(text: str) -> list[Entity]:
    """Han names of 2 to 4 characters that begin with a surname, unless the text is Chinese prose."""
    if text.isascii() or not HAN.search(text):
        return []
    han = len(HAN.findall(text))
    if len(text) >= 100 and han >= 0.15 * len(text):
        return []
    found = regex.finditer(rf"(?<!\p{{Han}})(?:{any_of(V.SURNAMES_HAN)})\p{{Han}}{{1,3}}(?!\p{{Han}})", text)
    return [entity(text, *m.span(), "person", 0.95, "deny-list") for m in found]


# --- travel documents and cards -----------------------------------------------------------


def _check(field: str) -> int:
    values = [0 if c == "<" else int(c) if c.isdigit() else ord(c) - 55 for c in field]
    return sum(v * (7, 3, 1)[i % 3] for i, v in enumerate(values)) % 10


def structured(text: str) -> list[Entity]:
    """Machine-readable zones of passports and cards (ICAO 9303 check digits) and card tracks (Luhn)."""
    out: list[Entity] = []
    if "<" not in text and "=" not in text and "^" not in text:
        return out
    for m in regex.finditer(r"(?m)^P[A-Z<][A-Z<]{42}\r?\n[A-Z0-9<]{44}$", text):
        b = m.group().split("\n")[1]
        if all(b[k].isdigit() and _check(b[i:k]) == int(b[k]) for i, k in ((0, 9), (13, 19), (21, 27))):
            out.append(entity(text, *m.span(), "passport number", 1.0, "regex"))
    for m in regex.finditer(r"(?m)^[ACI][A-Z0-9<]{29}\r?\n[0-9]{6}[0-9][MF<X][0-9]{6}[0-9][A-Z<]{3}[A-Z0-9<]{11}[0-9]\r?\n[A-Z<]{30}$", text):
        a, b, _ = (x.strip() for x in m.group().split("\n"))
        if a[14].isdigit() and _check(a[5:14]) == int(a[14]) and _check(b[:6]) == int(b[6]) and _check(b[8:14]) == int(b[14]):
            out.append(entity(text, *m.span(), "identity card number", 1.0, "regex"))
    for m in regex.finditer(r"%B(\d{13,19})\^[^^\n]{2,26}\^\d{2}(?:0[1-9]|1[0-2])\d{3}[^?\n]{0,40}\?|;(\d{13,19})=\d{2}(?:0[1-9]|1[0-2])\d{3}\d{0,30}\?", text):
        digits = [int(c) for c in (m.group(1) or m.group(2))][::-1]
        if sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0:
            out.append(entity(text, *m.span(), "credit card number", 1.0, "regex"))
    return out


# --- addresses ----------------------------------------------------------------------------

# Gaps, scores and sizes of address clusters.
CLUSTER_GAP, BASE_SCORE, PART_SCORE, CUE_SCORE, MOST_SCORE, EXPAND = 150, 0.5, 0.15, 0.1, 0.95, 200


def address_seeds(text: str, found: list[Entity]) -> list[tuple[int, int, str]]:
    forms = [(rf"(?<!\w)(?:{any_of(V.STREETS)})(?!\w)", "street", any(w in text for w in V.STREETS)), (rf"\b\p{{Lu}}\p{{L}}*(?:{'|'.join(V.STREET_ENDINGS)})\b", "street", any(w in text for w in V.STREET_ENDINGS)),
        (rf"(?<!\w)(?:{any_of(V.CITIES)})(?!\w)", "city", any(w in text for w in V.CITIES)), (rf"(?<=, )(?:{any_of(V.STATES)})(?= \d{{5}})", "state", DIGIT.search(text) is not None)]
    seeds = [(*m.span(), kind) for form, kind, may in forms if may for m in compiled(form).finditer(text)]
    if DIGIT.search(text):
        seeds += [(*m.span(), "postal") for m in compiled(r"(?<![\w-])(?:\d{5}(?:-\d{4})?|\d{3} \d{2}|\d{2}-\d{3}|[A-Z]{1,2}\d[A-Z\d]? \d[A-Z]{2})(?![\w-])").finditer(text)]
    seeds += [(e.start, e.end, "cue") for e in found if e.label == "address" and e.source == "trigger"]
    return sorted(seeds)


def addresses(text: str, found: list[Entity], standalone: bool = False) -> list[Entity]:
    """Clusters of address parts, scored by their kinds and grown to whole lines' parts."""
    seeds, out, group = address_seeds(text, found), [], []
    if not seeds:
        return []
    barriers = Covered((e.start, e.end) for e in found if e.label != "address")
    clusters: list[list[tuple[int, int, str]]] = []
    for s in seeds:
        if group:
            gap = text[group[-1][1] : s[0]]
            far = len(gap) > CLUSTER_GAP or "\n\n" in gap
            if far or len(regex.findall(r"(?<!\p{L})\p{Ll}{3,}", gap)) > 1 or barriers.touches(group[-1][1], s[0]):
                clusters.append(group)
                group = []
        group = [*group, s]
    clusters += [group] if group else []
    for c in clusters:
        kinds = {k for *_, k in c}
        a, b = c[0][0], max(x[1] for x in c)
        if len(kinds) < 2 and not (standalone and kinds == {"street"}):
            continue
        left = regex.search(r"(?:\d{1,5}[A-Za-z]?(?:/\d+)?,? )?(?:\p{Lu}[\p{L}'’.-]* )*$", text[max(0, a - EXPAND) : a])
        a -= len(left.group()) if left and "street" in kinds else 0
        right = regex.match(r"(?: \p{Lu}[\p{L}'’-]*){0,3} ?\d{1,4}[A-Za-z]?(?:/\d+)?\b" if c[-1][2] == "street" else r"(?:, (?:" + any_of(V.COUNTRIES) + r"))?", text[b : b + EXPAND])
        b += right.end() if right else 0
        if len(kinds) >= 2:
            score = min(MOST_SCORE, BASE_SCORE + PART_SCORE * len(kinds & {"postal", "city", "state", "street"}) + CUE_SCORE * ("cue" in kinds))
        elif standalone and kinds == {"street"} and regex.search(r"\d", text[a:b]):
            score = 0.65
        else:
            continue
        if 5 <= b - a <= 300:
            out.append(entity(text, a, b, "address", score, "regex"))
    return out


def address_context(text: str, found: list[Entity]) -> list[Entity]:
    """House numbers and street lines near known addresses: 'Word 12/3' near by or in the header, street lines of the header, 'Word 12' on the same line."""
    known = [e for e in found if e.label == "address"]
    header = min(len(text) * 15 // 100, 32 << 10)
    out = []
    for m in regex.finditer(r"\b\p{Lu}\p{L}+ \d{1,5}/\d{1,4}[a-z]?\b", text):
        near = any(max(0, e.start - m.end(), m.start() - e.end) <= 200 for e in known)
        if (near or m.start() < header) and not any(e.start < m.end() and m.start() < e.end for e in found):
            score = 0.95 if ":" in text[max(0, m.start() - 5) : m.start()] else 0.85 if m.start() < header else 0.8
            out.append(entity(text, *m.span(), "address", score, "regex", source_detail="address-context"))
    if known:
        at = 0
        for line in text[:header].split("\n"):  # street lines of their own in the header
            m = compiled(rf"\s*((?:\d{{1,5}} )?(?:\p{{Lu}}[\p{{L}}.'’-]* ){{1,4}}(?:{any_of(V.STREETS)})(?: \d{{1,4}})?),?\s*").fullmatch(line)
            if m and not any(e.start < at + m.end(1) and at + m.start(1) < e.end for e in [*found, *out]):
                out.append(entity(text, at + m.start(1), at + m.end(1), "address", 0.85, "regex", source_detail="address-context"))
            at += len(line) + 1
    for m in regex.finditer(r"\b\p{Lu}\p{L}{3,} \d{1,4}\b(?![/.,]\d)", text):
        near = any("\n" not in text[min(e.end, m.end()) : max(e.start, m.start())] and max(0, e.start - m.end(), m.start() - e.end) <= 50 for e in known)
        stop = m.group().split()[0].lower() in {"section", "article", "page", "schedule", "annex", *V.MONTHS["en"]}
        if near and not stop and not any(e.start < m.end() and m.start() < e.end for e in [*found, *out]):
            out.append(entity(text, *m.span(), "address", 0.75, "regex", source_detail="address-context"))
    return out


# --- resolution ---------------------------------------------------------------------------


def outranks(new: Entity, old: Entity) -> bool:
    """Whether `new` should take the place of `old`, which it overlaps. Rules in order; the first that decides wins."""
    mine, theirs = (e.source == "caller" or e.source_detail in ("custom-regex", "custom-deny-list") for e in (new, old))
    if mine != theirs:
        owned, other = (new, old) if mine else (old, new)
        if owned.size != other.size:
            return (owned.size > other.size) == mine
        if owned.source_detail in ("custom-regex", "custom-deny-list"):
            return mine
    inside = lambda a, b: a.start <= b.start and b.end <= a.end and a.size > b.size

    def widest(test) -> bool | None:
        for a, b, answer in ((new, old, True), (old, new, False)):
            if inside(a, b) and test(a, b):
                return answer
        return None

    literal = ("gazetteer",)
    tests = [
        lambda a, b: a.source in literal and b.source in literal,
        lambda a, b: a.label == "organization" and a.source in ("deny-list", "gazetteer"),
        lambda a, b: a.label == "address" and bool(re.fullmatch(r"[\d -]+", b.text)),
        lambda a, b: a.source == "legal-form",
        lambda a, b: a.label == b.label and a.start == b.start,
        lambda a, b: a.source == "regex" and b.source == "trigger" and a.label == b.label,
        lambda a, b: a.label == b.label == "person",
        lambda a, b: a.label in ("person", "organization") and b.label == "country",
        lambda a, b: a.label == "person" and b.label == "address",
        lambda a, b: a.label == "address" and b.label == "country",
    ]
    for test in tests:
        answer = widest(test)
        if answer is not None:
            return answer
    a, b = PRIORITY.get(new.source, 0), PRIORITY.get(old.source, 0)
    return (a, new.score, new.size) > (b, old.score, old.size)


def merge(entities: list[Entity]) -> list[Entity]:
    """One layer without overlaps: sorted by start (stable), each entity takes the place of those kept that it overlaps only if it outranks them all."""
    kept: list[Entity] = []  # disjoint and in order, so what a later entity overlaps is at the end
    for e in sorted(entities, key=lambda x: x.start):
        k = len(kept)
        while k and kept[k - 1].end > e.start:
            k -= 1
        if all(outranks(e, old) for old in kept[k:] if old.start < e.end):
            kept[k:] = [old for old in kept[k:] if old.start >= e.end]
            kept.append(e)
            if k + 1 < len(kept):
                kept[k:] = sorted(kept[k:], key=lambda x: x.start)
    return sorted(kept, key=lambda x: (x.start, x.end))


def grow_words(text: str, entities: list[Entity]) -> list[Entity]:
    """Spans that begin or end inside a word grow to its edge, but not into another entity."""
    out = []
    for i, e in enumerate(entities):
        low = entities[i - 1].end if i else 0
        high = entities[i + 1].start if i + 1 < len(entities) else len(text)
        a, b = e.start, e.end
        if a < len(text) and text[a].isalnum():
            while a > low and text[a - 1].isalnum():
                a -= 1
        if b and text[b - 1].isalnum():
            while b < high and text[b].isalnum():
                b += 1
        out.append(replace(e, start=a, end=b, text=text[a:b]) if (a, b) != (e.start, e.end) else e)
    return out


def cut_persons(text: str, entities: list[Entity]) -> list[Entity]:
    """Person spans end before a line break, a field label or a stamp phrase."""
    out = []
    for e in entities:
        m = regex.search(r"\n|\s+(?:Title|Date|Address|Tel|E-?mail|born|geboren|narozen\w*)\b:?|\s+(?:APPROVED|CERTIFIED|COPY)\b", e.text) if e.label == "person" else None
        out.append(replace(e, end=e.start + m.start(), text=e.text[: m.start()]) if m and m.start() else e)
    return out


def trim_crossing(text: str, entities: list[Entity]) -> list[Entity]:
    """Spans of different labels that cross: the one with the lower score (then the shorter) loses the shared part."""
    out = sorted(entities, key=lambda e: (e.start, e.end))
    for i in range(len(out) - 1):
        a, b = out[i], out[i + 1]
        if a.end > b.start and a.end < b.end:
            if (a.score, a.size) >= (b.score, b.size):
                out[i + 1] = replace(b, start=a.end, text=text[a.end : b.end])
            else:
                out[i] = replace(a, end=b.start, text=text[a.start : b.start])
    return [e for e in out if e.size > 0]


def join_adjacent(text: str, entities: list[Entity]) -> list[Entity]:
    """Neighbours of one label with at most three of space, tab, comma and hyphen between become one; not countries, not over a comma after a legal form."""
    out: list[Entity] = []
    for e in sorted(entities, key=lambda x: (x.start, x.end)):
        last = out[-1] if out else None
        gap = text[last.end : e.start] if last and last.end <= e.start else None
        if last and gap is not None and last.label == e.label != "country" and len(gap) <= 3 and not gap.strip(" \t,-") and not ("," in gap and last.source == "legal-form"):
            out[-1] = replace(last, end=e.end, text=text[last.start : e.end], score=max(last.score, e.score))
        else:
            out.append(e)
    return out


ABBREVIATIONS = ("s.r.o.", "a.s.", "Inc.", "Ltd.", "Corp.", "Co.", "S.A.", "S.p.A.", "S.r.l.", "B.V.", "N.V.", "e.V.", "z o.o.", "Kft.", "Zrt.", "d.o.o.", "Jr.", "Sr.", "St.", "Ave.", "Rd.", "Blvd.")


def sanitise(text: str, entities: list[Entity]) -> list[Entity]:
    """Without space, quotes and punctuation at the edges; empty ones go; a last full stop stays only after a known abbreviation."""
    out = []
    for e in entities:
        a, b = e.start, e.end
        while a < b and text[a] in " \t\n\r \"'“”„‘’,;:":
            a += 1
        while b > a and (text[b - 1] in " \t\n\r \"'“”„‘’,;:!?" or (text[b - 1] == "." and not text[a:b].endswith(ABBREVIATIONS))):
            b -= 1
        if any(c.isalnum() for c in text[a:b]):
            out.append(replace(e, start=a, end=b, text=text[a:b]))
    return out


def false_positive(text: str, e: Entity) -> str | None:
    """The rule that rejects an entity, if one does."""
    t, words = e.text, e.text.split()
    line_start = text.rfind("\n", 0, e.start) + 1
    line = text[line_start : (text + "\n").index("\n", e.end)]
    low = t.lower()
    if regex.fullmatch(r"[._]{3,}|\[\w+\]|\{\w+\}", t):
        return "template"
    if e.source != "legal-form" and len(t) > {"organization": 80, "person": 60}.get(e.label, 10**9):
        return "too-long"
    if e.label == "organization" and e.source in ("trigger", "coreference") and len(words) > 8:
        return "too-many-words"
    if e.label == "address" and (regex.fullmatch(r"§ ?\d+|\d+\.\d+", t) or (regex.fullmatch(r"\d+\.?", t) and e.start == line_start)):
        return "section"
    if regex.fullmatch(r"\d{1,2}(?:\.\d{1,2})+", t) and e.label not in ("ip address", "address") and e.source != "trigger":
        return "section-number"
    if regex.fullmatch(r"(?:19|20)\d{2}", t) and e.source != "trigger":
        return "year"
    if t[:1].isdigit() and regex.search(r"(?:No|Nr|Nos|č)\.? ?$", text[max(0, e.start - 5) : e.start]) and e.source != "trigger" and e.label != "case number" and e.score < 1:
        return "number-sign"
    if e.label == "registration number" and regex.fullmatch(r"\p{L}{1,2}", t):
        return "short-letters"
    if e.label == "birth number" and not regex.search(r"\d", t):
        return "no-digit"
    if e.label == "person" and regex.search(r"[0-9]", t):
        return "person-digit"
    if e.label == "person" and len(words) == 1 and low in V.PERSON_STOP:
        return "person-stopword"
    if e.label == "person" and len(words) > 1 and words[-1].lower() in V.PERSON_STOP:
        return "person-noun"
    if e.label in ("person", "organization") and low in V.ROLES:
        return "role"
    if e.label == "organization" and t.isupper() and len(words) > 1 and e.source != "legal-form":
        letters = [c for c in line if c.isalpha()]
        if len(letters) >= 5 and sum(c.isupper() for c in letters) >= 0.95 * len(letters) and len(line.split()) > len(words) + 2:
            return "capitals-line"
    if e.label == "organization" and regex.match(r"(?i)(?:article|section|annex|schedule|chapter|part) (?:no\. )?[0-9ivx]+", t):
        return "heading"
    if e.label == "organization" and (m := regex.fullmatch(r"(?i)(?:page|seite|strana) \d+ (?:of|von|z) (\d+)", t)) and int(m.group(1)) <= 1000:
        return "page-footer"
    if e.label == "address" and regex.fullmatch(r"(?i)(?:in|v|ve|à) \p{Lu}\p{L}+,? (?:on|dne|am|le)", t):
        return "signing-place"
    if e.label == "address" and e.source == "deny-list" and len(words) > 1 and words[-1].strip(".,;:").lower() in V.PERSON_STOP:
        return "address-noun"
    if e.label == "organization" and regex.search(r" (?:Reform|Protection|Exchange)(?: and [\p{Lu}\p{L} ]+)? Act$", t) and not regex.search(r"\d", t):
        return "statute"
    component = regex.search(rf"\d|(?<!\w)(?:{any_of(V.STREETS + V.CITIES + V.COUNTRIES)})(?!\w)", t)
    jurisdiction = regex.match(r"(?:State|Commonwealth|District|Territory) of ", t)
    if e.label == "address" and e.source == "trigger" and not component and not jurisdiction:
        return "no-component"
    if e.label == "address" and len(t) > 40 and not component:
        return "long-without-component"
    return None


PARTY = regex.compile(rf"(?i)(?:the )?(?:{any_of(V.ROLES)})(?:'s)?(?: address)?\s*[:,–-]\s*")
PROSE = regex.compile(r",? (?:hereinafter|which|who|where|that|and its|represented|vertreten|zastoupen\w*|ci-après|en adelante|dále jen)\b.*", regex.S | regex.I)
OPEN_END = regex.compile(r"(?: \p{Ll}{3,}){3,}.*", regex.S)


def normalise(text: str, entities: list[Entity]) -> list[Entity]:
    """Spans without what detectors took in too much: a party before an address, prose after an address or an organisation."""
    out = []
    for e in entities:
        a, b = e.start, e.end
        if e.label == "address" and e.source != "caller":
            lead = PARTY.match(text, a, b)
            a = lead.end() if lead and lead.end() < b else a
            tail = PROSE.search(text, a, b)
            b = tail.start() if tail and tail.start() > a else b
        elif e.label == "organization" and e.source in ("trigger", "coreference"):
            tail = OPEN_END.search(text, a, b)
            b = tail.start() if tail and tail.start() > a else b
        while b > a and text[b - 1] in " ,;:-–":
            b -= 1
        out.append(replace(e, start=a, end=b, text=text[a:b]) if (a, b) != (e.start, e.end) else e)
    return [e for e in out if e.size]


WRAPPED_CITY = regex.compile(rf"(?:[ \n]\p{{Lu}}[\p{{L}}'’-]+){{0,2}}, (?:{any_of(V.STATES)}) \d{{5}}(?:-\d{{4}})?\b")


def wrapped_cities(text: str, entities: list[Entity]) -> list[Entity]:
    """A person that goes on, perhaps over a line break, as 'City, ST 12345' is an address."""
    out = []
    for e in entities:
        m = WRAPPED_CITY.match(text, e.end) if e.label == "person" else None
        out.append(replace(e, end=m.end(), label="address", text=text[e.start : m.end()], score=max(e.score, 0.9), source="regex") if m else e)
    return out


def drop_false_positives(text: str, entities: list[Entity]) -> list[Entity]:
    return [e for e in entities if false_positive(text, e) is None]


# --- coreference --------------------------------------------------------------------------

DEFINED = regex.compile(r"\((?:(?:hereinafter|the|together with its affiliates, the|dále jen|im Folgenden|ci-après|en adelante)\s+)?(?:referred to as )?[\"“„']([^\"“”„']{2,60})[\"”“'](?:\s+or\s+(?:the\s+)?[\"“„']([^\"“”„']{2,60})[\"”“'])?\)")
BEFORE_ALIAS = 200


def similar(alias: str, name: str) -> bool:
    """One holds the other, they share a word, or the alias is made of the name's initials or leading letters."""
    a, n = alias.lower(), name.lower()
    words = [w for w in regex.findall(r"\w+", n)]
    if (len(a) >= 3 and a in n) or set(regex.findall(r"\w{3,}", a)) & set(words) or "".join(w[0] for w in words).startswith(a):
        return True
    at = 0  # an acronym that takes one or more letters from the front of words in order
    for w in words:
        k = 0
        while at < len(a) and k < len(w) and a[at] == w[k]:
            at, k = at + 1, k + 1
    return len(a) >= 3 and at == len(a)


def coreferences(text: str, entities: list[Entity]) -> list[Entity]:
    """Bare mentions of organisations without their legal form (0.9), and mentions of defined terms (0.95), linked to their source text."""
    out: list[Entity] = []
    known = Covered((e.start, e.end) for e in entities)
    new: list[tuple[int, int]] = []  # disjoint, in order

    def covered(a: int, b: int) -> bool:
        k = bisect_left(new, (b, -1))
        return known.touches(a, b) or bool(k and new[k - 1][1] > a)

    bases: dict[str, set[str]] = {}
    for e in entities:
        if e.label == "organization":
            base = regex.sub(rf",? (?:{any_of(V.LEGAL_FORMS)})$", "", e.text)
            if base != e.text and len(base) >= 3:
                bases.setdefault(base, set()).add(e.text)
    for base, sources in sorted(bases.items()):
        for m in regex.finditer(rf"(?<!\w){regex.escape(base)}(?!\w)", text):
            if not covered(*m.span()):
                insort(new, m.span())
                out.append(entity(text, *m.span(), "organization", 0.9, "coreference", kind="coreference", source_text=min(sources) if len(sources) == 1 else base))
    for d in DEFINED.finditer(text) if entities and "(" in text else ():
        near = [e for e in entities if e.label in ("person", "organization") and e.end <= d.start() and d.start() - e.end <= BEFORE_ALIAS and not regex.search(r"[.;]\s", text[e.end : d.start()])]
        if not near:
            continue
        owner = max(near, key=lambda e: e.end)
        for alias in [g for g in d.groups() if g][:2]:
            generic = alias.lower() in V.ROLES
            if not generic and not similar(alias, owner.text):
                continue
            for m in regex.finditer(rf"(?<!\w){regex.escape(alias)}(?!\w)", text):
                if not covered(*m.span()):
                    insort(new, m.span())
                    out.append(entity(text, *m.span(), owner.label, 0.95, "coreference", kind="coreference", source_text=owner.text))
    return out


def resolve(text: str, entities: list[Entity], threshold: float = 0.3, labels: set[str] | None = None, coreference: bool = True) -> list[Entity]:
    """Filter, merge, extend, fix boundaries, sanitise, reject, and once more with coreferences."""

    def once(found: list[Entity]) -> list[Entity]:
        kept = [e for e in found if (not labels or e.label in labels) and (e.score >= threshold or e.source_detail == "address-context")]
        kept = extend_money(text, merge(kept))
        kept = join_adjacent(text, trim_crossing(text, cut_persons(text, grow_words(text, kept))))
        return drop_false_positives(text, normalise(text, sanitise(text, kept)))

    first = once(wrapped_cities(text, entities))
    aliases = coreferences(text, first) if coreference else []
    final = once([*first, *aliases]) if aliases else first
    final = [e for e in final if (not labels or e.label in labels) and (e.score >= threshold or e.source_detail == "address-context")]
    return [replace(e, source_detail=None) if e.source_detail == "address-context" else e for e in final]
