"""The catalogue of built-in regex rules.

Patterns are Java regular expressions and ours: they follow public formats. A rule with a
checksum scores 1.0, a context-free shape 0.9, an obfuscated one 0.85.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions.idnumbers import ALL as VALIDATORS


@dataclass(frozen=True)
class Rule:
    rule_id: str
    label: str
    pattern: str
    score: float = 0.9
    validator: str | None = None
    min_length: int = 0
    #: A plain string that every match holds, or some of which it holds one; texts without skip the scan.
    needs: str | tuple[str, ...] | None = None
    #: Whether every match holds a digit; texts without one skip the scan.
    digit: bool = True
    #: The part of a match that is the value: drop this prefix (a cue before it).
    cue: str | None = None
    #: A short pattern that every match holds; texts without it skip the scan.
    clue: str | None = None
    #: Whether no character of a match, nor what its edges look at, is further than NEAR from a digit of it.
    near: bool = False


#: Code points round a digit that rules with `near` look at first.
NEAR = 100
#: Before a run of the characters of an address: a match begins there or where the last one ended, so other places needn't be tried.
RUN = r"(?:(?<![A-Za-z0-9._%+!-])|\G)"

EMAIL = r"[A-Za-z0-9._%+!-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}"
IPV4 = r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"
CARD = r"\b[0-9]{13,19}\b"
NANP = r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}"
SECRET = r'token = "[0-9a-f]{40}"'

RULES: list[Rule] = [
    Rule("email", "email address", RUN + EMAIL, needs="@"),
    Rule("email-idn", "email address", r"(?<![\w.@!+-])[\p{L}0-9._%+!-]+@[\p{L}0-9](?:[\p{L}0-9-]*[\p{L}0-9])?(?:\.[\p{L}0-9](?:[\p{L}0-9-]*[\p{L}0-9])?)*\.\p{L}{2,24}(?![\w@-])", needs="@"),
    Rule("email-written", "email address", r"\b[A-Za-z0-9._-]{1,64} (?:at|\(at\)|\[at\]) [A-Za-z0-9-]{1,63}(?: (?:dot|\(dot\)|\[dot\]) [A-Za-z0-9-]{2,63}){1,4}\b", 0.85, needs="dot", digit=False),
    Rule("ipv4", "ip address", IPV4, 1.0, "ip.v4"),
    Rule("ipv6", "ip address", r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:.])|(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Fa-f:.])", needs=":", clue=r":[0-9A-Fa-f]{0,4}:"),
    Rule("mac", "mac address", r"(?<![0-9A-Fa-f:-])[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:-])", digit=False, clue=r"[:-][0-9A-Fa-f]{2}[:-]"),
    Rule("url", "url", r"\b(?:https?://|www\.)[^\s<>\"']{3,2000}(?<![.,;:!?)\]])", needs=("://", "www."), digit=False),
    Rule("card", "credit card number", r"(?<![0-9-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9-])", 1.0, "card"),
    Rule("iban", "iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?\b", 1.0, "iban"),
    Rule("phone-international", "phone number", r"(?<![\w+/.-])(?:\+|00)[1-9(][0-9 ().\-/]{6,22}[0-9](?![\w])", 0.9, "phone.international"),
    Rule("phone-nanp", "phone number", r"(?<![\w+/.-])(?:1[ .-])?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![\w-])", 0.9, "phone.nanp"),
    Rule("phone-german", "phone number", r"(?<![\w+/.-])0[1-9][0-9]{1,4}[ /-][0-9]{5,9}(?![\w-])", 0.9, "phone.german"),
    Rule("ssn", "social security number", r"(?<![\w-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![\w-])", 1.0, "us.ssn"),
    Rule("nino", "social security number", r"\b[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z] ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[A-D]\b", 1.0, "uk.nino"),
    Rule("date-iso", "date", r"(?<![\w-])(?:19|20|21)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?![\w-])"),
    Rule("date-numeric", "date", r"(?<![\w./-])(?:0?[1-9]|[12][0-9]|3[01])(?:\. ?|[/-])(?:0?[1-9]|1[0-2])(?:\. ?|[/-])(?:19|20|21)[0-9]{2}(?![\w/-])"),
    Rule("percent", "monetary amount", r"(?<![\w.,])[-+]?[0-9]{1,3}(?:[.,' ]?[0-9]{3})*(?:[.,][0-9]+)? ?%(?: ?[–-] ?[0-9]+(?:[.,][0-9]+)? ?%)?", needs="%"),
    Rule("eth", "crypto", r"\b0x[0-9a-fA-F]{40}\b", 0.9, "crypto.wallet", needs="0x"),
    Rule("bech32", "crypto", r"\b(?:bc1|BC1)[02-9A-HJ-NP-Za-hj-np-z]{11,71}\b", 0.9, "crypto.wallet"),
    Rule("base58", "crypto", r"\b(?i:(?:btc|bitcoin|crypto)(?: (?:wallet|address))?|wallet(?: address)?)[: ]{1,2}[13][1-9A-HJ-NP-Za-km-z]{25,34}\b"),
    Rule("passport", "passport number", r"\b(?:(?!The |A |An |His |Her |Their |This |That |My |Your |Our |No )(?:US|UK|EU|[A-Z][a-z]{2,14}) )?(?i:passport)(?: (?i:number|no|num))?[.:#]{0,2} {0,2}(?:[A-Z]{1,2}[0-9]{6,8}|[0-9]{9}|[0-9]{2}[A-Z]{2}[0-9]{5})\b"),
    Rule("nhs", "national identification number", r"\b(?:NHS|National Health Service)(?: (?i:number|no|num))?[.:]? ?#? ?[0-9]{3}[ -]?[0-9]{3}[ -]?[0-9]{4}\b", 1.0, "uk.nhs"),
    Rule("fr-cni", "identity card number", r"\b(?:CNI|Carte [Nn]ationale [Dd][’'][Ii]dentit[ée])(?: ?(?:n[º°o]|[Nn]o\.?))?[ :]{1,2}[0-9]{2}[A-Z]{2}[0-9]{5}\b"),
    Rule("cy-tic", "tax identification number", r"\b(?i:cyprus TIC)[: ]{1,2}[0-9]{8}[A-Z]\b"),
    Rule("cy-id", "identity card number", r"\b(?i:cypriot ID card)(?: (?i:no|number))?[.:]? [0-9]{6,8}\b"),
    Rule("uk-licence", "identity card number", r"\bUK (?i:driving licen[cs]e)(?: (?i:no|number))?[.:]? [A-Z][A-Z9]{4}[0-9]{6}[A-Z][A-Z9][0-9A-Z][A-Z]{2}\b"),
    Rule("ca-licence", "identity card number", r"\b(?:CA|California) (?i:driver(?:[’']?s)? licen[cs]e)(?: (?i:no|number))?[.:]? [A-Z][0-9]{7}\b"),
    Rule("gmc", "registration number", r"\bGMC (?i:number|no\.?)[:]? [0-9]{7}\b"),
    Rule("nmc", "registration number", r"\bNMC (?i:PIN)[:]? [0-9]{2}[A-Z][0-9]{4}[A-Z]\b"),
    Rule("companies-house", "registration number", r"(?i:companies house)(?: (?i:no|number))?[.:]{0,2} {0,2}(?:[A-Z]{2}[0-9]{6}|[0-9]{8})\b", 0.9, cue=r"^(?i)companies house(?: (?:no|number))?[.:]{0,2} {0,2}"),
    Rule("signing-place", "address", r"(?<=(?:Done at |Signed at |Executed at |Fait à |Hecho en |Fatto a ))\p{Lu}[\p{L}-]{1,30}(?: \p{Lu}[\p{L}-]{1,30}){0,2}(?=,? (?:on|this|le|el|il) )|(?<=\bV )\p{Lu}\p{Ll}{2,30}(?= dne )|\b\p{Lu}\p{Ll}{2,30}(?=, den [0-9])", 0.9, needs=("Done at ", "Signed at ", "Executed at ", "Fait à ", "Hecho en ", "Fatto a ", " dne ", ", den "), digit=False),
    Rule("cn-ric", "national identification number", r"(?<![0-9A-Za-z])[1-9][0-9]{16}[0-9Xx](?![0-9A-Za-z])", 1.0, "cn.ric"),
    Rule("cz-birth", "birth number", r"(?<![\w/])[0-9]{6}/[0-9]{3,4}(?![\w/])", 1.0, "cz.birth", needs="/"),
    Rule("es-dni", "identity card number", r"\b(?:[0-9]{8}|[XYZ][0-9]{7})-?[A-Z]\b", 1.0, "es.dni"),
    Rule("br-cpf", "tax identification number", r"(?<![\w.])[0-9]{3}\.[0-9]{3}\.[0-9]{3}-[0-9]{2}(?!\w)", 1.0, "br.cpf"),
    Rule("br-cnpj", "registration number", r"(?<![\w.])[0-9]{2}\.[0-9]{3}\.[0-9]{3}/[0-9]{4}-[0-9]{2}(?!\w)", 1.0, "br.cnpj"),
    Rule("ch-uid", "registration number", r"\bCHE-?[0-9]{3}\.?[0-9]{3}\.?[0-9]{3}(?: (?:MWST|TVA|IVA))?\b", 1.0, "ch.uid", needs="CHE"),
    Rule("au-abn", "tax identification number", r"\bABN[: ]{1,2}[0-9]{2} ?[0-9]{3} ?[0-9]{3} ?[0-9]{3}\b", 1.0, "au.abn", needs="ABN", cue=r"^ABN[: ]{1,2}"),
    Rule("no-mva", "tax identification number", r"\b(?:NO ?)?[0-9]{3} ?[0-9]{3} ?[0-9]{3} ?MVA\b", 1.0, "no.mva", needs="MVA"),
    Rule("no-org", "registration number", r"(?i:\borg\.? ?nr\.?|organisasjonsnummer)[: ]{1,2}[0-9]{3} ?[0-9]{3} ?[0-9]{3}\b", 1.0, "no.orgnr", cue=r"^(?i)(?:org\.? ?nr\.?|organisasjonsnummer)[: ]{1,2}"),
    Rule("us-ein", "tax identification number", r"(?<![\w-])[0-9]{2}-[0-9]{7}(?![\w-])", 1.0, "us.ein"),
    Rule("de-idnr", "tax identification number", r"(?i:Steuer-?ID|IdNr|Identifikationsnummer)[.:]{0,2} {0,2}[1-9][0-9] ?[0-9]{3} ?[0-9]{3} ?[0-9]{3}\b", 1.0, "de.idnr", cue=r"^(?i)(?:Steuer-?ID|IdNr|Identifikationsnummer)[.:]{0,2} {0,2}"),
    Rule("uk-utr", "tax identification number", r"\bUTR[: ]{1,2}[0-9]{5} ?[0-9]{5}\b", 0.9, needs="UTR", cue=r"^UTR[: ]{1,2}"),
    Rule("uk-postcode", "address", r"\b(?:GIR ?0AA|[A-PR-UWYZ](?:[0-9]{1,2}|[A-HK-Y][0-9]{1,2}|[0-9][A-HJKSTUW]|[A-HK-Y][0-9][ABEHMNPRVWXY]) [0-9][ABD-HJLNP-UW-Z]{2})\b"),
    Rule("us-zip", "address", r"\b(?:A[KLRZ]|C[AOT]|D[CE]|FL|GA|HI|I[ADLN]|K[SY]|LA|M[ADEINOST]|N[CDEHJMVY]|O[HKR]|P[AR]|RI|S[CD]|T[NX]|UT|V[AT]|W[AIVY]) [0-9]{5}(?:-[0-9]{4})?(?![\w-])"),
    Rule("eu-vat", "tax identification number", r"\b(?:ATU[0-9]{8}|BE ?[01][0-9]{9}|BG[0-9]{9,10}|CY[0-9]{8}[A-Z]|CZ[0-9]{8,10}|DE[0-9]{9}|DK ?[0-9]{8}|EE[0-9]{9}|EL[0-9]{9}|ES[A-Z0-9][0-9]{7}[A-Z0-9]|FI[0-9]{8}|FR[0-9A-Z]{2} ?[0-9]{9}|GB ?[0-9]{9}|HR[0-9]{11}|HU[0-9]{8}|IE[0-9][0-9A-Z][0-9]{5}[A-Z]{1,2}|LT[0-9]{9,12}|LU[0-9]{8}|LV[0-9]{11}|MT[0-9]{8}|NL[0-9]{9}B[0-9]{2}|PT[0-9]{9}|RO[0-9]{2,10}|SI[0-9]{8}|SK[0-9]{10})\b", 1.0, "eu.vat"),
    Rule("it-fiscal", "tax identification number", r"\b[A-Z]{6}[0-9]{2}[A-EHLMPRST][0-9]{2}[A-Z][0-9]{3}[A-Z]\b", 1.0, "it.codiceFiscale"),
    Rule("de-svnr", "social security number", r"(?i:rentenversicherungsnummer|sozialversicherungsnummer|SVNR)[.: ]{1,2}[0-9]{2} ?[0-9]{6} ?[A-Z] ?[0-9]{3}\b", 1.0, "de.svnr", cue=r"^(?i)(?:rentenversicherungsnummer|sozialversicherungsnummer|svnr)[.: ]{1,2}"),
    Rule("ie-pps", "social security number", r"\bPPS[: ]{1,2}[0-9]{7}[A-W][A-IWTX]?\b", 1.0, "ie.pps", needs="PPS", cue=r"^PPS[: ]{1,2}"),
    Rule("fi-hetu", "national identification number", r"(?<![\w-])[0-3][0-9][01][0-9]{3}[-+A][0-9]{3}[0-9A-FHJ-NPR-Y](?![\w-])", 1.0, "fi.hetu"),
    Rule("ecli", "case number", r"\bECLI:[A-Z]{2}:[A-Z0-9]{1,7}:[0-9]{4}:[A-Z0-9.]{1,25}\b", needs="ECLI"),
    Rule("neutral-citation", "case number", r"\[(?:19|20)[0-9]{2}\] (?:UKSC|UKPC|EWCA (?:Civ|Crim)|EWHC|UKUT|UKFTT|CSIH|CSOH|NICA|IESC|IEHC) [0-9]{1,5}\b", needs="["),
    Rule("us-docket", "case number", r"\b[0-9]{1,2}:[0-9]{2}-(?:cv|cr|bk|md|mc|mj|ap)-[0-9]{3,6}(?:-[A-Z]{2,4})*\b"),
    Rule("de-aktenzeichen", "case number", r"\bAz\.? ?:? ?[0-9IVX]{1,4} [A-Z][A-Za-z]{0,4} [0-9]{1,5}/[0-9]{2,4}\b", needs="Az"),
    Rule("pl-sygnatura", "case number", r"(?i:sygn)\. ?(?i:akt):? [IVXLC]{1,5} [A-Z][A-Za-z]{0,4} [0-9]{1,5}/[0-9]{2}\b"),
    Rule("secret", "secret", r"(?i:\b(?:token|password|api[_-]?key|secret))\s{0,2}[=:]\s{0,2}[\"']?[0-9A-Za-z_\-/+]{12,128}[\"']?", digit=False, clue=r"[=:]\s{0,2}[\"']?[0-9A-Za-z_\-/+]{12}"),
]
# All rules of digits alone are short: at most 72 code points of a match and its edges are away from a digit (bech32).
RULES = [replace(r, near=True) if r.digit and not r.needs else r for r in RULES]

BY_ID = {r.rule_id: r for r in RULES}


def near_digits(text: Column) -> Column:
    """A text without what is further than NEAR from a digit, its start or its end: mostly far shorter."""
    return F.regexp_replace(text, f"(?<![^0-9])([^0-9]{{{NEAR}}})[^0-9]+([^0-9]{{{NEAR}}})", "$1\u0001$2")


def matches(column: str, rule: Rule, digits: str | None = None) -> Column:
    """Spans of one rule with the number k of the match before it is validated: scan, cut the cue, validate, check the length.

    digits: a column with near_digits() of the text. Rules with `near` try that first.
    """
    text = F.col(column)
    needs = (rule.needs,) if isinstance(rule.needs, str) else rule.needs
    when = reduce(or_, [F.contains(text, F.lit(n)) for n in needs]) if needs else text.rlike("[0-9]") if rule.digit else None
    if rule.near and digits:
        when = F.col(digits).rlike(rule.pattern)
    if rule.clue:
        when = text.rlike(rule.clue) if when is None else when & text.rlike(rule.clue)
    number = lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), i.cast("int").alias("k"))
    found = F.transform(S.spans(column, rule.pattern, when), number)
    if rule.cue:

        def value(s: Column) -> Column:
            cut = F.regexp_replace(s["value"], rule.cue, "")
            return F.struct((s["end"] - F.length(cut)).alias("start"), s["end"].alias("end"), cut.alias("value"), s["k"].alias("k"))

        found = F.transform(found, value)
    if rule.validator:
        found = F.filter(found, lambda s: F.coalesce(VALIDATORS[rule.validator](s["value"]), F.lit(False)))
    if rule.min_length:
        found = F.filter(found, lambda s: F.length(s["value"]) >= rule.min_length)
    return found


_BUILT: dict[tuple[int, Rule], Column] = {}


def found_by(rule: Rule) -> Column:
    """matches() in the columns _t and _d. An expression of a rule is large, so it is built once for a JVM and shared by all plans."""
    key = (id(SparkContext._gateway), rule)
    if key not in _BUILT:
        _BUILT[key] = matches("_t", rule, "_d")
    return _BUILT[key]


def spread(docs: DataFrame) -> DataFrame:
    """docs over all cores, if their scan has fewer partitions than there are cores (small inputs)."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs if docs.isStreaming or docs.rdd.getNumPartitions() >= cores else docs.repartition(cores)


def numbered(found: Column, rule: Rule, place: int) -> Column:
    """Matches of the rule at a place of the catalogue, with what entities carry."""
    seq = lambda k: (F.lit(place * (1 << 20)).cast("long") + k).alias("seq")
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(rule.label).alias("label"), F.lit(rule.score).alias("score"), F.lit(rule.rule_id).alias("rule_id"), seq(s["k"])))


#: Rules that one projection scans; its code is bounded.
GROUP = 8
FOUND = "array<struct<start:int,end:int,label:string,score:double,rule_id:string,seq:bigint>>"


def detect_arrays(docs: DataFrame, rules: list[Rule] | None = None, labels: list[str] | None = None, text: str = "text", out: str = "entities") -> DataFrame:
    """docs with an array of entities (start, end, label, text, score, source, rule_id, seq), in one pass over the texts.

    Rules of labels that aren't wanted are never scanned. seq keeps the order of rules and matches.
    """
    chosen = [r for r in (rules if rules is not None else RULES) if not labels or r.label in labels]
    rows = docs.withColumns({"_t": S.normalize_search(F.col(text)), "_found": F.array().cast(FOUND)}).withColumn("_d", near_digits(F.col("_t")))
    for lo in range(0, len(chosen), GROUP):
        part = [numbered(found_by(r), r, lo + n) for n, r in enumerate(chosen[lo : lo + GROUP])]
        rows = rows.withColumn("_found", F.concat("_found", *part).cast(FOUND))
    cut = lambda e: F.substring(F.col(text), e["start"] + 1, e["end"] - e["start"])
    entity = lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["label"].alias("label"), cut(e).alias("text"), e["score"].alias("score"), F.lit("regex").alias("source"), e["rule_id"].alias("rule_id"), e["seq"].alias("seq"))
    return S.computed(rows, **{out: F.transform("_found", entity)}).drop("_t", "_d", "_found")


def detect(docs: DataFrame, rules: list[Rule] | None = None, labels: list[str] | None = None, id_col: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, start, end, label, text, score, source, rule_id, seq, one row an entity; `keep` names columns of docs that go with it."""
    rows = detect_arrays(spread(docs.select(id_col, text, *keep)), rules, labels, text=text, out="_entities")
    return rows.select(id_col, *keep, F.explode("_entities").alias("_e")).select(id_col, "_e.*", *keep)
