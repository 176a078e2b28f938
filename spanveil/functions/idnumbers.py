"""Checksums of national tax, company and identity numbers as column expressions, from public specifications.

Each takes the number as written; separators, and a country prefix where one is usual, don't matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .validators import VALIDATORS, alnum, cz_birth, digit, digits, es_dni, fr_siren, mod11_10, no_orgnr, se_pnr, weighted


def _body(v: Column, prefix: str) -> Column:
    """The number without separators and its country prefix."""
    return F.regexp_replace(alnum(v), f"^{prefix}", "")


def _letter(alphabet: str, at: Column) -> Column:
    return F.substring(F.lit(alphabet), (at + 1).cast("int"), F.lit(1))


def _number(v: Column) -> Column:
    return v.try_cast("long")


def _date(day: Column, month: Column, year: Column) -> Column:
    return F.try_to_timestamp(F.concat(year, month, day), F.lit("yyyyMMdd")).isNotNull()


def _luhn_sum(v: Column, n: int, first_doubled: int) -> Column:
    """Sum of n digits where each second one, from `first_doubled` (1 or 2) on, is doubled and its digits added."""
    total = F.lit(0)
    for i in range(1, n + 1):
        d = digit(v, i)
        total = total + (F.when(d > 4, d * 2 - 9).otherwise(d * 2) if i % 2 == first_doubled % 2 else d)
    return total


def _two_tries(d: Column, first: list[int], second: list[int]) -> Column:
    """Remainder by 11 with the first weights, with the second ones if that is 10, and 0 if it is 10 again."""
    one, two = weighted(d, first) % 11, weighted(d, second) % 11
    return F.when(one < 10, one).otherwise(two % 10)


def au_acn(v: Column) -> Column:
    d = digits(v)
    return (F.length(d) == 9) & ((10 - weighted(d, [8, 7, 6, 5, 4, 3, 2, 1]) % 10) % 10 == digit(d, 9))


def at_business(v: Column) -> Column:
    return alnum(v).rlike("^(FN)?[0-9]{1,6}[A-Z]$")


def at_tin(v: Column) -> Column:
    d = digits(v)
    return (F.length(d) == 9) & ((10 - _luhn_sum(d, 8, 2) % 10) % 10 == digit(d, 9))


def at_uid(v: Column) -> Column:
    d = F.regexp_replace(_body(v, "AT"), "^U", "")
    return d.rlike("^[0-9]{8}$") & ((16 - _luhn_sum(d, 7, 2) % 10) % 10 == digit(d, 8))


def be_vat(v: Column) -> Column:
    d = F.lpad(_body(v, "BE"), 10, "0")
    return F.length(_body(v, "BE")).between(9, 10) & d.rlike("^[01][0-9]{9}$") & ((_number(F.substring(d, 1, 8)) + _number(F.substring(d, 9, 2))) % 97 == 0)


def bg_vat(v: Column) -> Column:
    d = _body(v, "BG")
    legal = _two_tries(d, [1, 2, 3, 4, 5, 6, 7, 8], [3, 4, 5, 6, 7, 8, 9, 10]) == digit(d, 9)
    other = (11 - weighted(d, [4, 3, 2, 7, 6, 5, 4, 3, 2]) % 11) % 11 == digit(d, 10)
    person = weighted(d, [2, 4, 8, 5, 10, 9, 7, 3, 6]) % 11 % 10 == digit(d, 10)
    return (d.rlike("^[0-9]{9}$") & legal) | (d.rlike("^[0-9]{10}$") & (other | person))


def cy_vat(v: Column) -> Column:
    a = _body(v, "CY")
    odd = F.create_map(*[F.lit(x) for pair in zip("0123456789", (1, 0, 5, 7, 9, 13, 15, 17, 19, 21), strict=True) for x in pair])
    total = F.lit(0)
    for i in range(1, 9):
        total = total + (odd[F.substring(a, i, 1)] if i % 2 else digit(a, i))
    return a.rlike("^(?!12)[0-9]{8}[A-Z]$") & (_letter("ABCDEFGHIJKLMNOPQRSTUVWXYZ", total % 26) == F.substring(a, 9, 1))


def cz_dic(v: Column) -> Column:
    d = _body(v, "CZ")
    company = (11 - weighted(d, [8, 7, 6, 5, 4, 3, 2]) % 11) % 10 == digit(d, 8)
    special = (8 - (10 - weighted(F.substring(d, 2, 8), [8, 7, 6, 5, 4, 3, 2]) % 11) % 11) % 10 == digit(d, 9)
    return (d.rlike("^[0-8][0-9]{7}$") & company) | (d.rlike("^6[0-9]{8}$") & special) | (d.rlike("^[0-9]{9,10}$") & cz_birth(d))


def de_stnr(v: Column) -> Column:
    """A regional number of 10 or 11 digits, or the federal form of 13 with a 0 after the office."""
    return digits(v).rlike("^(?:[0-9]{10,11}|[1-9][0-9]{3}0[0-9]{8})$")


def de_svnr(v: Column) -> Column:
    a = alnum(v)
    letter = F.lpad((F.ascii(F.substring(a, 9, 1)) - 64).cast("string"), 2, "0")
    d = F.concat(F.substring(a, 1, 8), letter, F.substring(a, 10, 2))
    total = F.lit(0)
    for i, w in enumerate([2, 1, 2, 5, 7, 1, 2, 1, 2, 1, 2, 1], 1):
        product = digit(d, i) * w
        total = total + F.floor(product / 10) + product % 10
    return a.rlike("^[0-9]{8}[A-Z][0-9]{3}$") & (total % 10 == digit(a, 12))


def de_vat(v: Column) -> Column:
    d = _body(v, "DE")
    return d.rlike("^[1-9][0-9]{8}$") & mod11_10(d, 9)


def dk_cpr(v: Column) -> Column:
    """A birth date and four digits; their checksum isn't required since 2007."""
    d = digits(v)
    century = F.when(digit(d, 7) <= 3, "19").when((digit(d, 7).isin(4, 9)) & (F.substring(d, 5, 2).try_cast("int") > 36), "19").when(digit(d, 7).between(5, 8) & (F.substring(d, 5, 2).try_cast("int") > 57), "18").otherwise("20")
    return (F.length(d) == 10) & _date(F.substring(d, 1, 2), F.substring(d, 3, 2), F.concat(century, F.substring(d, 5, 2)))


def dk_vat(v: Column) -> Column:
    d = _body(v, "DK")
    return d.rlike("^[1-9][0-9]{7}$") & (weighted(d, [2, 7, 6, 5, 4, 3, 2, 1]) % 11 == 0)


def baltic_person(v: Column) -> Column:
    """Estonian and Lithuanian personal codes: sex and century, date, serial, check digit by two series of weights."""
    d = digits(v)
    dated = _date(F.substring(d, 6, 2), F.substring(d, 4, 2), F.concat((F.floor((digit(d, 1) + 1) / 2) + 17).cast("string"), F.substring(d, 2, 2)))
    return d.rlike("^[1-8][0-9]{10}$") & dated & (_two_tries(d, [1, 2, 3, 4, 5, 6, 7, 8, 9, 1], [3, 4, 5, 6, 7, 8, 9, 1, 2, 3]) == digit(d, 11))


def ee_vat(v: Column) -> Column:
    d = _body(v, "EE")
    return d.rlike("^[0-9]{9}$") & (weighted(d, [3, 7, 1, 3, 7, 1, 3, 7, 1]) % 10 == 0)


def es_cif(v: Column) -> Column:
    a = _body(v, "ES")
    check = (10 - _luhn_sum(F.substring(a, 2, 7), 7, 1) % 10) % 10
    last = F.substring(a, 9, 1)
    by_digit, by_letter = check.cast("string") == last, _letter("JABCDEFGHI", check) == last
    kind = F.substring(a, 1, 1)
    return a.rlike("^[ABCDEFGHJNPQRSUVW][0-9]{7}[0-9A-J]$") & F.when(kind.isin("A", "B", "E", "H"), by_digit).when(kind.isin("N", "P", "Q", "R", "S", "W"), by_letter).otherwise(by_digit | by_letter)


def es_nie(v: Column) -> Column:
    return alnum(v).rlike("^[XYZ][0-9]{7}[A-Z]$") & es_dni(v)


def es_only_dni(v: Column) -> Column:
    return alnum(v).rlike("^[0-9]") & es_dni(v)


def es_nss(v: Column) -> Column:
    d = digits(v)
    province, serial = F.substring(d, 1, 2).try_cast("long"), F.substring(d, 3, 8).try_cast("long")
    number = F.when(serial < 10_000_000, province * 10_000_000 + serial).otherwise(F.substring(d, 1, 10).try_cast("long"))
    return (F.length(d) == 12) & (number % 97 == F.substring(d, 11, 2).try_cast("long"))


def es_vat(v: Column) -> Column:
    return es_dni(_body(v, "ES")) | es_cif(v)


def fi_hetu(v: Column) -> Column:
    a = F.upper(F.trim(v))
    sign = F.substring(a, 7, 1)
    century = F.when(sign == "+", "18").when(sign.rlike("[-U-Y]"), "19").otherwise("20")
    dated = _date(F.substring(a, 1, 2), F.substring(a, 3, 2), F.concat(century, F.substring(a, 5, 2)))
    value = F.concat(F.substring(a, 1, 6), F.substring(a, 8, 3)).try_cast("long")
    return a.rlike("^[0-9]{6}[-+A-FU-Y][0-9]{3}[0-9A-Y]$") & dated & (_letter("0123456789ABCDEFHJKLMNPRSTUVWXY", value % 31) == F.substring(a, 11, 1))


def fi_business(v: Column) -> Column:
    d = F.lpad(_body(v, "FI"), 8, "0")
    return F.length(_body(v, "FI")).between(7, 8) & d.rlike("^[0-9]{8}$") & (weighted(d, [7, 9, 10, 5, 8, 4, 2, 1]) % 11 == 0)


def fr_tva(v: Column) -> Column:
    a = _body(v, "FR")
    siren = F.substring(a, 3, 9)
    key = F.concat(siren, F.lit("12")).try_cast("long") % 97
    return a.rlike("^[0-9A-HJ-NP-Z]{2}[0-9]{9}$") & fr_siren(siren) & (~a.rlike("^[0-9]{2}") | (key == F.substring(a, 1, 2).try_cast("long")))


def gb_vat(v: Column) -> Column:
    d = _body(v, "GB")
    return d.rlike("^[0-9]{9}(?:[0-9]{3})?$") & (weighted(d, [8, 7, 6, 5, 4, 3, 2, 10, 1]) % 97).isin(0, 42)


def gr_vat(v: Column) -> Column:
    d = F.lpad(_body(v, "(?:EL|GR)"), 9, "0")
    return F.length(_body(v, "(?:EL|GR)")).between(8, 9) & d.rlike("^[0-9]{9}$") & (weighted(d, [256, 128, 64, 32, 16, 8, 4, 2]) % 11 % 10 == digit(d, 9))


def hr_vat(v: Column) -> Column:
    d = _body(v, "HR")
    return d.rlike("^[0-9]{11}$") & mod11_10(d, 11)


def hu_vat(v: Column) -> Column:
    d = _body(v, "HU")
    return d.rlike("^[0-9]{8}$") & (weighted(d, [9, 7, 3, 1, 9, 7, 3, 1]) % 10 == 0)


def ie_pps(v: Column) -> Column:
    a = _body(v, "IE")
    second = F.substring(a, 9, 1)
    extra = F.when(second.rlike("[A-IW]"), F.when(second == "W", 0).otherwise(F.ascii(second) - 64) * 9).otherwise(0)
    return a.rlike("^[0-9]{7}[A-W][A-IWTX]?$") & (_letter("WABCDEFGHIJKLMNOPQRSTUV", (weighted(a, [8, 7, 6, 5, 4, 3, 2]) + extra) % 23) == F.substring(a, 8, 1))


def ie_vat(v: Column) -> Column:
    """The present form, or the old one with a letter, + or * in the second place."""
    a = F.regexp_replace(F.upper(F.regexp_replace(v, r"[\s.-]", "")), "^IE", "")
    old = F.concat(F.lit("0"), F.substring(a, 3, 5), F.substring(a, 1, 1), F.substring(a, 8, 1))
    return ie_pps(a) | (a.rlike("^[0-9][A-Z+*][0-9]{5}[A-W]$") & ie_pps(old))


def it_fiscal(v: Column) -> Column:
    """Letters and digits in odd places count by a table of their own, in even places by their value; the sum names the last letter."""
    a = alnum(v)
    # The table for odd places, for 0-9 and A-Z.
    odd = [1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23]
    table = F.create_map(*[F.lit(x) for pair in zip("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", odd, strict=True) for x in pair])
    total = F.lit(0)
    for i in range(1, 16):
        c = F.substring(a, i, 1)
        total = total + (table[c] if i % 2 else F.when(c.between("0", "9"), c.try_cast("int")).otherwise(F.ascii(c) - 65))
    return a.rlike("^[A-Z]{6}[0-9L-NP-V]{2}[ABCDEHLMPRST][0-9L-NP-V]{2}[A-Z][0-9L-NP-V]{3}[A-Z]$") & (_letter("ABCDEFGHIJKLMNOPQRSTUVWXYZ", total % 26) == F.substring(a, 16, 1))


def lt_vat(v: Column) -> Column:
    d = _body(v, "LT")
    nine = _two_tries(d, [1, 2, 3, 4, 5, 6, 7, 8], [3, 4, 5, 6, 7, 8, 9, 1]) == digit(d, 9)
    twelve = _two_tries(d, [1, 2, 3, 4, 5, 6, 7, 8, 9, 1, 2], [3, 4, 5, 6, 7, 8, 9, 1, 2, 3, 4]) == digit(d, 12)
    return (d.rlike("^[0-9]{7}1[0-9]$") & nine) | (d.rlike("^[0-9]{10}1[0-9]$") & twelve)


def lu_vat(v: Column) -> Column:
    d = _body(v, "LU")
    return d.rlike("^[0-9]{8}$") & (_number(F.substring(d, 1, 6)) % 89 == _number(F.substring(d, 7, 2)))


def lv_vat(v: Column) -> Column:
    d = _body(v, "LV")
    company = weighted(d, [9, 1, 4, 8, 3, 10, 2, 5, 7, 6, 1]) % 11 == 3
    person = (1 + weighted(d, [10, 5, 8, 4, 2, 1, 6, 3, 7, 9])) % 11 % 10 == digit(d, 11)
    return d.rlike("^[0-9]{11}$") & F.when(digit(d, 1) > 3, company).otherwise(person | d.startswith("32"))


def mt_vat(v: Column) -> Column:
    d = _body(v, "MT")
    return d.rlike("^[1-9][0-9]{7}$") & (weighted(d, [3, 4, 6, 7, 8, 9, 10, 1]) % 37 == 0)


def nl_vat(v: Column) -> Column:
    """By the number of the owner, or since 2020 by the remainder by 97 of the whole with its prefix."""
    a = _body(v, "NL")
    old = (weighted(a, [9, 8, 7, 6, 5, 4, 3, 2]) - digit(a, 9)) % 11 == 0
    new = F.concat(F.lit("2321"), F.substring(a, 1, 9), F.lit("11"), F.substring(a, 11, 2)).cast("decimal(38,0)") % 97 == 1
    return a.rlike("^[0-9]{9}B[0-9]{2}$") & (old | F.when(a.rlike("^[0-9]{9}B[0-9]{2}$"), new).otherwise(False))


def no_mva(v: Column) -> Column:
    a = _body(v, "NO")
    return a.rlike("^[0-9]{9}MVA$") & no_orgnr(a)


def pt_cc(v: Column) -> Column:
    a = alnum(v)
    total = F.lit(0)
    for i in range(1, 13):
        c = F.substring(a, i, 1)
        value = F.when(c.between("0", "9"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
        total = total + (F.when(value * 2 > 9, value * 2 - 9).otherwise(value * 2) if i % 2 else value)
    return a.rlike("^[0-9]{9}[0-9A-Z]{2}[0-9]$") & (total % 10 == 0)


def pt_vat(v: Column) -> Column:
    d = _body(v, "PT")
    return d.rlike("^[1-9][0-9]{8}$") & ((11 - weighted(d, [9, 8, 7, 6, 5, 4, 3, 2]) % 11) % 11 % 10 == digit(d, 9))


def ro_vat(v: Column) -> Column:
    d = _body(v, "RO")
    padded = F.lpad(d, 10, "0")
    return d.rlike("^[1-9][0-9]{1,9}$") & (weighted(padded, [7, 5, 3, 2, 1, 7, 5, 3, 2]) * 10 % 11 % 10 == digit(padded, 10))


def si_vat(v: Column) -> Column:
    d = _body(v, "SI")
    check = 11 - weighted(d, [8, 7, 6, 5, 4, 3, 2]) % 11
    return d.rlike("^[1-9][0-9]{7}$") & (check != 11) & (check % 10 == digit(d, 8))


def sk_dic(v: Column) -> Column:
    d = _body(v, "SK")
    return d.rlike("^[1-9][0-9][2-47-9][0-9]{7}$") & (_number(d) % 11 == 0)


def eu_vat(v: Column) -> Column:
    """A number with the prefix of its country."""
    country = F.substring(F.upper(F.trim(v)), 1, 2)
    out = F.lit(False)
    for prefix, check in (
        ("AT", at_uid), ("BE", be_vat), ("BG", bg_vat), ("CY", cy_vat), ("CZ", cz_dic), ("DE", de_vat), ("DK", dk_vat), ("EE", ee_vat), ("EL", gr_vat), ("ES", es_vat), ("FI", fi_business), ("FR", fr_tva), ("GB", gb_vat),
        ("HR", hr_vat), ("HU", hu_vat), ("IE", ie_vat), ("LT", lt_vat), ("LU", lu_vat), ("LV", lv_vat), ("MT", mt_vat), ("NL", nl_vat), ("PT", pt_vat), ("RO", ro_vat), ("SI", si_vat), ("SK", sk_dic),
    ):
        out = F.when(country == prefix, check(v)).otherwise(out)
    return out


MORE: dict[str, Callable[[Column], Column]] = {
    "au.acn": au_acn, "at.businessid": at_business, "at.tin": at_tin, "at.uid": at_uid, "be.vat": be_vat, "bg.vat": bg_vat, "cy.vat": cy_vat, "cz.dic": cz_dic, "cz.rc": cz_birth,
    "de.stnr": de_stnr, "de.svnr": de_svnr, "de.vat": de_vat, "dk.cpr": dk_cpr, "dk.vat": dk_vat, "ee.ik": baltic_person, "ee.vat": ee_vat, "es.cif": es_cif, "es.dni": es_only_dni,
    "es.nie": es_nie, "es.nss": es_nss, "es.vat": es_vat, "fi.hetu": fi_hetu, "fi.vat": fi_business, "fi.ytunnus": fi_business, "fr.tva": fr_tva, "gb.nhs": VALIDATORS["uk.nhs"],
    "gb.nino": VALIDATORS["uk.nino"], "gb.vat": gb_vat, "gr.vat": gr_vat, "hr.vat": hr_vat, "hu.vat": hu_vat, "ie.pps": ie_pps, "ie.vat": ie_vat, "it.codiceFiscale": it_fiscal,
    "lt.asmens": baltic_person, "lt.vat": lt_vat, "lu.vat": lu_vat, "lv.vat": lv_vat, "mt.vat": mt_vat, "nl.vat": nl_vat, "no.mva": no_mva, "pt.cc": pt_cc, "pt.vat": pt_vat,
    "ro.vat": ro_vat, "se.personnummer": se_pnr, "si.vat": si_vat, "sk.dic": sk_dic, "eu.vat": eu_vat,
}
#: All validators by name.
ALL = VALIDATORS | MORE
