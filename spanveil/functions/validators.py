"""Checksums and shapes of identifiers as column expressions, from public specifications."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(v: Column) -> Column:
    return F.regexp_replace(v, r"[^0-9]", "")


def alnum(v: Column) -> Column:
    return F.upper(F.regexp_replace(v, r"[^0-9A-Za-z]", ""))


def digit(v: Column, i: int) -> Column:
    return F.substring(v, i, 1).try_cast("int")


def luhn_digits(d: Column) -> Column:
    return F.call_function("luhn_check", d)


def weighted(v: Column, weights: list[int]) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights, 1):
        total = total + digit(v, i) * w
    return total


def luhn(v: Column) -> Column:
    d = digits(v)
    return F.length(d).between(8, 19) & luhn_digits(d)


def card(v: Column) -> Column:
    d = digits(v)
    return F.length(d).between(13, 19) & luhn_digits(d)


def mod97(text: Column) -> Column:
    """Remainder of an alphanumeric string (A=10 .. Z=35) by 97."""
    return F.aggregate(
        F.split(text, ""),
        F.lit(0),
        lambda acc, c: F.when(c == "", acc)
        .when(c.between("0", "9"), (acc * 10 + c.try_cast("int")) % 97)
        .otherwise((acc * 100 + F.ascii(c) - 55) % 97),
    )


def iban(v: Column) -> Column:
    a = alnum(v)
    return a.rlike("^[A-Z]{2}[0-9]{2}[0-9A-Z]{11,30}$") & (mod97(F.concat(F.substring(a, 5, 64), F.substring(a, 1, 4))) == 1)


def mod11_10(d: Column, n: int) -> Column:
    """ISO 7064 MOD 11,10 over n digits, the last one the check digit."""
    p = F.aggregate(
        F.split(F.substring(d, 1, n - 1), ""),
        F.lit(10),
        lambda acc, c: F.when(c == "", acc).otherwise((F.when((acc + c.try_cast("int")) % 10 == 0, 10).otherwise((acc + c.try_cast("int")) % 10) * 2) % 11),
    )
    return (F.lit(11) - p) % 10 == digit(d, n)


def de_idnr(v: Column) -> Column:
    d = digits(v)
    return (F.length(d) == 11) & (digit(d, 1) != 0) & mod11_10(d, 11)


def nhs(v: Column) -> Column:
    d = digits(v)
    check = (11 - weighted(d, [10, 9, 8, 7, 6, 5, 4, 3, 2]) % 11) % 11
    return (F.length(d) == 10) & (check != 10) & (check == digit(d, 10))


def cn_ric(v: Column) -> Column:
    a = alnum(v)
    total = weighted(a, [7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2])
    date = F.try_to_timestamp(F.substring(a, 7, 8), F.lit("yyyyMMdd")).isNotNull()
    return a.rlike("^[0-9]{17}[0-9X]$") & date & (F.substring(F.lit("10X98765432"), (total % 11 + 1).cast("int"), F.lit(1)) == F.substring(a, 18, 1))


def au_abn(v: Column) -> Column:
    d = digits(v)
    return (F.length(d) == 11) & ((weighted(d, [10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19]) - 10) % 89 == 0)


def ch_uid(v: Column) -> Column:
    d = digits(v)
    check = (11 - weighted(d, [5, 4, 3, 2, 7, 6, 5, 4]) % 11) % 11
    return (F.length(d) == 9) & (check != 10) & (check == digit(d, 9))


def no_orgnr(v: Column) -> Column:
    d = digits(v)
    check = (11 - weighted(d, [3, 2, 7, 6, 5, 4, 3, 2]) % 11) % 11
    return (F.length(d) == 9) & (check != 10) & (check == digit(d, 9))


def us_rtn(v: Column) -> Column:
    d = digits(v)
    return (F.length(d) == 9) & (d != "000000000") & (weighted(d, [3, 7, 1, 3, 7, 1, 3, 7, 1]) % 10 == 0)


def us_ssn(v: Column) -> Column:
    d = digits(v)
    return (F.length(d) == 9) & ~d.rlike("^(000|666|9)") & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000")


def us_ein(v: Column) -> Column:
    return digits(v).rlike("^(0[1-6]|1[0-6]|2[0-7]|3[0-9]|4[0-8]|5[0-9]|6[0-8]|7[1-7]|8[0-8]|9[0-5]|98|99)[0-9]{7}$")


def uk_nino(v: Column) -> Column:
    a = alnum(v)
    return a.rlike("^[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z][0-9]{6}[A-D]$") & ~a.rlike("^(BG|GB|KN|NK|NT|TN|ZZ)")


def uk_utr(v: Column) -> Column:
    d = digits(v)
    return (F.length(d) == 10) & (F.substring(F.lit("21987654321"), (weighted(F.substring(d, 2, 9), [6, 7, 8, 9, 10, 5, 4, 3, 2]) % 11 + 1).cast("int"), F.lit(1)) == F.substring(d, 1, 1))


def cz_ico(v: Column) -> Column:
    d = F.lpad(digits(v), 8, "0")
    return (F.length(digits(v)).between(7, 8)) & ((11 - weighted(d, [8, 7, 6, 5, 4, 3, 2]) % 11) % 10 == digit(d, 8))


def cz_birth(v: Column) -> Column:
    """Czech and Slovak birth number: 9 digits before 1954, 10 digits divisible by 11 since."""
    d = digits(v)
    month = F.substring(d, 3, 2).try_cast("int")
    real = F.when(month > 70, month - 70).when(month > 50, month - 50).when(month > 20, month - 20).otherwise(month)
    day = F.substring(d, 5, 2).try_cast("int")
    return real.between(1, 12) & day.between(1, 31) & (((F.length(d) == 9) & ~F.substring(d, 1, 2).try_cast("int").between(54, 79)) | ((F.length(d) == 10) & (d.try_cast("long") % 11 == 0)))


def pl_pesel(v: Column) -> Column:
    d = digits(v)
    return (F.length(d) == 11) & ((10 - weighted(d, [1, 3, 7, 9, 1, 3, 7, 9, 1, 3]) % 10) % 10 == digit(d, 11))


def pl_nip(v: Column) -> Column:
    d = digits(v)
    return (F.length(d) == 10) & (weighted(d, [6, 5, 7, 2, 3, 4, 5, 6, 7]) % 11 == digit(d, 10))


def es_dni(v: Column) -> Column:
    a = F.regexp_replace(F.regexp_replace(F.regexp_replace(alnum(v), "^X", "0"), "^Y", "1"), "^Z", "2")
    n = F.substring(a, 1, 8).try_cast("int")
    return a.rlike("^[0-9]{8}[A-Z]$") & (F.substring(F.lit("TRWAGMYFPDXBNJZSQVHLCKE"), (n % 23 + 1).cast("int"), F.lit(1)) == F.substring(a, 9, 1))


def fr_siren(v: Column) -> Column:
    return (F.length(digits(v)) == 9) & luhn_digits(digits(v))


def fr_siret(v: Column) -> Column:
    return (F.length(digits(v)) == 14) & luhn_digits(digits(v))


def fr_nir(v: Column) -> Column:
    a = F.regexp_replace(F.regexp_replace(alnum(v), "2A", "19"), "2B", "18")
    return a.rlike("^[12][0-9]{14}$") & (F.lit(97) - F.substring(a, 1, 13).try_cast("long") % 97 == F.substring(a, 14, 2).try_cast("int"))


def it_iva(v: Column) -> Column:
    return (F.length(digits(v)) == 11) & luhn_digits(digits(v))


def nl_bsn(v: Column) -> Column:
    d = digits(v)
    return (F.length(d) == 9) & ((weighted(d, [9, 8, 7, 6, 5, 4, 3, 2]) - digit(d, 9)) % 11 == 0)


def be_nn(v: Column) -> Column:
    d = digits(v)
    body, check = F.substring(d, 1, 9), F.substring(d, 10, 2).try_cast("int")
    return (F.length(d) == 11) & ((97 - body.try_cast("long") % 97 == check) | (97 - F.concat(F.lit("2"), body).try_cast("long") % 97 == check))


def br_cpf(v: Column) -> Column:
    d = digits(v)
    one = (weighted(d, list(range(10, 1, -1))) * 10 % 11) % 10
    two = (weighted(d, list(range(11, 1, -1))) * 10 % 11) % 10
    return (F.length(d) == 11) & ~d.rlike(r"^(\d)\1{10}$") & (one == digit(d, 10)) & (two == digit(d, 11))


def br_cnpj(v: Column) -> Column:
    d = digits(v)
    one = weighted(d, [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]) % 11
    two = weighted(d, [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]) % 11
    return (F.length(d) == 14) & (F.when(one < 2, 0).otherwise(11 - one) == digit(d, 13)) & (F.when(two < 2, 0).otherwise(11 - two) == digit(d, 14))


def ro_cnp(v: Column) -> Column:
    d = digits(v)
    r = weighted(d, [2, 7, 9, 1, 4, 6, 3, 5, 8, 2, 7, 9]) % 11
    return (F.length(d) == 13) & (F.when(r == 10, 1).otherwise(r) == digit(d, 13))


def se_pnr(v: Column) -> Column:
    d = digits(v)
    last = F.when(F.length(d) == 12, F.substring(d, 3, 10)).otherwise(d)
    return (F.length(last) == 10) & luhn_digits(last)


def ipv4(v: Column) -> Column:
    return F.forall(F.split(v, r"\."), lambda p: p.try_cast("int").between(0, 255))


def phone_international(v: Column) -> Column:
    """+ or 00, then 8 to 15 digits without a leading 0; numbers of country 1 by the rules of NANP."""
    d = F.regexp_replace(digits(v), "^00", "")
    balanced = F.length(F.regexp_replace(v, r"[^(]", "")) == F.length(F.regexp_replace(v, r"[^)]", ""))
    return F.length(d).between(8, 15) & ~d.startswith("0") & balanced & (~d.startswith("1") | phone_nanp(F.substring(d, 2, 15)))


def phone_nanp(v: Column) -> Column:
    d = F.regexp_replace(digits(v), "^1(?=[0-9]{10}$)", "")
    return d.rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$") & ~F.substring(d, 2, 2).isin("11") & ~F.substring(d, 5, 2).isin("11")


def phone_german(v: Column) -> Column:
    return F.length(digits(v)).between(8, 15)


def crypto_wallet(v: Column) -> Column:
    """Shapes of Ethereum, bech32 (one case) and base58 addresses; base58 checksums need bytes and aren't taken here."""
    return v.rlike("^0x[0-9a-fA-F]{40}$") | (v.rlike("^(?i)bc1[02-9ac-hj-np-z]{11,71}$") & ((v == F.lower(v)) | (v == F.upper(v)))) | v.rlike("^[13][1-9A-HJ-NP-Za-km-z]{25,34}$")


def mrz_check(field: Column) -> Column:
    """ICAO 9303 check digit of a field: weights 7, 3, 1; digits, A=10 .. Z=35, < = 0."""
    value = lambda c: F.when(c == "<", 0).when(c.between("0", "9"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
    weight = lambda i: F.when(i % 3 == 0, 7).when(i % 3 == 1, 3).otherwise(1)
    return F.aggregate(F.transform(F.filter(F.split(field, ""), lambda c: c != ""), lambda c, i: value(c) * weight(i)), F.lit(0), lambda a, x: a + x) % 10


VALIDATORS: dict[str, Callable[[Column], Column]] = {
    "luhn": luhn, "card": card, "iban": iban, "de.idnr": de_idnr, "uk.nhs": nhs, "cn.ric": cn_ric, "au.abn": au_abn, "ch.uid": ch_uid, "no.orgnr": no_orgnr, "us.rtn": us_rtn,
    "us.ssn": us_ssn, "us.ein": us_ein, "uk.nino": uk_nino, "uk.utr": uk_utr, "cz.ico": cz_ico, "cz.birth": cz_birth, "pl.pesel": pl_pesel, "pl.nip": pl_nip, "es.dni": es_dni,
    "fr.siren": fr_siren, "fr.siret": fr_siret, "fr.nir": fr_nir, "it.iva": it_iva, "nl.bsn": nl_bsn, "be.nn": be_nn, "br.cpf": br_cpf, "br.cnpj": br_cnpj, "ro.cnp": ro_cnp, "se.pnr": se_pnr,
    "ip.v4": ipv4, "phone.international": phone_international, "phone.nanp": phone_nanp, "phone.german": phone_german, "crypto.wallet": crypto_wallet,
}
