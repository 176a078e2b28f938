"""Word lists of the sequential detectors, our own, by language. Callers can pass others."""

from __future__ import annotations

MONTHS = {
    "en": "january february march april may june july august september october november december jan feb mar apr jun jul aug sep sept oct nov dec".split(),
    "de": "januar februar märz april mai juni juli august september oktober november dezember".split(),
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
    "it": "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre".split(),
    "cs": "ledna února března dubna května června července srpna září října listopadu prosince".split(),
    "pl": "stycznia lutego marca kwietnia maja czerwca lipca sierpnia września października listopada grudnia".split(),
}
#: Months that are words of their own in lower case.
AMBIGUOUS_MONTHS = {"may", "march", "mar", "jan", "mars", "mai", "dec", "sep"}
CURRENCY_CODES = "AUD BGN BRL CAD CHF CNY CZK DKK EUR GBP HKD HUF ILS INR JPY KRW MXN NOK NZD PLN RON SEK SGD THB TRY UAH USD ZAR".split()
CURRENCY_SYMBOLS = "$ € £ ¥ ₹ ₽ ₩ ₺ ₴ Kč zł".split()
CURRENCY_NAMES = "dollars dollar euros euro pounds sterling yen francs rupees korun koruna złotych forint".split()
MAGNITUDES = "thousand million billion trillion mio mrd tisíc milionů miliard tausend millionen milliarden millions milliards millones".split()
NUMBER_WORDS = "one two three four five six seven eight nine ten eleven twelve fifteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
LEGAL_FORMS = "Inc. Inc Incorporated LLC L.L.C. LLP LP Ltd. Ltd Limited Corp. Corp Corporation PLC plc Co. GmbH AG KG OHG UG SE e.V. S.A. SA SAS SARL S.à r.l. S.p.A. S.r.l. SRL B.V. BV N.V. A/S ApS AB AS Oy OÜ s.r.o. a.s. spol. sp. z o.o. Kft. Zrt. d.o.o.".replace("sp. z o.o.", "sp. z o.o.").replace("S.à r.l.", "S.à r.l.").split(" ")
LEGAL_FORMS = [f.replace(" ", " ") for f in LEGAL_FORMS]
CONNECTORS = "and of the & de la du von van der und für et y e do da del".split()
INSTITUTIONS = "Ministry Court University Bank Department Institute Agency Commission Council Office Ministerium Gericht Universität Tribunal Cour Université Ministerio Universidad".split()
TITLES = "Mr Mr. Mrs Mrs. Ms Ms. Dr Dr. Prof Prof. Sir Lady Lord Judge Justice Miss Herr Frau Monsieur Madame M. Mme Señor Señora Ing. Mgr. JUDr. MUDr. pan paní".split()
FIRST_NAMES = "Alice Anna Anne Carlos Charles Claire Daniel David Elena Emma Eva František George Hans Jan Jana Jean Johann John José Juan Julia Karel Laura Lucas Ludwig Maria Marie Martin Mary Michael Miguel Nicolas Paul Petr Peter Pierre Robert Sarah Sophie Thomas William".split()
SURNAMES = "Brown Davis Dupont Dvořák Evans Fischer García Johnson Jones López Martin Meyer Miller Moreau Müller Novák Nováková Roberts Schmidt Schneider Smith Svoboda Taylor Weber Williams Wilson".split()
PARTICLES = "von van de der den da di du del la le bin ibn al".split()
#: Nouns of documents that a capitalised line can hold but no person's name ends in.
PERSON_STOP = "appendix attachment bill chapter clause contract deed exhibit invoice letter memorandum notice page paragraph receipt report statute table title undersigned warranty agreement article section schedule annex court bank company party state".split()
#: Parties that documents name by what they do.
ROLES = "agent applicant assignee assignor auditor beneficiary buyer client company consultant contractor creditor customer debtor defendant distributor donor employee employer guarantor heir insured insurer issuer landlord lender lessee lessor licensee licensor owner parties party payee payer plaintiff principal provider purchaser seller shareholder subcontractor supplier tenant trustee arbeitgeber arbeitnehmer auftraggeber auftragnehmer käufer mieter vermieter verkäufer acheteur bailleur locataire vendeur arrendador comprador vendedor kupující nájemce objednatel prodávající zhotovitel".split()
STREETS = "Alley Ave. Avenue Blvd. Boulevard Close Court Crescent Drive Highway Lane Parkway Place Quay Rd. Road Row Square St. Street Terrace Way Allee Gasse Platz Ring Strasse Straße Ufer Weg avenue boulevard chemin impasse place quai route rue avenida calle camino carrera paseo plaza corso piazza strada via viale náměstí nábřeží třída ulice aleja plac ulica".split()
STREET_ENDINGS = ("straße", "strasse", "gasse", "allee", "platz", "weg")
CITIES = "Amsterdam Barcelona Berlin Bratislava Brno Brussels Chicago Dublin Frankfurt Geneva Hamburg Lisbon London Lyon Madrid Milano München Munich Paris Praha Prague Roma Vienna Warszawa Wien Zürich Boston Houston Seattle".split()
STATES = "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY".split()
COUNTRIES = "Austria Belgium Canada Czechia France Germany Ireland Italy Netherlands Poland Portugal Slovakia Spain Sweden Switzerland".split()
SURNAMES_HAN = "王 李 张 刘 陈 杨 黄 赵 吴 周 徐 孙 马 朱 胡 郭 何 林 高 罗".split()

#: Cue phrases, our own: (cues, label, strategy, parameters, validations). Strategies: comma, line, words, id, address, pattern.
TRIGGERS = [
    (["acting through", "in the person of", "on behalf of whom signs", "signing for it", "represented by", "im Namen handelnd", "vertreten von", "jednající", "za niž jedná", "agissant par", "représenté par", "en la persona de", "representado por"], "person", "comma", {"most": 80}, ["upper"]),
    (["born on", "was born", "birth date", "geboren am", "geb. am", "narozena dne", "narozen dne", "né le", "née le", "nacido el", "nacida el", "nato il", "nata il"], "date of birth", "words", {"n": 4}, ["digit"]),
    (["residing at", "resides at", "living at", "home address", "postal address", "wohnhaft in", "Anschrift", "trvale bytem", "bydliště", "demeurant", "domicilié", "con domicilio en", "residente in"], "address", "address", {"most": 120}, ["upper"]),
    (["registered under number", "registry number", "registration no.", "registration number", "company number", "HRB", "IČO", "SIREN", "KRS", "KvK"], "registration number", "id", {}, ["digit"]),
    (["VAT no.", "VAT number", "taxpayer number", "tax number", "tax id", "USt-IdNr.", "Steuernummer", "DIČ", "N° TVA", "NIF", "P.IVA"], "tax identification number", "id", {}, ["digit"]),
    (["passport no.", "passport number", "Reisepass Nr.", "Reisepassnummer", "číslo pasu", "numéro de passeport", "número de pasaporte"], "passport number", "id", {}, ["digit"]),
    (["account no.", "account number", "bank account", "Kontonummer", "Konto-Nr.", "číslo účtu", "numéro de compte", "número de cuenta"], "bank account number", "id", {}, ["digit"]),
    (["docket no.", "case no.", "case number", "file reference", "Aktenzeichen", "Geschäftszeichen", "sp. zn.", "n° de dossier"], "case number", "line", {"most": 40}, ["digit"]),
    (["call us:", "cell:", "fax:", "mobile:", "phone:", "tel.:", "telephone:", "Telefon:", "téléphone:", "teléfono:"], "phone number", "pattern", {"re": r"[+(]?[0-9][0-9 ()./-]{4,24}[0-9]"}, ["phone"]),
    (["date of birth:", "DOB:", "Geburtsdatum:", "datum narození:", "date de naissance:", "fecha de nacimiento:"], "date of birth", "line", {"most": 30}, ["digit"]),
]

#: Words that speak for a label near by, our own: (words, labels, score change, reach before, reach after, new label or None).
HOTWORDS = [
    (["mailbox", "write to", "inbox", "Postfach", "schránka", "courriel", "correo"], ["email address"], 0.1, 60, 60, None),
    (["dial", "ring", "hotline", "switchboard", "Rufnummer", "volejte", "appelez", "llame"], ["phone number"], 0.15, 60, 60, None),
    (["birthday", "birthplace", "Geburtstag", "narození", "naissance", "nacimiento"], ["date"], 0.15, 60, 60, "date of birth"),
    (["personal number", "Personenkennzahl", "rodné č.", "PESEL"], ["birth number"], 0.25, 60, 60, None),
    (["commercial register", "companies house", "Firmenbuch", "obchodní rejstřík", "registre du commerce", "registro mercantil"], ["registration number"], 0.2, 60, 60, None),
    (["revenue office", "taxpayer", "Finanzamt", "finanční úřad", "fisc", "hacienda"], ["tax identification number"], 0.2, 60, 60, None),
    (["payable to", "beneficiary account", "Überweisung", "bankovní spojení", "virement", "transferencia", "SWIFT"], ["bank account number", "iban"], 0.15, 60, 60, None),
    (["premises", "located at", "headquarters", "Niederlassung", "provozovna", "siège", "sede"], ["address"], 0.15, 80, 120, None),
    (["chairman", "managing partner", "notary", "Vorstand", "Prokurist", "statutární orgán", "gérant", "apoderado"], ["person"], 0.1, 60, 60, None),
]
