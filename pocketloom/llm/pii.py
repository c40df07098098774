"""Personal information in free text: anchors found by Aho-Corasick, expanded and validated by local parsers.

Cues, signs and listed words are anchors found in one pass; from each a parser expands to both sides as far as the case
goes, without a fixed reach. Names are found by a name list, titles, initials and cues first, and then by where two words
in capitals stand: what comes before and after, e-mail addresses of the same text, and lists that go on.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from pocketloom.llm.given_names import GIVEN_NAMES
from pocketloom.runtime import SPACE

# Further given names of English, German, French and Spanish speakers.
GIVEN = """
Adam Agnes Alan Alice Amara Amelia Andrew Anna Arthur Ben Carol Charlotte Chloe Daniel David Dennis Diane Edward Ella
Emily Emma Eric Eva Felix Fiona Frank George Grace Hannah Harry Helen Henry Hugo Ian Isabel Jack James Jane Jennifer
Joanna John Julia Karen Kate Kevin Laura Leila Linda Lucy Marcus Margaret Maria Mark Martin Mary Meera Michael Naomi
Nora Oliver Patrick Paul Peter Priya Rachel Richard Robert Rosa Ruth Samuel Sarah Simon Sophie Susan Tessa Thomas
Victor Walter Wendy William Yusuf Anja Björn Dörte Franziska Günter Hans Heike Holger Ingrid Jürgen Katrin Klaus Lukas
Matthias Monika Petra Sabine Silke Stefan Ulrike Ute Uwe Wolfgang Amélie Benoît Camille Chantal Élodie Étienne François
Gérard Hélène Jacques Laurent Luc Margaux Mathieu Noémie Pascal Pierre Sylvie Thierry Véronique Álvaro Andrés Begoña
Carlos Carmen Elena Íñigo Inés Javier Joaquín José Juan Lucía Luis Marisol Marta Miguel Nuria Pablo Pilar Rubén Sergio
Sofía Teresa
""".split()
# What stands before a person's name.
TITLES = "Dr Prof Herr Herrn Frau Mme Mlle Madame Monsieur Mr Mrs Ms Miss Sr Sra Srta Dra Señor Señora".split()
# The end of what stands before a name that has initials only, or its family name first.
NAME_CUES = (
    "by", "to", "ask", "contact", "volunteer:", "signed:", "thanks,", "regards,", "list:", "week:", "laut", "selon", "según", "an", "à", "a",
    "für", "par", "de", "recibió", "gezeichnet", "lieferanschrift:", "firmado", "firmado:", "signé", "signé:", "atentamente,", "cordialement,",
    "grüße,", "saludos,", "merci,", "gracias,", "danke,", "from", "with", "von", "und", "and", "et", "y", "que", "nom",
)
# What stands before the full name of a person, whatever the given name.
PERSON_CUES = (
    "signed by", "written by", "sent by", "collected by", "handed over by", "reviewed by", "signed:", "contact", "contact:", "volunteer:", "donor:", "patient:", "participant:", "regards", "sincerely",
    "thanks", "cheers", "unterschrieben von", "unterzeichnet von", "gezeichnet", "gezeichnet von", "ansprechpartner", "ansprechpartnerin", "ansprechpartner:", "grüße", "grüßen", "gruß",
    "lieferanschrift:", "ausgestellt für", "signé par", "signé", "signé:", "contactez", "contacter", "cordialement", "salutations", "merci", "firmado por", "firmado", "firmado:", "contacto", "contacto:",
    "contacte con", "contactar con", "atentamente", "saludos", "gracias", "a nombre de", "au nom de",
    "name:", "name is", "i am", "named", "namens", "mein name ist", "ich bin", "nommé", "nommée", "je m'appelle", "je suis", "me llamo", "llamado", "llamada", "se llama",
    "colleague", "coworker", "postdoc", "student", "intern", "technician", "chemist", "biologist", "nurse", "supervisor", "manager", "director", "assistant", "secretary",
    "visitor", "guest", "neighbour", "neighbor", "applicant", "employee", "operator", "author", "holder", "kollege", "kollegin", "studentin", "techniker", "technikerin",
    "chemiker", "chemikerin", "mitarbeiter", "mitarbeiterin", "doktorand", "doktorandin", "patientin", "spender", "spenderin", "collègue", "étudiant", "étudiante", "technicien",
    "technicienne", "stagiaire", "infirmière", "patiente", "donneur", "donneuse", "compañero", "compañera", "colega", "estudiante", "técnico", "técnica", "paciente", "enfermera",
)
# Words after which two words in capitals are a thing or a place rather than a person.
NO_PERSON_AFTER = set("""
the a an our my your his her its their this these those some any no every each in at into near inside outside within across der die das den dem des ein eine einen einem einer
unser unsere im am zum zur ins vom beim dieser diese dieses jeder jede le la les un une du des au aux ce cette ces notre votre dans en el los las una al del este esta nuestro nuestra
""".split())
# Words that may open a sentence right before a name.
OPENERS = set("""
dear hello hi sorry attn owner from to by with for when if because while but and selon avec pour par chez según con para por laut mit von für bei liebe lieber geehrte geehrter hallo hola
bonjour cher chère estimado estimada querido querida
""".split())
# Frequent German words; in their company nouns have capitals too.
GERMAN = set("der die das und ist nicht ein eine wurde wurden mit von für auf den dem im bei sich auch nach aus zu".split())
# What people do, after two words in capitals.
VERBS = (
    "said", "says", "wrote", "writes", "asked", "asks", "replied", "answered", "phoned", "telephoned", "emailed", "signed", "agreed", "thinks", "thought", "believes", "lives",
    "lived", "went", "came", "joined", "left", "retired", "resigned", "told", "met", "spoke", "mentioned", "noticed", "prefers", "works", "worked", "stopped", "visited", "wants",
    "wanted", "forgot", "remembered", "promised", "called", "sent", "brought", "took", "sagte", "sagt", "schrieb", "schreibt", "fragte", "antwortete", "unterschrieb", "wohnt",
    "arbeitet", "meinte", "rief", "kam", "ging", "verließ", "brachte", "dit", "écrit", "demande", "répond", "habite", "travaille", "signe", "pense", "appelle", "arrive", "dijo",
    "dice", "escribió", "preguntó", "respondió", "vive", "trabaja", "firmó", "piensa", "llamó", "llegó", "atiende",
    "is", "was", "has", "had", "will", "can", "hat", "ist", "war", "wird", "kann", "a", "est", "était", "sera", "es", "ha", "fue", "estaba", "está",
)
# Words that show that what stands there is a firm, a place, a part of a house or a chain of residues, and no person.
FUNCTION_WORDS = set("""
the a an our your this that these those all any no new my his her their its we it to for in on at by from with and or if when please see dear
der die das den dem des ein eine unser unsere ihre im am zum zur le la les un une notre votre nos el los las una nuestro nuestra su
after before later then here there since while because although however once two three four five six seven eight nine ten yesterday today tomorrow now soon often sometimes usually
recently finally meanwhile perhaps maybe only even also both neither either each every some many most several such what which who whose how why where so yet still just
consider choose suppose explain given unlike assume decide compare discuss describe state list show find use take note check keep
diese dieser dieses jede jeder jedes alle beide keine kein meine mein seine sein solche manche viele mehrere andere einige welche gestern heute abend morgen mittag nacht
ce cet cette ces chaque plusieurs quelques tous toutes hier demain este esta estos estas cada todos todas muchas muchos otro otra algunos ayer hoy mañana
""".split())
# Words of which none stands in a name: firms, places, parts of a house, methods, residues, days.
NO_PERSON = FUNCTION_WORDS | set("""
reagents reagent sons brothers bros ltd limited inc llc llp plc corp corporation co company gmbh ag kg ohg ug sa sas sarl sl srl bv nv ab oy group groupe gruppe grupo holding
labs lab laboratory laboratories laboratoire laboratoires labor laboratorio laboratorios institute institut instituto university université universität universidad
college school faculty hospital clinic klinik klinikum hôpital clínica centre center zentrum centro department dept abteilung département departamento division unit
office büro bureau oficina desk team service services support customer sales orders order help helpdesk reception security human resources logistics accounts billing
shipping supplies supply supplier instruments instrument scientific science sciences systems technologies technology biotech biotechnology pharma pharmaceuticals
chemicals chemical chemie chimie química diagnostics biologics bio therapeutics analytics solutions software international global partners associates foundation trust
society committee board council ministry agency bank press journal street road avenue lane square building hall room wing floor house site plant store stores
glass glassware plastics optics imaging medical health care data core facility management quality control safety project program programme protein kinase receptor
ala arg asn asp cys gln glu gly his ile leu lys met phe pro ser thr trp tyr val chain loop helix sheet
optical works print press mills foundry forge farm farms shop market theatre cinema museum library church castle tower bridge gate garden island river lake valley
new san santa santo saint sankt los las north south east west northern southern eastern western central upper lower great little old royal united grand mount port fort cape
monte table figure fig chapter section page appendix equation method methods assay test trial plot buffer kit panel model version release phase step batch lot plate
compound sample samples series order barcode reader firmware revision sheet report note memo file form title variant residue rest pose vitamin factor type grade class level
answer question summary abstract introduction conclusion results discussion background subject regarding
ansatz charge platte probe proben raum salz messung verbindung serie gerät tabelle abbildung kapitel seite nummer hilfe puffer versuch lösung essai tampon plaque salle
tableau ensayo muestra placa tampón lote solución cadena after before later then there here since while because although however once two three four five six
microsoft google windows linux python excel word blot gaussian poisson bayes fourier
day week month year monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december
""".split())
# What a person does, after initials and a family name.
NAME_VERBS = ("signed", "wrote", "said", "agreed", "will", "moved", "called", "asked", "has", "is", "was", "hat", "ist", "schrieb", "répond", "est", "a", "atiende", "firmó", "escribió")
# What stands before the number of a document or person.
ID_CUES = (
    "id card", "identity card", "identity number", "id number", "id no", "personal number", "passport", "national insurance", "social security",
    "ssn", "ausweisnummer", "ausweisnr", "ausweis-nr", "personalausweis", "reisepass", "passnummer", "steuer-id", "numéro national",
    "pièce d'identité", "pièce d’identité", "documento", "document", "carte d'identité", "carte d’identité", "passeport", "numéro de sécurité sociale", "documento de identidad", "dni", "nie",
    "número de identidad", "pasaporte", "tax id", "tax number", "steuernummer", "steueridentifikationsnummer", "sozialversicherungsnummer", "versichertennummer", "carte nationale",
    "numéro fiscal", "seguridad social", "nif", "driving licence", "driver's license", "driver’s license", "führerschein", "permis de conduire", "permiso de conducir", "nhs number",
    "pesel", "codice fiscale", "aadhaar", "national id", "national number",
)
# What stands before the number of a person's account or payment card; such numbers have check digits.
ACCOUNT_CUES = ("iban", "account", "account no", "account number", "konto", "kontonummer", "compte", "cuenta")
CARD_CUES = ("card", "card no", "card number", "visa", "mastercard", "amex", "kreditkarte", "kartennummer", "carte", "carte bancaire", "tarjeta")
# What stands shortly before a telephone number.
PHONE_CUES = (
    "phone", "telephone", "telefon", "téléphone", "teléfono", "tel", "tél", "mobile", "mobil", "cell", "fax", "call", "calls", "texted", "text", "dial", "ring", "rang",
    "unter", "anrufen", "appeler le", "appeler au", "répond au", "joindre au", "llamar al", "atiende en el", "on call", "handy",
    "callto", "sms", "sip", "whatsapp", "reach me", "reach me at", "reach me on", "reach her at", "reach him at", "reach us at", "call me at", "call me on", "erreichbar unter",
    "durchwahl", "joignable au", "contact number",
)

_GIVEN = {g.lower() for g in [*GIVEN_NAMES, *GIVEN]}
_LETTERS = [chr(c) for c in (*range(0x41, 0x530), *range(0x1E00, 0x2000)) if chr(c).isalpha()]
_LU, _LL = "".join(c for c in _LETTERS if c.isupper()), "".join(c for c in _LETTERS if c.islower())
_CAP = rf"(?:(?:O|D)['’])?(?:Mc|Mac)?[{_LU}][{_LL}]+"
_FAMILY = rf"(?:(?:von|van|de|del|di|da|du|la|le|zu)\s){{0,2}}{_CAP}(?:-{_CAP})*"
_UPPER = rf"[{_LU}]{{2,}}(?:-[{_LU}]{{2,}})*"
_INITIALS = rf"(?:[{_LU}]\.-?){{1,3}}"
_S = r"\s+"
_END = r"(?![\w-]|['’]\w)"

_AFTER_GIVEN = re.compile(rf"(?:-{_CAP})?(?:{_S}{_INITIALS})?{_S}{_FAMILY}{_END}")
_AFTER_GIVEN_UPPER = re.compile(rf"(?:-{_UPPER})?(?:{_S}{_INITIALS})?{_S}{_UPPER}{_END}")
_GIVEN_TAIL = re.compile(rf"(?:-{_CAP}|-{_UPPER})?(?:{_S}{_INITIALS})?")
_FAMILY_FIRST = re.compile(rf"{_CAP}(?:-{_CAP})*|{_UPPER}")
_PAIR = re.compile(rf"{_CAP}(?:-{_CAP})*(?:{_S}{_INITIALS})?{_S}{_FAMILY}{_END}")
_CAPITAL = re.compile(rf"(?<![^ (\"“‘„])(?=[{_LU}]['’{_LL}])")
_NEXT = re.compile(r"[ -]([\w'’]+)")
_INITIAL_NAME = re.compile(rf"[{_LU}](?<![\w.@-][{_LU}])\.-?(?:[{_LU}]\.-?){{0,2}}\s{{0,2}}(?:{_CAP}(?:-{_CAP})*|{_UPPER}){_END}")
_TITLED = re.compile(rf"(?<!\w)(?:{'|'.join(TITLES)})\b\.?{_S}(?:(?:{'|'.join(TITLES)})\b\.?{_S})*")
_ONLY_FAMILY = re.compile(rf"(?:{_FAMILY}|{_UPPER}){_END}")
_MONSIEUR = re.compile(rf"(?<!\w)M\.{_S}({_FAMILY}|{_UPPER}){_END}(?=\s+(?:répond|est|a|sera|arrive|attend|signe)\b)")
_CUE_BEFORE = re.compile(rf"(?:^|[\s(:.])(?:{'|'.join(map(re.escape, sorted(NAME_CUES, key=len, reverse=True)))})\s+$", re.I)
_VERB_AFTER = re.compile(rf"\s+(?:{'|'.join(NAME_VERBS)})\b")
_AFTER_CUED = re.compile(rf"\s*[:,]?\s*(?:-\s+)?({_CAP}(?:-{_CAP})*(?:{_S}{_INITIALS})?{_S}(?:{_FAMILY}|{_UPPER})){_END}(?!{_S}(?:&|und|and|et|y){_S}(?:Co|Sons|Söhne|Fils|Hijos)\b)(?:{_S}(\w+))?")
_NO_FAMILY = {"the", "a", "an", "for", "in", "on", "our", "we", "it", "after", "two", "plates", "flat", "apt", "tel", "der", "die", "das", "le", "la", "les", "el", "los"}

_DOT = r"(?:\.|\s?\(dot\)\s?|\s?\[dot\]\s?|\s?\{dot\}\s?|\s+dot\s+)"
_DOMAIN = re.compile(rf"\s*([\w-]+(?:{_DOT}[\w-]+)*{_DOT}[A-Za-z]{{2,}})(?![\w@])", re.I)
_DOMAIN_WORDS = re.compile(r"\s+([\w-]+(?:\s+dot\s+[\w-]+)*\s+dot\s+[A-Za-z]{2,})(?![\w@])", re.I)

_TOWN = r"[A-ZÀ-ÖØ-Þ][\w'’-]+(?:\s(?:am|an der|bei|sur|sous|de|del|de la|la|les)\s[A-ZÀ-ÖØ-Þ][\w'’-]+)?"
_ENGLISH_STREET = r"(?:Street|St\b\.?|Road|Rd\b\.?|Avenue|Ave\b\.?|Lane|Ln\b\.?|Close|Drive|Way|Court|Ct\b\.?|Place|Pl\b\.?|Square|Sq\b\.?|Terrace|Boulevard|Blvd\b\.?|Crescent|Gardens|Row|Hill|Park|Walk|Mews)"
_ADDRESSES = [
    re.compile(
        rf"(?<![\w-])(?:(?:Flat|Apt|Apartment|Unit|Suite|Room)\b\.?\s+\d+\s?[A-Za-z]?,?\s+)?\d+[A-Za-z]?,?\s+(?:[A-ZÀ-Þ][\w'’-]+\s+){{1,3}}?{_ENGLISH_STREET}"
        rf"(?:,?\s+(?:Apt|Flat|Unit|Suite|Apartment|\#)\.?\s*\d+\s?[A-Za-z]?)?,?\s+[A-ZÀ-Þ][\w'’-]+(?:[  -][A-ZÀ-Þ][\w'’-]+){{0,2}}?,?\s+(?:[A-Z]{{1,2}}\d{{1,2}}[A-Z]?\s+\d[A-Z]{{2}}|[A-Z]{{2}}\s+\d{{5}}(?:-\d{{4}})?)(?![\w-])"
    ),
    re.compile(
        rf"(?<![\w-])(?:(?:Am|An|Auf|Im|In|Zum|Zur|Unter|Hinter)\s+(?:(?:der|dem|den)\s+)?)?[A-ZÄÖÜ][\w-]*(?:\s+)?(?:straße|strasse|str\.|Straße|Strasse|Str\.|weg|Weg|platz|Platz|allee|Allee|gasse|Gasse|ring|Ring|ufer|Ufer|damm|hof|markt)\s+\d+\s?[a-z]?(?:\s?-\s?\d+[a-z]?)?,?\s+(?:[A-Z]{{1,2}}-)?\d{{4,5}}\s+{_TOWN}"
    ),
    re.compile(
        rf"(?<![\w-])\d+[A-Za-z]?(?:\s+(?:bis|ter|quater))?,?\s+(?:rue|avenue|av\.|quai|boulevard|bd|place|chemin|impasse|allée|cours|square|route|passage|Rue|Avenue|Quai|Boulevard|Place|Chemin|Impasse|Allée|Cours|Route)\s+(?:(?:de|du|des|la|le|les|l['’]|d['’])\s?)*[A-ZÀ-Þ][\w'’-]+(?:\s+[A-ZÀ-Þ][\w'’-]+)*,?\s+(?:[A-Z]{{1,2}}-)?\d{{5}}\s+{_TOWN}"
    ),
    re.compile(
        rf"(?<![\w-])(?:Calle|C/|Avenida|Avda\.|Av\.|Plaza|Paseo|Camino|Ronda|Travesía|Carretera)\s*(?:(?:de|del|la|las|los|el)\s+)*[A-ZÀ-Þ][\w'’-]+(?:\s+(?:(?:de|del|la|las|los)\s+)*[A-ZÀ-Þ][\w'’-]+)*,?\s+(?:n\.?[º°]\s*)?\d+\s?[a-z]?(?:,?\s+(?:\d+\s?\.?[ºª°]|bajo|ático|piso\s+\d+)(?:\s*[A-Za-z]\b|\s+(?:izq|dcha)\.?)?)?,?\s+\d{{5}}\s+{_TOWN}"
    ),
]
# Words and word ends at which an address of each of the four kinds is looked for.
STREETS = (
    ("street", " st", "road", " rd", "avenue", " ave", "lane", " ln", "close", "drive", " way", "court", " ct", "place", " pl", "square", " sq", "terrace", "boulevard", "blvd", "crescent", "gardens", " row", " hill", " park", " walk", "mews"),
    ("straße", "strasse", "str.", "weg", "platz", "allee", "gasse", "ring", "ufer", "damm", "hof", "markt"),
    ("rue ", "avenue ", "av. ", "quai ", "boulevard ", "bd ", "place ", "chemin ", "impasse ", "allée ", "cours ", "square ", "route ", "passage "),
    ("calle", "c/", "avenida", "avda.", "av.", "plaza", "paseo", "camino", "ronda", "travesía", "carretera"),
)
# Words in small letters that stand within an address.
_WITHIN = "am an auf im in zum zur bei der dem den hinter unter bis ter quater rue avenue av. quai boulevard bd place chemin impasse allée cours square route passage de du des la le les las los el l' d' l’ d’ sur sous n. n.º n° nº bajo ático piso izq izq. dcha dcha. straße strasse str. weg platz allee gasse ring ufer damm hof markt - #".split()
#: Words that may belong to an address, one after another: it lies within such a run, however long.
_RUN_OF_PARTS = re.compile(rf"(?<!\S)(?:(?:[(\[]?(?:[ld]['’])?[A-ZÀ-ÖØ-ÞŒ0-9#]\S*|[a-z][,.]?|{'|'.join(re.escape(w) + ',?' for w in sorted(_WITHIN, key=len, reverse=True))})(?!\S)\s?)+")

_B = r"[\s.\-]"
_PLANS = [
    rf"(?:\+?1{_B}?)?\(\d{{3}}\){_B}?\d{{3}}{_B}\d{{4}}",
    rf"(?:\+?1{_B})?\d{{3}}{_B}\d{{3}}{_B}\d{{4}}",
    r"\d{3}-\d{4}",
    r"(?:(?:\+44|\(\+44\)|0044)\s?(?:\(0\)\s?)?\d{2,4}|\(0\d{2,4}\)|0\d{2,4})\s\d{3,4}\s?\d{3,4}",
    r"(?:(?:\+44|\(\+44\)|0044)\s?(?:\(0\)\s?)?\d{4}|\(0\d{4}\)|0\d{4})\s\d{6}",
    r"(?:\+49|\(\+49\)|0049)[\s/-]{0,3}(?:\(0\))?\d{2,4}[\s/-]{1,3}\d{3,8}(?:[\s-]\d{1,5}){0,2}",
    r"(?:\(0\d{2,4}\)|0\d{2,4})\s?[/-]?\s?\d{3,8}(?:[\s-]\d{2,5})?",
    r"(?:(?:\+33|\(\+33\)|0033)[\s.-]?(?:\(0\)\s?)?\d|0\d)(?:[\s.-]\d{2}){4}",
    r"(?:\+34|\(\+34\)|0034)[\s.-]?\d{3}(?:[\s.-]?\d{3}[\s.-]?\d{3}|(?:[\s.-]\d{2}){3})",
    r"\d{3}(?:(?:[\s.-]\d{2}){3}|(?:[\s.-]\d{3}){2})",
    r"\+\d{8,15}",
    r"(?:\+\d{1,3}|\(\+\d{1,3}\)|00\d{2,3})(?:[\s./-]{1,3}(?:\d{1,5}|\(\d{1,5}\))){2,5}",
]
_PHONES = [re.compile(p + r"(?![\w]|[.\-/]\d)") for p in _PLANS]
_PHONE_START = re.compile(r"(?<![\w#.\-/+])(?=\(?\+?\d)")
_AFTER_CUE = re.compile(r"(?:[\s.:]+(?:no|nr|number|numéro|número|num)\b)?\.?[\s:(/]*", re.I)
_AFTER_PERSON = re.compile(r"(?:\s*[-–,:;(]\s*|\s+(?:or|oder|ou|o|at|on|am|Empfang)\b|\s+)+")

_ID_LINK = re.compile(r"(?:\s*(?:no\b|nr\b|n\.?\s?[º°]|number\b|nummer\b|numéro\b|número\b)\.?)?(?:\s+(?:du|de la|de|del|des|der|of|for)(?:\s+\w+)?)?(?:\s+(?:is|was|ist|war|lautet|est|es)\b)?\s*\.?\s*[:#=]?\s*", re.I)
_ID_VALUE = re.compile(r"[A-Z]{0,4}\d[A-Z0-9]*(?:(?:\s|[.\-/])(?:\d[A-Z0-9]*|[A-Z](?![\w'’])))*(?![\w])|[A-Z]{1,4}(?:\s\d[A-Z0-9]*)+(?:\s[A-Z](?![\w'’]))?(?!\w)")


_IBAN = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_CARD = re.compile(r"\d(?:[ -]?\d){12,18}(?![\w-])")
_AFTER_ACCOUNT = re.compile(r"(?:\s+(?:is|was|ist|lautet|est|es|no|nr|number)\b)?[\s.:#]*", re.I)


def _checked_account(text: str, at: int) -> int | None:
    """Where an IBAN that begins at a place ends, if its remainder by 97 is right; its groups are taken as far as they fit."""
    m = _IBAN.match(text, at)
    ends = [] if not m else [m.end(), *(at + i for i in range(len(m[0]) - 1, 14, -1) if not m[0][i].isalnum())]
    for end in ends:
        plain = text[at:end].replace(" ", "")
        if 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1:
            return end
    return None


def _checked_card(text: str, at: int) -> int | None:
    """Where a payment card's number that begins at a place ends, if its last digit is right by Luhn's rule."""
    m = _CARD.match(text, at)
    if not m:
        return None
    digits = [int(c) for c in reversed(m[0]) if c.isdigit()]
    return m.end() if sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0 else None


_ODD_SPACES = [c for c in SPACE if c != " "]


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def anchors():
    """The automaton that finds all cues in one pass over a text; its values are (kind, length)."""
    import ahocorasick

    found: dict[str, set[str]] = {}
    for kind, cues in (
        ("given", _GIVEN), ("id", ID_CUES), ("phone", PHONE_CUES), ("title", [*TITLES, "M."]), ("person", PERSON_CUES), *((f"street{i}", x) for i, x in enumerate(STREETS)),
        ("at", ("@", "%40", "(at)", "[at]", "{at}", " at ")), ("account", ACCOUNT_CUES), ("card", CARD_CUES), ("initial", {f"{c}." for c in _LL}),
        ("verb", ["'s", "’s", *(f" {w}" for w in VERBS)]),
    ):
        for c in cues:
            found.setdefault(c.lower(), set()).add(kind)
    automaton = ahocorasick.Automaton()
    for c, kinds in found.items():
        automaton.add_word(c, (sorted(kinds), len(c)))
    automaton.make_automaton()
    return automaton


class Finder:
    """Finds personal information in texts; make one for a task, as its automaton is not sent along."""

    def __init__(self) -> None:
        self.automaton = anchors()

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, type) of each case, in order and without overlap; none in a null or empty text.

        Where readings overlap, an e-mail address counts before a postal address, an identity number, a telephone
        number and a name, in this order.
        """
        if not text:
            return []
        for c in _ODD_SPACES if not text.isascii() else _ODD_SPACES[:9]:  # in place: cues and cases may run over line breaks
            text = text.replace(c, " ")
        short, back = _collapsed(text)
        return sorted((back(s), back(e - 1) + 1, kind) for s, e, kind in self._spans(short))

    def _spans(self, text: str) -> list[tuple[int, int, str]]:
        """As spans, for a text whose white space is single blanks, so that no layout pulls a case apart."""
        at: dict[str, list[tuple[int, int]]] = {}
        for end, (kinds, n) in self.automaton.iter(_lower(text)):
            for kind in kinds:
                at.setdefault(kind, []).append((end - n + 1, end + 1))
        taken = _Taken(len(text))
        for s, e in at.get("at", ()):
            if hit := _email(text, s, e):
                taken.add(*hit, "EMAIL")
        runs = None
        for i, pattern in enumerate(_ADDRESSES):
            if cues := at.get(f"street{i}"):
                runs = runs or [m.span() for m in _RUN_OF_PARTS.finditer(text)]
                for hit in _addresses(text, pattern, cues, runs):
                    taken.add(*hit, "ADDRESS")
        for s, e in at.get("id", ()):
            if hit := _id_number(text, s, e):
                taken.add(*hit, "ID_NUMBER")
        for kind, checked in (("account", _checked_account), ("card", _checked_card)):
            for s, e in at.get(kind, ()):
                begin = _AFTER_ACCOUNT.match(text, e).end()
                if _alone(text, s, e) and (end := checked(text, begin)):
                    taken.add(begin, end, "ID_NUMBER")
        mails = [(s, e) for s, e, kind in taken.spans if kind == "EMAIL"]
        names = _names(text, at, mails)
        for s, e in _phones(text, at.get("phone", ()), [*names, *mails]):
            taken.add(s, e, "PHONE")
        for s, e in names:
            taken.add(s, e, "NAME")
        return taken.spans

    def found(self, text: str | None) -> set[tuple[str, str]]:
        """(type, text) of the distinct cases, each run of white space as one space."""
        return {(kind, re.sub(r"\s+", " ", text[s:e])) for s, e, kind in self.spans(text)}

    def redacted(self, text: str | None) -> str | None:
        """The text with [TYPE] in place of each case and otherwise unchanged."""
        spans = self.spans(text)
        if not spans:
            return text
        out, last = [], 0
        for s, e, kind in spans:
            out += [text[last:s], f"[{kind}]"]
            last = e
        return "".join([*out, text[last:]])


class _Taken:
    """Spans without overlap, the first to come staying; marks each character, so long texts cost no more than short."""

    def __init__(self, length: int) -> None:
        self.marks = bytearray(length)
        self.spans: list[tuple[int, int, str]] = []

    def add(self, s: int, e: int, kind: str) -> None:
        if s < e and not any(self.marks[s:e]):
            self.marks[s:e] = b"\1" * (e - s)
            self.spans.append((s, e, kind))


def _email(text: str, s: int, e: int) -> tuple[int, int] | None:
    sign = text[s:e]
    plain, worded = sign in ("@", "%40"), sign.strip().lower() == "at"
    end = s - 1 if not (plain or worded) and s and text[s - 1] == " " else s
    start = end
    while start and (text[start - 1].isalnum() or text[start - 1] in "_.+%-"):
        start -= 1
    while start < end and not (text[start].isalnum() or text[start] == "_"):
        start += 1
    local = text[start:end]
    if not any(c.isalnum() for c in local):
        return None
    if start and text[start - 1] in ":/":  # scheme://user:password@host is no address
        j = start
        while j and text[j - 1] not in " /@":
            j -= 1
        if text[max(0, j - 3) : j] == "://":
            return None
    if worded:
        d = _DOMAIN_WORDS.match(text, e - 1)
        if not d and (sign.isupper() or re.fullmatch(r"[^\W\d_]+[._][^\W\d_]+", local)):
            d = _DOMAIN.match(text, e)
    else:
        d = _DOMAIN.match(text, e)
    if not d or (plain and text[e : e + 1].isspace()):
        return None
    if not worded and re.search(r"\s", d[1]) and not re.search(r"dot", d[1], re.I):
        return None
    return start, d.end(1)


def _id_number(text: str, s: int, e: int) -> tuple[int, int] | None:
    if (s and text[s - 1].isalnum()) or (text[e : e + 1].isalpha()):
        return None
    link = _ID_LINK.match(text, e)
    for at in dict.fromkeys((link.end(), e + len(text[e : e + 9]) - len(text[e : e + 9].lstrip(" .:#")))):
        m = _ID_VALUE.match(text, at)
        if m and sum(c.isdigit() for c in m[0]) >= 5:
            return m.span()
    return None


def _alone(text: str, s: int, e: int) -> bool:
    """Whether a cue stands by itself rather than within a word."""
    return not (s and text[s - 1].isalnum()) and not text[e : e + 1].isalnum()


_RUN = re.compile(r"\s{2,}")


def _collapsed(text: str) -> tuple[str, Callable[[int], int]]:
    """The text with each run of white space as one space, and a function from places in it to places in the text."""
    runs = [m.span() for m in _RUN.finditer(text)]
    if not runs:
        return text, int
    ends, shifts, gone = [], [], 0
    for s, e in runs:
        gone += e - s - 1
        ends.append(e - gone)
        shifts.append(gone)

    def back(i: int) -> int:
        k = bisect_right(ends, i) - 1
        return i if k < 0 else i + shifts[k]

    return _RUN.sub(" ", text), back


def _addresses(text: str, pattern: re.Pattern, cues: list[tuple[int, int]], runs: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Matches of pattern within those runs of parts that hold a cue."""
    starts = [s for s, _ in cues]
    for lo, hi in runs:
        k = bisect_left(starts, lo - 1)  # a cue may begin with the blank before a run
        if k < len(starts) and starts[k] < hi:
            yield from (m.span() for m in pattern.finditer(text, lo, hi))


def _phones(text: str, cues: list[tuple[int, int]], people: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    starts = set()
    for m in (*(_AFTER_CUE.match(text, e) for s, e in cues if _alone(text, s, e)), *(_AFTER_PERSON.match(text, e) for _, e in people)):
        if m:
            starts |= {m.end(), m.end() - 1} if text[m.end() - 1] == "(" and m[0] else {m.end()}
    at = text.find("+")
    while at >= 0:
        starts |= {at, at - 1} if at and text[at - 1] == "(" else {at}
        at = text.find("+", at + 1)
    last = 0
    for s in sorted(starts):
        if s < last or not _PHONE_START.match(text, s):
            continue
        best = max((p.end() for p in (x.match(text, s) for x in _PHONES) if p and 7 <= sum(c.isdigit() for c in p[0]) <= 15), default=0)
        if best:
            last = best
            yield s, best


def _word_before(text: str, end: int) -> int:
    """Where the word begins that ends there."""
    at = end
    while at and (text[at - 1].isalpha() or text[at - 1] in "-'’"):
        at -= 1
    while at < end and not text[at].isalpha():
        at += 1
    return at


def _folded(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


class _Persons:
    """Tells whether two words in capitals may be a person's name, by what stands around them in the text."""

    def __init__(self, text: str) -> None:
        self.text = text
        self._plain: set[str] | None = None
        self._german: bool | None = None

    def may_be(self, s: int, e: int) -> bool:
        words = [w.lower() for w in re.split(r"[\s-]+", self.text[s:e]) if w[:1].isupper() and w[-1:] != "."]
        after = _NEXT.match(self.text, e)
        after = after[1] if after else ""
        if after[:1].isupper() and len(after) > 1 and self.text[e] == " " and not self.german():  # a longer title
            return False
        if NO_PERSON & {*words} or after.lower() in NO_PERSON and (after[:1].isupper() or after not in FUNCTION_WORDS) or _FIRM_AFTER.match(self.text, e):
            return False
        if self._plain is None:  # words that the text has in small letters too are no names
            self._plain = set(re.findall(rf"(?<![\w.@%+-])[{_LL}]{{4,}}(?![\w-]|[.@]\w)", self.text))
        return not self._plain & {*words}


    def stands_well(self, s: int) -> bool:
        """Whether a person may be named at a place: after a word in small letters that calls for no thing, after a comma,
        colon or bracket, or, save among German nouns, at the beginning of a sentence."""
        text = self.text
        if not s or text[s - 1] != " ":
            return bool(s) or not self.german()
        sign = text[s - 2]
        if sign in ",:;(–-":
            return True
        if not sign.isalpha():
            return sign in ".!?" and not self.german()
        begin = _word_before(text, s - 1)
        word = text[begin : s - 1]
        if not word.islower() and word.lower() not in OPENERS or word.lower() in NO_PERSON_AFTER:
            return False
        return word != "of" or begin < 2 or not text[_word_before(text, begin - 1)].isupper()

    def acts_well(self, s: int) -> bool:
        """Whether a person may do something at a place: not after an article or within a longer title."""
        before = self.text[_word_before(self.text, s - 1) : s - 1] if s > 1 and self.text[s - 2].isalpha() else ""
        return before.lower() not in NO_PERSON_AFTER and (before.islower() or not before or before.lower() in NO_PERSON)

    def german(self) -> bool:
        if self._german is None:
            words = re.findall(rf"[{_LL}]+", self.text)
            self._german = 8 * sum(w in GERMAN for w in words) > len(words)
        return self._german


_FIRM_NEXT = re.compile(rf"{_S}(?:GmbH|AG|KG|Ltd|Limited|Inc|LLC|PLC|plc|Corp|SA|SARL|BV|NV)\b")
_FIRM_AFTER = re.compile(rf"{_S}(?:&|und|and|et|y){_S}(?:Co|Sons|Söhne|Fils|Hijos)\b")


def _names(text: str, at: dict[str, list[tuple[int, int]]], mails: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of names: first what a name list, titles and initials tell, then what cues, words before and after, and e-mail addresses do."""
    taken = _Taken(len(text))
    given, titles = at.get("given", ()), at.get("title", ())

    def add(s: int, e: int) -> None:
        taken.add(s, e, "NAME")

    firsts = [(s, e) for s, e in given if not (s and (text[s - 1].isalnum() or text[s - 1] in "-_@./")) and not text[e : e + 1].isalnum() and text[e : e + 1] not in ("_", "@", "+") and text[s].isupper()]
    starts = {s for s, _ in firsts}
    for s, e in firsts:  # family name first
        if text[max(0, s - 2) : s] != ", ":
            continue
        begin = _word_before(text, s - 2)
        family = _FAMILY_FIRST.fullmatch(text, begin, s - 2)
        if not family or (begin and (text[begin - 1].isalnum() or text[begin - 1] in "_-")):
            continue
        before = text[max(0, begin - 30) : begin]  # longer than any cue, title or initials
        if re.search(rf"(?<!\d\s)(?<!\w){_INITIALS}\s?$", before) or any(g in starts and re.fullmatch(rf"\w+(?:\s+{_INITIALS})?\s+", text[g:begin]) for g in range(max(0, begin - 24), begin)):
            continue  # that family name has its given name before it
        tail = _GIVEN_TAIL.match(text, e)
        straight = _AFTER_GIVEN.match(text, e) or (text[s:e].isupper() and _AFTER_GIVEN_UPPER.match(text, e))
        cued = _CUE_BEFORE.search(before) or _TITLED.search(before + "x") and re.search(rf"(?:{'|'.join(TITLES)})\b\.?\s+$", before)
        if straight and not cued:
            continue
        if family[0].lower() not in _NO_FAMILY and family[0].lower() not in _GIVEN:
            add(begin, tail.end())
    for s, e in firsts:
        upper = text[s:e].isupper()
        m = (_AFTER_GIVEN_UPPER if upper else _AFTER_GIVEN).match(text, e)
        if m and m[0].split()[-1].lower() not in _NO_FAMILY and not _FIRM_NEXT.match(text, m.end()):
            add(s, m.end())
    for m in filter(None, (_TITLED.match(text, s) for s, _ in titles)):
        if n := (_INITIAL_NAME.match(text, m.end()) or _ONLY_FAMILY.match(text, m.end())):
            if n[0].lower() not in _NO_FAMILY:
                first = n[0].lower() in _GIVEN and re.compile(rf"{_S}{_FAMILY}{_END}").match(text, n.end())
                add(n.start(), first.end() if first else n.end())
    for m in filter(None, (_MONSIEUR.match(text, s) for s, _ in titles)):
        add(*m.span(1))
    last = 0
    for s, _ in at.get("initial", ()):
        m = _INITIAL_NAME.match(text, s) if s >= last else None
        if not m:
            continue
        last = e = m.end()
        before = text[max(0, s - 30) : s]
        if re.search(r"\d\s$", before) or re.sub(rf"{_INITIALS}\s*", "", m[0]).lower() in _NO_FAMILY:
            continue  # 21 C. The ...
        comma = re.search(r",\s*$", before)
        listed = bool(comma) and s - len(comma[0]) > 0 and taken.marks[s - len(comma[0]) - 1]
        if _CUE_BEFORE.search(before) or listed or _VERB_AFTER.match(text, e):
            add(s, e)
    for m in (_AFTER_CUED.match(text, e) for s, e in at.get("person", ()) if _alone(text, s, e)):
        if m and not NO_PERSON & {*(w.lower() for w in re.split(r"[\s-]+", m[1]) if w[:1].isupper()), (m[2] or "").lower() if (m[2] or "")[:1].isupper() else ""}:
            add(*m.span(1))
    persons = _Persons(text)
    for m in filter(None, (_PAIR.match(text, m.start()) for m in _CAPITAL.finditer(text))):
        if persons.stands_well(m.start()) and persons.may_be(*m.span()):
            add(*m.span())
    for s, e in at.get("verb", ()):
        if text[e : e + 1].isalnum():
            continue
        begin = _pair_before(text, s)
        if begin is not None and persons.acts_well(begin) and persons.may_be(begin, s):
            add(begin, s)
    for s, e in _written_as_mail(text, mails):
        if persons.may_be(s, e):
            add(s, e)
    for s, e, _ in sorted(taken.spans):  # a list goes on in both directions: A B, C D and E F
        while (m := _GOES_ON.match(text, e)) and persons.may_be(*m.span(1)) and not any(taken.marks[m.start(1) : m.end(1)]):
            add(*m.span(1))
            e = m.end(1)
        while (sign := _LISTED.search(text, max(0, s - 6), s)) and (begin := _pair_before(text, sign.start())) is not None and persons.may_be(begin, sign.start()) and not any(taken.marks[begin : sign.start()]):
            add(begin, sign.start())
            s = begin
    return sorted((s, e) for s, e, _ in taken.spans)


def _pair_before(text: str, end: int) -> int | None:
    """Where a name of given name, initials, particles and family name begins that ends there, if one does."""
    begin = end
    for _ in range(5):  # given name, initials, two particles, family name
        begin = text.rfind(" ", 0, max(0, begin)) + 1
        if not text[begin : begin + 1].isalpha():
            return None
        if _PAIR.fullmatch(text, begin, end):
            return begin
        if not begin:
            return None
        begin -= 1
    return None


_LISTED = re.compile(rf"(?:,(?:{_S}(?:and|und|et|y))?|{_S}(?:and|und|et|y)){_S}$")
_GOES_ON = re.compile(rf"(?:,{_S}(?:and{_S}|und{_S}|et{_S}|y{_S})?|{_S}(?:and|und|et|y|or|oder|ou|o){_S})({_CAP}(?:-{_CAP})*(?:{_S}{_INITIALS})?{_S}{_FAMILY}){_END}")


def _written_as_mail(text: str, mails: Iterable[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Two words in capitals of which an e-mail address in the same text has one, of four letters or more, to itself."""
    parts = set()
    for s, e in mails:
        parts |= {p for p in re.split(r"[^a-z]+", _folded(re.split(r"@|%40|[ (\[{]+at\b", text[s:e], maxsplit=1)[0])) if len(p) >= 4}
    if parts:
        for m in filter(None, (_PAIR.match(text, c.start()) for c in _CAPITAL.finditer(text))):
            if parts & set(re.split(r"[^a-z]+", _folded(m[0]))):
                yield m.span()


def personal_information(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, pii_type, pii_text), distinct: e-mail addresses, telephone and identity numbers, postal addresses and
    names of private persons, as they stand in each whole text, each run of white space as one space.

    One pass over the texts, nothing is shuffled. Null and empty texts have no cases.
    """
    kind = documents.schema[doc_id].dataType.simpleString()

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder()
        for batch in batches:
            rows = [(i, k, t) for i, x in zip(batch["d"], batch["t"]) for k, t in sorted(finder.found(x))]
            yield pd.DataFrame(rows, columns=["d", "k", "p"])

    rows = documents.selectExpr(f"`{doc_id}` d", f"`{text}` t").mapInPandas(find, f"d {kind}, k string, p string")
    return rows.toDF(doc_id, "pii_type", "pii_text")


def redact(documents: DataFrame, text: str = "text", out: str = "redacted") -> DataFrame:
    """documents with a column out: the text with typed placeholders for personal information, otherwise unchanged.

    Null stays null. Other columns, whatever their names, are kept as they are.
    """
    from pyspark.sql import functions as F

    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = Finder()
        for batch in batches:
            yield batch.map(lambda x: finder.redacted(x) if isinstance(x, str) else None).astype(object)

    clean.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return documents.withColumn(out, F.pandas_udf(clean, "string")(F.col(f"`{text}`")))
