import pytest

from pocketloom.llm.pii import Finder, personal_information, redact

CASES = [
    ("Replies go to\nmeera.tolvand@dock.example; call (212) 555-0112 now.", {("EMAIL", "meera.tolvand@dock.example"), ("PHONE", "(212) 555-0112")}),
    ("cc kev_t63 at lab dot example dot net Variant His272 binds.", {("EMAIL", "kev_t63 at lab dot example dot net")}),
    ("office[at]quarry[dot]example or j.t (at) mail.quarry.test", {("EMAIL", "office[at]quarry[dot]example"), ("EMAIL", "j.t (at) mail.quarry.test")}),
    ("Signal at 59 s @ 55 C; ligand C[C@@H](N)C[C@H](F)O was kept at 4 C. The lid moved.", set()),
    ("Samples were handed over by Alice Tolvand (+44 20 7946 0186).", {("NAME", "Alice Tolvand"), ("PHONE", "+44 20 7946 0186")}),
    ("Ask Tolvand, Priya; Ms Tolvand moved to 208 Birch Road, Apt 26C, Grimley, XY 00110 last week.", {("NAME", "Tolvand, Priya"), ("NAME", "Tolvand"), ("ADDRESS", "208 Birch Road, Apt 26C, Grimley, XY 00110")}),
    ("F. Tolvand signed the form; ID no. QQ 44 55 33 C.", {("NAME", "F. Tolvand"), ("ID_NUMBER", "QQ 44 55 33 C")}),
    ("It was kept at 6 C. Tolvand, Grace signed the form; ID no. X79195226. Rerun it.", {("NAME", "Tolvand, Grace"), ("ID_NUMBER", "X79195226")}),
    ("Visitor list: Tolvand, Tessa, Martin Orvgren, M. Quell-Orvand.", {("NAME", "Tolvand, Tessa"), ("NAME", "Martin Orvgren"), ("NAME", "M. Quell-Orvand")}),
    ("According to HUGO TOLVAND-ORV, it was old. According to Birch Reagents, too.", {("NAME", "HUGO TOLVAND-ORV")}),
    ("Lieferanschrift: Jürgen Tolvand, Am Birkenplatz 29, 00460 Ostertal. Tel. 030 / 23125-502.", {("NAME", "Jürgen Tolvand"), ("ADDRESS", "Am Birkenplatz 29, 00460 Ostertal"), ("PHONE", "030 / 23125-502")}),
    ("Ausweisnummer 44 975 913 368, ausgestellt für Katrin B. Tolvand. Birkenweg 45a, D-00993 Grünfelde", {("ID_NUMBER", "44 975 913 368"), ("NAME", "Katrin B. Tolvand"), ("ADDRESS", "Birkenweg 45a, D-00993 Grünfelde")}),
    ("M. Tolvand répond au 06.39.98.69.25; Mme Élodie Tolvand, 74 bis, avenue Birche, 00978 Montoriel.", {("NAME", "Tolvand"), ("PHONE", "06.39.98.69.25"), ("NAME", "Élodie Tolvand"), ("ADDRESS", "74 bis, avenue Birche, 00978 Montoriel")}),
    ("Numéro national du donneur : 1 80 32 99 952 608 59.", {("ID_NUMBER", "1 80 32 99 952 608 59")}),
    ("La Sra. Tolvand atiende en\nel (+34) 555-013-857. Documento de\nidentidad 99.597.149-L, a nombre de Tolvand, Pilar.", {("NAME", "Tolvand"), ("PHONE", "(+34) 555-013-857"), ("ID_NUMBER", "99.597.149-L"), ("NAME", "Tolvand, Pilar")}),
    ("Enviar a Inés Tolvand, Calle Abedul 15, 3º B, 00793 Fuenteoro.", {("NAME", "Inés Tolvand"), ("ADDRESS", "Calle Abedul 15, 3º B, 00793 Fuenteoro")}),
    ("Counts of 602.141.8666 and 1 180 407 919; barcode 971-23-4298; order PO 412 2148 80; lot 634-1598-33; firmware 5.387.239.393; #8959084.", set()),
    ("The Halvard-Osker plot from Birch & Sons hung in room 212, Mossy Street wing; Chain A and Chain B.", set()),
    ("", set()),
]


@pytest.mark.parametrize("text,want", CASES)
def test_found(text, want):
    assert Finder().found(text) == want


@pytest.mark.parametrize("text,want", [
    ("Signed by Andreas Schmidt.", {("NAME", "Andreas Schmidt")}),
    ("Please contact Jean Dupont, 555-0112, or Antonio Pérez.", {("NAME", "Jean Dupont"), ("PHONE", "555-0112"), ("NAME", "Antonio Pérez")}),
    ("It was Christian Weber and María García.", {("NAME", "Christian Weber"), ("NAME", "María García")}),
    ("Ask Łukasz Wiśniewski.", {("NAME", "Łukasz Wiśniewski")}),
    ("Best regards,\nOttokar Brandström", {("NAME", "Ottokar Brandström")}),
    ("Gezeichnet: Wunibald Ğökçe. Contact Brimwell Reagents. Contact Customer Service. Signed by Orvgren & Sons; contact Tyr Gly.", {("NAME", "Wunibald Ğökçe")}),
])
def test_names_that_stand_in_no_small_list(text, want):
    assert Finder().found(text) == want


#: Given names that are in no list of the package.
HELD_OUT = "Ottokar Wunibald Hyacinthe Philomène Eudald Sisebuto Ethelred Thurstan Merewen Tancrède Ermelinda Kunigunde Zdravko Bolormaa Nkechi Tjark Gwilym Aoife Rhiannon Xoán".split()


def test_recall_on_names_held_out():
    from pocketloom.llm.pii import _GIVEN

    assert not _GIVEN & {g.lower() for g in HELD_OUT}
    cues = ("signed by {}.", "Please contact {} soon.", "Regards,\n{}", "Unterschrieben von {}.", "Cordialement,\n{}", "Firmado por {}.")
    finder = Finder()
    assert all(finder.found(c.format(f"{g} Tolvand")) == {("NAME", f"{g} Tolvand")} for g in HELD_OUT for c in cues)
    assert all(finder.found(f"Later {g} Tolvand went home.") == {("NAME", f"{g} Tolvand")} for g in HELD_OUT)


#: Further given and family names in no list of the package, from countries whose names it mostly lacks.
ABROAD = """Chidi Temitope Thanh Nguyet Siddhartha Anuradha Ezgi Hüseyin Tuğba Jadranka Zvonimir Ruslan Giorgi Nino Tamar Baurzhan Aigerim Kanat Sorin Viorel Liisu Jüri
Imants Baiba Gintaras Rasa Kalevi Väinö Eerikki Snorri Guðrún Þórunn Mehtap Parisa Shirin Farhad Dilnoza Otabek Makoto Hinako Seung Jiwoo Nomvula Sipho Thandiwe Ayodele Folasade
Malaika Wanjiru Otieno Quetzal Itzel Nahuel Ayelén""".split()
FAMILIES = "Tolvand Obiorandu Perić Ganzorig Brunswig Lehtonen Kvaran Mkhize Arslanoğlu Tran Yamashiro Chatterjee".split()
#: Sentences with a name somewhere. The rules found 0.44 of the names when these were first tried; the rule of place was made then.
LAYOUTS = (
    "We are still waiting for a reply of {} concerning lot 7.", "Has anyone seen {} since the fire drill?", "{}, who joined in May, runs the robot.",
    "The centrifuge was broken last night, says {}.", "Room 4 is shared between {} and a student.", "{} (Kinetics) will present the data.", "Minutes taken: {}",
    "Last week {} presented new data.", "The key is with {}.", "A parcel arrived, addressed to {}.", "Der Schlüssel liegt bei {}.", "Heute hat {} Geburtstag.",
    "Anbei die Daten, die {} gemessen hat.", "Les données de {} sont prêtes.", "Merci de prévenir {} avant midi.", "Los datos de {} están listos.", "Llame a {} antes del lunes.",
    "{} and I repeated the run.", "I think {} knows the password.", "The badge of {} no longer opens the door.", "{}: please bring your own pipettes.",
    "As agreed with {} on the phone, we stop.", "Sorry {}, the plate is gone.", "Results were checked by {} twice.", "{} ist krank.", "{} est absente.", "{} no vino.",
    "{}'s badge was found.", "Approved: {}, 3 May", "{} hat gestern angerufen.", "{} a téléphoné ce matin.", "{} trabaja en el turno de noche.",
)
#: Capitals that name no person.
NO_NAMES = """A Western Blot was run. The talk is about Monte Carlo methods. We flew to New York on Monday. He lives in San Francisco. The Green Lantern is a bar.
See Figure Two for details. It was made by Sigma Aldrich Ltd. The Bradford Assay failed. We used the Michaelis Menten equation. From South Africa came a call. The Royal Society met.
According to Nature Methods, it works. Die Proben kamen von Roche Diagnostics. Das Gerät von Agilent Technologies ist neu. Der Puffer ist von Carl Roth GmbH. El reactivo es de Panreac Química.
The Golden Gate method was used. Buffers by Cold Spring Harbor Protocols. In Mass Spectrometry mode. With Magic Angle Spinning we saw it. It was Boxing Day. Install Windows Server first.
The Great Barrier Reef. We saw the White House. Die Firma Boehringer Ingelheim liefert. Ask Customer Service. Our Standard Operating Procedure is old. The Data Safety Board met.
Contact Human Resources. Read the Safety Data Sheet. The sample was sent to Oxford Nanopore. Plates from Thermo Fisher were used. La plaque vient de Lyon Sud. He went to Buenos Aires.""".replace("\n", " ").split(". ")


def test_recall_and_precision_on_names_and_layouts_held_out():
    """Of names in no list nine of ten are found in running text; of the sentences without a name, firms and places of
    two unknown words are taken for persons. README has the figures."""
    from pocketloom.llm.pii import _GIVEN

    abroad = [g for g in [*ABROAD, *HELD_OUT] if g.lower() not in _GIVEN]
    assert len(abroad) > 60
    finder = Finder()
    names = [f"{g} {FAMILIES[i % len(FAMILIES)]}" for i, g in enumerate(abroad)]
    right = found = 0
    for layout in LAYOUTS:
        for n in names:
            got = {t for k, t in finder.found(layout.format(n)) if k == "NAME"}
            right, found = right + (n in got), found + len(got)
    assert right / (len(names) * len(LAYOUTS)) >= 0.9 and right / found >= 0.98
    wrong = [x for x in NO_NAMES if finder.found(x + ".")]
    assert len(wrong) <= 4, wrong


@pytest.mark.parametrize("text,want", [
    ("My SSN is 123-45-6789.", {("ID_NUMBER", "123-45-6789")}),
    ("IBAN DE89 3704 0044 0532 0130 00 BIC X, not IBAN DE88 3704 0044 0532 0130 00.", {("ID_NUMBER", "DE89 3704 0044 0532 0130 00")}),
    ("Card 4111 1111 1111 1111, not card 4111 1111 1111 1112.", {("ID_NUMBER", "4111 1111 1111 1111")}),
    ("Write to jo.smith AT mail.example or ana.ruiz at mail.example; we met at mail.example.", {("EMAIL", "jo.smith AT mail.example"), ("EMAIL", "ana.ruiz at mail.example")}),
    ("Reach me: 555-0128; tel:+442079460018", {("PHONE", "555-0128"), ("PHONE", "+442079460018")}),
    ("mailto:x.y%40c.example, ftp://bob:secret@host.example/x", {("EMAIL", "x.y%40c.example")}),
    (f"mailto:{'a' * 150}.b@c.example", {("EMAIL", f"{'a' * 150}.b@c.example")}),
    ("Kept at 12 Xoán-" + "Y" + "y" * 200 + " Road, Grimley, XY 00110.", {("ADDRESS", "12 Xoán-" + "Y" + "y" * 200 + " Road, Grimley, XY 00110")}),
    ("The form of Nkechi Obiorandu, Tjark Brunswig and Bolormaa Ganzorig came.", {("NAME", "Nkechi Obiorandu"), ("NAME", "Tjark Brunswig"), ("NAME", "Bolormaa Ganzorig")}),
    ("The Perić Zdravko; mail zdravko.peric@x.example", {("NAME", "Perić Zdravko"), ("EMAIL", "zdravko.peric@x.example")}),
])
def test_schemes_check_digits_and_long_cases(text, want):
    assert Finder().found(text) == want


def test_addresses_over_deep_indentation():
    gap = "\n" + " " * 200
    for parts in (["208", "Birch", "Road, Apt 26C,", "Grimley, XY", "00110"], ["Am Birkenplatz", "29,", "00460", "Ostertal"], ["74, avenue", "Birche,", "00978", "Montoriel"], ["Calle", "Abedul", "15,", "00793", "Fuenteoro"]):
        for n in (1, 20):
            text = "Kept   at" + gap + gap.join(parts) + "." + " " * n + "End."
            assert Finder().found(text) == {("ADDRESS", " ".join(parts))}
            assert Finder().redacted(text) == "Kept   at" + gap + "[ADDRESS]." + " " * n + "End."


def test_redaction_keeps_the_rest():
    text = "Thanks,\nAlice\nTolvand  -  tel 555-0128.\n"
    assert Finder().redacted(text) == "Thanks,\n[NAME]  -  tel [PHONE].\n"
    assert Finder().redacted(None) is None and Finder().redacted("plain") == "plain"


def test_long_text_in_time():
    text = "Ask Alice Tolvand at a.b@c.example or +44 20 7946 0186. " * 4000
    assert len(Finder().spans(text)) == 12_000


def test_tables_with_nulls_repeats_and_other_columns(spark):
    df = spark.createDataFrame([(1, "Ask Alice Tolvand. Ask Alice\nTolvand.", "k"), (2, None, "k"), (3, "", None)], "doc_id long, text string, d string")
    assert [tuple(r) for r in personal_information(df).collect()] == [(1, "NAME", "Alice Tolvand")]
    out = {r["doc_id"]: r for r in redact(df).collect()}
    assert out[1]["redacted"] == "Ask [NAME]. Ask [NAME]." and out[2]["redacted"] is None and out[3]["redacted"] == "" and out[1]["d"] == "k"
    assert personal_information(df.limit(0)).collect() == []
