import time

from voxloom.llm import pii
from voxloom.llm.pii import Names, find_mentions, learn_names, mentions, redact

NAMES = Names(frozenset({"moreau", "tamsin", "o'keefe", "brandt", "anya"}), frozenset({"will"}), frozenset({"reset", "will", "the", "support"}))


def kinds(text, names=NAMES):
    return [(k, text[a:b]) for a, b, k in find_mentions(text, names)]


def test_mail_forms():
    for m in ("ann.b+c@example.org", "ann @ post.example", "ann[at]mail(dot)example", "ann dot b at mail dot example", "ann punto b arroba post punto example", "ANN@EXAMPLE.ORG"):
        assert kinds(f"Write to {m}, please.") == [("email", m)], m
    assert kinds("The portal status.corvid.example said @oncall would look.") == []


def test_phones_and_other_numbers():
    for p in ("(947) 555-0111", "+1(931)555-0159", "573.555.0103", "2905550186", "+44 20 7946 0345", "020 7946 0705", "01 99 00 59 94", "+49 (0)30 23125 097", "600 000 296", "four eight four, five five five, oh one three four"):
        assert kinds(f"Ring {p} after four.") == [("phone", p)], p
    for other in ("Part number 862-53-22041, batch 05652491, counter 2694107530.", "The address 192.0.2.204 answers.", "ticket is 2410-549-665.", "Our order 2077-61-6767 is open.", "port 30 shows 02:00:5e:97:30:79 and build 3.6.74.453.", "Ref 234470824575941598652."):
        assert kinds(other) == [], other


def test_identity_numbers():
    for s, n in (("My social security number is {}.", "850-26-5581"), ("It is {}, as printed on the card.", "834410052"), ("The passport number on file is {}, yes.", "L1CV8JP63"), ("Mi DNI es {}.", "94.442.170-F"), ("La carte porte le {}.", "1 77 09 37 455 853 98"), ("Her social is {} today.", "QQ 81 53 90 C"), ("auf der karte steht {}.", "t13mk7lfk")):
        assert kinds(s.format(n)) == [("identity_number", n)], n
    assert kinds("The sticker reads serial T81Z00597 and more.") == []


def test_addresses():
    for s, a in (("at {} now", "1441 Harrow Terrace"), ("show {}, that", "nineteen twelve Marlpit avenue"), ("nicht an {}, ja", "Am Marlpitplatz 21"), ("an {}.", "Gullwingstr. 209"), ("au {}.", "67 bis, avenue Harrow"), ("a {}.", "Calle Oldferry 120"), ("a {}.", "Avda. Quill n.º 57")):
        assert [k for k, _ in kinds(s.format(a))] == ["street_address"] and kinds(s.format(a))[0][1].startswith(a[:12]), a
    assert kinds("mark slot 7 as failed and lane 3 of the switch; court 5, the signal") == []


def test_names():
    assert kinds("Tell Mr. Moreau about it.") == [("person_name", "Moreau")]
    for n in ("Tamsin Moreau", "MOREAU Tamsin", "Moreau, Tamsin", "T. Moreau", "Tamsin van der Moreau", "Moreau-Brandt", "O'Keefe", "Will Moreau", "tamsin brandt"):
        assert kinds(f"Nobody but {n} has the key.") == [("person_name", n)], n
    assert kinds("You will hear from us, my colleague reset it.") == []
    assert kinds("My name is Xanthe Quill, I run it.") == [("person_name", "Xanthe Quill")]  # behind a cue, never seen before
    assert kinds("Anya and Brandt both saw it happen.") == [("person_name", "Anya"), ("person_name", "Brandt")]


def test_learning():
    n = learn_names(["My name is Zelda Fitz, I will call. Thank you, Zelda Fitz, one moment. We will reset it."] * 4)
    assert {"zelda", "fitz"} <= n.sure and "will" not in n.sure


GENERAL = [
    "Mr. Halvorsen called. We reset the router and the line came back; the router was slow. She will call about the line.",
    "My name is Nkechi Abara and the router fails. Please will you mark the port, then reset it again.",
    "The pilot of the ferry said that our engineer was here. It will take a day, they said, and the refund is late.",
    "I told them so: the passport is at the office, forward the refund. The Ferrowen 210 and the Ferrowen router fail.",
] * 3


def test_names_that_no_count_has_seen():
    n = learn_names(GENERAL)
    for text, name in (
        ("Please forward the refund to Margaret Halloway.", "Margaret Halloway"),
        ("Yesterday I told Priyanka Venkataraman about it.", "Priyanka Venkataraman"),
        ("Regards, Tobias Oyelaran", "Tobias Oyelaran"),
        ("Our engineer Okonkwo Adeyemi came.", "Okonkwo Adeyemi"),
        ("It went to Jan van der Hoeven today.", "Jan van der Hoeven"),
        ("We met Siobhán O'Rourke-Byrne there.", "Siobhán O'Rourke-Byrne"),
        ("Dear Katarzyna, we wait.", "Katarzyna"),
    ):
        assert kinds(text, n) == [("person_name", name)], text
    for text in ("Ask about the Ferrowen 210 today.", "It is in San Bartolo near the ferry.", "We took the North Ferry.", "VPN SFP are up.", "Good morning. Please Wait"):
        assert kinds(text, n) == [], text


def test_no_frame_of_the_test_data_is_needed():
    """Names known from titles and introductions alone are found wherever else they stand."""
    n = learn_names([f"Mr. {a} {b} called, Mrs. {b} too." for a, b in (("Tamsin", "Moreau"), ("Anya", "Brandt"))] * 3 + GENERAL)
    assert kinds("the key is with tamsin, not with brandt", n) == [("person_name", "tamsin"), ("person_name", "brandt")]


def test_cues_are_whole_words():
    for text, want in (("her passport C01X00T47", "C01X00T47"), ("passport number 123456789", "123456789"), ("The pilot 415-555-0132 called", "415-555-0132"), ("the track 415-555-0132", "415-555-0132")):
        assert [text[a:b] for a, b, _ in find_mentions(text, NAMES)] == [want], text
    assert kinds("Seriennummer 415-555-0132, part 415-555-0132.") == []


def test_borders_however_far():
    for m in ("x" * 85 + "@example.org", "a@" + "b" * 200 + ".example.org", " dot ".join(["part"] * 40) + " at mail dot example"):
        assert kinds(f"Write to {m}, please.") == [("email", m)]
    card = "The passport, " + "which is old and " * 30 + "has 123456789 on it."
    assert ("identity_number", "123456789") in kinds(card)


def test_many_mentions_take_linear_time():
    took = []
    for n in (4000, 8000):
        text = " ".join(f"ann{i}@mail.example or 415-555-0{100 + i % 900}," for i in range(n)) + "@" * n
        began = time.process_time()
        assert len(find_mentions(text, NAMES)) == 2 * n
        took.append(time.process_time() - began)
    assert took[1] < 4 * took[0] + 0.2


def test_names_beyond_the_bound_are_joined_to_their_texts(spark, monkeypatch):
    rows = [(f"r{i}", t) for i, t in enumerate([*GENERAL, "it was nkechi who saw abara.", None, ""])]
    df = spark.createDataFrame(rows, "rec_id string, text string")
    sent = {r.rec_id: r.found for r in mentions(df).collect()}
    monkeypatch.setattr(pii, "MOST_NAMES", 0)
    joined = {r.rec_id: r.found for r in mentions(df).collect()}
    assert joined == sent and len(sent["r12"]) == 2


def test_counting_in_spark_equals_counting_at_hand(spark):
    df = spark.createDataFrame([(t,) for t in [*GENERAL, None, ""]], "text string").repartition(3)
    names, table = pii.corpus_names(df)
    here = learn_names(GENERAL)
    assert table is None and (names.sure, names.doubtful, names.things) == (here.sure, here.doubtful, here.things)
    assert names.common <= here.common


RARE = ["Our man will recalibrate it, Mr. Halvorsen said.", "She had to recalibrate the line.", "They recalibrate and rock'n'roll; the Rock'n'Roll fails."]


def test_counts_do_not_depend_on_batches():
    texts = [*GENERAL, *RARE]
    added: dict[str, list[int]] = {}
    for t in texts:
        for w, n in pii.count_words([t]).items():
            added[w] = [a + b for a, b in zip(added.get(w, [0] * len(n)), n, strict=True)]
    assert added == pii.count_words(texts) and added["recalibrate"][0] == 3


def test_words_of_which_each_batch_has_one_are_known(spark):
    df = spark.createDataFrame([(f"r{i}", t) for i, t in enumerate([*GENERAL, *RARE, "hello, this is recalibrate", "Look (Recalibrate Router) up"])], "rec_id string, text string").repartition(20)
    names, _ = pii.corpus_names(df)
    assert "recalibrate" in names.common and names.common == learn_names([r.text for r in df.collect()]).common
    found = {r.rec_id: [m.pii_kind for m in r.found] for r in mentions(df).collect()}
    assert found["r15"] == [] and found["r16"] == []


def test_other_words_beyond_the_bound_are_joined_to_their_texts(spark, monkeypatch):
    more = ["hello, this is recalibrate", "Look (Recalibrate Router) up", "Please ask the Ferrowen Router of Nkechi Abara's Line's Ferry", "Yesterday Rock'n'Roll Pilot and d'Abara'n'Halvorsen met Margaret Halloway", "this is halvorsen's router", None, ""]
    rows = [(f"r{i}", t) for i, t in enumerate([*GENERAL, *RARE, *more, *more])]
    df = spark.createDataFrame(rows, "rec_id string, text string")
    sent = {r.rec_id: r.found for r in mentions(df).collect()}
    assert sent["r15"] == [] and len(sent["r18"]) > 0
    for others, names in ((0, 1000), (3, 1000), (5, 0), (0, 0)):
        monkeypatch.setattr(pii, "MOST_OTHERS", others)
        monkeypatch.setattr(pii, "MOST_NAMES", names)
        assert pii.corpus_names(df)[1] is not None
        assert {r.rec_id: r.found for r in mentions(df).collect()} == sent, (others, names)


def test_redaction_and_placeholders():
    text = "Ring 573.555.0103 or [REDACTED:PHONE], Mr. Moreau."
    assert redact(text, find_mentions(text, NAMES)) == "Ring [REDACTED:PHONE] or [REDACTED:PHONE], Mr. [REDACTED:PERSON_NAME]."


def test_tables(spark):
    rows = [("a", "Ring 573.555.0103.", "x"), ("a", "Ring 573.555.0103.", "x"), ("b", None, "x"), ("c", "", "x"), (None, "x" * 300_000 + " ann@b.example", "x")]
    df = spark.createDataFrame(rows, "rec_id string, text string, found string")
    got = {r.rec_id: r for r in mentions(df).collect()}
    assert got["a"].found[0].start_at == 5 and got["b"].redacted is None and got["b"].found == [] and got["c"].redacted == ""
    assert got[None].found[0].start_at == 300_001
    assert mentions(df.limit(0)).count() == 0
