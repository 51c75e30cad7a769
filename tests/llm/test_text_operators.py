"""Splitting, tokens, leaks, quality, mapping: edge cases and brute force."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from voxloom.llm import leaks, mapping, quality, splitting, tokenizing


# -- splitting ---------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n!?é😀", max_size=700), st.integers(20, 90), st.integers(0, 15))
def test_pieces_cover_exactly(text, limit, overlap):
    pieces = splitting.split_text(text, limit, overlap)
    assert all(0 < e - s <= limit for s, e in pieces)
    if pieces:
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (s, e), (s2, e2) in zip(pieces, pieces[1:], strict=False):
        assert s < s2 <= e < e2 and e - s2 <= overlap
        assert overlap == 0 or s2 < e


def test_cuts_at_the_most_natural_place():
    text = "\n".join(f"{'agent' if i % 2 else 'customer'}: {'word ' * 80}end." for i in range(8))
    pieces = splitting.split_text(text)
    assert len(pieces) > 2 and all(text[e - 1] == "\n" for _, e in pieces[:-1])
    solid = splitting.split_text("x" * 3000)
    assert [e - s for s, e in solid][:-1] == [1080] * (len(solid) - 1) or all(e - s <= 1200 for s, e in solid)


def test_pieces_of_tables(spark):
    long = "é" * 1201
    segments = spark.createDataFrame([("S1", long, "x"), ("S1", long, "x"), ("S2", "é" * 1200, "x"), ("S3", None, "x"), ("S4", "", "x")], "segment_id string, text string, turn_pos string")
    calls = spark.createDataFrame([("C1", [("a", "b" * 1300, None, None), None, ("a", None, None, None)]), ("C2", None), ("C3", [])], "call_id string, turns array<struct<speaker: string, text: string, start_time: double, speaker_confidence: double>>")
    rows = splitting.oversized_pieces(segments, calls).collect()
    assert {(r.rec_id, r.turn_pos) for r in rows} == {("S1", -1), ("C1", 0)}
    assert len(rows) == 4
    assert splitting.oversized_pieces(segments.limit(0), calls.limit(0)).count() == 0


# -- tokens ------------------------------------------------------------------


@pytest.fixture(scope="module")
def both():
    path = tokenizing.default_vocabulary()
    real = Tokenizer.from_file(path)
    real.encode_special_tokens = True
    return tokenizing.BytePairCodec(path), real


def agree(both, texts):
    codec, real = both
    offsets, values = codec.encode_batch(texts)
    ours = [values[offsets[i] : offsets[i + 1]].tolist() for i in range(len(texts))]
    assert ours == [e.ids for e in real.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_any_text_is_encoded_alike(both, texts):
    agree(both, texts)


def test_spaces_specials_and_long_words(both):
    rng = random.Random(1)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    agree(both, [None, "", " ", "\n\n a  b\t\n c", "a\t b c\x1cd", "<|endoftext|>", "x" * 20_000, "ab" * 9000, " ".join(words), "é" * 5000])


def test_ids_of_a_table(spark, both):
    df = spark.createDataFrame([(1, "hello world", "z"), (2, None, "z"), (3, "", "z"), (1, "hello world", "z"), (None, "a", "z")], "doc_id long, text string, ids string")
    rows = tokenizing.encode_corpus(df).collect()
    assert len(rows) == 5 and [r.ids for r in rows if r.doc_id in (2, 3)] == [[], []]
    assert next(r.ids for r in rows if r.doc_id == 1) == both[1].encode("hello world").ids
    assert tokenizing.encode_corpus(df.limit(0)).count() == 0


# -- leaks -------------------------------------------------------------------


def test_tiles_cover_reordered_text():
    item = np.arange(1, 41)
    doc = np.concatenate([[0] * 5, item[20:], [0] * 3, item[:20], [0] * 4])
    tiles = leaks.greedy_tiles(leaks.common_seeds(doc, item, 4), len(doc), len(item), 4)
    assert sum(n for *_, n in tiles) == 40
    assert leaks.passage(tiles, doc, item) == 20


def test_tiles_never_overlap_and_match():
    rng = np.random.default_rng(3)
    for _ in range(40):
        doc, item = rng.integers(0, 4, 60), rng.integers(0, 4, 30)
        tiles = leaks.greedy_tiles(leaks.common_seeds(doc, item, 3), 60, 30, 3)
        d, i = np.zeros(60, int), np.zeros(30, int)
        for a, b, n in tiles:
            assert n >= 3 and (doc[a : a + n] == item[b : b + n]).all()
            d[a : a + n] += 1
            i[b : b + n] += 1
        assert d.max(initial=0) <= 1 and i.max(initial=0) <= 1


def test_leaked_items(spark):
    rng = random.Random(4)
    item = [f"w{i}" for i in range(60)]
    noise = lambda n: [f"n{rng.randrange(999)}" for _ in range(n)]
    tenth = [w if k % 10 else "zz" for k, w in enumerate(item)]
    cases = {
        1: noise(30) + item + noise(20),
        2: noise(10) + tenth + noise(10),
        3: item[:29] + noise(40),  # less than half
        4: item[:32] + noise(40),
        5: item[40:] + noise(5) + item[20:40] + noise(5) + item[:20],  # no passage in order
        6: [w.upper() + "!" for w in item],
    }
    docs = spark.createDataFrame([(k, " ".join(w), "x") for k, w in cases.items()] + [(7, None, "x"), (8, "", "x"), (9, "  ", "x"), (1, " ".join(cases[1]), "x"), (10, "w1 " * 200_000, "x")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(100, " ".join(item), "s"), (100, " ".join(item), "s"), (101, None, "s"), (102, "", "s"), (103, "two words", "s")], "item_id long, item_text string, doc_id string")
    rows = leaks.leaked_items(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in rows if r.passage_share >= leaks.SHARE} == {(1, 100), (2, 100), (4, 100), (6, 100)}
    # In any order the tiles cover the reordered one whole.
    assert {(r.doc_id, r.cover) for r in rows if r.passage_share < leaks.SHARE} == {(5, 1.0)}
    assert leaks.leaked_items(docs.limit(0), items).count() == 0 and leaks.leaked_items(docs, items.limit(0)).count() == 0


def test_short_items_are_found(spark):
    texts = {1: "the quick brown fox jumps", 2: "a quick fox", 3: "Yes!", 4: "one two three four five six", 5: "no"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    items = spark.createDataFrame([(1, "quick brown fox"), (2, "yes"), (3, "zero two three four nine ten"), (4, "never seen here")], "item_id long, item_text string")
    assert {(r.doc_id, r.item_id) for r in leaks.leaked_items(docs, items).filter("passage_share >= 0.5").collect()} == {(1, 1), (3, 2), (4, 3)}


def test_a_quotation_elsewhere_takes_no_words_from_the_passage():
    item = [f"w{i}" for i in range(100)]
    passage = [w if k % 10 else "changed" for k, w in enumerate(item)]
    block = leaks.ItemBlock([7], [" ".join(item)])
    ((_, _, cover, share),) = block.find([(1, " ".join([*passage, *(f"n{i}" for i in range(50)), *item[40:60]]))])
    assert cover >= 0.9 and share >= 0.9


def test_blocks_of_items_find_the_same(spark, monkeypatch):
    texts = [" ".join(f"t{k}w{i}" for i in range(30)) for k in range(9)]
    docs = spark.createDataFrame([(k, "x " + t + " y") for k, t in enumerate(texts)], "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, item_text string")
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 60)
    assert {tuple(r)[:2] for r in leaks.leaked_items(docs, items).collect()} == {(k, k) for k in range(9)}


# -- quality -----------------------------------------------------------------

PROSE = "We moved the unit to another room, but it still fails when the lights are on. Could you please tell us what to do?\n"
LIST = "- fan tray\n- power module\n- uplink port (3)\n- lobby handset\n"
TABLE = "| a | b | c |\n|---|---|---|\n| 12 | 4% | ok |\n| 3.1 | n/a | fail |\n"
JUNK = "4f 8a 00 1c 9d\n%%$#@!<<>>~~^^||\nqxzkjw vbnmpt zzkrtw\n"


def corpus():
    return [(k, t * (1 + k % 4), "z") for k, t in enumerate([PROSE, LIST, TABLE, JUNK] * 20)]


def test_classes_and_edges(spark):
    rows = [*corpus(), (100, None, "z"), (101, "", "z"), (102, " \n\t ", "z"), (103, PROSE * 2000, "z"), (0, PROSE, "z"), (104, PROSE * 4 + LIST, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string")
    got = {r.doc_id: r for r in quality.document_quality(df).collect()}
    assert [got[k].doc_class for k in range(4)] == ["prose", "list", "table", "junk"]
    assert [got[k].doc_class for k in (100, 101, 102)] == [None] * 3 and got[100].n_words == 0
    assert got[103].doc_class == got[104].doc_class == "prose"
    assert got[0].n_words == 24 and got[0].punctuated_lines == 1.0
    assert quality.document_quality(df.limit(0)).count() == 0


def test_posteriors_against_the_plain_recursion():
    rng = np.random.default_rng(5)
    model = quality.LineModel(np.log(np.full(4, 0.25)), np.log(rng.dirichlet(np.ones(4), 4)), [])
    owner = np.repeat([0, 1, 2], [1, 5, 9])
    scores = rng.normal(size=(15, 4))
    got = model.posteriors(scores, owner)
    for o in range(3):
        e = np.exp(scores[owner == o])
        step = np.exp(model.move)
        f, b = [0.25 * e[0]], [np.ones(4)]
        for t in range(1, len(e)):
            f.append((f[-1] @ step) * e[t])
        for t in range(len(e) - 1, 0, -1):
            b.append(step @ (e[t] * b[-1]))
        p = np.array(f) * np.array(b[::-1])
        assert np.allclose(got[owner == o], p / p.sum(axis=1, keepdims=True))


# -- mapping -----------------------------------------------------------------

CATALOG = [("QO250", "Quorvane 250 Edge Router", ["qo250", "qo-250", "quorvane router", "the 250 router"], ["router"]), ("HL640", "Halcyra 640 Desk Phone", ["hl640", "halcyra phone", "the 640 phone"], ["phone"]), ("ZZ1", None, None, None)]


def test_hints(spark):
    want = {
        "QO250": "QO250", " qo-250 ": "QO250", "Q O 2 5 0": "QO250", "QO25O": "QO250", "ＱＯ２５０": "QO250", "Quörvané 250": "QO250", "Quorvnae 250 ruoter": "QO250",
        "router quorvane 250": "QO250", "Quor. 250 rtr": "QO250", "SKU:HL640; qty 1": "HL640", "HL640 fw 2.4.3": "HL640", "customer's Halcyra 640 (lobby)": "HL640", "the 640 phone": "HL640",
        "Halcyra 895 Desk Phone": "UNMATCHED", "HL295": "UNMATCHED", "router": "UNMATCHED", "12345": "UNMATCHED", " ": "UNMATCHED", "Dorvex 900 modem": "UNMATCHED", "x" * 5000: "UNMATCHED", "it's a {brace} \\ 'quote'": "UNMATCHED",
    }
    rows = [(f"C{k}", h, "n") for k, h in enumerate(want)] + [("N1", None, "n"), ("N2", "", "n"), ("C0", "QO250", "n")]
    calls = spark.createDataFrame(rows, "call_id string, product_hint string, product_id string")
    cat = spark.createDataFrame(CATALOG, "product_id string, canonical_name string, aliases array<string>, generic_aliases array<string>")
    got = {r.call_id: r.product_id for r in mapping.map_hints(calls, cat).collect()}
    assert got == {f"C{k}": p for k, p in enumerate(want.values())}
    assert {r.product_id for r in mapping.map_hints(calls, cat.limit(0)).collect()} == {"UNMATCHED"}
    assert mapping.map_hints(calls.limit(0), cat).count() == 0


def test_pigeonhole_finds_all_within_the_edits(spark):
    rng = random.Random(6)
    ref = "quorvane250edgerouter"
    keys = set()
    while len(keys) < 300:
        s = list(ref)
        for _ in range(rng.randrange(1, 4)):
            i = rng.randrange(len(s))
            s[i : i + 1] = rng.choice([[], [rng.choice("abc")], [s[i], rng.choice("abc")]])
        keys.add("".join(s))
    refs = spark.createDataFrame([("P", ref, len(ref), 2)], "product_id string, ref string, ref_len int, k int")
    frame = spark.createDataFrame([(k, k, len(k)) for k in keys], "product_hint string, key string, key_len int")
    got = {r.product_hint for r in mapping._run(spark, mapping.matches_sql(), refs=refs, keys=frame).collect()}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    assert got == {k for k in keys if edits(k, ref) <= 2 and "".join(filter(str.isdigit, k)) == "250"}
