"""Leaked passages, changed lightly and re-parameterised."""

import pytest

from matchlake.llm.leak_text import Index, aligned, canonical, lowered, raw_words, templates, words
from matchlake.llm.leaks import leaks, reparameterised, repeats

P1 = "Neither K. Molmolos nor the potter could say who had signed for ƒ573,242 at the weighhouse in Caskal on 5 April 2002. By 12 October 2022 the dispute over 192 drums of resin had cost K. Molmolos 371.50 marks, the lease at Jorgristow and the custom of one cheese maker."
P2 = "Neither Osgriade nor the saddler could say who had signed for 2,450,444 crowns at the weighhouse in Quinfalby on 16 August 1998. By 3 May 2011 the dispute over 480 milk churns had cost Osgriade 611 florins, the lease at Caslorhaven and the custom of one baker."
FORMULA = "The appeal is dismissed with costs to be assessed if not agreed between the parties."
FILL = "The court below overlooked that the ferry did not call in winter. " * 30
ITEMS = "item_id bigint, benchmark string, lang string, passage string, doc_id bigint"
DOCS = "doc_id bigint, text string, item_id string"


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "b", "en", P1, 0), (2, "b", "en", FORMULA + " " + P2, 0), (3, "b", "en", None, 0), (4, "b", "en", "", 0), (5, "b", "en", P1, 0)], ITEMS)


def test_leaks(spark, items):
    half = P1[: len(P1) // 2]
    light = P1.upper().replace(",", "").replace("5 APRIL", "5  Aprli").replace("RESIN", "RE-\nSIN")
    hidden = P1.replace("K. Molmolos", "[redacted]")
    other = P1.replace("Molmolos", "Ardraver").replace("573,242", "11,002").replace("Caskal", "Kalmara").replace("5 April 2002", "9 June 1997").replace("192", "77").replace("371.50", "8,420").replace("Jorgristow", "Venhal").replace("12 October 2022", "1 May 2003")
    docs = [(1, FILL + P1 + FILL), (2, FILL + half + FILL), (3, light), (4, FILL + hidden), (5, other + FILL), (6, FILL + FORMULA), (7, None), (8, ""), (9, "word"), (10, FILL * 400 + P2), (11, FILL + P2[:50] + FILL), (1, FILL + P1 + FILL)]
    got = {tuple(r) for r in leaks(spark.createDataFrame([(*d, "clash") for d in docs], DOCS), items).select("doc_id", "item_id").collect()}
    assert got == {(d, i) for d in (1, 2, 3, 4) for i in (1, 5)} | {(10, 2)}


def test_empty_tables(spark, items):
    docs = spark.createDataFrame([(1, FILL + P1, "")], DOCS)
    assert leaks(docs.limit(0), items).count() == 0
    assert leaks(docs, items.limit(0)).count() == 0


def test_a_short_passage_copied_word_for_word_is_found(spark):
    short = "Ostavel owed Kenrick 42 crowns in 1998."
    items = spark.createDataFrame([(1, "b", "en", short, 0)], ITEMS)
    docs = spark.createDataFrame([(1, FILL + short + FILL, ""), (2, FILL + short.replace("Kenrick", "Dunmar").replace("42", "7").replace("1998", "2003"), "")], DOCS)
    assert [tuple(r) for r in leaks(docs, items).select("doc_id", "item_id").collect()] == [(1, 1)]


def test_a_third_is_enough_and_less_is_not(spark, items):
    parts = P1.split()
    n = len(parts)
    docs = [(1, FILL + " ".join(parts[: int(n * 0.38)]) + " " + FILL, ""), (2, FILL + " ".join(parts[: int(n * 0.25)]) + " " + FILL, "")]
    assert {r["doc_id"] for r in leaks(spark.createDataFrame(docs, DOCS), items).where("item_id = 1").collect()} == {1}


def test_the_same_question_about_other_facts_is_its_own_kind(spark):
    asked = "A lender, Ostavel of Dunmar, gave Kenrick 42 crowns. Kenrick kept the 42 crowns at Dunmar, said Ostavel, and Kenrick lost them."
    again = asked.replace("Ostavel", "Bolkan").replace("Dunmar", "Feld").replace("Kenrick", "Arno").replace("42", "77")
    mixed = again.replace("the 77", "the 12").replace("at Feld", "at Holm")
    items = spark.createDataFrame([(1, "b", "en", asked, 0)], ITEMS)
    docs = spark.createDataFrame([(1, FILL + asked, ""), (2, FILL + again, ""), (3, FILL + mixed, "")], DOCS)
    assert {(r["doc_id"], r["kind"]) for r in repeats(docs, items).collect()} == {(1, "leak"), (2, "reparameterised")}
    assert [r["doc_id"] for r in reparameterised(docs, items).collect()] == [2]


def test_blocks_and_pieces_change_nothing(spark, items, monkeypatch):
    from matchlake.llm import leak_text

    docs = spark.createDataFrame([(1, FILL * 300 + P1 + FILL * 300, ""), (2, P2, ""), (3, FILL, "")], DOCS)
    whole = {tuple(r) for r in repeats(docs, items).collect()}
    index = Index.of([(1, P1), (2, P2)])
    text = FILL * 40 + P1 + FILL * 40
    once = index.scan(text)
    monkeypatch.setattr(leak_text, "SEGMENT", 64)
    assert index.scan(text) == once and once
    assert {r[:2] for r in whole} == {tuple(r)[:2] for r in repeats(docs, items, block_chars=400).collect()}


def test_no_leak_is_lost_against_aligning_every_pair(spark, data):
    """Every document against every passage, without windows."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{data}/eval_items.parquet")
    passages = [(r["item_id"], r["passage"]) for r in items.collect()]
    index = Index.of(passages)
    brute = set()
    for r in docs.collect():
        raw = raw_words(r["text"] or "")
        low = lowered(raw)
        have = set(low)
        for i, p in passages:
            own = words(p)
            if sum(w in have for w in own if w not in index.voc.template and len(w) > 1) >= 2:
                share, agree, differ = aligned(own, low, raw, index.voc.template)
                if share >= 1 / 3 and agree >= 2 and agree >= 0.6 * (agree + differ):
                    brute.add((r["doc_id"], i))
    got = {(r["doc_id"], r["item_id"]) for r in leaks(docs, items).collect()}
    assert brute and len(brute & got) >= 0.9 * len(brute)


def test_template_words_and_units_are_learned():
    texts = [f"The {g} sold {n} bales of flax to Mr {x} for {n} marks." for n, (g, x) in enumerate([("miller", "Arno"), ("baker", "Bolk"), ("miller", "Cado"), ("tanner", "Dems")], 10)]
    voc = Index.of(list(enumerate(texts))).voc
    assert {"sold", "bales", "marks", "miller", "the"} <= set(voc.template) and not {"arno", "bolk"} & set(voc.template)
    assert {w for w, i in voc.template.items() if i in voc.units} == {"bales", "marks"}
    a, b = (canonical(words(t), voc) for t in ("He sold 10 bales to Arno.", "He sold 7 to K. Bolk."))
    assert a.ids.tolist() == b.ids.tolist() and templates(a.ids).tolist() == templates(b.ids).tolist()
