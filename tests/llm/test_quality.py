"""Text statistics on made-up documents."""

from matchlake.llm import quality
from matchlake.llm.quality import STATISTICS, block_scales, flagged, judged, not_prose, statistics

PROSE = "The court held that the lease could be renewed only once, because the notice had not been given in time. It was said that the tenant did not know of it when he signed. "
SCHEMA = "doc_id bigint, text string, lang string, words string"


def documents(spark, extra=()):
    rows = [(i, PROSE + f"This was decided on day {i}, and there is no reason why it should not stand. " * (1 + i % 2), "en", "") for i in range(60)]
    return spark.createDataFrame(rows + [(1000 + i, t, None, "") for i, t in enumerate(extra)], SCHEMA)


def test_junk_is_found_and_odd_prose_is_not(spark):
    table = "\n".join(f"{i} ; baker ; oak planks ; {i * 7} ; {i}.50" for i in range(60))
    index = "\n".join(f"{i}) Letter from A. Arkan about roof slates, {i} May 2001" for i in range(1, 60))
    junk = [table, index, "9f2g78m2 r090 nl s m1fc7482wo4 " * 60, "There will be no order for costs in this court. \n" * 60, "", None, "   ", "| Home | Next |\n" * 50, PROSE[:100] + "\n\n" + table]
    wrapped = "\n".join(PROSE[i : i + 40] for i in range(0, len(PROSE), 40))
    odd = [PROSE.upper(), wrapped, PROSE.replace("t", "†", 4), "Der Senat hat nicht geprüft, ob die Frist noch lief, weil es darauf nicht ankam und die Klage schon deshalb nicht begründet war.", "El tribunal no dijo que la venta fuera nula, porque el contrato ya se había cumplido cuando las partes lo firmaron."]
    got = {r["doc_id"] for r in not_prose(documents(spark, [*junk, *odd])).collect()}
    assert got == {1000 + i for i in range(len(junk))}


def test_junk_is_found_however_much_of_it_there_is(spark):
    tables = ["\n".join(f"{i} ; the cost of {k} planks ; {i * k} ; {i}.50" for i in range(20 + k)) for k in range(60)]
    assert {r["doc_id"] for r in not_prose(documents(spark, tables)).collect()} == {1000 + k for k in range(60)}


def test_mere_repetition_is_no_prose(spark):
    short = "It was so. He did not go. They were not there. "
    texts = [PROSE * 3, PROSE * 4, "\n\n".join([PROSE] * 3), "It is so ordered. " * 400, short * 3, PROSE, PROSE + "It is so ordered. It is so ordered."]
    got = {r["doc_id"]: r["prose_ratio"] for r in judged(documents(spark, texts)).collect()}
    assert all(got[1000 + i] < 0.5 for i in range(5)) and got[1005] > 0.9 and got[1006] > 0.8
    assert {r["doc_id"] for r in not_prose(documents(spark, texts)).collect()} == {1000, 1001, 1002, 1003, 1004}


def test_statistics_and_repeats(spark):
    df = documents(spark, ["One two. Three", "x" * 300_000])
    got = {r["doc_id"]: r for r in statistics(df.union(df)).collect()}
    assert statistics(df.union(df)).count() == 124
    assert got[1000]["words"] == 3 and abs(got[1000]["mean_word"] - 11 / 3) < 1e-9 and got[1001]["words"] == 1
    assert got[0]["inferred"] == "en"
    f = flagged(df).collect()
    assert all(0 <= r[f"pct_{s}"] <= 1 for r in f for s in STATISTICS)


def test_empty_table(spark):
    assert not_prose(documents(spark).limit(0)).count() == 0


def test_short_blocks_are_judged_together(spark):
    short = ["He did not go.", "They were not there.", "It was so.", "She had it when he came.", "We could not see why.", "That is what they said.", "He was to stay with us.", "If it is so, why not?"]
    text = "\n\n".join(short + [f"He said that he was {w} then." for w in "old new red big sad shy wet dry hot odd".split()])
    assert judged(documents(spark, [text])).where("doc_id = 1000").first()["prose_ratio"] > 0.9


def test_the_sketches_decide(spark, monkeypatch):
    listed = "Of the barge, to the north of a quay: tar, flax, hemp and rope, oak planks, lime; roof slates, cork, the glass, and in store what was old. "
    docs = documents(spark, [listed * 1 + "\n\n" + listed.replace("barge", "ferry").replace("tar", "ore")])
    score = [b["score"] for b in statistics(docs).where("doc_id = 1000").first()["blocks"]]
    assert all(s > quality.FLOOR for s in score)  # the fixed floor alone takes it for prose
    scale = {r["inferred"]: r for r in block_scales(statistics(docs)).collect()}["en"]
    assert all(s < scale["middle"] - quality.TAIL_Z * scale["scale"] for s in score)
    assert [r["doc_id"] for r in not_prose(docs).collect()] == [1000]


def test_declared_languages_do_not_matter_and_null_ones_neither(spark):
    rows = [(1, PROSE, "de", ""), (2, PROSE, None, ""), (3, PROSE, "xx", "")]
    got = judged(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["inferred"] for r in got} == {"en"} and len({r["prose_ratio"] for r in got}) == 1
