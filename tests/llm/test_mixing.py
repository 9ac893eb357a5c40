"""Selections against caps, budgets and a plain sort."""

import base64
import math
import random

import pytest
import tiktoken
from pyspark.sql import functions as F

from matchlake.llm.mixing import VOCABULARY, mix, pieces, reached_shares, token_counts

TARGETS = "mix string, source string, target_share double, max_repeats int, tokens string"
SIZES = "doc_id bigint, source string, tokens bigint, quality double, key string"


def sizes(spark, n=3000):
    rows = [(i, "hot" if i % 3 else "small" if i % 100 == 0 else "mid", 50 + i % 37, 0.5 + (i % 5) / 10, "clash") for i in range(n)]
    return rows, spark.createDataFrame(rows, SIZES)


def test_shares_caps_and_epochs(spark):
    rows, df = sizes(spark)
    targets = spark.createDataFrame([("m", "hot", 0.5, 1, ""), ("m", "mid", 0.3, 2, ""), ("m", "small", 0.1, 4, ""), ("m", "absent", 0.1, 2, ""), ("one", "small", 1.0, 3, "")], TARGETS)
    picked = mix(df, targets)
    got = picked.collect()
    assert len({(r["mix"], r["doc_id"]) for r in got}) == len(got)
    caps = {"hot": 1, "mid": 2, "small": 4}
    assert all(1 <= r["uses"] <= caps[r["source"]] for r in got if r["mix"] == "m")
    for key in {(r["mix"], r["source"]) for r in got}:
        uses = [r["uses"] for r in got if (r["mix"], r["source"]) == key]
        assert max(uses) - min(uses) <= 1 and (max(uses) == min(uses) or min(uses) >= 1)
    shares = {(r["mix"], r["source"]): r["actual_share"] for r in reached_shares(picked, targets).collect()}
    assert shares[("m", "absent")] == 0 and shares[("one", "small")] == 1
    assert shares[("m", "hot")] / shares[("m", "mid")] == pytest.approx(5 / 3, rel=0.02)
    assert shares[("m", "small")] / shares[("m", "hot")] == pytest.approx(0.2, rel=0.05)


def test_ranges_give_what_one_sort_gives(spark):
    rows, df = sizes(spark, 900)
    targets = spark.createDataFrame([("m", "hot", 0.5, 1, ""), ("m", "mid", 0.5, 1, "")], TARGETS)
    few, many = ({(r["doc_id"], r["uses"]) for r in mix(df, targets, 20_000, ranges=k).collect()} for k in (1, 512))
    assert few == many and few
    keyed = df.select("doc_id", "source", "tokens", (-F.log((F.pmod(F.xxhash64("doc_id", F.lit(20)), F.lit(2**52)) + 0.5) / float(2**52)) / F.pow("quality", F.lit(2.0))).alias("k")).collect()
    want = set()
    for s in ("hot", "mid"):
        total = 0
        for r in sorted((r for r in keyed if r["source"] == s), key=lambda r: (r["k"], r["doc_id"])):
            total += r["tokens"]
            if total > 10_000:
                break
            want.add((r["doc_id"], 1))
    assert few == want


def test_better_documents_are_drawn_more_often(spark):
    df = spark.createDataFrame([(i, "s", 100, 0.9 if i % 2 else 0.3, "") for i in range(4000)], SIZES)
    got = mix(df, spark.createDataFrame([("m", "s", 1.0, 1, "")], TARGETS), 40_000).collect()
    assert sum(r["doc_id"] % 2 for r in got) > 0.75 * len(got) and len(got) == 400


def test_tokens_of_whole_texts(spark):
    pytest.importorskip("public_tokenizers")
    texts = [("word " * 100_000), "", None, "naïve <|endoftext|>", "x" * 450_000]
    docs = spark.createDataFrame([(i, t, "s", "q") for i, t in enumerate(texts)], "doc_id bigint, text string, source string, quality string")
    got = {r["doc_id"]: r["tokens"] for r in token_counts(docs).collect()}
    assert got[1] == got[2] == 0 and got[3] > 5 and math.isclose(got[0], 100_000, rel_tol=0.01) and got[4] > 10_000
    assert mix(token_counts(docs).limit(0), spark.createDataFrame([("m", "s", 1.0, 1, "")], TARGETS)).count() == 0


def test_pieces_have_the_tokens_of_the_whole_text():
    public = pytest.importorskip("public_tokenizers")
    with open(public.path(VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    bpe = tiktoken.Encoding("t", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(4)
    for _ in range(200):
        text = "".join(r.choice(["word", "'s", " ", "  ", "\n", "\t ", "12", ",", "é", "x" * 30, "\u00a0", "...", "Über"]) for _ in range(60))
        parts = list(pieces(text, 7))
        assert "".join(parts) == text and sum(len(bpe.encode_ordinary(p)) for p in parts) == len(bpe.encode_ordinary(text))
