"""Evaluation passages leaking into training text (problem 8).

Passages and documents are canonicalised alike: numbers with their units and names become typed placeholders, the
words of templates stay. The vocabulary is learned from the passages. Windows of five canonical tokens are hashed and
hash-joined on the template alone, so a sentence meets its template whatever it says. Then the slots are checked: where
they hold the passage's own facts the texts are aligned, and a continuous stretch of a third of the passage with its own
facts is a leak; where every fact that recurs is replaced by one and the same other fact, the passage is asked again
about other facts, which is reported as a kind of its own.

Documents are scanned where they lie, once per block of passages: the index of a block, bounded by the characters of its
passages, is broadcast, and the join is a lookup in it. No text and no window is shuffled, so no formula, document or
passage can be hot.

Defined results: null or empty passages and texts leak nothing; a passage without a number or a name has no account of
its own and leaks nothing; texts shorter than a window neither; the same passage under two ids is reported under both;
repeated documents are each reported once per doc_id; of several rows of one id all are searched; very long texts are
searched whole, in overlapping pieces; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm.leak_text import Index

#: Characters of passages in one block; with them the broadcast index of a block stays below some 40 MB.
BLOCK_CHARS = 2_000_000
COLUMNS = "doc_id bigint, item_id bigint, kind string, share double, agreeing int, differing int"


def blocks(items: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[Index]:
    """The index of each block of passages."""
    total = items.agg(F.sum(F.length("passage"))).first()[0] or 0
    n = -(-total // block_chars)
    part = F.pmod(F.xxhash64("item_id"), F.lit(max(1, n)))
    for b in range(n):
        rows = items.where(part == b).orderBy("item_id", "passage").collect()  # a block of bounded size
        yield Index.of([(r["item_id"], r["passage"]) for r in rows])


def scanned(documents: DataFrame, index: Index) -> DataFrame:
    """COLUMNS of every passage of a block that a document repeats or asks again."""
    shared = documents.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, *x) for d, text in zip(pdf["doc_id"], pdf["text"], strict=True) for x in shared.value.scan(text)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in COLUMNS.split(", ")])

    return documents.mapInPandas(run, COLUMNS)


def repeats(documents: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, kind, share, agreeing, differing), one row per document and passage.

    kind is ``leak`` (facts agreeing and differing) or ``reparameterised`` (substitutions kept and broken).
    """
    items = items.where("passage is not null and item_id is not null").select("item_id", "passage")
    texts = documents.where("text is not null and doc_id is not null").select("doc_id", "text")
    found = documents.sparkSession.createDataFrame([], COLUMNS)
    for index in blocks(items, block_chars):
        found = found.union(scanned(texts, index))
    # Rows of one id may repeat, and a leak outdoes the same question about other facts.
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("kind") == "leak", "share", "agreeing", "differing", "kind")).alias("s"))
    return best.select("doc_id", "item_id", "s.kind", "s.share", "s.agreeing", "s.differing")


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, share, agreeing, differing): documents that repeat a passage's own account of its facts."""
    return repeats(documents, items).where("kind = 'leak'").drop("kind")


def reparameterised(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, share, kept): documents that ask a passage's question again about other facts."""
    return repeats(documents, items).where("kind = 'reparameterised'").select("doc_id", "item_id", "share", F.col("agreeing").alias("kept"))
