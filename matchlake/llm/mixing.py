"""Mixing sources to target weights (problem 9).

Sizes are tokens of a public tokenizer. Each document draws an exponential key divided by its quality weight
(Efraimidis-Spirakis sampling without replacement: the smallest keys are the sample). A source's token budget is met by
complete epochs over all its documents first; what remains is filled in key order up to the budget.

The prefix sum over a source is not one sort: keys fall into ranges, ranges are summed, and only the range in which the
budget ends is sorted. However large a source, one task handles one range.

Defined results: documents with a null source belong to no mix; a null or empty text has no tokens and is never
selected; a source named by the mix without documents contributes nothing and its share is reported as 0; documents of
sources the mix does not name are left out; ties of keys are ordered by doc_id; the same seed gives the same selection in
any partitioning; empty tables give an empty selection.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlake.util import materialize

VOCABULARY = "byte_bpe_50k.tiktoken"
SEED = 20
#: Ranges a source's keys are cut into.
RANGES = 2048
#: Texts are tokenised in pieces of about this many characters to bound memory.
PIECE = 200_000
#: No token reaches over a change from a character to a blank, so pieces cut there have the tokens of the whole text.
_CUT = re.compile(r"(?<=\S)(?=\s)")


def pieces(text: str, about: int = PIECE) -> Iterator[str]:
    at = 0
    while at < len(text):
        cut = _CUT.search(text, min(at + about, len(text)))
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def token_counts(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, source, tokens, quality): tokens of the whole text; quality is the share of letters and blanks."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import public_tokenizers as public
        import tiktoken

        path = vocabulary or public.path(VOCABULARY)
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        bpe = tiktoken.Encoding("mixing", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})

        def size(text: str | None) -> int:
            return sum(len(bpe.encode_ordinary(part)) for part in pieces(text or ""))

        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "quality": pdf["quality"], "tokens": [size(t) for t in pdf["text"]]})

    letters = F.length(F.regexp_replace("text", r"[^\p{L} ]+", ""))
    quality = F.coalesce(letters / F.greatest(F.length("text"), F.lit(1)), F.lit(0.0))
    return documents.select("doc_id", "source", "text", quality.alias("quality")).mapInPandas(count, "doc_id bigint, source string, quality double, tokens bigint")


def mix(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = SEED, ranges: int = RANGES) -> DataFrame:
    """(mix, source, doc_id, uses, tokens): how often each document is used.

    Without ``total_tokens`` a mix is as large as its sources' caps allow all shares to be met.
    """
    sizes = sizes.select("doc_id", "source", "tokens", "quality").where("source is not null and tokens > 0 and doc_id is not null")
    targets = targets.select("mix", "source", "target_share", "max_repeats")
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(2**52)) + 0.5) / float(2**52)
    keyed = sizes.withColumn("key", -F.log(u) / F.pow(F.greatest(F.col("quality"), F.lit(0.01)), F.lit(2.0)))
    # A monotone map of keys to (0, 1); ranges of it are summed first.
    keyed = keyed.withColumn("range", F.floor((1 - F.exp(-F.col("key") / 2)) * ranges).cast("int"))
    keyed = materialize(keyed, "keyed")

    parts = keyed.groupBy("source", "range").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    parts = materialize(parts, "parts")
    have = parts.groupBy("source").agg(F.sum("tokens").alias("available"))
    plan = targets.where("source is not null and target_share > 0").join(have, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    reach = F.when(F.col("available") > 0, F.col("available") * F.greatest("max_repeats", F.lit(1)) / F.col("target_share"))
    size = F.lit(float(total_tokens)) if total_tokens else F.min(reach).over(Window.partitionBy("mix"))
    plan = plan.withColumn("budget", F.floor(F.least(F.coalesce(size, F.lit(0.0)) * F.col("target_share"), (F.col("available") * F.greatest("max_repeats", F.lit(1))).cast("double"))))
    plan = plan.withColumn("epochs", F.when(F.col("available") > 0, F.floor(F.col("budget") / F.col("available"))).otherwise(0)).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("available"))
    plan = plan.select("mix", "source", "epochs", "rest")

    upto = parts.withColumn("before", F.coalesce(F.sum("tokens").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    wanted = plan.join(upto, "source").select("mix", "source", "epochs", "rest", "range", "before", (F.col("before") + F.col("tokens")).alias("after"))
    wanted = wanted.withColumn("how", F.when(F.col("after") <= F.col("rest"), "all").when(F.col("before") < F.col("rest"), "cut").otherwise("none")).where("how <> 'none' or epochs > 0")
    rows = keyed.join(F.broadcast(wanted), ["source", "range"]) if wanted.limit(200_001).count() <= 200_000 else keyed.join(wanted, ["source", "range"])
    rows = rows.select("mix", "source", "doc_id", "tokens", "key", "range", "epochs", "rest", "before", "how")
    whole = rows.where("how = 'all'").select("mix", "source", "doc_id", (F.col("epochs") + 1).cast("int").alias("uses"), "tokens")
    none = rows.where("how = 'none'").select("mix", "source", "doc_id", F.col("epochs").cast("int").alias("uses"), "tokens")
    inside = F.sum("tokens").over(Window.partitionBy("mix", "source", "range").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    cut = rows.where("how = 'cut'").withColumn("upto", F.col("before") + inside).select("mix", "source", "doc_id", (F.col("epochs") + F.when(F.col("upto") <= F.col("rest"), 1).otherwise(0)).cast("int").alias("uses"), "tokens")
    return whole.unionByName(none).unionByName(cut).where("uses > 0")


def reached_shares(selection: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix, source, target_share, actual_share, tokens, documents, most_uses) of every row of ``targets``."""
    got = selection.groupBy("mix", "source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.count("*").alias("documents"), F.max("uses").alias("most_uses"))
    both = targets.select("mix", "source", "target_share").join(got, ["mix", "source"], "left").fillna(0, ["tokens", "documents", "most_uses"])
    total = F.sum("tokens").over(Window.partitionBy("mix"))
    return both.select("mix", "source", "target_share", F.when(total > 0, F.col("tokens") / total).otherwise(0.0).alias("actual_share"), "tokens", "documents", "most_uses")
