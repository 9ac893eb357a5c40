"""Per-document text statistics that tell running prose from lists, tables and junk (problem 10).

One pass over whole texts gives each document's statistics and, for each block between blank lines, a score: how dense
common words and clause words (verbs, pronouns, conjunctions) are in it. Mergeable quantile sketches are built per
language, of the statistics and of the scores of well-formed blocks. Values become percentiles and robust z-scores
against the document's language, and the tails are flagged.

A block is running prose when its score is not in the low tail of its language's, where the scale comes from the upper
quarter of the sketch and from well-formed blocks alone, so that junk cannot widen it; a fixed floor holds for any
language. It must be well formed too: some clause words, mostly whole words, and no run of list items or table rows. A
sentence counts once, further copies of it are repetition, those of short ones where they fill more than a small share
of the text. A document is no prose when more than half of its characters are not in such blocks.

Defined results: a null or blank text has zero words and zero prose and is flagged; a single huge line is handled like
any other text; neighbouring blocks of few words are judged together; the language is the one whose common words are
most frequent, whatever is declared, and a text without any has no prose; repeated rows are kept; empty tables give
empty results; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.util import materialize

# Common words by language, and of them the words clauses are built with.
COMMON = {
    "en": "a about after all although an and any as at before between by during each for from in into its many more no of on only or other out over same some such than the their there through to under up upon was were is are be been being had has have did does do would could should shall must may might can not that which who whom whether if when because since though unless until we they it he she this these those never nor so what why",
    "es": "a al ante antes aunque como con contra cual cuando de del desde después donde durante el ella en entre era es esa ese esta este esto está fue fueron ha habían había han hasta la las le les lo los más no nunca o para pero por porque que quien quién según ser si sido sin sobre son su sus también tan un una unos y ya",
    "de": "aber als am an auch auf aus bei beim bis dass das dem den der des die dies diese durch ein eine einem einen einer eines er es für gegen hat hatte haben im in ist kein keine können mit nach nicht nie noch nur ob oder ohne seit sich sie sind so über um und uns unter von vor war waren warum was weil wenn wer werden wie wird worden wurde wurden zu zum zur",
}
CLAUSE = {
    "en": "was were is are be been being had has have did does do would could should shall must may might can not that which who whom whether if when because since although though unless until than we they it he she this these those never nor so what why there",
    "es": "es era fue fueron está han ha había habían ser sido no que quien quién cuando porque aunque como lo le su si nunca cual donde este esto según ya pero",
    "de": "ist war sind waren hat hatte haben wird wurde wurden werden worden nicht dass ob wenn weil da als es er sie sich noch nie können was wie warum uns wer kein",
}
STATISTICS = ["words", "mean_word", "symbol_ratio", "digit_ratio", "line_end_ratio", "common_ratio", "repeat_ratio", "prose_ratio"]
#: Direction in which a statistic's tail speaks against prose, and the robust z-score it starts at.
TAILS = {"symbol_ratio": 1, "digit_ratio": 1, "common_ratio": -1, "repeat_ratio": 1, "line_end_ratio": -1, "prose_ratio": -1}
TAIL_Z = 3.5
SKETCH_K = 400
POINTS = 200
#: Sentences under so many characters recur by chance; their copies are repetition beyond this share of the text.
SHORT = 25
SHORT_SHARE = 0.05

#: Blocks of fewer words are judged together with short neighbours.
FEW_WORDS = 20
#: Share of clause words and of whole words a well-formed block has at least.
LEAST_CLAUSE, LEAST_WHOLE = 0.02, 0.5
#: Words of the blocks whose scores are sketched; shorter blocks vary more, by the root of their words.
REFERENCE = 30
#: Upper quantiles that give the scores' middle and scale, as for a normal distribution, and the least scale, which
#: sampling REFERENCE words alone exceeds.
UPPER, NORMAL, LEAST_SCALE = (0.75, 0.95), (0.6745, 1.6449), 0.08
#: Score below which no block is prose in any language.
FLOOR = 1 / 3
#: Printed tokens whose counts a worker keeps.
TOKENS = 200_000

_LANGS = list(COMMON)
_COMMON = {k: frozenset(v.split()) for k, v in COMMON.items()}
_CLAUSE = {k: frozenset(v.split()) for k, v in CLAUSE.items()}
_SPLIT = re.compile(r"\n[^\S\n]*\n")
_SENTENCE = re.compile(r"(?<=[.!?;:])\s+|\n")
_MARK = re.compile(r"^\s*(?:[-•*>|–]|\(?\d{1,3}[.)\]]?\s|\(?[A-Za-z]\d{0,3}[.)]?\s\s?)")
_EDGES = ".,;:!?()[]{}\"'“”„«»‘’`´§¶…-–—"
_ENDS = ".!?:;\"'”’)"


class _Words(dict):
    """Printed token -> row of ``table``: what it adds to each count, worked out once per distinct token. The columns
    are whole word, letters, digits, length of the token and of the word in it, then common and clause words by
    language."""

    def __init__(self) -> None:
        super().__init__()
        self.table = np.zeros((1024, 5 + 2 * len(_LANGS)), dtype=np.int32)

    def __missing__(self, token: str) -> int:
        n = len(self)
        if n == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        word = token.strip(_EDGES)
        languages = [word in _COMMON[k] for k in _LANGS] + [word in _CLAUSE[k] for k in _LANGS]
        self.table[n] = [word.isalpha(), sum(map(str.isalpha, token)), sum(map(str.isdigit, token)), len(token), len(word), *languages]
        self[token] = n
        return n

    def counts(self, tokens: list[str]) -> np.ndarray:
        if len(self) > TOKENS:
            self.clear()
        rows = np.fromiter(map(self.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        return self.table[rows]


_words = _Words()


def _units(low: str) -> tuple[list[str], list[str], list[int]]:
    """Blocks between blank lines with all tokens and their number in each; neighbouring short blocks make one."""
    blocks, tokens, sizes = [], [], []
    joins = False
    for block in _SPLIT.split(low):
        own = block.split()
        if not own:
            continue
        short = len(own) < FEW_WORDS
        if short and joins:
            blocks[-1] += "\n\n" + block
            sizes[-1] += len(own)
        else:
            blocks.append(block)
            sizes.append(len(own))
        tokens += own
        joins = short
    return blocks, tokens, sizes


def _measure(text: str | None) -> tuple:
    """The statistics of one text, and the words, new characters and scores of its blocks; malformed ones score -1."""
    low = (text or "").lower()
    blocks, tokens, sizes = _units(low)
    if not tokens:
        return ("", 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, len(low), [], [], [])
    counts = _words.counts(tokens)
    whole, letters, digits, printed, length, *_ = counts.sum(0, dtype=np.int64).tolist()
    n_langs = len(_LANGS)
    hits = counts[:, 5 : 5 + n_langs].sum(0).tolist()
    best = int(np.argmax(hits))
    lang = _LANGS[best] if hits[best] else ""
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    per = np.add.reduceat(counts, starts, axis=0) / np.array(sizes)[:, None]
    common, clause = (per[:, 5 + best], per[:, 5 + n_langs + best]) if lang else (np.zeros(len(sizes)), np.zeros(len(sizes)))
    size = len(low)
    lines = ended = 0
    seen: set[str] = set()
    repeated = short = 0
    rows = []
    for k, block in enumerate(blocks):
        own = [x for x in block.split("\n") if x and not x.isspace()]
        lines += len(own)
        ended += sum(x.rstrip()[-1] in _ENDS for x in own)
        form = bool(clause[k] >= LEAST_CLAUSE and per[k, 0] >= LEAST_WHOLE)
        if form and len(own) >= 4 and sum(bool(_MARK.match(x)) for x in own) >= 0.6 * len(own):
            form = False
        fresh = again = 0
        for s in _SENTENCE.split(block):
            key = " ".join(s.split())
            known = key in seen
            seen.add(key)
            if known and len(key) >= SHORT:
                repeated += len(s) + 1
                continue
            fresh += len(s) + 1
            if known and key:
                again += len(s) + 1
        short += again
        rows.append((sizes[k], min(fresh, len(block)), again, float(common[k] + 2 * clause[k]) if form else -1.0))
    if short > SHORT_SHARE * size:
        rows = [(n, max(0, fresh - again), again, score) for n, fresh, again, score in rows]
        repeated += short
    return (
        lang,
        len(tokens),
        length / len(tokens),
        (printed - letters - digits) / size,
        digits / size,
        ended / max(1, lines),
        hits[best] / len(tokens) if lang else 0.0,
        min(1.0, repeated / size),
        0.0 if whole == 0 else 1.0,
        size,
        [r[0] for r in rows],
        [r[1] for r in rows],
        [r[3] for r in rows],
    )


def statistics(documents: DataFrame) -> DataFrame:
    """(doc_id, inferred, *STATISTICS without prose_ratio, size, blocks) of every document's whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, *_measure(t)) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True)]
            out = pd.DataFrame(rows, columns=["doc_id", "inferred", *STATISTICS[:-1], "worded", "size", "b_words", "b_fresh", "b_score"])
            yield out.astype({"words": "float64"})

    numbers = ", ".join(f"{s} double" for s in STATISTICS[:-1])
    rows = documents.select("doc_id", "text").mapInPandas(run, f"doc_id bigint, inferred string, {numbers}, worded double, size bigint, b_words array<int>, b_fresh array<int>, b_score array<double>")
    blocks = F.arrays_zip(F.col("b_words").alias("words"), F.col("b_fresh").alias("fresh"), F.col("b_score").alias("score"))
    return rows.withColumn("blocks", blocks).drop("b_words", "b_fresh", "b_score")


def block_scales(stats: DataFrame) -> DataFrame:
    """(inferred, middle, scale) of the scores of well-formed blocks, '' for all languages together."""
    b = stats.select("inferred", F.explode("blocks").alias("b")).where((F.col("b.score") >= 0) & (F.col("b.words") >= REFERENCE))
    per = materialize(b.groupBy("inferred").agg(F.kll_sketch_agg_double("b.score", SKETCH_K).alias("s")), "block-sketches")
    pooled = per.agg(F.kll_merge_agg_double("s").alias("s"), F.count("*").alias("n")).where("n > 0").select(F.lit("").alias("inferred"), "s")
    q = per.where("inferred <> ''").unionByName(pooled).select("inferred", F.kll_sketch_get_quantile_double("s", F.array(*map(F.lit, UPPER))).alias("q"))
    scale = F.greatest((F.get("q", F.lit(1)) - F.get("q", F.lit(0))) / (NORMAL[1] - NORMAL[0]), F.lit(LEAST_SCALE))
    return q.select("inferred", (F.get("q", F.lit(0)) - NORMAL[0] * scale).alias("middle"), scale.alias("scale"))


def judged(documents: DataFrame) -> DataFrame:
    """(doc_id, inferred, *STATISTICS): the statistics with the share of characters in blocks of running prose."""
    stats = materialize(statistics(documents), "stats")
    scales = block_scales(stats)  # one row per known language and one for all: at most four
    both = stats.join(F.broadcast(scales), "inferred", "left")

    def is_prose(b: Column) -> Column:
        z = (b["score"] - F.col("middle")) / (F.col("scale") * F.sqrt(F.greatest(F.lit(1.0), REFERENCE / F.greatest(b["words"], F.lit(1)))))
        return (b["score"] >= FLOOR) & F.coalesce(z >= -TAIL_Z, F.lit(True))

    new = F.aggregate(F.filter("blocks", is_prose), F.lit(0).cast("bigint"), lambda a, b: a + b["fresh"])
    share = F.when(F.col("size") > 0, F.least(F.lit(1.0), new / F.col("size")) * F.col("worded")).otherwise(0.0)
    return both.withColumn("prose_ratio", share).select("doc_id", "inferred", *STATISTICS)


def sketches(stats: DataFrame) -> DataFrame:
    """Per inferred language (and '' for all together) the quantile points of each statistic, from merged KLL sketches."""
    per = stats.groupBy("inferred").agg(*[F.kll_sketch_agg_double(s, SKETCH_K).alias(s) for s in STATISTICS])
    per = materialize(per, "sketches")
    pooled = per.agg(*[F.kll_merge_agg_double(s).alias(s) for s in STATISTICS], F.count("*").alias("n")).where("n > 0").select(F.lit("").alias("inferred"), *STATISTICS)
    points = F.array(*[F.lit(i / POINTS) for i in range(POINTS + 1)])
    both = per.where("inferred <> ''").unionByName(pooled)
    return both.select("inferred", *[F.kll_sketch_get_quantile_double(F.col(s), points).alias(f"q_{s}") for s in STATISTICS])


def flagged(documents: DataFrame) -> DataFrame:
    """Statistics with ``pct_<s>`` (share of the language's documents at or below), ``z_<s>`` and ``tails``, the names
    of the statistics in a tail that speaks against prose."""
    stats = materialize(judged(documents), "judged")
    q = sketches(stats)  # one row per known language and one for all: at most four
    both = stats.join(F.broadcast(q), "inferred", "left")

    def z(s: str) -> Column:
        points = F.col(f"q_{s}")
        low, mid, high = F.get(points, F.lit(POINTS // 4)), F.get(points, F.lit(POINTS // 2)), F.get(points, F.lit(3 * POINTS // 4))
        return (F.col(s) - mid) / F.greatest((high - low) / 1.349, F.lit(0.005))

    def pct(s: str) -> Column:
        return F.size(F.filter(f"q_{s}", lambda x: x <= F.col(s))) / (POINTS + 1)

    both = both.withColumns({f"z_{s}": z(s) for s in STATISTICS} | {f"pct_{s}": pct(s) for s in STATISTICS})
    tails = F.filter(F.array(*[F.when(F.col(f"z_{s}") * side > TAIL_Z, F.lit(s)) for s, side in TAILS.items()]), lambda x: x.isNotNull())
    return both.withColumn("tails", F.when(F.col("words") == 0, F.array(F.lit("words"))).otherwise(tails)).drop(*[f"q_{s}" for s in STATISTICS])


def not_prose(documents: DataFrame) -> DataFrame:
    """(doc_id) of documents of which more than half of the characters are no running prose."""
    return judged(documents).where(F.col("prose_ratio") < 0.5).select("doc_id")
