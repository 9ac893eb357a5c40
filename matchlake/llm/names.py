"""Linking typed spellings to the names they refer to (problem 5).

Distinct spellings are linked, not rows. A symmetric-delete index over tokens brings together words within a few edits:
both sides leave out up to two characters and meet where the hashes of what remains are equal; words cut by a dot meet
the beginnings of known words. Known names reached by a word are then aligned with the spelling token by token, by the
optimal assignment that permits initials, abbreviations, slips, any order and club affixes. A spelling is linked when
one name is clearly cheapest.

Words that very many names share say what kind of club it is; they are learned from the names, beside the usual ones,
and reach no name by themselves. Any other word is in less than COMMON of the names, which bounds how many names a
spelling meets.

Defined results: null and empty spellings, and those made of kind words only, link to nothing; spellings equal to a name
are not looked at; other squads of a club and two names at the same cost link to nothing; a spelling may be of any
length, but one with more words than the longest name, affixes aside, or a word longer than the longest known one by more
than the edits allowed, can stand for none; repeated rows are each linked; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm.names_align import AFFIXES, FAR, USUAL, align, edits_allowed, is_kind, token_cost, tokens
from matchlake.util import lookup_join, materialize

#: Shortest cut word that is looked up by its beginning.
BEGINNING = 4
#: A word is a kind from this share of the names and this number of them on; at most 1 / COMMON words per word of a name.
COMMON, LEAST = 0.01, 3
#: Spellings up to which a lookup of them is broadcast once their rows were counted: some 25 MB.
SPELLINGS = 250_000
#: Words longer than this are indexed by their two ends, of which one has at most one of two edits.
LONG, END = 40, 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over as many tasks as a shuffle has: the steps that follow cost much more than their bytes suggest."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _powers(n: int) -> np.ndarray:
    out, p = [], 1
    for _ in range(n):
        out.append(p)
        p = p * _BASE & _MASK
    return np.array(out, dtype=np.uint64)


def delete_hashes(words: list[str], most: int) -> np.ndarray:
    """Hashes of what each of ``words``, all of one length, leaves with up to ``most`` characters (2 at most) left out.

    A polynomial in the characters: what stands behind a gap moves up by one power, so all gaps come from three prefix
    sums.
    """
    n = len(words[0])
    with np.errstate(over="ignore"):
        codes = np.array([[ord(c) + 1 for c in w] for w in words], dtype=np.uint64).reshape(len(words), n)
        power = _powers(n)
        sums = []
        for shift in range(most + 1):
            part = np.zeros((len(words), n + 1), dtype=np.uint64)
            if n > shift:
                part[:, shift + 1 :] = np.cumsum(codes[:, shift:] * power[: n - shift], axis=1, dtype=np.uint64)
            sums.append(part)
        out = [sums[0][:, n :]]
        if most >= 1 and n >= 1:
            i = np.arange(n)
            out.append(sums[0][:, i] + (sums[1][:, n :] - sums[1][:, i + 1]))
        if most >= 2 and n >= 2:
            i, j = np.triu_indices(n, 1)
            out.append(sums[0][:, i] + (sums[1][:, j] - sums[1][:, i + 1]) + (sums[2][:, n :] - sums[2][:, j + 1]))
        return np.concatenate(out, axis=1)


def _variants(parts: list[tuple[int, str, int, int]]) -> list[tuple[int, np.ndarray]]:
    """(row, hashes) of ``(row, text, edits, side)``; texts of one length, edits and side are hashed together."""
    groups: dict[tuple[int, int, int], list[tuple[int, str]]] = {}
    for row, text, edits, side in parts:
        groups.setdefault((len(text), edits, side), []).append((row, text))
    out = []
    for (_, edits, side), members in groups.items():
        hashes = delete_hashes([t for _, t in members], edits)
        with np.errstate(over="ignore"):
            hashes = ((hashes ^ np.uint64(side * 0x5851F42D4C957F2D & _MASK)) * np.uint64(0xC2B2AE3D27D4EB4F)).view(np.int64)
        out += [(row, h) for (row, _), h in zip(members, hashes, strict=True)]
    return out


def _parts(row: int, word: str, cut: bool, known: bool) -> list[tuple[int, str, int, int]]:
    """What of a word is hashed: the whole, the beginnings a cut word may stand for, the ends of a long one."""
    n = len(word)
    out = []
    if n <= LONG:
        out.append((row, word, edits_allowed(n), 0))
        if known:
            out += [(row, word[:k], 1, 1) for k in range(BEGINNING - 1, n)]
        elif cut and n >= BEGINNING:
            out.append((row, word, 1, 1))
    if n > LONG - 3:
        out += [(row, word[:END], 2, 2), (row, word[-END:], 2, 3)]
        if known:
            out += [(row, word[:k], 1, 1) for k in range(LONG, n)]
        elif cut and n > LONG:
            out.append((row, word, 1, 1))
    return out


def _hashed(words: DataFrame, known: bool) -> DataFrame:
    """(word, cut, variant) or, of known words, (known, variant)."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = [x for i, (w, c) in enumerate(zip(pdf["word"], pdf["cut"], strict=True)) for x in _parts(i, w, bool(c), known)]
            got = _variants(parts)
            rows = [row for row, _ in got]
            yield pd.DataFrame({"word": pdf["word"].to_numpy()[rows], "cut": pdf["cut"].to_numpy()[rows], "variants": [h for _, h in got]})

    out = words.mapInPandas(emit, "word string, cut boolean, variants array<bigint>")
    if known:
        return out.select(F.col("word").alias("known"), F.explode("variants").alias("variant"))
    return out.select("word", "cut", F.explode("variants").alias("variant"))


def learned_kinds(names: DataFrame) -> frozenset[str]:
    """Usual kinds and the words COMMON names have; a bounded set."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(w,) for text in pdf["name"] for w in {t for t, _ in tokens(text)} if w != "the"], columns=["word"])

    distinct = names.where("name is not null").select("name").distinct()
    n = distinct.count()
    often = distinct.mapInPandas(cut, "word string").groupBy("word").count().where(F.col("count") >= max(float(LEAST), COMMON * n))
    return frozenset(USUAL.split()) | {r["word"] for r in often.select("word").collect()}


def _words(df: DataFrame, column: str, kinds: frozenset[str], most: int | None = None) -> DataFrame:
    """(column, word, cut, long) for each word that is not a plain kind word; ``long`` is the number of tokens.

    Texts with more than ``most`` tokens, affixes aside, are left out: none of them can stand for a name.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf[column]:
                own = tokens(text)
                if most is None or sum(t not in AFFIXES for t, _ in own) <= most:
                    rows += [(text, w, c, len(own)) for w, c in dict.fromkeys(own) if not is_kind(w, kinds) and w != "the"]
            yield pd.DataFrame(rows, columns=[column, "word", "cut", "long"])

    return df.select(column).mapInPandas(cut, f"{column} string, word string, cut boolean, long int")


def near_words(typed: DataFrame, known: DataFrame) -> DataFrame:
    """(word, cut, known): admissible pairs of typed and known words."""
    longest = known.agg(F.max(F.length("word"))).first()[0] or 0
    asked = typed.where(F.length("word") <= longest + 3).select("word", "cut").distinct()
    index = _hashed(_spread(known.select("word").distinct().withColumn("cut", F.lit(False)), "word"), True)
    # An index is many times its words, which the planner cannot know: never broadcast it.
    met = _hashed(_spread(asked, "word"), False).hint("merge").join(index.hint("merge"), "variant").select("word", "cut", "known").distinct()

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[[token_cost(w, bool(c), k, False) is not None for w, c, k in zip(pdf["word"], pdf["cut"], pdf["known"], strict=True)]]

    # What a whole word leaves cannot be further off than this; a cut one stands for a beginning.
    near = F.col("cut") | (F.levenshtein("word", "known", 6) >= 0)
    return met.where(near).mapInPandas(keep, "word string, cut boolean, known string")


def candidates(spellings: DataFrame, names: DataFrame, kinds: frozenset[str]) -> DataFrame:
    """(typed, met) with the names a spelling reaches by a word, or by two where a name is made of common words."""
    known = materialize(_words(names.select("name").distinct(), "name", kinds), "known")
    most = known.agg(F.max("long")).first()[0] or 0
    words = materialize(_words(_spread(spellings.where("typed is not null"), "typed"), "typed", kinds, most + 1), "words")
    reached = words.join(near_words(words, known.select("word")), ["word", "cut"]).select("typed", "known").distinct()

    entries = known.join(names, "name").select("id", "name", "whole", "word")
    by_one = entries.where(~F.col("whole")).select(F.col("word").alias("known"), "id", "name").distinct()
    one = reached.join(by_one, "known").select("typed", "id", "name")
    # Both sides have at most as many words as the longest name.
    pair_of = F.flatten(F.transform("ws", lambda a: F.transform(F.filter("ws", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    twos = entries.where("whole").groupBy("id", "name").agg(F.sort_array(F.collect_set("word")).alias("ws"))
    by_two = twos.select("id", "name", F.explode(pair_of).alias("p"))
    common = reached.join(entries.where("whole").select(F.col("word").alias("known")).distinct(), "known", "left_semi")
    typed_twos = common.groupBy("typed").agg(F.sort_array(F.collect_set("known")).alias("ws")).select("typed", F.explode(pair_of).alias("p"))
    both = one.union(typed_twos.join(by_two, "p").select("typed", "id", "name"))
    return both.groupBy("typed").agg(F.collect_set(F.struct("id", "name")).alias("met"))


def clearest(typed: str, met: Iterable[tuple[int, str]], kinds: frozenset[str]) -> tuple[int, float] | None:
    """(id, cost) of the name that is cheapest to align with, where the next id costs clearly more."""
    cost: dict[int, float] = {}
    for i, name in met:
        c = align(typed, name, kinds)
        if c is not None:
            cost[i] = min(c, cost.get(i, c))
    order = sorted((c, i) for i, c in cost.items())
    if not order or (len(order) > 1 and order[1][0] - order[0][0] < FAR):
        return None
    return order[0][1], order[0][0]


def link(spellings: DataFrame, names: DataFrame) -> DataFrame:
    """(typed, id, cost) of ``spellings(typed)``, distinct, against ``names(id, name, whole)``.

    ``whole`` marks names whose words are common ones, such as nicknames: they are reached by two of their words, not
    by a single one.
    """
    kinds = learned_kinds(names.where(~F.col("whole")))

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(t, *got) for t, met in zip(pdf["typed"], pdf["met"], strict=True) if (got := clearest(t, ((x["id"], x["name"]) for x in met), kinds))]
            yield pd.DataFrame(rows, columns=["typed", "id", "cost"])

    return candidates(spellings, names, kinds).mapInPandas(pick, "typed string, id bigint, cost double")


def team_names(teams: DataFrame) -> DataFrame:
    own = teams.where("name is not null").select(F.col("team_id").cast("bigint").alias("id"), "name", F.lit(False).alias("whole"))
    nick = teams.where("nickname is not null").select(F.col("team_id").cast("bigint").alias("id"), F.col("nickname").alias("name"), F.lit(True).alias("whole"))
    return own.unionByName(nick)


def sides(history: DataFrame) -> DataFrame:
    """(row_id, side, typed), two rows per match record."""
    return history.select("row_id", F.explode(F.array(F.struct(F.lit("home").alias("side"), F.col("home").alias("typed")), F.struct(F.lit("away").alias("side"), F.col("away").alias("typed")))).alias("s")).select("row_id", "s.side", "s.typed")


def linked_spellings(history: DataFrame, teams: DataFrame) -> DataFrame:
    """(typed, team_id) of every distinct spelling of ``history`` that is not a team's exact name but refers to it."""
    typed = sides(history).select("typed").where("typed is not null").distinct()
    new = typed.join(teams.select(F.col("name").alias("typed")), "typed", "left_anti")
    return materialize(link(new, team_names(teams)).select("typed", F.col("id").alias("team_id")), "linked")


def linked_sides(history: DataFrame, teams: DataFrame) -> DataFrame:
    """(row_id, side, team_id) of every side typed otherwise than the name of the team it refers to."""
    return lookup_join(sides(history), linked_spellings(history, teams), ["typed"], "inner", limit=SPELLINGS, held=True).select("row_id", "side", "team_id")


def all_spellings(history: DataFrame, teams: DataFrame) -> DataFrame:
    """(typed, team_id) of exact names and linked spellings alike, one row per spelling."""
    exact = teams.where("name is not null").groupBy(F.col("name").alias("typed")).agg(F.min("team_id").cast("bigint").alias("team_id"))
    return linked_spellings(history, teams).unionByName(exact)


def recall(history: DataFrame, teams: DataFrame, every: int = 100, block: int = 20_000) -> DataFrame:
    """(asked, brute_force, found, recall): spellings of the rows whose id is divisible by ``every``, aligned with every
    name, in blocks of names, without the index, against what the index links."""
    names = materialize(team_names(teams), "names")
    kinds = learned_kinds(names.where(~F.col("whole")))
    asked = sides(history.where(F.col("row_id") % every == 0)).select("typed").where("typed is not null").distinct()
    asked = materialize(asked.join(teams.select(F.col("name").alias("typed")), "typed", "left_anti"), "asked")
    n = -(-names.count() // block)
    met = None
    for b in range(n):
        rows = names.where(F.pmod(F.xxhash64("name"), F.lit(n)) == b).select("id", "name").collect()  # a block of bounded size
        shared = history.sparkSession.sparkContext.broadcast([(r["id"], r["name"]) for r in rows])

        def every_name(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = [(t, i, name) for t in pdf["typed"] for i, name in shared.value if align(t, name, kinds) is not None]
                yield pd.DataFrame(rows, columns=["typed", "id", "name"])

        part = _spread(asked, "typed").mapInPandas(every_name, "typed string, id bigint, name string")
        met = part if met is None else met.union(part)
    if met is None:
        return asked.agg(F.count("*").alias("asked"), F.lit(0).cast("bigint").alias("brute_force"), F.lit(0).cast("bigint").alias("found"), F.lit(None).cast("double").alias("recall"))

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(t, got[0]) for t, m in zip(pdf["typed"], pdf["met"], strict=True) if (got := clearest(t, ((x["id"], x["name"]) for x in m), kinds))]
            yield pd.DataFrame(rows, columns=["typed", "true_id"])

    brute = met.groupBy("typed").agg(F.collect_set(F.struct("id", "name")).alias("met")).mapInPandas(pick, "typed string, true_id bigint")
    both = asked.join(brute, "typed", "left").join(link(asked, names).select("typed", "id"), "typed", "left")
    counts = both.agg(F.count("*").alias("asked"), F.count("true_id").alias("brute_force"), F.count_if(F.col("true_id") == F.col("id")).alias("found"))
    return counts.withColumn("recall", F.try_divide("found", "brute_force"))
