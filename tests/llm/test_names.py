"""Name linking: single alignments, and the index against aligning every pair."""

import random
from itertools import combinations, permutations

import pytest

from matchlake.llm.names import delete_hashes, linked_sides, recall
from matchlake.llm.names_align import USUAL, align, assignment, distance

TEAMS = [
    (1, "Dynamo Fafaborkel", None),
    (2, "Corkelhelsol United", None),
    (3, "Dynamo Corkelhelsol", None),
    (4, "FC Zatra-qualen", None),
    (5, "Union Trani Selda", "The Cobalt Plovers"),
    (6, "Bortídrazor", None),
    (7, "Gordiniwél Wanderers", "Misty Beavers"),
    (8, "Balatelfi 1908", None),
]
YES = [
    ("D. Fafaborkel", 1),
    ("Fafaborkel", 1),
    ("FAFABORKEL, DYNAMO", 1),
    ("Dnyamo Fafaborkel F.C.", 1),
    ("Dyn. Fafabor.", 1),
    ("Corkelhelsol Utd", 2),
    ("Corkelhelsol U.", 2),
    ("Corkelhelsol (Dynamo)", 3),
    ("F.C. Zatra-qualen", 4),
    ("  Zatra-qualen", 4),
    ("Trani Sel., Union", 5),
    ("Cobalt Plovers", 5),
    ("The Cobalt Plvoers", 5),
    ("Bort\\u00eddrazor", 6),
    ("Bortidrazor SC", 6),
    ("Gordiniwel Wdrs", 7),
    ("AFC Gordiniwél\xa0Wanderers", 7),
    ("1908 Balateli", 8),
]
NO = ["Corkelhelsol", "Dynamo Fafaborkel B", "Dynamo Fafaborkel U21", "Fafaborkel Women", "Racing Fafaborkel", "Lininelmu 1908", "Dynamo", "Trani Nord", "", "  ", None, "x" * 100_000, "Cobalt Beavers"]
KINDS = frozenset(USUAL.split())
SCHEMA = "row_id bigint, home string, away string, typed string"


@pytest.fixture(scope="module")
def teams(spark):
    return spark.createDataFrame(TEAMS, "team_id bigint, name string, nickname string")


def test_variants_and_non_variants(spark, teams):
    rows = [(i, t, n) for i, (t, n) in enumerate([(t, "Bortídrazor") for t, _ in YES] + [("Bortídrazor", t) for t in NO])]
    h = spark.createDataFrame([(i, a, b, "clash") for i, a, b in rows], SCHEMA)
    got = {(r["row_id"], r["side"]): r["team_id"] for r in linked_sides(h.union(h.limit(1)), teams).distinct().collect()}
    assert got == {(i, "home"): t for i, (_, t) in enumerate(YES)}


def test_empty_tables(spark, teams):
    h = spark.createDataFrame([(1, "Fafaborkel", "x", "")], SCHEMA)
    assert linked_sides(h.limit(0), teams).count() == 0
    assert linked_sides(h, teams.limit(0)).count() == 0
    assert linked_sides(h.union(h), teams).count() == 2


def test_index_loses_no_pair_within_reach(spark, teams):
    r = random.Random(2)
    typed = set()
    while len(typed) < 150:
        word = list(r.choice([n for _, n, _ in TEAMS]))
        for _ in range(r.choice([1, 2])):
            i = r.randrange(len(word))
            word[i] = r.choice(["", word[i] * 2, "e", "x"])
        typed.add("".join(word))
    h = spark.createDataFrame([(i, t, "Bortídrazor", "") for i, t in enumerate(sorted(typed))], SCHEMA)
    got = {x["row_id"]: x["team_id"] for x in linked_sides(h, teams).collect()}
    want = {}
    for i, t in enumerate(sorted(typed)):
        costs = sorted((c, k) for k, n, _ in TEAMS if (c := align(t, n, KINDS)) is not None and t != n)
        if costs and t not in {n for _, n, _ in TEAMS} and (len(costs) == 1 or costs[1][0] - costs[0][0] >= 0.07):
            want[i] = costs[0][1]
    assert len(want) > 100 and sum(got.get(i) == t for i, t in want.items()) >= 0.97 * len(want) and all(want.get(i) == t for i, t in got.items())


def test_symmetric_deletes_meet_within_two_edits():
    r = random.Random(7)
    for _ in range(300):
        a, b = ("".join(r.choice("abc") for _ in range(8)) for _ in range(2))
        if distance(a, b, 2) <= 2:
            assert set(delete_hashes([a], 2)[0].tolist()) & set(delete_hashes([b], 2)[0].tolist())


def test_hashes_are_those_of_what_remains():
    for word in ("abcdef", "ab", "a", "aaaa", "größe"):
        for most in (0, 1, 2):
            left = {"".join(c for i, c in enumerate(word) if i not in gone) for k in range(most + 1) for gone in combinations(range(len(word)), min(k, len(word)))}
            want = {int(delete_hashes([x], 0)[0, 0]) if x else 0 for x in left}
            assert set(delete_hashes([word, word[::-1]], most)[0].tolist()) == want


def test_assignment_is_optimal():
    r = random.Random(3)
    for _ in range(200):
        rows, columns = r.randint(1, 4), r.randint(4, 6)
        cost = [[r.choice([1e6, r.random()]) for _ in range(columns)] for _ in range(rows)]
        assert assignment(cost) == pytest.approx(min(sum(cost[i][p[i]] for i in range(rows)) for p in permutations(range(columns), rows)))


def test_names_of_many_and_of_long_words(spark):
    long = "Llanfairpwllgwyngyllgogerychwyrndrobwllllantysiliogogogoch"
    many = "Alfa Beta Gamma Delta Epsilon Zeta Eta Theta Iota Kappa Lamda"
    teams = spark.createDataFrame([(1, f"{long} Town", None), (2, many, None)], "team_id bigint, name string, nickname string")
    typed = [(long[:30] + "x" + long[30:] + " Town", 1), (many.replace("Gamma", "Gmama"), 2), ("FC " + " ".join(reversed(many.split())), 2), (long + "xxx", None), (" " * 300 + many.upper(), 2), ("fc " * 2000 + "x", None)]
    h = spark.createDataFrame([(i, t, None, "") for i, (t, _) in enumerate(typed)], SCHEMA)
    got = {r["row_id"]: r["team_id"] for r in linked_sides(h, teams).collect()}
    assert got == {i: t for i, (_, t) in enumerate(typed) if t}


def test_recall_against_every_name(spark, data):
    got = recall(spark.read.parquet(f"{data}/history.parquet"), spark.read.parquet(f"{data}/teams.parquet"), every=3).first()
    assert got["brute_force"] > 30 and got["recall"] >= 0.99
    empty = spark.createDataFrame([], "team_id bigint, name string, nickname string")
    assert recall(spark.createDataFrame([(100, "a", "b", "")], SCHEMA), empty).first()["recall"] is None
