"""Reading a typed name into tokens, and the cost of aligning it with a known name.

Everything here works on one name or one pair of names; :mod:`matchlake.llm.names` finds the pairs.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Usual words for the kind of a club, and kinds that are added to any name.
USUAL = "ac albion as athletic athletico atletico bk calcio cd cf city club county dinamo dynamo fc fk football hotspur if lokomotiv nk olympic olympique racing rangers rc real rovers royal sd sk spartak sport sporting sv torpedo town tsv ud union united vfb vfl wanderers"
AFFIXES = frozenset(["afc", "fc", "sc"])

_LETTERS = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ð": "d", "ı": "i"})
_ESCAPE = re.compile(r"\\[uU]([0-9a-fA-F]{4})")
_PIECE = re.compile(r"[^\W_]+(?:[-'’][^\W_]+)*\.?")
_DOTTED_LETTERS = re.compile(r"\b([^\W\d_]{1,2})\.([^\W\d_])\.(?:([^\W\d_])\.)?(?=\s|$|\))")

#: Costs of one token's way of matching; a name is taken below TAKEN and when the runner-up is FAR more costly.
ABBREVIATED, AFFIX, DROPPED, PER_EDIT = 0.15, 0.1, 0.25, 0.3
TAKEN, FAR = 1.6, 0.07


def fold(text: str) -> str:
    """Lower case, accents and escapes resolved, white space collapsed."""
    text = _ESCAPE.sub(lambda m: chr(int(m[1], 16)), text)
    text = unicodedata.normalize("NFKD", text.lower().translate(_LETTERS))
    return " ".join("".join(c for c in text if not unicodedata.combining(c)).split())


@lru_cache(10_000)
def tokens(text: str) -> tuple[tuple[str, bool], ...]:
    """The name's tokens, each with whether a dot cuts it short."""
    text = fold(text)
    text = _DOTTED_LETTERS.sub(lambda m: "".join(g for g in m.groups() if g), text)
    return tuple((t.rstrip("."), t.endswith(".")) for t in _PIECE.findall(text))


def is_kind(word: str, kinds: frozenset[str]) -> bool:
    """Whether a word says what kind of club it is; founding years do, too."""
    return word in kinds or word.isdigit()


def distance(a: str, b: str, limit: int) -> int:
    """Edit distance with transpositions, or ``limit + 1`` when it is larger."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    low, most = 0, min(len(a), len(b))
    while low < most and a[low] == b[low]:
        low += 1
    high = 0
    while high < most - low and a[-1 - high] == b[-1 - high]:
        high += 1
    a, b = a[low : len(a) - high], b[low : len(b) - high]
    if not a or not b:
        return min(len(a) + len(b), limit + 1)
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            row.append(v)
        if min(row) > limit:
            return limit + 1
        before, last = last, row
    return min(last[-1], limit + 1)


def edits_allowed(n: int) -> int:
    return 0 if n < 3 else 1 if n < 5 else 2


def _subsequence(short: str, long: str) -> bool:
    it = iter(long)
    return all(c in it for c in short)


def _abbreviates(typed: str, known: str) -> bool:
    return typed[:1] == known[:1] and len(typed) < len(known) and _subsequence(typed, known)


@lru_cache(50_000)
def token_cost(typed: str, cut: bool, known: str, kind: bool) -> float | None:
    """Cost of ``typed`` standing for ``known``; None when it cannot."""
    if typed == known:
        return 0.0
    best = None
    if cut and len(typed) >= (1 if kind else 2):
        n = len(typed)
        if known.startswith(typed):
            best = ABBREVIATED
        elif n >= 3:
            d = min(distance(typed, known[:k], 2) for k in (n - 1, n, n + 1))
            if d <= (1 if n < 6 else 2):
                best = ABBREVIATED + d * PER_EDIT
    if kind and best is None and 2 <= len(typed) <= 4 and _abbreviates(typed, known):
        best = ABBREVIATED
    if kind and best is None and 2 <= len(typed) <= 5 and any(_abbreviates(typed[:i] + typed[i + 1 :], known) for i in range(len(typed))):
        best = ABBREVIATED + PER_EDIT  # an abbreviation with one slip
    d = distance(typed, known, 3)
    longer = max(len(typed), len(known))
    most = 1 if kind and longer == 2 and sorted(typed) == sorted(known) else edits_allowed(longer) + (longer >= 10)
    if d <= most and (best is None or d * PER_EDIT < best):
        best = d * PER_EDIT
    return best


def assignment(cost: list[list[float]]) -> float:
    """Least total of one column per row, no column twice; rows are no more than columns. Grows with rows^2 x columns."""
    rows, columns = len(cost), len(cost[0]) if cost else 0
    u, v = [0.0] * (rows + 1), [0.0] * (columns + 1)
    taken = [0] * (columns + 1)
    for i in range(1, rows + 1):
        taken[0], j = i, 0
        least, back, done = [float("inf")] * (columns + 1), [0] * (columns + 1), [False] * (columns + 1)
        while True:
            done[j] = True
            r, step, to = taken[j], float("inf"), 0
            for k in range(1, columns + 1):
                if not done[k]:
                    c = cost[r - 1][k - 1] - u[r] - v[k]
                    if c < least[k]:
                        least[k], back[k] = c, j
                    if least[k] < step:
                        step, to = least[k], k
            for k in range(columns + 1):
                if done[k]:
                    u[taken[k]] += step
                    v[k] -= step
                else:
                    least[k] -= step
            j = to
            if not taken[j]:
                break
        while j:
            taken[j] = taken[back[j]]
            j = back[j]
    return sum(cost[taken[k] - 1][k - 1] for k in range(1, columns + 1) if taken[k])


#: Stands for an impossible match; larger than any sum of possible ones.
_NEVER = 1e6


def align(typed: str, known: str, kinds: frozenset[str]) -> float | None:
    """Cost of the cheapest assignment of the typed tokens to those of ``known``; None when none is admissible.

    Every typed token must stand for a known one, except club affixes; every known one must be met, except one kind
    word, and that only where no other word has more than one slip and no kind is put before the name instead. A squad
    word, or any other word left over, means another side.
    """
    q, e = tokens(typed), [t for t, _ in tokens(known)]
    if not q or not e:
        return None
    if e[0] == "the":
        e, q = e[1:], q[1:] if len(q) > 1 and distance(q[0][0], "the", 1) <= 1 else q
    affix = [t in AFFIXES for t, _ in q]
    if not e or len(q) - sum(affix) > len(e) or len(q) < len(e) - 1:
        return None
    # One row per known token, one column per typed one; an unmatched typed token costs AFFIX or is impossible.
    alone = [AFFIX if x else _NEVER for x in affix]
    full = []
    for j, known_token in enumerate(e):
        kind = is_kind(known_token, kinds)
        row = []
        for i, (t, cut) in enumerate(q):
            c = token_cost(t, cut, known_token, kind)
            row.append(_NEVER if c is None else c + (0.01 if i != j else 0.0))
        if not kind and min(row) >= _NEVER:
            return None
        full.append(row)
    best = _total(full, alone)
    for j, known_token in enumerate(e):
        if len(e) > 1 and is_kind(known_token, kinds):
            rest = [[c if c - 0.01 * (i != k) < 2 * PER_EDIT else _NEVER for i, c in enumerate(row)] for k, row in enumerate(full) if k != j]
            first = [_NEVER if affix[0] and is_kind(q[0][0], kinds) else alone[0], *alone[1:]]
            best = min(best, DROPPED + _total(rest, first))
    return best if best < TAKEN else None


def _total(rows: list[list[float]], alone: list[float]) -> float:
    if len(rows) > len(alone) or any(min(row) >= _NEVER for row in rows):
        return _NEVER
    base = sum(alone)
    return base + assignment([[c - a for c, a in zip(row, alone, strict=True)] for row in rows])
