"""Template canonicalisation of a text, windows of templates, and the check of what fills a template's slots.

Works on one text against a block of passages; :mod:`matchlake.llm.leaks` learns the vocabulary and runs the blocks.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from difflib import SequenceMatcher

import numpy as np

from matchlake.llm.names_align import distance

NUMBER, NAME, WORDS = 1, 2, 3
#: What a slot of a text holds besides a passage's fact: another one, or nothing that can be read.
OTHER, HIDDEN = -1, -2
#: Canonical tokens per template window.
WINDOW = 5
#: A leak repeats a stretch of at least this share of the passage's words, at least HELD of them unaltered.
STRETCH, HELD = 1 / 3, 0.5
#: Facts of the stretch that must be the passage's own: a share and a number.
AGREEING, FACTS = 0.6, 2
#: Unmatched words in a row that still belong to one stretch.
GAP = 6
#: A template word occurs in so many passages and in this share of them, if it is not printed small; a unit follows a
#: number in this share of its places.
SHARED, SHARE, UNIT = 3, 0.005, 0.8
#: Canonical tokens searched at once, and by what multiple of the longest passage one piece reaches into the next.
SEGMENT, REACH = 4096, 3
#: Windows whose shift against the passage differs by less are taken together when their slots are checked.
DRIFT = 16
#: Repeated slots that must keep their substitution for a text to count as the same question about other facts.
KEPT = 2

_TOKEN = re.compile(r"\d+|[^\W\d_]+|█+|_{3,}|\*{3}")
_GROUPED = re.compile(r"(?<=\d)[.,](?=\d)")
#: A sign or foreign letter set before a number is its unit.
_SIGN = re.compile(r"(?:[^\w\s,.;:()\[\]\-–—'\"/#]|[^\W\d_A-Za-z])(?=\d)")
_HYPHEN = re.compile(r"(?<=[^\W\d_])-\n\s*(?=[^\W\d_])")
#: Words in square brackets stand in place of something.
_BRACKET = re.compile(r"\[[^\W\d_][^\]\n]{0,60}\]")


def raw_words(text: str) -> list[str]:
    """Words and numbers as printed; a word hyphenated over a line end is one word, bracketed words one mark."""
    if "-\n" in text:
        text = _HYPHEN.sub("", text)
    if "[" in text:
        text = _BRACKET.sub("█", text)
    return _TOKEN.findall(_GROUPED.sub("", _SIGN.sub(" ", text)))


def words(text: str) -> list[str]:
    return lowered(raw_words(text))


def lowered(tokens: list[str]) -> list[str]:
    return " ".join(tokens).lower().split(" ") if tokens else []


@dataclass
class Vocabulary:
    """Words of templates and units of quantities, numbered from WORDS on; every other word is a name."""

    template: dict[str, int]
    units: frozenset[int]

    @staticmethod
    def learned(texts: list[str]) -> Vocabulary:
        """From passages: words that many of them share, or that are mostly printed small, belong to templates; of them,
        those that mostly follow a number are units."""
        spread, seen, after, small = Counter(), Counter(), Counter(), Counter()
        for text in texts:
            raw = raw_words(text)
            low = lowered(raw)
            spread.update({w for w in low if len(w) > 1 and not w[0].isdigit()})
            for i, w in enumerate(low):
                seen[w] += 1
                small[w] += raw[i][0].islower()
                after[w] += i > 0 and low[i - 1][0].isdigit()
        often = max(SHARED, SHARE * len(texts))
        template = {w for w, n in spread.items() if n >= often or 2 * small[w] >= seen[w]}
        units = {w for w in template if spread[w] >= SHARED and after[w] >= UNIT * seen[w]}
        code = {w: i + WORDS for i, w in enumerate(sorted(template))}
        return Vocabulary(code, frozenset(code[w] for w in units))


@dataclass
class Canonical:
    """Canonical tokens with the first and the end index of what they stand for."""

    ids: np.ndarray
    start: np.ndarray
    end: np.ndarray


def canonical(tokens: list[str], voc: Vocabulary) -> Canonical:
    """Numbers with the unit after them become one placeholder each, runs of other words a name; template words stay."""
    get = voc.template.get
    ids = np.array([get(t) or (NUMBER if "0" <= t[0] <= "9" else NAME) for t in tokens], dtype=np.int64)
    if not len(ids):
        return Canonical(ids, ids, ids)
    before = np.concatenate([[0], ids[:-1]])
    unit = np.isin(ids, np.fromiter(voc.units, np.int64, len(voc.units))) & (before == NUMBER) if voc.units else np.zeros(len(ids), bool)
    kept = np.flatnonzero(~unit)
    k, last = ids[kept], np.concatenate([[0], ids[kept[:-1]]])
    apart = np.concatenate([[True], np.diff(kept) > 1])
    first = np.flatnonzero((k != last) | (k > NAME) | apart)
    start = kept[first]
    return Canonical(k[first], start, np.append(start[1:], len(tokens)))


def fill(tokens: list[str], start: int, end: int) -> str:
    """What fills a slot: the digits of a number, the last word of a name."""
    if tokens[start][0].isdigit():
        return "".join(t for t in tokens[start:end] if t[0].isdigit())
    return tokens[end - 1]


def templates(ids: np.ndarray) -> np.ndarray:
    """One hash per window of canonical tokens; windows without a slot are 0."""
    n = len(ids) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out, slots = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=bool)
    with np.errstate(over="ignore"):
        for k in range(WINDOW):
            part = ids[k : k + n]
            out = (out ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
            slots |= part <= NAME
    return np.where(slots, out | np.uint64(1), np.uint64(0))


@dataclass
class Passage:
    item: int
    tokens: list[str]
    facts: frozenset[str]
    windows: int


@dataclass
class Index:
    """A block of passages: sorted template hashes with, for each, the windows of passages that have it."""

    voc: Vocabulary
    passages: list[Passage] = field(default_factory=list)
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.uint64))
    owner: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    place: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    slots: np.ndarray = field(default_factory=lambda: np.zeros((0, WINDOW), dtype=np.int64))
    fills: dict[str, int] = field(default_factory=dict)
    third: np.ndarray = field(default_factory=lambda: np.zeros(0))
    longest: int = 1

    @staticmethod
    def of(rows: list[tuple[int, str]]) -> Index:
        out = Index(Vocabulary.learned([text for _, text in rows]))
        keys, owner, place, slots = [], [], [], []
        for item, text in rows:
            tokens = words(text)
            c = canonical(tokens, out.voc)
            t = templates(c.ids)
            at = np.flatnonzero(t)
            numbers = np.zeros(len(c.ids), dtype=np.int64)
            facts = set()
            for i in np.flatnonzero(c.ids <= NAME):
                f = fill(tokens, int(c.start[i]), int(c.end[i]))
                numbers[i] = out.fills.setdefault(f, len(out.fills) + 1)
                facts.add(f)
            keys.append(t[at])
            owner.append(np.full(len(at), len(out.passages)))
            place.append(at)
            slots.append(np.stack([numbers[at + k] for k in range(WINDOW)], 1) if len(at) else np.zeros((0, WINDOW), dtype=np.int64))
            out.passages.append(Passage(item, tokens, frozenset(facts), len(at)))
        if keys:
            flat = np.concatenate(keys)
            order = np.argsort(flat, kind="stable")
            out.keys, out.owner, out.place, out.slots = flat[order], np.concatenate(owner)[order], np.concatenate(place)[order], np.concatenate(slots)[order]
        out.third = np.array([max(1.0, STRETCH * p.windows) for p in out.passages])
        out.longest = max([len(p.tokens) for p in out.passages], default=0) + WINDOW
        return out

    def meetings(self, tokens: list[str], raw: list[str], c: Canonical) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(posting, window of the text, equal slots, other slots) of every window of the text that has a passage's
        template; slots whose fact the text hides are neither."""
        t = templates(c.ids)
        low, high = np.searchsorted(self.keys, t, "left"), np.searchsorted(self.keys, t, "right")
        hit = np.flatnonzero((high > low) & (t != 0))
        if not len(hit):
            none = np.zeros(0, dtype=np.int64)
            return none, none, none, none
        size = (high - low)[hit]
        window = np.repeat(hit, size)
        posting = np.repeat(low[hit], size) + np.arange(len(window)) - np.repeat(np.cumsum(size) - size, size)
        number = np.full(len(c.ids), -1, dtype=np.int64)
        get = self.fills.get
        near = np.unique((hit[:, None] + np.arange(WINDOW)).ravel())
        for i in near[c.ids[near] <= NAME].tolist():
            j = int(c.end[i]) - 1
            number[i] = get(fill(tokens, int(c.start[i]), j + 1), HIDDEN if _hidden(tokens, raw, j) else OTHER)
        own, theirs = np.stack([number[window + k] for k in range(WINDOW)], 1), self.slots[posting]
        return posting, window, (own == theirs).astype(np.int64), ((own != theirs) & (own != HIDDEN) & (theirs > 0)).astype(np.int64)

    def scan(self, text: str | None) -> list[tuple[int, str, float, int, int]]:
        """(item, kind, share, facts agreeing, facts differing) of the passages that ``text`` repeats (``leak``) or asks
        again about other facts (``reparameterised``)."""
        raw = raw_words(text or "")
        tokens = lowered(raw)
        whole = canonical(tokens, self.voc)
        best: dict[int, tuple[int, str, float, int, int]] = {}
        for begin in range(0, max(1, len(whole.ids)), SEGMENT):
            part = slice(begin, begin + SEGMENT + REACH * self.longest)
            for row in self.piece(tokens, raw, Canonical(whole.ids[part], whole.start[part], whole.end[part])):
                best[row[0]] = max(best.get(row[0], row), row, key=lambda x: (x[1] == "leak", x[2:]))
        return [best[i] for i in sorted(best)]

    def piece(self, tokens: list[str], raw: list[str], c: Canonical) -> list[tuple[int, str, float, int, int]]:
        posting, window, agree, differ = self.meetings(tokens, raw, c)
        out: list[tuple[int, str, float, int, int]] = []
        if not len(posting):
            return out
        owner = self.owner[posting]
        for o in self.consistent(owner, posting, window, agree, differ, len(c.ids)):
            p = self.passages[o]
            score = best_stretch(p, tokens, raw, c.start[window[(owner == o) & (agree.sum(1) > 0)]].tolist(), self.voc.template)
            if leaked(score):
                out.append((p.item, "leak", *score))
        done = {x[0] for x in out}
        for o in np.flatnonzero(np.bincount(owner, minlength=len(self.passages)) >= self.third).tolist():
            p = self.passages[o]
            if p.item not in done:
                score = self.substituted(p, tokens, c, posting[owner == o], window[owner == o])
                if score:
                    out.append((p.item, "reparameterised", *score))
        return out

    def consistent(self, owner: np.ndarray, posting: np.ndarray, window: np.ndarray, agree: np.ndarray, differ: np.ndarray, n: int) -> list[int]:
        """Passages for which the slots of windows of about one shift hold the passage's own facts: FACTS of them at
        least, and no more than twice as many other ones (words misspelt count as others here)."""
        k = np.arange(WINDOW)
        seen = (agree + differ) > 0
        o = np.repeat(owner[:, None], WINDOW, 1)[seen]
        at, here = (self.place[posting][:, None] + k)[seen], (window[:, None] + k)[seen]
        _, one = np.unique((o * self.longest + at) * (n + 1) + here, return_index=True)
        o, shift, same = o[one], here[one] - at[one], agree[seen][one]
        wide = n + self.longest
        found: set[int] = set()
        for half in (0, DRIFT // 2):
            group, to = np.unique(o * (4 * wide) + (shift + wide + half) // DRIFT, return_inverse=True)
            own = np.bincount(to, same)
            ok = (own >= FACTS) & (3 * own >= np.bincount(to))
            found.update((group[ok] // (4 * wide)).tolist())
        return sorted(found)

    def substituted(self, p: Passage, tokens: list[str], c: Canonical, posting: np.ndarray, window: np.ndarray) -> tuple[float, int, int] | None:
        """Share, kept and broken substitutions of the longest run of windows in which every fact of the passage that
        occurs again is replaced by one and the same other fact."""
        shift = window - self.place[posting]
        best = None
        for s in np.unique(shift).tolist():
            mine = np.flatnonzero(np.abs(shift - s) <= 1)
            if len(mine) < STRETCH * p.windows:
                continue
            pairs: dict[tuple[int, int], tuple[int, str]] = {}
            for m in mine.tolist():
                for k in range(WINDOW):
                    number = int(self.slots[posting[m], k])
                    if number:
                        i = int(window[m]) + k
                        pairs[int(self.place[posting[m]]) + k, i] = number, fill(tokens, int(c.start[i]), int(c.end[i]))
            seen: dict[int, list[str]] = defaultdict(list)
            for number, f in pairs.values():
                seen[number].append(f)
            kept = sum(len(v) - 1 for v in seen.values() if len(set(v)) == 1)
            broken = sum(len(set(v)) - 1 for v in seen.values())
            score = len(set(self.place[posting[mine]].tolist())) / max(1, p.windows), kept, broken
            if score[0] >= STRETCH and kept >= KEPT and broken == 0 and (best is None or score > best):
                best = score
        return best


def best_stretch(p: Passage, tokens: list[str], raw: list[str], positions: list[int], code: dict[str, int]) -> tuple[float, int, int]:
    """The best :func:`aligned` score of a passage around each cluster of ``positions`` in a text."""
    best = (0.0, 0, 0)
    reach = len(p.tokens) + 15
    at = sorted(positions)
    begin = 0
    for i in range(1, len(at) + 1):
        if i == len(at) or at[i] - at[i - 1] > reach or at[i] - at[begin] > 4 * reach:
            low, high = max(0, at[begin] - reach), at[i - 1] + reach
            best = max(best, aligned(p.tokens, tokens[low:high], raw[low:high], code))
            begin = i
    return best


def joined(tokens: list[str]) -> tuple[list[str], list[int]]:
    """Neighbouring numbers as one run of digits, so that grouping by blanks does not matter, and where each begins."""
    out: list[str] = []
    at: list[int] = []
    for i, t in enumerate(tokens):
        if t[0].isdigit() and out and out[-1][0].isdigit():
            out[-1] += t
        else:
            out.append(t)
            at.append(i)
    return out, at


def aligned(passage: list[str], doc: list[str], raw: list[str], code: dict[str, int]) -> tuple[float, int, int]:
    """(share of the passage's words in the best continuous stretch of ``doc``, facts that agree, facts that differ).

    Words changed inside the stretch belong to it. What stands in place of a fact differs from it when it is a number
    or a name; marks, single letters and plain words hide the fact.
    """
    passage, _ = joined(passage)
    doc, at = joined(doc)
    if not passage or not doc:
        return 0.0, 0, 0
    match = SequenceMatcher(None, passage, doc, autojunk=False)
    pairs: list[tuple[int, int, bool]] = []
    at_p = at_d = 0
    for block in match.get_matching_blocks():
        if 0 < block.a - at_p <= GAP and 0 < block.b - at_d <= GAP and pairs:
            pairs += [(i, j, _near(passage[i], doc[j])) for i, j in zip(range(at_p, block.a), range(at_d, block.b), strict=False)]
        pairs += [(block.a + k, block.b + k, True) for k in range(block.size)]
        at_p, at_d = block.a + block.size, block.b + block.size
    best = (0.0, 0, 0)
    run: list[tuple[int, int, bool]] = []
    for x in [*pairs, None]:
        if x is not None and (not run or (x[0] - run[-1][0] <= GAP and x[1] - run[-1][1] <= GAP)):
            run.append(x)
            continue
        if run:
            agree = differ = 0
            for i, j, same in run:
                if len(passage[i]) > 1 and passage[i] not in code:
                    if same:
                        agree += 1
                    elif doc[j] not in code and not _hidden(doc, raw, j, at[j]):
                        differ += 1
            held = sum(same for _, _, same in run)
            span = run[-1][0] - run[0][0] + 1
            if held >= HELD * span:
                best = max(best, (span / len(passage), agree, differ))
        run = [x] if x is not None else []
    return best


def _near(x: str, y: str) -> bool:
    return not x[0].isdigit() and len(x) >= 3 and distance(x, y, 2) <= (1 if len(x) < 6 else 2)


def _hidden(doc: list[str], raw: list[str], j: int, printed: int | None = None) -> bool:
    """Whether word ``j`` hides a fact: a mark, a single letter, a title before one, or a word printed small."""
    word = doc[j]
    if word[0].isdigit():
        return False
    return len(word) == 1 or word[0] in "█_*" or raw[j if printed is None else printed][0].islower() or (j + 1 < len(doc) and len(doc[j + 1]) == 1 and not doc[j + 1][0].isdigit())


def leaked(score: tuple[float, int, int]) -> bool:
    share, agree, differ = score
    return share >= STRETCH and agree >= FACTS and agree >= AGREEING * (agree + differ)
