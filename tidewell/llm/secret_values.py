"""Summaries of literal values that add up: a joined value is scored without being built.

A constant can be joined to itself again and again, so that the joined text grows without bound. What decides
whether it looks like key material are counts of its characters, a few flags, its words and what stands at its ends;
these of a joined value follow from those of its parts, at the cost of one small array.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, replace

import numpy as np

_WRAP = re.compile(r"[\x20\t]*\\?\r?\n[\x20\t]*")
_KEY = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
_MARK = re.compile(r"(?i)\$\{|\$\(|%\(|\{\{|<|x{4}|\*{3}|\.{3}|change.?me|example|placeholder|your.|dummy|sample|redacted")
_WORD_AT_END = re.compile(r"(?i)(?:none|null|true|false|undefined)$")
_PAUSE = re.compile(r"[.?!;:,]\s")
#: Characters at either end that are looked at across a joint: longer than any mark or line of a key.
_EDGE = 64
_PRIME = (1 << 61) - 1
_SCORE = 0.6  # of a phrase of several words


def _counts(text: str) -> np.ndarray:
    """How often each character occurs; those above ASCII are counted by their remainder."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(np.where(points < 128, points, 128 + points % 128), minlength=256).astype(np.float64)


def _word(text: str) -> tuple[int, int]:
    """A hash that adds up over joined texts, and what it takes to shift another by this one."""
    data = text.encode("utf-32-be", "surrogatepass")
    return int.from_bytes(data) % _PRIME, pow(2, 8 * len(data), _PRIME)


def _after(a: tuple[int, int], b: tuple[int, int]) -> tuple[int, int]:
    return (a[0] * b[1] + b[0]) % _PRIME, a[1] * b[1] % _PRIME


@dataclass(frozen=True)
class Blank:
    """A run of white space at an end: it counts once something stands on its other side, too."""

    counts: np.ndarray | None = None
    wraps: bool = False  # holds a line end, and so vanishes inside a value
    space: bool = False
    edge: str = ""  # as much of it as a mark could span

    def __add__(self, other: Blank) -> Blank:
        if self.counts is None or other.counts is None:
            return other if self.counts is None else self
        return Blank(self.counts + other.counts, self.wraps or other.wraps, self.space or other.space, (self.edge + other.edge)[:_EDGE])


def _blank(text: str) -> Blank:
    return Blank(_counts(text), "\n" in text, " " in text, text[:_EDGE]) if text else Blank()


@dataclass(frozen=True)
class Value:
    """Of a text without blank ends: counts, kinds of characters, words, marks; and the blanks at its ends.

    ``counts`` is None for a text that is blank as a whole, which has all of it in ``lead``.
    """

    counts: np.ndarray | None = None
    kinds: frozenset[str] = frozenset()
    space: bool = False
    head: str = ""
    tail: str = ""
    key: bool = False
    mark: bool = False
    pause: bool = False
    words: int = 0
    first: tuple[int, int] = (0, 1)
    last: tuple[int, int] = (0, 1)
    inner: frozenset = frozenset()  # three different words at most tell as much as all
    lead: Blank = Blank()
    trail: Blank = Blank()

    def __add__(self, other: Value) -> Value:
        if self.counts is None:
            return replace(other, lead=self.lead + other.lead)
        if other.counts is None:
            return replace(self, trail=self.trail + other.lead)
        gap = self.trail + other.lead
        apart = gap.counts is not None and not gap.wraps
        counts = self.counts + other.counts + (gap.counts if apart else 0)
        if counts.sum() > 1e200:  # only shares matter by then
            counts = counts * 1e-100
        joint = self.tail + (gap.edge if apart else "") + other.head
        inner = set(self.inner) | other.inner
        if apart:
            first, last, words = self.first, other.last, self.words + other.words
            inner |= {self.last} if self.words > 1 else set()
            inner |= {other.first} if other.words > 1 else set()
        else:
            met, words = _after(self.last, other.first), self.words + other.words - 1
            first = self.first if self.words > 1 else met
            last = other.last if other.words > 1 else met
            inner |= {met} if self.words > 1 and other.words > 1 else set()
        return Value(
            counts, self.kinds | other.kinds | ({"other"} if apart else set()), self.space or other.space or (apart and gap.space),
            self.head if len(self.head) >= _EDGE else joint[:_EDGE], other.tail if len(other.tail) >= _EDGE else joint[-_EDGE:],
            self.key or other.key or bool(_KEY.search(joint)), self.mark or other.mark or bool(_MARK.search(joint)), self.pause or other.pause or bool(_PAUSE.search(joint)),
            min(words, 1 << 60), first, last, frozenset(sorted(inner)[:3]), self.lead, other.trail,
        )


def summary(text: str) -> Value:
    """The summary of one literal."""
    core = text.strip()
    if not core:
        return Value(lead=_blank(text))
    start = text.index(core[0])
    lead, trail = _blank(text[:start]), _blank(text[start + len(core) :])
    key = bool(_KEY.search(core))
    if "\n" in core:
        core = _WRAP.sub("", core)
    kinds = {name for name, test in (("lower", str.islower), ("upper", str.isupper), ("digit", str.isdigit)) if any(map(test, core))}
    kinds |= set() if core.isalnum() else {"other"}
    words = core.split()
    n, first, last = len(words), _word(words[0]), _word(words[-1])
    inner = frozenset(sorted(map(_word, set(words[1:-1])))[:3])
    return Value(
        _counts(core), frozenset(kinds), " " in core, core[:_EDGE], core[-_EDGE:], key, bool(_MARK.search(core)), bool(_PAUSE.search(core)), n, first, last, inner, lead, trail
    )


def randomness(value: Value, quoted: bool, phrases: bool) -> float:
    """0 to 1: how far a value looks like key material and not like a word.

    ``phrases``: whether its name allows for several words, which are not a sentence or a hint.
    """
    if value.key:
        return 1.0
    if value.counts is None:
        return 0.0
    n = float(value.counts.sum())
    if n < 8 or value.mark or _WORD_AT_END.search(value.tail):
        return 0.0
    share = value.counts[value.counts > 0] / n
    entropy = -float((share * np.log2(share)).sum())
    if value.space and not (quoted and len(value.kinds) >= 4):
        several = value.words >= 3 and len(value.inner | {value.first, value.last}) > 2
        return _SCORE if quoted and phrases and n >= 12 and several and not value.pause and value.tail[-1] not in ".?!:" else 0.0
    if len(value.kinds) < 2 and not (quoted and entropy >= 3.5 and n >= 16):
        return 0.0
    if "digit" not in value.kinds and not (quoted and len(value.kinds) >= 3):
        return 0.0
    return 0.0 if math.isnan(entropy) else min(1.0, entropy / 3.0)
