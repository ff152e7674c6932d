"""Secret scans: fixed patterns, and literals that flow to sensitive names.

A small lexer reads source and configuration syntax (``name = literal``, ``"name": literal``,
``name := literal``, ``name => literal``, ``<name>literal</name>``) into name-literal pairs.
Constants propagate: a right side that names another pair, or joins literals and names by
``+``, takes their literals along with their places; a name stands for its last pair before, or else
its first one behind. A literal counts as a secret if the sensitivity of the name it reaches times the
randomness of its characters is high enough; in a call on the right side each quoted argument counts by itself.
Lexing is driven by the operators in the text and takes linear time; joined values are scored by summaries that add up.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import map_arrow
from tidewell.llm.secret_values import Value, randomness, summary

KINDS = ("assign", "access", "hex", "literal")
_ORDER = {kind: i for i, kind in enumerate(KINDS)}

_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")  # whole runs, so the same as dropping shorter ones

_OPERATOR = re.compile(r":=|=>|==+|::+|[:=]|</|<(?P<element>[A-Za-z_][\w.-]*)(?=[\s>])", re.ASCII)
_INNER = re.compile("[:=]")
_LEFT = re.compile(r"""(?:^|[^\w.$-])(["']?)([A-Za-z_$][\w$.-]*)\1$""", re.ASCII)
_BARE = re.compile(r"""[^\s"'`,;{}()\[\]<>&?+]+""")
_SPACE = re.compile(r"[\x20\t]*")
_NAME = re.compile(r"[A-Za-z_$][\w$.]*$", re.ASCII)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_CALL_TOKEN = re.compile("[\"'`()]")
_KEY = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
_KEY_END = re.compile(r"-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")

#: Sensitivity of a name: the highest of those whose words all occur in it.
SENSITIVE = {
    ("password",): 1.0, ("passwd",): 1.0, ("passphrase",): 1.0, ("pwd",): 0.9, ("passcode",): 0.9,
    ("secret",): 1.0, ("api", "key"): 1.0, ("apikey",): 1.0, ("private", "key"): 1.0, ("access", "key"): 1.0,
    ("signing", "key"): 1.0, ("encryption", "key"): 1.0, ("auth", "key"): 1.0, ("token",): 0.9, ("pass",): 0.8, ("pw",): 0.8,
    ("credential",): 0.9, ("credentials",): 0.9, ("bearer",): 0.9, ("authorization",): 0.8, ("auth",): 0.6,
}
#: Words that make a name about a secret, not the secret itself.
HARMLESS = {"public", "count", "length", "limit", "max", "min", "size", "path", "file", "url", "name", "field", "hint", "type", "expiry", "ttl", "id"}
THRESHOLD = 0.45
#: Words of a name whose quoted literal can be a phrase of several words.
PHRASES = {"password", "passwd", "passphrase", "pwd", "passcode", "secret"}


def _sensitivity(name: str) -> float:
    parts = {p.lower() for p in _PARTS.findall(name)}
    if parts & HARMLESS:
        return 0.0
    return max((score for need, score in SENSITIVE.items() if parts.issuperset(need)), default=0.0)


def _scored(value: Value, quoted: bool, name: str) -> float:
    return randomness(value, quoted, bool({p.lower() for p in _PARTS.findall(name)} & PHRASES))


class _Ahead:
    """Next place of a character from a position on; linear over positions that only grow."""

    def __init__(self, text: str):
        self.text, self.known = text, {}

    def next(self, char: str, at: int) -> int:
        found = self.known.get(char, -2)
        if found == -1 or found >= at:
            return found
        self.known[char] = found = self.text.find(char, at)
        return found


def _quoted(text: str, ahead: _Ahead, at: int) -> tuple[int, int, int] | None:
    """Start, end and place behind the literal whose quote is at ``at``; None if it is not closed.

    Triple quotes, back quotes and, if nothing closes them on their line, single and double
    quotes go over lines."""
    quote = text[at] * 3 if text[at] != "`" and text.startswith(text[at] * 3, at) else text[at]
    close = ahead.next(quote, at + len(quote))
    while close != -1 and text[close - 1] == "\\" and close > at + len(quote):
        close = ahead.next(quote, close + 1)
    return None if close == -1 else (at + len(quote), close, close + len(quote))


class _Values:
    """Lists of parts (literals, lists of other names, names met later) and their summaries, each made once."""

    def __init__(self, text: str, later: dict[str, list]):
        self.text, self.later, self.known, self.leaves = text, later, {}, {}

    def _leaf(self, span: tuple[int, int, bool]) -> Value:
        if span[:2] not in self.leaves:
            self.leaves[span[:2]] = summary(self.text[span[0] : span[1]])
        return self.leaves[span[:2]]

    def lists(self, parts: list) -> list[list]:
        """The lists that ``parts`` refers to, its names resolved."""
        return [found for x in parts if (found := self.list_of(x)) is not None]

    def list_of(self, part) -> list | None:
        return part if isinstance(part, list) else self.later.get(part.name) if isinstance(part, _Later) else None

    def of(self, parts: list) -> tuple[Value, bool]:
        """Summary of the joined value and whether its first literal is quoted. A name that leads back to itself adds nothing."""
        if id(parts) in self.known:
            return self.known[id(parts)][:2]
        stack, open_ = [(parts, iter(self.lists(parts)))], {id(parts)}
        while stack:
            top, rest = stack[-1]
            todo = next((x for x in rest if id(x) not in self.known and id(x) not in open_), None)
            if todo is not None:
                stack.append((todo, iter(self.lists(todo))))
                open_.add(id(todo))
                continue
            value, quoted, some = Value(), False, False
            for part in top:
                inner = self.list_of(part)
                if inner is None:
                    span = part.span if isinstance(part, _Later) else part
                    if span[1] == span[0]:
                        continue
                    more, by_quotes = self._leaf(span), span[2]
                elif id(inner) in self.known:
                    more, by_quotes, held = self.known[id(inner)]
                    if not held:
                        continue
                else:
                    continue
                value, quoted, some = value + more, quoted if some else by_quotes, True
            self.known[id(top)] = (value, quoted, some)
            open_.discard(id(top))
            stack.pop()
        return self.known[id(parts)][:2]


@dataclass(frozen=True)
class _Later:
    """A bare word that may be a name bound further on."""

    name: str
    span: tuple[int, int, bool]


def _call_literals(text: str, ahead: _Ahead, calls: dict[int, tuple[float, str]]) -> Iterator[tuple[int, int, float, str]]:
    """Quoted literals inside the closed calls whose brackets open at the keys of ``calls``: with the weight and name of the heaviest call around.

    Every character is passed once: calls inside one another close in order.
    """
    reached = 0
    for start in sorted(calls):
        if start < reached:
            continue
        open_, literals, closed, at = [], [], [], start
        while m := _CALL_TOKEN.search(text, at):
            at = m.end()
            if m.group() == "(":
                open_.append((m.start(), len(literals)))
            elif m.group() == ")":
                begun, since = open_.pop()
                if begun in calls:
                    closed.append((since, len(literals), calls[begun]))
                if not open_:
                    break
            elif found := _quoted(text, ahead, m.start()):
                literals.append(found[:2])
                at = found[2]
        reached = at if not open_ else len(text)
        around: list[tuple[int, tuple[float, str]]] = []  # ends of the calls around, with the heaviest so far
        closed.sort(key=lambda c: (c[0], -c[1]))
        k = 0
        for i, (a, b) in enumerate(literals):
            while k < len(closed) and closed[k][0] <= i:
                if closed[k][1] > i:
                    while around and around[-1][0] <= closed[k][0]:
                        around.pop()
                    around.append((closed[k][1], max(closed[k][2], around[-1][1]) if around else closed[k][2]))
                k += 1
            while around and around[-1][0] <= i:
                around.pop()
            if around:
                yield (a, b, *around[-1][1])


def _last_word(text: str, start: int, end: int) -> str:
    """What stands between the last blank or line end and the blanks at ``end``, from ``start`` on."""
    while end > start and text[end - 1] in " \t":
        end -= 1
    return text[max(text.rfind(c, start, end) + 1 for c in " \t\n") or start : end] if end > start else ""


def key_blocks(text: str) -> list[tuple[int, int]]:
    """Private keys from their BEGIN to their END line, however they are quoted."""
    out, at = [], 0
    while begin := _KEY.search(text, at):
        end = _KEY_END.search(text, begin.end())
        if not end:
            break
        out.append((begin.start(), end.end()))
        at = end.end()
    return out


def lexed_literals(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, name, score) of literals that reach a sensitive name, and of key blocks."""
    if "=" not in text and ":" not in text and "</" not in text and "-----BEGIN" not in text:
        return []
    ahead, bound, first, found, consumed = _Ahead(text), {}, {}, {}, 0
    element, run_end, run_taken = None, 0, False
    weighed: list[tuple[float, str, list]] = []  # names to be scored, with their parts
    calls: dict[int, tuple[float, str]] = {}
    if "-----BEGIN" in text:
        found = {span: ("private key", 1.0) for span in key_blocks(text)}
    before = 0
    for op in _OPERATOR.finditer(text):
        at, sign = op.end(), op.group()
        behind, before = before, at  # a name stands between two operators
        if op["element"]:
            close, other = ahead.next(">", at), ahead.next("<", at)
            element = (op["element"], close + 1) if close != -1 and (other == -1 or close < other) else None
            continue
        if op.start() < consumed or len(sign) > 1 and sign not in (":=", "=>", "</"):
            continue
        parts: list = []
        if sign == "</":
            last, element = element, None
            if not last or ahead.next("<", last[1]) != op.start():
                continue
            name, start = last
            parts.append((start, op.start(), False))
            weight = _sensitivity(name)
        else:
            m = _LEFT.search(_last_word(text, behind, op.start()))
            if not m:
                continue
            name = m[2]
            weight = _sensitivity(name)
            while True:
                at = _SPACE.match(text, at).end()
                if at < len(text) and text[at] in "\"'`":
                    literal = _quoted(text, ahead, at)
                    if literal is None:
                        break
                    parts.append((*literal[:2], True))
                    at = literal[2]
                else:
                    # a run of bare characters can hold further pairs: its first pair and its first
                    # sensitive one take all of it, others what comes before the next operator
                    whole = at >= run_end
                    if whole:
                        bare = _BARE.match(text, at)
                        if not bare:
                            break
                        run_end, run_taken = bare.end(), False
                    whole = whole or weight and not run_taken
                    run_taken = run_taken or weight > 0
                    inner = _INNER.search(text, at, run_end)
                    stop = run_end if whole or not inner else inner.start()
                    word = text[at:stop].rstrip(".:")
                    known = bound.get(word) if _NAME.match(word) else None
                    span = (at, at + len(word), False)
                    parts.append(known if known else _Later(word, span) if _NAME.match(word) else span)
                    if weight and stop < len(text) and text[stop] == "(":
                        calls[stop] = max(calls.get(stop, (0.0, "")), (weight, name))
                    at, consumed = stop, inner.start() if inner else run_end
                at = _SPACE.match(text, at).end()
                if at >= len(text) or text[at] != "+":
                    break
                at += 1
        if not parts:
            continue
        if len(parts) == 1 and isinstance(parts[0], list):
            parts = parts[0]
        bound[name] = parts
        first.setdefault(name, parts)
        if weight:
            weighed.append((weight, name, parts))
    values = _Values(text, first)
    # a bare word that is also a name further on counts as itself, too
    alone = [(w, name, [x.span if isinstance(x, _Later) else x for x in parts]) for w, name, parts in weighed if any(isinstance(x, _Later) for x in parts)]
    scored = []
    for weight, name, parts in [*weighed, *alone]:
        score = weight * _scored(*values.of(parts), name)
        if score >= THRESHOLD:
            scored.append((score, name, parts))
    taken: set[int] = set()
    for score, name, parts in sorted(scored, key=lambda s: -s[0]):  # so that each list is gone through once, at its best score
        stack = [parts]
        while stack:
            top = stack.pop()
            if id(top) in taken:
                continue
            taken.add(id(top))
            for part in top:
                inner = values.list_of(part)
                if inner is not None:
                    stack.append(inner)
                    continue
                a, b, _ = part.span if isinstance(part, _Later) else part
                if b > a and score > found.get((a, b), ("", 0.0))[1]:
                    found[a, b] = (name, score)
    for a, b, weight, name in _call_literals(text, _Ahead(text), calls) if calls else ():
        score = weight * _scored(summary(text[a:b]), True, name)
        if score >= THRESHOLD and score > found.get((a, b), ("", 0.0))[1]:
            found[a, b] = (name, score)
    return [(a, b, name, score) for (a, b), (name, score) in sorted(found.items())]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the fixed patterns, leftmost and non-overlapping for each kind."""
    out = []
    if "=" in text or ":" in text:
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], _ORDER[s[0]]))


def all_spans(text: str) -> list[tuple[str, int, int, str, float]]:
    """Base spans, and lexed literals that no base span covers: kind, start, end, name, score."""
    base = base_spans(text)
    spans = [(k, a, b, "", 1.0) for k, a, b in base]
    at = reach = 0  # furthest end of the base spans that start at or before the literal
    for a, b, name, score in lexed_literals(text):  # by start
        while at < len(base) and base[at][1] <= a:
            reach = max(reach, base[at][2])
            at += 1
        if b > reach:
            spans.append(("literal", a, b, name, score))
    return sorted(spans, key=lambda s: (s[1], _ORDER[s[0]], s[2]))


def _joined(spans) -> str:
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans)


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Findings of every row: ``doc_id``, ``n_assign``, ``n_access``, ``n_hex`` (long, base
    patterns), ``base_sha256``, and ``spans``, an array of (kind, start, end, name, score).

    Places count code points, ends are exclusive. A null text counts as empty and has no
    findings. Whole texts are read; repeated rows give repeated results; a null doc_id stays
    null; an empty table gives an empty result; other columns are ignored.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
            for value in batch.column(1):
                spans = all_spans(value.as_py() or "")
                for kind in KINDS[:3]:
                    rows[f"n_{kind}"].append(sum(s[0] == kind for s in spans))
                rows["base_sha256"].append(hashlib.sha256(_joined(s for s in spans if s[0] != "literal").encode()).hexdigest())
                rows["spans"].append([dict(zip(("kind", "start", "end", "name", "score"), s, strict=True)) for s in spans])
            types = {"base_sha256": pa.string(), "spans": pa.list_(span)}
            arrays = [pa.array(v, types.get(k, pa.int64())) for k, v in rows.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", *rows])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_arrow(
        rows, run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans array<struct<kind:string,start:long,end:long,name:string,score:double>>"
    )


def redact(text: str) -> str:
    """The text with every found span replaced by a mark of its kind; overlaps become one."""
    out, at = [], 0
    merged: list[list] = []
    for kind, a, b, *_ in all_spans(text):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(b, merged[-1][2])
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[at:a], f"[secret:{kind}]"]
        at = b
    return "".join([*out, text[at:]]) if merged else text


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with secrets in ``text`` replaced by marks; all rows and columns stay.

    A null text stays null. A column ``n_chars`` follows the new text. An empty table stays
    empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            new = [None if v is None else redact(v) for v in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    out = map_arrow(docs, run, docs.schema)
    return out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
