"""Token counts by a compiled finite-state transducer.

A vocabulary of byte-pair merges is compiled to a deterministic transducer over the bytes of a
piece (a word, number or run of signs); the last byte of a piece is a symbol of its own. After
each byte, exactly one token can end there: the one that neither merges with the token before
it nor falls apart. A state therefore holds the bytes that can still become part of a longer
token, the token that ends at each place among them, and how many tokens that leaves; the
transition for a byte is annotated with the change of the token count. States and transitions
are compiled when first needed and shared by all pieces; counts of pieces are remembered.
Tables that grow past a bound are dropped and compiled anew, which changes no result.

A long text is cut into chunks, wherever that may fall. A state of the text's transducer is the kind of the
piece that is open (none, letters or signs), the state inside that piece and its last byte, which
is held back as a piece's last byte is a symbol of its own. A chunk's map gives, for the states in which it
may start, the state in which it ends and the tokens emitted on the way; maps are made for each chunk on its
own, for no open piece and for pieces that the text before the chunk may have left open. They compose
associatively, and a prefix scan over the chunks in log steps joins them to the map of the whole text. A start state that a map
lacks is run when a composition asks for it, which adds it to the map.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import map_arrow

#: Characters of a chunk, and bytes before it from which the states of a piece that is open there are guessed.
CHUNK, WARM_UP = 1 << 14, 64
MAX_PIECES, MAX_STATES, MAX_PAIRS = 400_000, 200_000, 400_000


def _byte_letters() -> dict[int, str]:
    """Letters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself,
    all others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Transducer:
    """Token counts of pieces. ``spec``: the JSON text of a vocabulary file."""

    def __init__(self, spec: str):
        model = json.loads(spec)["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        ids: dict[str, int] = model["vocab"]
        letters = _byte_letters()
        bytes_of = {c: b for b, c in letters.items()}
        self.inner = [ids[letters[b]] for b in range(256)]
        self.final = [ids[letters[b] + self.suffix] for b in range(256)]
        self.merges = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])
        self.open_tokens: dict[bytes, int] = {}
        self.end_tokens: dict[bytes, int] = {}
        self.symbols: dict[int, list[int]] = {}
        self.prefixes: set[bytes] = {b""}
        made = {*self.inner, *self.final, *(new for _, new in self.merges.values())}
        for token, i in ids.items():
            if i not in made:
                continue
            ends = bool(self.suffix) and token.endswith(self.suffix)
            raw = bytes(bytes_of[c] for c in (token[: -len(self.suffix)] if ends else token))
            (self.end_tokens if ends else self.open_tokens)[raw] = i
            self.symbols[i] = [self.inner[b] for b in raw[:-1]] + [(self.final if ends else self.inner)[raw[-1]]]
            self.prefixes.update(raw[:k] for k in range(1, len(raw)))
        self.pairs: dict[tuple[int, int], bool] = {}
        self.held = False  # whether states are in use outside, so that tables must stay
        self._reset()

    def _reset(self) -> None:
        # a state: window, token that ends before each of its bytes and after the last, counts
        self.states = [(b"", (-1,), (0,))]
        self.numbers = {self.states[0]: 0}
        self.steps: dict[int, tuple[int, int]] = {}
        self.ends: dict[int, int] = {}

    def merged(self, symbols: list[int]) -> list[int]:
        """The tokens of a sequence of symbols, by the merges in order of rank."""
        out, ranks = list(symbols), self.merges
        while len(out) > 1:
            best = min(((ranks[p][0], i) for i, p in enumerate(zip(out, out[1:], strict=False)) if p in ranks), default=None)
            if best is None:
                break
            i = best[1]
            out[i : i + 2] = [ranks[out[i], out[i + 1]][1]]
        return out

    def _fits(self, before: int, token: int) -> bool:
        """Whether ``token`` stays whole right after the token ``before`` (-1: at the start)."""
        found = self.pairs.get((before, token))
        if found is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            if before == -1:
                found = self.merged(self.symbols[token]) == [token]
            else:
                found = self.merged(self.symbols[before] + self.symbols[token]) == [before, token]
            self.pairs[before, token] = found
        return found

    def _last(self, window: bytes, tokens: tuple[int, ...], known: dict[bytes, int]) -> tuple[int, int]:
        """Where the token that ends the window starts, and that token."""
        for start in range(len(window)):
            token = known.get(window[start:])
            if token is not None and self._fits(tokens[start], token):
                return start, token
        raise ValueError("no token ends here; the merges don't fit the vocabulary")

    def _compile_step(self, state: int, byte: int) -> tuple[int, int]:
        window, tokens, counts = self.states[state]
        grown = window + bytes((byte,))
        start, token = self._last(grown, tokens, self.open_tokens)
        count = counts[start] + 1
        cut = 0
        while grown[cut:] not in self.prefixes:
            cut += 1
        tokens, rel = (*tokens, token)[cut:], tuple(c - count for c in (*counts, count)[cut:])
        new = (grown[cut:], tokens, rel)
        number = self.numbers.get(new)
        if number is None:
            number = self.numbers[new] = len(self.states)
            self.states.append(new)
        self.steps[state << 8 | byte] = found = (number, count)
        return found

    def _compile_end(self, state: int, byte: int) -> int:
        window, tokens, counts = self.states[state]
        start, _ = self._last(window + bytes((byte,)), tokens, self.end_tokens if self.suffix else self.open_tokens)
        self.ends[state << 8 | byte] = found = counts[start] + 1
        return found

    def run(self, state: int, data: bytes) -> tuple[int, int]:
        """The state behind bytes that don't end a piece, and the tokens emitted."""
        total, steps = 0, self.steps
        for byte in data:
            found = steps.get(state << 8 | byte) or self._compile_step(state, byte)
            state, total = found[0], total + found[1]
        return state, total

    def end(self, state: int, byte: int) -> int:
        """Tokens emitted by the last byte of a piece."""
        found = self.ends.get(state << 8 | byte)
        return self._compile_end(state, byte) if found is None else found

    def count(self, piece: bytes) -> int:
        if not piece:
            return 0
        if len(self.states) > MAX_STATES and not self.held:
            self._reset()
        state, total = self.run(0, piece[:-1])
        return total + self.end(state, piece[-1])


class State(NamedTuple):
    """Kind of the open piece ("" for none, "L" letters, "S" signs), the transducer's state in it, its last byte."""

    kind: str = ""
    inner: int = 0
    last: int = -1


class ChunkMap:
    """What a run of chunks does: from a start state to the end state and the tokens in between."""

    def __init__(self, run: Callable[[State], tuple[State, int]], starts: Iterable[State]):
        self.run = run
        self.known: dict[State, tuple[State, int]] = {s: run(s) for s in starts}

    def __call__(self, start: State) -> tuple[State, int]:
        if start not in self.known:
            self.known[start] = self.run(start)
        return self.known[start]

    def then(self, following: ChunkMap) -> ChunkMap:
        """The map of this run of chunks and the ``following`` one."""

        def run(start: State) -> tuple[State, int]:
            middle, before = self(start)
            end, after = following(middle)
            return end, before + after

        return ChunkMap(run, self.known)


def prefix_scan(maps: list[ChunkMap]) -> list[ChunkMap]:
    """For each chunk the map of all chunks up to it, by doubling: log2(n) steps, each of independent compositions."""
    step = 1
    while step < len(maps):
        maps = [maps[i - step].then(m) if i >= step else m for i, m in enumerate(maps)]
        step *= 2
    return maps


def _character_class(prop: str) -> str:
    """A nested set for a general category as the library's regular expressions know it.

    Their Unicode version may be another one than that of ``regex``; the characters on
    which the two differ are found by asking both about all of them.
    """
    from tokenizers import Regex, pre_tokenizers

    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    keep = pre_tokenizers.Split(Regex(rf"\p{{{prop}}}+"), behavior="removed", invert=True)
    theirs = {c for run, _ in keep.pre_tokenize_str(everything) for c in run}
    ours = set(regex.findall(rf"\p{{{prop}}}", everything))

    def listed(chars: set[str]) -> str:
        runs: list[list[int]] = []
        for o in sorted(map(ord, chars)):
            if runs and runs[-1][1] == o - 1:
                runs[-1][1] = o
            else:
                runs.append([o, o])
        return "[" + "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in runs) + "]"

    out = rf"\p{{{prop}}}"
    if ours - theirs:
        out = f"[{out}--{listed(ours - theirs)}]"
    if theirs - ours:
        out = f"[{out}||{listed(theirs - ours)}]"
    return out


def character_classes() -> tuple[str, str]:
    """Sets of letters and numbers as the library knows them: made once, on the driver, as it takes seconds."""
    return _character_class("L"), _character_class("N")


def up_sweep(maps: list[ChunkMap]) -> ChunkMap:
    """The map of all chunks: the scan's first half, which joins neighbours until one is left."""
    while len(maps) > 1:
        maps = [maps[i].then(maps[i + 1]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


class Counter:
    """Token counts of texts as the vocabulary file's own rules give them. ``classes``: see :func:`character_classes`."""

    def __init__(self, spec: str, classes: tuple[str, str] | None = None):
        rules = json.loads(spec)
        self.transducer = Transducer(spec)
        self.special = [t["content"] for t in rules.get("added_tokens", [])]
        self.split_special = regex.compile("|".join(regex.escape(s) for s in self.special)) if self.special else None
        steps = rules["pre_tokenizer"].get("pretokenizers", [rules["pre_tokenizer"]])
        pattern = next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split")
        space = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # white space of the library
        pattern = pattern.replace(r"\s", space)
        # on Latin-1 both agree, and the plain classes match faster
        self.latin_pieces = regex.compile(pattern)
        letters, numbers = classes or character_classes()
        self.pieces = regex.compile(pattern.replace(r"\p{L}", letters).replace(r"\p{N}", numbers), regex.V1)
        self.open_run = {"L": regex.compile(f"{letters}*", regex.V1), "S": regex.compile(rf"[^{space}{letters}{numbers}]*", regex.V1)}
        self.last_kind = regex.compile(rf"(?P<L>{letters})|(?P<S>[^{space}{letters}{numbers}])", regex.V1)
        self.known: dict[str, int] = _Remembered(lambda piece: self.transducer.count(piece.encode()))

    def _normal(self, text: str) -> str:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # letter by letter, so without the rule for a final sigma
        return text.replace("Σ", "σ").lower()

    def _found(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
            return self.latin_pieces.findall(text)
        except UnicodeEncodeError:
            return self.pieces.findall(text)

    def _whole(self, text: str) -> int:
        """Tokens of a text in its normal form, all pieces closed at its end."""
        if len(self.known) > MAX_PIECES:
            self.known.clear()
        return sum(map(self.known.__getitem__, self._found(text)))

    def _go_on(self, state: State, run: str) -> tuple[State, int]:
        """Characters that the open piece takes in, as long as they don't end it."""
        data = run.encode()
        if not data:
            return state, 0
        first = bytes((state.last,)) if state.last >= 0 else b""
        inner, n = self.transducer.run(state.inner, first + data[:-1])
        return State(state.kind, inner, data[-1]), n

    def _close(self, state: State) -> int:
        return self.transducer.end(state.inner, state.last) if state.kind else 0

    def _run(self, text: str, start: State) -> tuple[State, int]:
        """From a start state through the characters of a chunk in its normal form."""
        n = 0
        if start.kind:
            head = self.open_run[start.kind].match(text).group()
            start, n = self._go_on(start, head)
            if len(head) == len(text):
                return start, n
            n += self._close(start)
            text = text[len(head) :]
        kind = self.last_kind.match(text[-1])
        if not kind:
            return State(), n + self._whole(text)
        # the last piece stays open; an apostrophe that starts a contraction is never cut from it
        pieces = self._found(text)
        for piece in pieces[:-1]:
            n += self.known[piece]
        state, emitted = self._go_on(State(kind.lastgroup), pieces[-1])
        return state, n + emitted

    def _cuts(self, text: str, chunk: int) -> list[int]:
        """Places about ``chunk`` characters apart where no contraction is cut: not within three characters behind an apostrophe."""
        cuts, at = [0], chunk
        while at < len(text):
            while at < len(text) and "'" in text[max(0, at - 3) : at + 1]:
                at += 1
            if at < len(text):
                cuts.append(at)
            at += chunk
        return [*cuts, len(text)]

    def chunk_maps(self, text: str, chunk: int) -> list[ChunkMap]:
        """A map for each chunk of a text in its normal form, each made without the others."""
        cuts, out = self._cuts(text, chunk), []
        for a, b in zip(cuts, cuts[1:], strict=False):
            before = text[max(0, a - WARM_UP) : a]
            guessed = {State(), self._run(before, State())[0]} if before else {State()}
            out.append(ChunkMap(lambda start, part=text[a:b]: self._run(part, start), guessed))
        return out

    def _segment(self, text: str, chunk: int) -> int:
        text = self._normal(text)
        if len(text) <= chunk:
            return self._whole(text)
        self.transducer.held = True
        try:
            end, n = up_sweep(self.chunk_maps(text, chunk))(State())
            return n + self._close(end)
        finally:
            self.transducer.held = False

    def count(self, text: str, chunk: int = CHUNK) -> int:
        if self.split_special is None or not any(s in text for s in self.special):
            return self._segment(text, chunk)
        parts = self.split_special.split(text)
        return len(parts) - 1 + sum(self._segment(p, chunk) for p in parts)


class _Remembered(dict):
    def __init__(self, make: Callable[[str], int]):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> int:
        self[key] = value = self.make(key)
        return value


_counters: dict[int, Counter] = {}


def _counter(spec: str, classes: tuple[str, str]) -> Counter:
    """One compiled counter a Python worker."""
    key = hash(spec)
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(spec, classes)
    return _counters[key]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` (long), ``over_limit`` of every row's whole text.

    ``vocabulary``: path of a vocabulary file on the driver (about 2 MB; its text is sent to
    the executors). Tokens are those of the file's own rules without added special tokens;
    special strings inside a text count as one token each. A null text counts as empty (0
    bytes, 0 tokens). Repeated rows give repeated results; a null doc_id stays null; an
    empty table gives an empty result; other columns are ignored.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast((f.read(), character_classes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(*spec.value)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for value in batch.column(1):
                t = value.as_py() or ""
                n_bytes.append(len(t.encode()))
                n_tokens.append(counter.count(t))
            over = [n > limit for n in n_tokens]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(over, pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_arrow(rows, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
