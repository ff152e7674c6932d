"""Summaries of joined values against the joined texts, and the lexer against a plain evaluation of assignments."""

import math
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewell.llm import secret_scan
from tidewell.llm.secret_values import Value, randomness, summary

PIECES = st.text(alphabet=st.sampled_from("abAB01 \t-_.<x*é漢🙂${"), max_size=12) | st.sampled_from(["exam", "ple", "none", "-----BEGIN RSA ", "PRIVATE KEY-----", "change", "me", "word ", " of", ". ", "your"])


def plain(text, quoted, phrases):
    """The rules on one whole text without line ends."""
    if re.search(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----", text.strip()):
        return 1.0
    v = text.strip()
    mark = r"(?i)\$\{|\$\(|%\(|\{\{|<|x{4,}|\*{3,}|\.{3}|change.?me|example|placeholder|your.|dummy|sample|redacted|(?:none|null|true|false|undefined)$"
    if len(v) < 8 or re.search(mark, v):
        return 0.0
    points = [ord(c) if ord(c) < 128 else 128 + ord(c) % 128 for c in v]
    entropy = -sum(points.count(p) / len(v) * math.log2(points.count(p) / len(v)) for p in set(points))
    kinds = sum((any(map(str.islower, v)), any(map(str.isupper, v)), any(map(str.isdigit, v)), not v.isalnum()))
    if " " in v and not (quoted and kinds >= 4):
        w = v.split()
        ok = quoted and phrases and len(v) >= 12 and len(w) >= 3 and len(set(w)) > 2 and v[-1] not in ".?!:" and not re.search(r"[.?!;:,]\s", v)
        return 0.6 if ok else 0.0
    if kinds < 2 and not (quoted and entropy >= 3.5 and len(v) >= 16):
        return 0.0
    if not any(map(str.isdigit, v)) and not (quoted and kinds >= 3):
        return 0.0
    return min(1.0, entropy / 3)


@settings(max_examples=600, deadline=None)
@given(st.lists(PIECES, max_size=7), st.booleans(), st.booleans())
def test_summaries_add_up(pieces, quoted, phrases):
    total = Value()
    for p in pieces:
        total = total + summary(p)
    assert randomness(total, quoted, phrases) == pytest.approx(plain("".join(pieces), quoted, phrases))


@settings(max_examples=200, deadline=None)
@given(st.lists(PIECES, min_size=3, max_size=6))
def test_grouping_does_not_matter(pieces):
    left, right = Value(), Value()
    for p in pieces:
        left = left + summary(p)
    for p in reversed(pieces):
        right = summary(p) + right
    for quoted in (True, False):
        assert randomness(left, quoted, True) == pytest.approx(randomness(right, quoted, True))


@pytest.mark.parametrize("seed", range(40))
def test_random_assignments(seed):
    """Constants joined from literals and other names, used before and after their pairs, against evaluation by strings."""
    r = random.Random(seed)
    names = [f"c{i}" for i in range(12)] + [f"password{i}" for i in range(4)]
    r.shuffle(names)
    made, text = [], ""
    for i, name in enumerate(names):
        parts = []
        for _ in range(r.choice((1, 1, 2, 3))):
            if r.random() < 0.45:
                parts.append(r.choice(names))
            else:
                literal = "".join(r.choice("aK9$q") for _ in range(r.choice((2, 6, 12)))).replace("$", "_")
                parts.append((literal, len(text)))
        row = f"{name} = "
        places = []
        for k, p in enumerate(parts):
            row += " + " if k else ""
            if isinstance(p, tuple):
                places.append(("literal", len(text) + len(row) + 1, p[0]))
                row += f'"{p[0]}"'
            else:
                places.append(("name", len(text) + len(row), p))
                row += p
        made.append((name, places, i))
        text += row + "\n"
    by_name = {name: (places, i) for name, places, i in made}

    def leaves(name, open_):
        out = []
        for kind, at, p in by_name[name][0]:
            if kind == "literal":
                out.append((at, at + len(p), p, True))
            elif p not in open_:
                out += leaves(p, open_ | {p})
        return out

    def cyclic(name, open_=()):
        return name in open_ or any(kind == "name" and cyclic(p, (*open_, name)) for kind, _, p in by_name[name][0])

    got = {(a, b) for a, b, *_ in secret_scan.lexed_literals(text)}
    for name in names:
        if name.startswith("password") and not cyclic(name):
            held = leaves(name, {name})
            if held and plain("".join(x[2] for x in held), held[0][3], True) >= secret_scan.THRESHOLD:
                assert {x[:2] for x in held} <= got, text


def test_nothing_is_capped():
    base = 'base = "' + "Kx9" + "ab1Z" * 500 + '"\n'
    last = "v = 'Zx9qW7eR5tY3'; v2 = v; secret_final = v2 + 'k1'\n"
    t = base + "".join(f"password{i} = base + 'x{i}'\n" for i in range(40)) + last
    got = [t[a:b] for a, b, *_ in secret_scan.lexed_literals(t)]
    assert all(f"x{i}" in got for i in range(40)) and "Zx9qW7eR5tY3" in got and "k1" in got
    t = base + "b0 = base\n" + "".join(f"password_{i} = b{i} + b{i}\nb{i + 1} = password_{i}\n" for i in range(3000)) + last
    assert {"Zx9qW7eR5tY3", "k1"} <= {t[a:b] for a, b, *_ in secret_scan.lexed_literals(t)}
    words = " ".join(f"w{chr(97 + i % 26)}rd" for i in range(60))
    assert secret_scan.lexed_literals(f'passphrase = "{words}"')


@pytest.mark.parametrize(
    ("t", "secrets"),
    [
        ("secret = a_b\nother = 1\na_b = 'Zx9qW7eR5tY3k'", ["Zx9qW7eR5tY3k"]),
        ("api_key = get('KEY_NAME', 'sk_live_Zx9qW7eR5tY3k')", ["sk_live_Zx9qW7eR5tY3k"]),
        ("token = a(b(1, 'Zx9qW7eR5tY3k'), c(\"n\"))\nname = f('Yx9qW7eR5tY3k')", ["Zx9qW7eR5tY3k"]),
        ("token = a(b(1, 'Zx9qW7eR5tY3k'", []),
        ("a = b\nb = a\nsecret = a", []),
        ("DB_PASS=S3cr3tP4ss!", ["S3cr3tP4ss!"]),
        ("user_pw: 'Zx9qW7eR5tY3k'", ["Zx9qW7eR5tY3k"]),
    ],
)
def test_forward_names_calls_and_short_names(t, secrets):
    assert [t[a:b] for a, b, *_ in secret_scan.lexed_literals(t)] == secrets


def test_hostile_texts_take_linear_time():
    forms = [
        lambda n: "secret=f(" * (n // 9), lambda n: "secret=f('a9Zk1L2m3N')" * (n // 20), lambda n: "".join(f"a{i + 1}=a{i}+'x'\nsecret{i}=a{i}\n" for i in range(n // 30)),
        lambda n: "".join(f"secret{i}=secret{i + 1}\n" for i in range(n // 20)), lambda n: "x = 'k9'\nsecret = " + "+".join(["x"] * (n // 2)), lambda n: "".join(f"c{i}=c{i}+'a'\n" for i in range(n // 12)) + "secret=" + "+".join(f"c{i}" for i in range(n // 24)),
    ]
    for form in forms:
        took = []
        for n in (20_000, 160_000):
            t, began = form(n), time.process_time()
            secret_scan.all_spans(t)
            took.append(time.process_time() - began)
        assert took[1] < 30 * max(took[0], 0.05)
