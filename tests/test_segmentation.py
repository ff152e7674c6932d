"""Lexicon and splits against plain counting and all splits."""

import math
import random
from collections import Counter
from itertools import product

import pytest
from pyspark.sql import functions as F

from tidewell.operators import segmentation as seg

WORDS = ["北京", "上海市", "天气", "很好", "今天", "去", "了", "我们", "公园里", "散步"]


def texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(WORDS) for _ in range(r.randint(3, 12))) + r.choice(["。", " ok ", ""]) + r.choice(WORDS) for _ in range(n)]


def plain_runs(text):
    out, held = [], ""
    for c in text + " ":
        if "一" <= c <= "鿿" or ord(c) >= 0x20000:
            held += c
        elif held:
            out.append(held)
            held = ""
    return out


def plain_lexicon(docs, min_count):
    runs = [r for t in docs for r in plain_runs(t)]
    counts, before, after = Counter(), {}, {}
    for r in runs:
        for n in range(1, seg.MAX_CHARS + 1):
            for i in range(len(r) - n + 1):
                w = r[i : i + n]
                counts[w] += 1
                before.setdefault(w, []).append(r[i - 1] if i else object())
                after.setdefault(w, []).append(r[i + n] if i + n < len(r) else object())
    total = sum(n for w, n in counts.items() if len(w) == 1)
    entropy = lambda xs: -sum(c / len(xs) * math.log(c / len(xs)) for c in Counter(xs).values())
    out = {}
    for w, n in counts.items():
        if len(w) == 1:
            out[w] = n
        elif n >= min_count:
            cohesion = min(math.log(n * total / (counts[w[:k]] * counts[w[k:]])) for k in range(1, len(w)))
            if cohesion >= seg.MIN_COHESION and min(entropy(before[w]), entropy(after[w])) >= seg.MIN_ENTROPY:
                out[w] = n
    return out


def test_lexicon_equals_plain_counting(spark):
    docs = [*texts(300), None, "", "abc", "\U00020000\U00020001" * 3]
    got = {r.word: r.n for r in seg.learn(spark.createDataFrame([(t,) for t in docs], "text string"), min_count=5).collect()}
    assert got == plain_lexicon([d for d in docs if d], 5)
    assert {w for w in got if len(w) > 1} == {w for w in WORDS if len(w) > 1}


def all_splits(run):
    for cuts in product((0, 1), repeat=len(run) - 1):
        out, at = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                out.append(run[at:i])
                at = i
        yield [*out, run[at:]]


@pytest.mark.parametrize("seed", range(30))
def test_best_split_equals_all_splits(seed):
    r = random.Random(seed)
    logs = {"".join(r.choice("abc") for _ in range(r.randint(1, 4))): -r.random() * 5 for _ in range(25)}
    run = "".join(r.choice("abcd") for _ in range(11))
    value = lambda split: sum(logs.get(w, -9.0 if len(w) == 1 else -math.inf) for w in split)
    got = seg.best_split(run, logs, -9.0, 4)
    assert "".join(got) == run and value(got) == pytest.approx(max(map(value, all_splits(run))))


def test_segments_of_odd_texts(spark):
    lexicon = seg.learn(spark.createDataFrame([(t,) for t in texts(300)], "text string"))
    rows = [(1, "今天天气很好。我们去公园里散步"), (2, None), (3, ""), (4, "hello"), (None, "上海市x北京"), (1, "天")]
    got = {(r.id, len(r.words)): r.words for r in seg.segmented(spark.createDataFrame(rows, "id long, text string"), lexicon).collect()}
    assert got[1, 7] == ["今天", "天气", "很好", "我们", "去", "公园里", "散步"] and got[None, 2] == ["上海市", "北京"] and got[2, 0] == got[3, 0] == got[4, 0] == [] and got[1, 1] == ["天"]
    df = spark.createDataFrame([(["今天", "去", "今天", "北京"],)], "w array<string>")
    assert df.select(seg.entities(F.col("w"), ["北京"])).first()[0] == ["今天"]
    empty = spark.createDataFrame([], "id long, text string")
    assert seg.learn(empty).count() == 0 and seg.segmented(empty, lexicon).count() == 0


def test_query_over_documents(spark, sf):
    """Splits of the registered query against the helper on the lexicon's own figures, and best paths against relaxation from the right."""
    import hashlib

    from tidewell.plans import catalogue

    lexicon = {r.word: r.n for r in catalogue.learned_lexicon(spark, sf).collect()}
    total = sum(lexicon.values())
    logs = {w: math.log(n / total) for w, n in lexicon.items()}
    docs = {r.doc_id: r.text for r in catalogue._unspaced(spark, sf).collect()}
    for r in catalogue.segmented_texts(spark, sf).collect():
        t = docs[r.doc_id] or ""
        words = seg.best_split(t, logs, math.log(0.5 / total), max(map(len, lexicon))) if t else []
        assert (r.n_words, r.split_sha256) == (len(words), hashlib.sha256(" ".join(words).encode()).hexdigest())
        tail = [0.0] * (len(t) + 1)
        for i in range(len(t) - 1, -1, -1):
            tail[i] = max(logs.get(t[i:j], -math.inf) + tail[j] for j in range(i + 1, min(len(t), i + 4) + 1))
        assert sum(logs[w] for w in words) == pytest.approx(tail[0])


@pytest.mark.parametrize("direct", [1 << 22, 1])
@pytest.mark.parametrize("seed", range(5))
def test_splitter_equals_best_split(monkeypatch, seed, direct):
    monkeypatch.setattr(seg, "_DIRECT", direct)
    r = random.Random(seed)
    logs = {"".join(r.choice("abc") for _ in range(r.randint(1, 4))): -float(r.randint(1, 6)) for _ in range(40)}
    parts = ["".join(r.choice("abcd\U00020000") for _ in range(n)) for n in (0, 1, 2, 3, 4, 50, 400)]
    assert seg.Splitter(logs, -9.0, 4)(parts) == [seg.best_split(x, logs, -9.0, 4) for x in parts]
    assert seg.Splitter({}, -9.0, 1)(["ab"]) == [["a", "b"]] and seg.Splitter({"abcde": -1.0}, -9.0, 5)(["abcde"]) == [["abcde"]]


@pytest.mark.parametrize(("alphabet", "held"), [(5404, 2_000_000), (12, 30)])
def test_windows_equal_plain_counting(monkeypatch, alphabet, held):
    """Also where a task's characters or strings are more than it may hold; nothing but different windows leaves a task."""
    import pyarrow as pa

    monkeypatch.setattr(seg, "_ALPHABET", alphabet)
    monkeypatch.setattr(seg, "_HELD", held)
    docs = [[*plain_runs(t)] for t in texts(200)] + [[], ["天"], ["\U00020000天去" * 40]]
    got, sent = Counter(), 0
    for b in seg._windows(iter([pa.RecordBatch.from_arrays([pa.array(docs[i : i + 50], pa.list_(pa.string()))], names=["runs"]) for i in range(0, len(docs), 50)])):
        sent += b.num_rows
        for gram, n in zip(*[c.to_pylist() for c in b.columns], strict=True):
            got[gram] += n
    assert got == Counter(x[i : i + 5] for d in docs for x in d for i in range(len(x)))
    assert alphabet < 5404 or sent == len(got)
