"""Small tables with every odd case, for the operators' tests."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
#: Names that operators use themselves.
CLASHING = ["kept", "n_words", "quality", "size", "fp", "shard", "tokens", "piece", "spans", "score", "digest", "level", "stratum", "node", "held"]


def words(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(["ka", "lo", "mi", "ter", "su", "né", "ß"]) for _ in range(r.randint(1, 4))) for _ in range(n)]


def text(seed: int, n: int) -> str:
    return " ".join(words(seed, n))


def rows() -> list[tuple]:
    base = text(1, 120)
    found = [
        (1, base, "en", "src0"), (2, base, "en", "src0"), (3, base, "de", None), (4, None, "en", "src1"), (5, "", None, "src1"), (6, " \t\n\x0b\x0c\r ", "en", ""),
        (7, "word", "en", "src2"), (8, "two words", "en", "src2"), (9, "a b c", "fr", "src2"), (None, text(2, 60), "en", "src3"), (None, None, None, None),
        (10, text(3, 20_000), "en", "src3"), (11, "x" * 50_000, "en", "src3"), (12, "Same " * 3000, "en", "src3"), (13, "\U0001f600 né́ 　 İ Σας <|endoftext|>", "el", "src4"),
        (14, text(4, 300), "en", "src0"), (14, text(4, 300), "en", "src0"), (15, base + " end", "en", "src5"), (16, text(5, 200).upper() + "!!", "en", "src5"), (-3, text(6, 40), "en", "src5"),
        (17, 'password = "hunter2secret9"\nkey_id: abc\n' + text(7, 30), "en", "src6"),
    ]
    found += [(100 + i, base if i % 3 == 0 else text(50 + i, 30 + i), "en", "src0" if i % 2 else f"src{i % 7}") for i in range(60)]
    return [(*r, None if r[1] is None else len(r[1])) for r in found]


def table(spark, which: str = "odd"):
    """``odd``: all cases; ``empty``: no rows; ``extra``: further columns whose names operators use."""
    df = spark.createDataFrame([] if which == "empty" else rows(), SCHEMA)
    if which == "extra":
        from pyspark.sql import functions as F

        for name in CLASHING:
            df = df.withColumn(name, F.lit("clash"))
    return df


def labels(spark, which: str = "odd"):
    found = [] if which == "empty" else [(i, None if i % 11 == 5 else int(i % 4 != 0), i % 2) for i in range(1, 160)] + [(1, 0, 0), (None, 1, 0), (100, 1, None)]
    return spark.createDataFrame(found, "doc_id long, quality int, toxic int")
