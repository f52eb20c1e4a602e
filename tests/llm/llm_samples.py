"""Small tables with the awkward rows every operator has to stand."""

import random

from pyspark.sql import functions as F

AWKWARD = [
    None, "", " ", "\n", "a", "A b", "äöü ß É", "x" * 5000, "word " * 3000, "  two  spaces \n\n lines\n",
    "<|endoftext|> it's 12 o'clock_now", "tab\there", "　wide space", "é combining", "🙂 emoji 🙂",
]


def documents(spark, texts, first=0, **extra):
    """A documents table with a clashing extra column or two."""
    rows = [(first + i, t, "en", "src0", None if t is None else len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.withColumns({name: F.lit(value) for name, value in extra.items()})


def prose(seed, count, words=60, vocabulary=300):
    rng = random.Random(seed)
    names = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(vocabulary)]
    return [" ".join(rng.choice(names) for _ in range(rng.randint(1, words))) for _ in range(count)]
