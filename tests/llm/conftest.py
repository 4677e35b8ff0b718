import random

import pytest
from pyspark.sql import DataFrame

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VOWELS = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "or"]


def sentence(rng: random.Random, n: int) -> str:
    words = ["".join(rng.choice(VOWELS) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return " ".join(words).capitalize() + "."


@pytest.fixture(scope="session")
def docs(spark) -> DataFrame:
    """Nulls, empty and long texts, ties, repeated rows, near copies, and columns with clashing names."""
    rng = random.Random(4)
    texts: list = ["", None, "one", "two words", " \t\n ", "x" * 5000, "été ΣΑΣ İ 日本語 🙂 don't\x0bwe'll\x1cx"]
    base = sentence(rng, 300)
    texts += [base, base, base.replace(".", "!"), sentence(rng, 9000)]
    texts += ["\n".join(sentence(rng, rng.randint(5, 40)) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    texts += ["token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" " + sentence(rng, 30), "###a %%%b $$$c " * 20, "SHOUT!! " * 40]
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[8], (None, "no id " + base, "en", "src0", 0), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    extra = {"part": 1, "bin": 2, "row": 3, "base": 4, "found": 5, "score": 6, "word": 7, "key": 8, "fp": 9}
    from pyspark.sql import functions as F

    return df.withColumns({k: F.lit(v) for k, v in extra.items()}).repartition(3)


@pytest.fixture(scope="session")
def none(docs) -> DataFrame:
    return docs.where("false")
