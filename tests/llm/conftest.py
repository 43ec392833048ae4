import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, fp long, length int, kind string"


def prose(rng, n):
    """Words of a small vocabulary in sentences, two of which may make a line."""
    out = []
    for k in range(n):
        word = "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(1, 7)))
        out.append(word + ("." if k % 9 == 8 or k == n - 1 else "") + ("\n" if k % 27 == 26 else " "))
    return "".join(out).rstrip(" \n")


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, long, short, empty and null ones."""
    rng = random.Random(5)
    whole = [prose(rng, rng.randint(55, 150)) for _ in range(25)]
    near = []
    for text in whole[:8]:
        words = text.split(" ")
        words[rng.randrange(len(words))] = "other"
        near.append(" ".join(words))
    odd = [None, "", " \n\t ", "one", "two words", "é ü　中文 🙂 \x1c x", prose(rng, 9000), "ab" * 20_000]
    return whole + near + whole[:5] + odd


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with columns whose names the operators use themselves, from texts or (doc_id, text)."""

    def make(rows):
        rows = [r if isinstance(r, tuple) else (k, r) for k, r in enumerate(rows)]
        data = [(i, t, "en", "src", -1, "words", 7, 3, "kind") for i, t in rows]
        return spark.createDataFrame(data, SCHEMA)

    return make
