import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kind int, fp string, s string, t long"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with nulls, empty and long texts, copies, near copies and columns whose names operators use themselves."""
    import random

    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [None, "", " \t\n", "a", "a ", "A", "one two", say(4000), "é ß\xa0x"]
    base = [say(60) for _ in range(12)]
    texts += base + base[:4] + [base[0]] * 30 + [b.replace(" ", "\n", 3) for b in base[:3]]
    for b in base[:6]:
        w = b.split()
        w[10] = "changed"
        texts.append(" ".join(w))
    rows = [(k, t, "en", [None, "s1", "s2", "s1"][k % 4] if k % 3 else "s0", len(t or ""), 7, "x", "y", 3) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
