import random

import pytest

WORDS = [f"{a}{b}" for a in ("ab", "cor", "de", "fil", "gan", "hu", "jor", "kel", "mi", "no") for b in ("la", "men", "ta", "ris", "dor", "ves", "nu", "po")]
COLUMNS = "doc_id long, text string, lang string, cell long, fp long, component_id long, score double, rank int, blob string, key string, line string, shard int, slot int, lines string, start int, length int, marks string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edge_rows():
    """Nulls, empty and long texts, repeated rows, equal texts, ties, and odd white space."""
    rng = random.Random(1)
    long = "\n".join(prose(rng, 40) for _ in range(300))
    base = prose(rng, 60)
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, base), (5, base), (6, base), (None, base), (None, None), (7, long), (8, long + " more"), (9, base.replace(" ", "  ")), (10, "é 日本 🙂 x"), (11, prose(rng, 30)), (12, "\n".join([base] * 3)), (13, base.upper())]
    return [(i, t, None if i == 4 else "en", *([1, 2, 3, 0.5, 4, "b", "k", "l", 5, 6, "n", 7, 8, "m"])) for i, t in texts]


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(edge_rows(), COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


def varied(n=120, seed=3):
    """(doc_id, text): prose with exact copies, near copies and shared lines."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lines = [prose(rng, rng.randint(3, 30)) + "." for _ in range(rng.randint(1, 6))]
        if rows and i % 5 == 0:
            lines = rng.choice(rows)[1].split("\n")
            if i % 10 == 0:
                words = lines[0].split(" ")
                words[rng.randrange(len(words))] = "changed"
                lines[0] = " ".join(words)
        if i % 7 == 0:
            lines.insert(0, "This line of licence text stands in a lot of documents.")
        rows.append((i, "\n".join(lines)))
    return rows
