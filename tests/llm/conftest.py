import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in that heed eron thin lyble nder stion whou edre anti orst beld harn mole tirn".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", "a", "en", "ou", "er"]) for _ in range(n))


@pytest.fixture(scope="session")
def docs(spark):
    """Some hundred documents: random ones, copies exact and near, shared passages, nulls, empty and
    long texts, repeated rows; a column whose name clashes with a result's."""
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(1, 120))) for i in range(60)]
    base = [prose(rng, 90) for _ in range(3)]
    for i in range(60, 100):
        w = base[i % 3].split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        rows.append((i, " ".join(w)))
    passage = prose(rng, 40)
    rows += [(i, prose(rng, 50) + "\n" + passage + " " + prose(rng, 20)) for i in range(100, 110)]
    rows += [(i, base[0].upper()) for i in range(110, 114)]
    rows += [(114, None), (115, ""), (116, " \n\t "), (117, "one"), (118, "One"), (119, prose(rng, 6000)), (120, "x " * 700)]
    rows += [rows[3], rows[70], rows[114], (None, base[1]), (None, None)]
    full = [(i, t, "en", f"src{(i or 0) % 4}" if i != 7 else None, len(t or "")) for i, t in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
