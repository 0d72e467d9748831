"""Small tables with odd rows."""

import random

import pytest
from conftest_rows import SCHEMA


def words(rng, n, pool):
    return " ".join(rng.choice(pool) for _ in range(n))


def sample_rows(seed=1, n=60):
    """Prose in two made-up languages, with copies, near copies, junk, nulls, empty and long texts."""
    rng = random.Random(seed)
    pools = {"xa": [a + b for a in ("ka", "to", "mi", "ru", "se") for b in ("n", "la", "ro", "st", "vi")], "yb": [a + b for a in ("gru", "pfe", "zwo", "sch") for b in ("ung", "heit", "en", "ig", "acht")]}
    rows = []
    for i in range(n):
        lang = "xa" if i % 3 else "yb"
        text = "\n".join(words(rng, 30, pools[lang]) for _ in range(rng.randint(2, 6)))
        rows.append([i, text, lang, f"s{i % 4}", len(text)])
    rows[10][1] = rows[2][1]
    rows[11][1] = rows[2][1] + " extra"
    rows[12][1] = rows[2][1].upper()
    rows[13][1] = None
    rows[14][1] = ""
    rows[15][1] = "  \n\t "
    rows[16][1] = "same same same " * 40
    rows[17][1] = words(rng, 6000, pools["xa"])
    rows[18][1] = "été Ünïcode ßtraße 漢字 " + rows[4][1]
    rows[19][3] = None
    rows[20][2] = None
    for i in range(25, 40):
        rows[i][1] = "  A Common Line. \n" + rows[i][1]
    rows[41][1] = "prefix here " + rows[40][1][:300] + " and more"
    return [tuple(r) for r in rows]


@pytest.fixture(scope="session")
def rows():
    return sample_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def odd(spark, rows):
    """Repeated rows, a null id, and columns with names that operators use themselves."""
    more = [*rows[:12], rows[3], rows[3], (None, rows[5][1], "xa", "s1", 1), (None, None, None, None, None)]
    return spark.createDataFrame([(*r, 1, "x", 2) for r in more], SCHEMA + ", size int, n_words string, h int")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
