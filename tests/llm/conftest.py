import random

import pytest

LONG = "una palabra muy larga " * 9000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, t string, h long, n int, node long, keep_id long, size long, bucket int, score double, _n int, k1 string, `a.b` string"


def rows():
    r = random.Random(7)
    syllables = ["the", "er", "in", "on", "an", "re", "st", "ou"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))
    out = []
    for i in range(60):
        text = " ".join(word() for _ in range(r.randint(1, 120))).capitalize() + "."
        out.append([i, text, "en" if i % 3 else "xx", f"s{i % 5}", len(text)])
    out += [[60, None, None, None, None], [61, "", "en", "s1", 0], [62, "", None, None, 0], [63, " \n\t ", "en", "s0", 4], [64, LONG, "xx", "s2", len(LONG)]]
    out += [[100 + k, out[5][1], "en", "s0", 1] for k in range(12)]  # exact copies
    out += [[200 + k, out[7][1] + " " + word() + " end", "en", "s0", 1] for k in range(6)]  # near copies
    out += [[300, "repeated row", "en", "s4", 12]] * 3  # the same row three times
    out += [[301, "mail a@b.co +1 (555) 123-4567 😀 10.0.0.1", "en", "s4", 3], [302, "12345 !!", "en", "s4", 3], [None, "no id here", "en", "s4", 10]]
    return [(*x, "x", "y", 1, 2, 3, 4, 5, 6, 0.5, 1, "k", "ab") for x in out]


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
