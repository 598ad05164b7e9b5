import random

import pytest


@pytest.fixture(scope="session")
def corpus_rows():
    """Small documents with copies, near copies, shared passages, repeated lines, nulls, ties and long texts."""
    r = random.Random(5)
    words = ["".join(r.choice("aeiou") + r.choice("bcdfgh") for _ in range(r.randint(1, 4))) for _ in range(300)]

    def prose(n):
        return " ".join(r.choice(words) for _ in range(n))

    passage, line = prose(60), "This is a line that many documents share, number 12."
    rows = [(i, prose(r.randint(1, 80)) + "\n" + prose(20)) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(10)]
    near = rows[3][1].split()
    for i in range(12):
        copy = list(near)
        copy[i] = "zzz"
        rows.append((200 + i, " ".join(copy)))
    rows += [(300 + i, f"{prose(10)}\n{passage}\n{prose(5)}") for i in range(8)]
    rows += [(400 + i, f"{prose(4)}\n{line}\n  {line.replace('12', str(10 + i))}\nab\nab") for i in range(8)]
    rows += [(500, None), (501, ""), (502, " \n\t\n"), (503, "é😀 " * 80), (504, "a" * 5000), (505, prose(4000))]
    rows += [(-7, rows[5][1]), (506, rows[0][1]), (506, rows[0][1]), (507, prose(30)), (507, prose(31)), (None, prose(9)), (None, rows[1][1])]
    return rows


@pytest.fixture(scope="session")
def corpus(spark, corpus_rows):
    """The documents as a table with extra columns whose names the operators use inside."""
    rows = [(i, t, None if t is None else len(t), "x", 1, 2.0, "k") for i, t in corpus_rows]
    return spark.createDataFrame(
        rows, "doc_id long, text string, n_chars long, lang string, doc int, score double, key string"
    ).repartition(5)


@pytest.fixture(scope="session")
def nothing(corpus):
    return corpus.limit(0)
