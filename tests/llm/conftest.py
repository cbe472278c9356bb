import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, row string, node long, label string, root string, score string"
WORDS = ["the", "of", "Erh", "ingle", "thought", "éelle", "über", "ñandú", "And", "x1", "ion.", "was,", "re-do", "don't", "中文", "a"]


def words(rng, n):
    return [rng.choice(WORDS) + rng.choice(["", "", "s", "ed", str(rng.randint(0, 99))]) for _ in range(n)]


def corpus(seed=3):
    """Texts with exact and near copies, shared passages, empty, null and long ones, and repeated rows."""
    rng = random.Random(seed)
    passage = words(rng, 70)
    out = []
    for k in range(60):
        out.append((k, " ".join(words(rng, rng.randint(1, 160)))))
    for k in range(60, 75):  # copies with other white space
        text = out[rng.randint(0, 25)][1]
        out.append((k, text.replace(" ", rng.choice(["  ", "\n", "\t "])) + rng.choice(["", " \r\n"])))
    for k in range(75, 95):  # near copies of one text
        base = (" ".join(words(random.Random(9), 120))).split(" ")
        for _ in range(rng.randint(0, 4)):
            base[rng.randrange(len(base))] = "changed" + str(rng.randint(0, 9))
        out.append((k, " ".join(base)))
    for k in range(95, 103):  # a passage of 70 words
        out.append((k, " ".join(words(rng, rng.randint(0, 30)) + passage + words(rng, rng.randint(0, 30)))))
    out += [(103, ""), (104, None), (105, "   \n"), (106, " ".join(words(rng, 9000))), (107, "one two three four"), (108, "One  two three FOUR"), (109, "x" * 3000), (110, "buy " * 200), (111, "buy " * 180)]
    out += [(5, out[5][1]), (None, "no id here " * 20), (None, "no id here " * 20)]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    data = [(d, t, "en", "s", len(t or ""), "k", "r", 1, "l", "z", "q") for d, t in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)

