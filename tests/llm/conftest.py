import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns that clash with names the operators use inside.
EXTRA = ["id", "q", "kind", "h1", "h", "size", "uid", "path", "rep", "n", "data", "grp", "node", "leaf", "w", "pi", "blocks", "ids", "part", "rank", "canon", "slot", "source_size", "_slot"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)


def prose(rng, words, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 6))) for _ in range(words))


def edge_rows(seed=5):
    rng = random.Random(seed)
    shared = prose(rng, 120)
    base = [prose(rng, rng.randrange(60, 200)) for _ in range(30)]
    texts = [None, "", " ", "\t\n\x0b", "one", "one two three", "1234 !!!", *base]
    texts += [base[0], base[0], base[0].upper(), base[1] + " tail", "head " + base[1], base[2].replace(" ", "  ", 3)]
    texts += [f"{prose(rng, 80)} {shared} {prose(rng, 30)}" for _ in range(6)]
    words = base[3].split()
    texts += [" ".join(words[:k] + ["changed"] + words[k + 1 :]) for k in (3, 40)]
    texts += ["=" * 4000 + " end", "=" * 3000, "start " + "-+" * 1500, "-+" * 1200 + " then", "x" * 200, "x" * 130 + "y", "ab " * 400, "ab " * 300, "Ünïcödé — „ﬁ“ 日本語 " * 20, "ünïcödé — „fi“ 日本語 " * 20, "a\x00b\x1ec 'tis we're", "é" * 60]
    texts += [prose(rng, 30_000)]
    rows = [(i * 3 + 1, t, rng.choice(["aa", "bb", None]), rng.choice(["s1", "s2", "é", None]), None if i % 4 else len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[8], rows[8], (rows[9][0], rows[10][1], "aa", "s1", 1)]
    return [r + tuple("clash" for _ in EXTRA) for r in rows]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
