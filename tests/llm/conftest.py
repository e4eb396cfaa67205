import random
import re

import pytest

#: Every kind of row: null id and text, empty, blank, short, repeated, shared passages, near copies, odd characters.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6))) for _ in range(n))


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="session")
def rows():
    passage = prose(80, "passage")
    base = prose(300, "base").split(" ")
    near = base.copy()
    near[150] = "changed"
    texts = {
        1: prose(200, 1), 2: prose(200, 1), 3: None, 4: "", 5: " \t\n ", 6: "one two", 7: "one two", 8: "One TWO\nthree four five",
        9: f"{prose(60, 9)}\n{passage}\n{prose(60, 10)}", 10: f"{prose(30, 11)} {passage} {prose(20, 12)}", 11: passage, 12: " ".join(base), 13: " ".join(near),
        14: "ab " * 300, 15: f"line a\nline a\n\nline a\n{prose(60, 15)}", 16: prose(5000, 16), 17: "é ü 字 🗺  x  y", 18: "w" * 20000, 19: prose(49, 19), 20: prose(50, 20), 21: prose(50, 20), 22: prose(50, 20),
    }
    out = [(i, t, "en", f"s{i % 3}" if i % 7 else None, None if t is None else len(t)) for i, t in texts.items()]
    return [*out, (None, prose(70, "null id"), None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """More columns, with names that the operators use."""
    from pyspark.sql import functions as F

    names = ["kept", "score", "rank", "n_words", "rule_bits", "hits", "key", "x", "anchors", "component", "tox_score", "tox_spans", "ids", "n_tokens", "decoded", "block", "slot", "seq", "_s", "c", "hash", "rid"]
    return docs.withColumns({n: F.lit("theirs") for n in names})
