from collections import Counter

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import quality
from tests.llm.conftest import words_of


def brute(text):
    w, t = words_of(text), text or ""
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if words_of(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_measures_match_brute_force(docs, rows):
    got = {(r["doc_id"], r["n_words"]): r for r in quality.ledger(docs).collect()}
    for i, t, *_ in rows:
        want = brute(t)
        r = got[i, want[0]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want


def test_policies_read_bits_only(docs):
    book = quality.ledger(docs).filter("doc_id IS NOT NULL")
    base = {r["doc_id"]: r["kept"] for r in quality.apply_policy(book, "base").collect()}
    assert not base[3] and not base[14] and base[16] and base[20] and not base[19]
    with pytest.raises(KeyError):
        quality.apply_policy(book, "none")


def test_ablations_add_up(docs):
    book = quality.ledger(docs)
    n = quality.apply_policy(book).filter("kept").count()
    for r in quality.ablations(book).collect():
        assert r["kept_with"] == n and r["kept_without"] == n + r["rejected_by_it_alone"] and r["failing"] >= r["rejected_by_it_alone"]


def test_plan_is_native_and_names_may_clash(clashing, empty):
    out = quality.apply_policy(quality.ledger(clashing))
    assert out.count() == clashing.count() and out.select("key").first()[0] == "theirs"
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert quality.ledger(empty).count() == 0 and quality.ablations(quality.ledger(empty)).count() == 0


def test_repeated_rows_get_equal_rows(docs):
    twice = quality.ledger(docs.unionAll(docs)).groupBy("doc_id", "rule_bits").count()
    assert {r["count"] for r in twice.filter(F.col("doc_id").isNotNull()).collect()} == {2}


def test_windows_of_equal_hash_are_compared(spark, monkeypatch):
    """With hashes of a bit, nearly all windows clash and are sorted by their words."""
    texts = ["a b c a b c d", "a b c d e f g h", "x x x x", "a b c d a b c x b c d", "", "one two", " ".join("abcdefgh"[i * i % 7] for i in range(400))]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    real, exprs = F.expr, []

    def coarse(e):
        exprs.append(e)
        return real(e.replace("xxhash64(get(w, i), get(w, i + 1), get(w, i + 2))", "(xxhash64(get(w, i), get(w, i + 1), get(w, i + 2)) & 1L)"))

    monkeypatch.setattr(quality.F, "expr", coarse)
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality.ledger(d).collect()}
    monkeypatch.undo()
    assert any("xxhash64" in e for e in exprs) and got == {i: brute(t)[4] for i, t in enumerate(texts)}


def test_long_text_and_columns_keep_their_values(spark, docs):
    long = " ".join(str(i * i % 99_991) for i in range(300_000)) + "\n" + "word " * 100_000
    r = quality.ledger(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()
    assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(long)
    names = ["_w", "_b", "_t", "_m", "_s", "_p", "_l", "w", "b", "t", "m", "e", "r", "p", "lines", "mask", "clash", "row", "own", "a.b"]
    d = docs.withColumns({n: F.concat(F.lit(f"{n}/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) for n in names})
    quoted = [f"`{c}`" for c in d.columns if c != "text"]
    key = lambda rows: sorted(map(repr, rows))
    assert key(quality.apply_policy(quality.ledger(d)).select(*quoted).collect()) == key(d.select(*quoted).collect())
