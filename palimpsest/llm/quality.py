"""Quality rules as a bitmask ledger.

``ledger`` measures every text once and stores the measurements with one failure bit a rule.
Policies are versioned sets of bits: ``apply_policy`` decides from the stored bits alone, and
``ablations`` counts, from one aggregation by bit pattern, what each rule of a policy costs.
Built-in functions only; one narrow pass, no shuffle before ``ablations``.

Null and empty texts have no words, fail the length rule and are rejected. Repeated rows get equal
rows, and an empty table stays empty. Columns of the input that have the name of a new column are replaced; all others
come back as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import words

#: Rule name -> test on the measurements. The position in this list is the bit: append only.
RULES: list[tuple[str, str]] = [
    ("too_short", "n_words < 50"),
    ("repeated_trigrams", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "n_dup_lines > 3 AND 10 * n_dup_lines > 3 * n_lines"),
    ("word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words)"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["too_short"] | BIT["repeated_trigrams"]

#: Policy version -> bits that reject.
POLICIES = {
    "base": BASE,
    "v1": BASE | BIT["symbols"] | BIT["repeated_lines"] | BIT["word_length"],
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


#: Whether windows x and y (hash and position packed) have the same hash, and whether the same words.
_ALIKE = "coalesce(shiftright({x}, b) = shiftright({y}, b), false)"
_EQUAL = " AND ".join(f"get(w, CAST({{x}} & mask AS INT) + {k}) = get(w, CAST({{y}} & mask AS INT) + {k})" for k in range(3))
#: Whether sorted windows x and y (words and position) have the same words.
_SAME = "coalesce(x.a = get(e, i {n}).a AND x.b = get(e, i {n}).b AND x.c = get(e, i {n}).c, false)"


def _repeat_words(df: DataFrame) -> DataFrame:
    """Words that lie in a 3-word window found twice or more in the text ``w``.

    A window's hash is packed with its position (in as many low bits as the text needs); after a
    sort, windows of equal hash are neighbours, and their words are compared. In the rare text where
    different windows share a hash, the windows are sorted by their words. The words that repeated windows
    cover follow from the gaps between their positions.
    """
    df = df.withColumn("b", F.expr("CAST(length(bin(size(w))) AS INT)")).withColumn("mask", F.expr("shiftleft(1L, b) - 1L"))
    df = df.withColumn("p", F.expr("""CASE WHEN size(w) < 3 THEN CAST(array() AS ARRAY<BIGINT>) ELSE sort_array(transform(sequence(0, size(w) - 3),
        i -> shiftleft(xxhash64(get(w, i), get(w, i + 1), get(w, i + 2)), b) | CAST(i AS BIGINT))) END"""))
    alike = lambda n: _ALIKE.format(x="x", y=f"get(p, i {n})")
    df = df.withColumn("clash", F.expr(f"exists(transform(p, (x, i) -> {alike('- 1')} AND NOT ({_EQUAL.format(x='x', y='get(p, i - 1)')})), v -> v)"))
    df = df.withColumn("e", F.expr("CASE WHEN clash THEN array_sort(transform(sequence(0, size(w) - 3), i -> struct(get(w, i) AS a, get(w, i + 1) AS b, get(w, i + 2) AS c, CAST(i AS BIGINT) AS i))) END"))
    df = df.withColumn("r", F.expr(f"""sort_array(CASE WHEN clash THEN transform(filter(e, (x, i) -> {_SAME.format(n='- 1')} OR {_SAME.format(n='+ 1')}), x -> x.i)
        ELSE transform(filter(p, (x, i) -> {alike('- 1')} OR {alike('+ 1')}), x -> x & mask) END)"""))
    return df.withColumn("n_repeat_words", F.expr("""CASE WHEN size(r) = 0 THEN 0L ELSE 3L + aggregate(zip_with(slice(r, 2, size(r)), slice(r, 1, size(r) - 1), (x, y) -> least(3L, x - y)), 0L, (s, x) -> s + x) END"""))


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace the text by its measurements."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in (text, *MEASURES)]
    (own,) = words.unused(df, "own")  # a row is no empty struct
    out = df.select(F.struct(*rest, F.lit(0).alias(own)).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    out = out.withColumn("w", F.regexp_extract_all("t", F.lit(f"({words.WORD})"), F.lit(1)))
    out = out.withColumn("lines", F.filter(F.split("t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    out = _repeat_words(out)
    measures = F.struct(
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace("t", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.char_length("t") - F.char_length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
    )
    # Generated columns are computed once: a filter on them is not pushed below, where each of its
    # references would measure the text again.
    out = out.select("row", F.explode(F.array(measures)).alias("m"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in df.columns if c not in (text, *MEASURES)], "m.*")


def ledger(df: DataFrame, text: str = "text") -> DataFrame:
    """Measurements and ``rule_bits`` (long): bit i is set where rule i fails the text."""
    bits = F.lit(0).cast("long")
    for i, (_, test) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(test), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measure(df.drop("rule_bits"), text).withColumn("rule_bits", bits)


def rejected(policy: str) -> Column:
    return F.col("rule_bits").bitwiseAND(F.lit(POLICIES[policy]).cast("long")) != 0


def apply_policy(book: DataFrame, policy: str = "v1") -> DataFrame:
    """Add ``kept`` and the policy's version; texts are not read again."""
    return book.withColumn("kept", ~rejected(policy)).withColumn("policy", F.lit(policy))


def ablations(book: DataFrame, policy: str = "v1") -> DataFrame:
    """A row for each rule of the policy: documents that fail it, that only it rejects, and that the
    policy keeps with and without it. One partial aggregation by bit pattern feeds all of them."""
    mask = POLICIES[policy]
    patterns = words.cut(book.groupBy("rule_bits").agg(F.count("*").alias("n")))  # a row for each pattern, before the arms multiply it
    rules = [(name, bit) for name, bit in BIT.items() if bit & mask]
    arms = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(bit).cast("long").alias("bit")) for name, bit in rules])
    each = patterns.select("rule_bits", "n", F.explode(arms).alias("r")).select("rule_bits", "n", "r.rule", "r.bit")
    live = F.col("rule_bits").bitwiseAND(F.lit(mask).cast("long"))
    tally = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    return each.groupBy("rule", "bit").agg(
        tally(live.bitwiseAND(F.col("bit")) != 0).alias("failing"),
        tally(live == F.col("bit")).alias("rejected_by_it_alone"),
        tally(live == 0).alias("kept_with"),
        tally((live == 0) | (live == F.col("bit"))).alias("kept_without"),
    )


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = apply_policy(ledger(words.read(spark, sf_dir, "documents").select("doc_id", "text")))
    failed = F.col("rule_bits").bitwiseAND(F.lit(BASE).cast("long")) != 0
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept", "rule_bits")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM d),
g AS (SELECT rn, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM (SELECT rn, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT rn, i FROM (SELECT rn, i, count(*) OVER (PARTITION BY rn, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT rn, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) AS v(k) GROUP BY rn),
m AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(ls) AS n_lines,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
    FROM w LEFT JOIN c USING (rn)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN n_dup_lines > 3 AND 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END)
    + (CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words) THEN 16 ELSE 0 END) AS rule_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (rule_bits & 3) <> 0 AS base_failed,
    (rule_bits & 31) = 0 AS kept, CAST(rule_bits AS BIGINT) AS rule_bits FROM b
"""
