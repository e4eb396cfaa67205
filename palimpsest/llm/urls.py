"""URL filter: host and path rules first, then a character language-model ratio.

URLs that a rule decides train two smoothed variable-order Markov models, one for accepted and one
for rejected URLs: a character's probability interpolates, after Witten and Bell, its counts behind
the last 0 to ORDER characters down to a uniform floor. A URL without a rule gets the difference of
its log-likelihoods a character; the cut between the verdicts is calibrated on the tenth part or so
of the ruled URLs that the models have not seen.

Built-in functions only. Strings are scored once however often they repeat, counts are combined
before they are shuffled, and the table of grams is dealt over SALT copies so that a gram that
most URLs hold does not meet in one task.

A null url, or one without ``://``, has empty host and path and fits no rule; it is scored as an
empty string. What stands behind the path (query and fragment) is no part of the rules and is not scored: it
names a state of a page rather than a page. If either class has no ruled URL, the cut is 0 and both models may be uniform: all
are allowed. Repeated rows get equal verdicts, and an empty table stays empty. The columns host, path, rule, verdict and
margin are replaced where the input has them; all others come back as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import words

#: (verdict, host, path): a rule fits its host and subdomains where the path starts with its own.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Longest context of a character.
ORDER = 3
#: Symbols of the uniform floor.
ALPHABET = 256
SALT = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (ASCII lower case) and path."""
    u = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(u, _PARTS, 1), _UPPER, _LOWER), F.regexp_extract(u, _PARTS, 2)


def match(host: Column, path: Column, rules=None) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null. The rules are a short list."""
    name = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(RULES if rules is None else rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _held_back(s: Column) -> Column:
    return F.substring(F.md5(s), 1, 1) == "0"


def _grams(df: DataFrame) -> DataFrame:
    """Every character (and the end) of ``s`` with the ORDER characters before it, as ``gram``."""
    padded = F.concat(F.lit("\u0002" * ORDER), F.col("s"), F.lit("\u0003"))
    return df.select("*", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("s") + 1), lambda i: F.substr(padded, i, F.lit(ORDER + 1)))).alias("gram"))


def _model(seen: DataFrame, asked: DataFrame) -> DataFrame:
    """Log probabilities ``la`` and ``lr`` of each asked gram's last character.

    seen: gram, a and r (counts in accepted and rejected URLs); asked: gram, distinct.
    """
    out = asked
    p = {c: F.lit(1.0 / ALPHABET) for c in "ar"}
    for k in range(ORDER + 1):
        tail = F.substring("gram", ORDER + 1 - k, k + 1)
        chars = seen.groupBy(tail.alias(f"g{k}")).agg(F.sum("a").alias(f"a{k}"), F.sum("r").alias(f"r{k}"))
        before = F.substring(F.col(f"g{k}"), 1, k).alias(f"h{k}")
        contexts = chars.groupBy(before).agg(*[f.alias(x) for c in "ar" for f, x in ((F.sum(f"{c}{k}"), f"n{c}{k}"), (F.count(F.when(F.col(f"{c}{k}") > 0, 1)), f"t{c}{k}"))])
        out = out.withColumn(f"g{k}", tail).withColumn(f"h{k}", F.substring("gram", ORDER + 1 - k, k)).join(chars, f"g{k}", "left")
        out = out.join(F.broadcast(contexts), f"h{k}", "left") if k == 0 else out.join(contexts, f"h{k}", "left")  # order 0 has one context
        for c in "ar":
            n, t = F.coalesce(f"n{c}{k}", F.lit(0)), F.coalesce(f"t{c}{k}", F.lit(0))
            out = out.withColumn(f"p{c}{k}", F.when(n > 0, (F.coalesce(f"{c}{k}", F.lit(0)) + t * p[c]) / (n + t)).otherwise(p[c]))
            p[c] = F.col(f"p{c}{k}")
        out = out.select("gram", f"pa{k}", f"pr{k}")
    return out.select("gram", F.log(p["a"]).alias("la"), F.log(p["r"]).alias("lr"))


def _score(strings: DataFrame, model: DataFrame) -> DataFrame:
    """``s`` and ``margin``: log-likelihood a character under the accepted less the rejected model."""
    dealt = model.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    grams = _grams(strings.select("s")).withColumn("salt", F.pmod(F.hash("s"), F.lit(SALT)))
    return grams.join(dealt, ["gram", "salt"]).groupBy("s").agg((F.sum(F.round((F.col("la") - F.col("lr")) * 1e9).cast("long")) / 1e9 / F.count("*")).alias("margin"))


def judge(pages: DataFrame, url: str = "url", rules=None) -> DataFrame:
    """Add host, path, rule, verdict and margin (null where a rule decides)."""
    host, path = split_url(F.col(url))
    base = pages.drop("host", "path", "rule", "verdict", "margin").withColumn("host", host).withColumn("path", path)
    name, verdict = match(F.col("host"), F.col("path"), rules)
    base = base.withColumn("rule", name).withColumn("verdict", verdict)
    text = F.concat("host", "path")
    ruled, free = base.filter(F.col("rule").isNotNull()), base.filter(F.col("rule").isNull())

    strings = base.select(text.alias("s"), "verdict").groupBy("s").agg(F.max("verdict").alias("verdict"), F.count("*").alias("n"))
    labelled = strings.filter(F.col("verdict").isNotNull())
    fit = _grams(labelled.filter(~_held_back(F.col("s"))))
    seen = words.store(fit.groupBy("gram").agg(*[F.sum(F.when(F.col("verdict") == v, 1).otherwise(0)).alias(c) for v, c in (("allow", "a"), ("block", "r"))]))
    asked = strings.filter(F.col("verdict").isNull() | _held_back(F.col("s")))
    model = _model(seen, _grams(asked).select("gram").distinct())
    scored = words.store(_score(asked, model))

    held = scored.join(labelled, "s").groupBy("verdict").agg(F.avg("margin").alias("m"), F.coalesce(F.stddev_pop("margin"), F.lit(0.0)).alias("d"))
    stats = {r["verdict"]: r for r in held.collect()}  # two rows
    at = 0.0
    if len(stats) == 2:
        (ma, da), (mr, dr) = ((stats[v]["m"], stats[v]["d"] + 1e-6) for v in ("allow", "block"))
        at = (ma * dr + mr * da) / (da + dr)
    (own,) = words.unused(base.withColumn("margin", F.lit(0)), "s")
    free = free.drop("verdict").withColumn(own, text).join(scored.withColumnRenamed("s", own), own, "left").drop(own).withColumn("verdict", F.when(F.col("margin") < at, F.lit("block")).otherwise(F.lit("allow")))
    order = [*base.columns, "margin"]
    return reduce(DataFrame.unionByName, [ruled.withColumn("margin", F.lit(None).cast("double")).select(order), free.select(order)])


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(words.read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    levels, last = [], f"SELECT gram, 1.0 / {ALPHABET} AS pa, 1.0 / {ALPHABET} AS pr FROM asked_grams"
    for k in range(ORDER + 1):
        cond = lambda c: f"CASE WHEN coalesce(x.n{c}, 0) > 0 THEN (coalesce(c.{c}, 0) + x.t{c} * p.p{c}) / (x.n{c} + x.t{c}) ELSE p.p{c} END"
        levels.append(f"""c{k} AS (SELECT substr(gram, {ORDER + 1 - k}, {k + 1}) AS g, sum(a) AS a, sum(r) AS r FROM seen GROUP BY 1),
x{k} AS (SELECT substr(g, 1, {k}) AS h, sum(a) AS na, sum(r) AS nr, count(*) FILTER (a > 0) AS ta, count(*) FILTER (r > 0) AS tr FROM c{k} GROUP BY 1),
p{k} AS (SELECT p.gram, {cond("a")} AS pa, {cond("r")} AS pr FROM ({last}) p LEFT JOIN c{k} c ON c.g = substr(p.gram, {ORDER + 1 - k}, {k + 1}) LEFT JOIN x{k} x ON x.h = substr(p.gram, {ORDER + 1 - k}, {k}))""")
        last = f"SELECT * FROM p{k}"
    fits = [(f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')", v, h + p) for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))]
    pick = lambda i: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[i]}'" for f in fits) + " END"
    pad = "repeat(chr(2), %d) || s || chr(3)" % ORDER
    gram = f"substr({pad}, unnest(range(1, length(s) + 2)), {ORDER + 1})"
    return f"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
b AS (SELECT *, host || path AS s, {pick(2)} AS rule, {pick(1)} AS v FROM u),
strings AS (SELECT s, max(v) AS v FROM b GROUP BY s),
seen AS (SELECT gram, sum(CASE WHEN v = 'allow' THEN 1 ELSE 0 END) AS a, sum(CASE WHEN v = 'block' THEN 1 ELSE 0 END) AS r
    FROM (SELECT v, {gram} AS gram FROM strings WHERE v IS NOT NULL AND md5(s)[1] <> '0') GROUP BY 1),
asked AS (SELECT s, v FROM strings WHERE v IS NULL OR md5(s)[1] = '0'),
gs AS (SELECT s, {gram} AS gram FROM asked),
asked_grams AS (SELECT DISTINCT gram FROM gs),
{", ".join(levels)},
scored AS (SELECT s, sum(CAST(round((ln(pa) - ln(pr)) * 1e9) AS BIGINT)) / 1e9 / count(*) AS margin FROM gs JOIN p{ORDER} USING (gram) GROUP BY s),
st AS (SELECT avg(margin) FILTER (v = 'allow') AS ma, stddev_pop(margin) FILTER (v = 'allow') + 1e-6 AS da, avg(margin) FILTER (v = 'block') AS mr, stddev_pop(margin) FILTER (v = 'block') + 1e-6 AS dr
    FROM scored JOIN asked USING (s) WHERE v IS NOT NULL),
cut AS (SELECT coalesce((ma * dr + mr * da) / (da + dr), 0) AS edge FROM st)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN margin < edge THEN 'block' ELSE 'allow' END) AS verdict FROM b LEFT JOIN scored USING (s), cut
"""


SQL = _sql()
