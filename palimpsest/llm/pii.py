"""Surrogates for personal data.

One pattern finds e-mail and IP addresses, phone, card, social-security and bank numbers,
credentials and titled names. Every entity gets a keyed replacement of its own type: character by
character of the same class (digit, hex digit, small or capital letter, Latin or Cyrillic), with
punctuation kept; cards keep their first digit and whether the check digit holds, IPv4 addresses
stay valid, a name keeps title, gender and script. The replacement depends on key, type and
canonical form (lower case, letters and digits only), so one entity is replaced alike in every text
and spelling. A name without a title is not detected.

Collision check: over all distinct entities, replacements that two entities share, or that are
themselves an entity of the corpus, are drawn again with a higher salt, until none is left; usually
none is at first, then texts are rewritten where they are. Only texts that hold a redrawn entity
need the join with the salts. Where a form has too few free values (the corpus itself holds most of
them), replacements grow by a character a round beyond the first ROUNDS, so that redrawing always ends.

Built-in functions only. Patterns and replacements take time in proportion to the text, and no loop of the
pattern recurses, so that long texts and long entities are safe. A null text stays null, texts without
entities come back unchanged, and repeated rows are rewritten alike. All other columns come back as they
are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import words

#: Key of the replacements where none is given; a deployment passes its own secret.
KEY = "palimpsest"
#: Rounds of redrawing in the entity's own form; from then on a replacement is longer than its entity.
ROUNDS = 8

_L, _R = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_HEX = "[0-9A-Fa-f]{1,4}"
_MALE = "Mr|Herr|Monsieur|Señor|Sr|Господин"
_FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Госпожа"
_BY_FIRST = {
    r"[0-9]": [
        rf"(?<![\p{{L}}\p{{N}}.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?[\p{{L}}\p{{N}}])",
        rf"\d{{3}}-\d{{2}}-\d{{4}}{_R}",
        rf"(?:\d[ \-]?){{12,18}}\d{_R}",
        rf"(?<![+.\-])\d{{3}}[.\-]\d{{3}}[.\-]\d{{4}}{_R}",
    ],
    r"[0-9A-Fa-f]": [
        rf"(?<!:)(?:{_HEX}:){{7}}{_HEX}(?![\p{{L}}\p{{N}}:])",
        rf"(?<!:)(?=[A-Fa-f:]{{0,35}}[0-9]){_HEX}(?::{_HEX}){{0,6}}::(?:{_HEX}(?::{_HEX}){{0,6}})?(?![\p{{L}}\p{{N}}:])",
    ],
    r"[+(]": [
        rf"(?<!\+)(?:\+\d{{1,3}}[ .\-]?)?\(\d{{2,4}}\)[ .\-]?\d{{3,4}}[ .\-]\d{{3,4}}{_R}",
        rf"(?<!\+)\+\d{{1,3}}(?:[ .\-]?\d{{1,4}}){{3,6}}{_R}",
    ],
    r"[A-Z]": [
        rf"[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?{_R}",
        rf"(?:AKIA|ASIA)[A-Z0-9]{{16}}{_R}",
    ],
    r"[gsx]": [r"(?:ghp_|gho_|sk-|xox[bp]-)[A-Za-z0-9_\-]{16,}"],
    r"\p{Lu}": [rf"(?:{_MALE}|{_FEMALE})\.? \p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)?{_R}"],
    r"[A-Za-z0-9_\-+/]": [r"(?<=(?i:password|passwd|secret|token|api_key|apikey)\s{0,2}[=:]\s{0,2}[\"']?)[A-Za-z0-9_\-+/]{8,}"],
}
#: All of them. No entity starts inside a word, so most positions cost one look back, and an
#: alternative is tried only where its first character stands.
#: A host runs to its last label that two letters begin: possessive loops, for those that give back recurse.
_LABEL = r"[\p{L}\p{N}\-]++\."
_HOST = rf"(?:(?:{_LABEL}(?!\p{{L}}{{2}}))*+{_LABEL}(?=\p{{L}}{{2}}))++\p{{L}}{{2,}}+"
PATTERN = rf"{_L}(?:(?<![._%+\-])[\p{{L}}\p{{N}}._%+\-]++@{_HOST}|" + "|".join(f"(?={first})(?:{'|'.join(of)})" for first, of in _BY_FIRST.items()) + ")"
_HINTS = [*_MALE.split("|"), *_FEMALE.split("|"), "AKIA", "ASIA", "ghp_", "gho_", "sk-", "xoxb-", "xoxp-"]

# Fixed first names, by gender and script.
_FIRST = {
    ("m", "latin"): "James Robert John Michael David Thomas Daniel Paul Mark Steven Andrew Kevin Brian Peter Simon Adrian",
    ("f", "latin"): "Mary Linda Susan Karen Nancy Laura Sarah Anna Emma Julia Helen Diana Alice Clara Maria Irene",
    ("m", "cyrillic"): "Иван Сергей Андрей Дмитрий Алексей Павел Николай Михаил Борис Виктор Юрий Олег Антон Роман Максим Денис",
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Ирина Светлана Татьяна Вера Нина Юлия Дарья Софья Ксения Полина Алиса",
}
_ONSET = {"latin": "b br c d dr f g gr h k l m n p r s".split(), "cyrillic": "б бр в г д ж з к кр л м н п р с т".split()}
_VOWEL = {"latin": "a e i o".split(), "cyrillic": "а е и о".split()}


def _hinted(text: Column) -> Column:
    """False only for texts that cannot hold an entity: plain scans spare them the pattern."""
    out = text.rlike("[0-9@=:]")
    for hint in _HINTS:
        out = out | text.contains(hint)
    return out


def _matches(text: Column) -> Column:
    return F.regexp_extract_all(F.when(_hinted(text), text).otherwise(F.when(text.isNotNull(), "")), F.lit(f"({PATTERN})"), F.lit(1))


def kind(m: Column) -> Column:
    digits = F.char_length(F.regexp_replace(m, r"\D", ""))
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike(rf"^(?:{_MALE})\.? "), "name_m")
        .when(m.rlike(rf"^(?:{_FEMALE})\.? "), "name_f")
        .when(m.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), "ipv4")
        .when(m.rlike(r"^[0-9A-Fa-f:]++$") & m.contains(":"), "ipv6")
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(m.rlike(r"^[0-9 \-]+$") & digits.between(13, 19), "card")
        .when(m.rlike(r"^[A-Z]{2}\d{2}[ A-Z0-9]+$"), "iban")
        .when(m.rlike(r"^[0-9+(). \-]+$") & m.rlike(r"[+(). \-]"), "phone")
        .otherwise("secret")
    )


def canonical(m: Column, type_: Column) -> Column:
    name = F.regexp_replace(m, r"^\p{L}+\.? ", "")
    return F.when(type_.startswith("name"), F.lower(name)).when(type_ == "ipv4", m).when(type_ == "ipv6", F.lower(m)).otherwise(F.lower(F.regexp_replace(m, r"[^\p{L}\p{N}]", "")))


def _stream(key: str, type_: Column, canon: Column, salt: Column) -> Column:
    """Hex digits that decide a replacement: 128 bytes."""
    seed = F.concat_ws("\u0001", F.lit(key), type_, canon, salt.cast("string"))
    return F.concat(*[F.sha2(F.concat(seed, F.lit(f"\u0001{i}")), 512) for i in range(2)])


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substr(stream, (i % 128) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(chars: str, n: Column) -> Column:
    return F.substr(F.lit(chars), n % len(chars) + 1, F.lit(1))


_LATIN = "abcdefghijklmnopqrstuvwxyz"
_CYRILLIC = "абвгдежзийклмнопрстуфхцчшщъыьэюя"


def _signs(m: Column) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(m, r"[^\p{L}\p{N}]++", "")


def _characters(m: Column, stream: Column, head: Column, tail: Column, hexes: Column) -> Column:
    """Replace letters and digits by others of their class, the i-th by the i-th byte; but not the
    first ``head`` and those from ``tail`` on. What stands between them is kept."""

    def one(c: Column, i: Column) -> Column:
        n = _byte(stream, i)
        return (
            F.when((i < head) | (i >= tail), c)
            .when(hexes & c.rlike("[0-9a-f]"), _pick("0123456789abcdef", n))
            .when(hexes & c.rlike("[A-F]"), _pick("0123456789ABCDEF", n))
            .when(c.rlike(r"\p{N}"), _pick("0123456789", n))
            .when(c.rlike("[А-ЯЁ]"), _pick(_CYRILLIC.upper(), n))
            .when(c.rlike("[а-яё]"), _pick(_CYRILLIC, n))
            .when(c.rlike(r"\p{Lu}"), _pick(_LATIN.upper(), n))
            .otherwise(_pick(_LATIN, n))
        )

    new = F.transform(F.split(_signs(m), ""), one)
    return F.array_join(F.zip_with(F.split(m, r"[\p{L}\p{N}]", -1), F.concat(new, F.array(F.lit(""))), lambda gap, c: F.concat(gap, c)), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum of a digit string."""
    n = F.char_length(digits)
    values = F.transform(F.split(digits, ""), lambda c, i: F.when((n - i) % 2 == 0, F.get(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))


def _card(m: Column, drawn: Column) -> Column:
    """The drawn number with the last digit that makes its check hold, if the entity's check holds."""
    digits, new = F.regexp_replace(m, r"\D", ""), F.regexp_replace(drawn, r"\D", "")
    head = F.substr(new, F.lit(1), F.char_length(new) - 1)
    check = ((10 - _luhn(F.concat(head, F.lit("0"))) % 10) % 10).cast("string")
    return F.when(_luhn(digits) % 10 == 0, F.concat(F.substr(drawn, F.lit(1), F.char_length(drawn) - 1), check)).otherwise(drawn)


def _name(m: Column, type_: Column, stream: Column) -> Column:
    title = F.regexp_extract(m, r"^\p{L}+\.? ", 0)
    rest = F.substr(m, F.char_length(title) + 1, F.lit(1 << 20))

    def names(script: str) -> Column:
        item = lambda xs, i: F.get(F.array(*map(F.lit, xs)), _byte(stream, F.lit(i)) % len(xs))
        first = F.when(type_ == "name_m", item(_FIRST["m", script].split(), 0)).otherwise(item(_FIRST["f", script].split(), 0))
        last = F.initcap(F.concat(*[item(x[script], 1 + 2 * i + j) for i in range(4) for j, x in enumerate((_ONSET, _VOWEL))]))
        return F.when(rest.contains(" "), F.concat(first, F.lit(" "), last)).otherwise(last)

    return F.concat(title, F.when(rest.rlike(r"\p{IsCyrillic}"), names("cyrillic")).otherwise(names("latin")))


def typed(found: Column) -> Column:
    """Entities (an array of strings) as structs of spelling ``m``, type ``t`` and canonical form ``c``."""
    with_type = F.transform(found, lambda m: F.struct(m.alias("m"), kind(m).alias("t")))
    return F.transform(with_type, lambda e: F.struct(e["m"].alias("m"), e["t"].alias("t"), canonical(e["m"], e["t"]).alias("c")))


def _kept_head(m: Column, t: Column) -> Column:
    """Letters and digits at the beginning that a replacement keeps."""
    country = F.char_length(_signs(F.regexp_extract(m, r"^\+\d{1,3}(?=[ .\-])", 0)))
    maker = F.char_length(_signs(F.regexp_extract(m, r"^(?:AKIA|ASIA|ghp_|gho_)", 0)))
    return F.when(t == "card", 1).when(t == "iban", 2).when(t == "secret", maker).when(t == "phone", country).otherwise(0)


def _kept_tail(m: Column, t: Column) -> Column:
    """Letters and digits at the end that a replacement keeps: an address's top domain."""
    return F.when(t == "email", F.char_length(F.regexp_extract(m, r"\.(\p{L}{2,}+)$", 1))).otherwise(0)


def _longer(new: Column, t: Column, stream: Column, salt: Column) -> Column:
    """Beyond ROUNDS, a letter or digit more a round."""
    more = F.substr(stream, F.lit(200), F.greatest(salt - ROUNDS, F.lit(0)))
    return F.concat(new, F.when(t.isin("email", "name_m", "name_f"), F.translate(more, "0123456789", "ghijklmnop")).otherwise(F.translate(more, "abcdef", "012345")))


def replaced(entities_: Column, key: str, salt) -> Column:
    """The replacements of typed entities. salt: of a struct as ``typed`` gives it."""

    def prepare(e: Column) -> Column:
        m, t = e["m"], e["t"]
        return F.struct(m.alias("m"), t.alias("t"), _stream(key, t, e["c"], salt(e)).alias("s"), salt(e).alias("salt"), _kept_head(m, t).alias("head"), (F.char_length(_signs(m)) - _kept_tail(m, t)).alias("tail"), ((t == "secret") & m.rlike("^[0-9a-f]+$") | (t == "ipv6")).alias("hexes"))

    def draw(e: Column) -> Column:
        fixed = e["t"].isin("ipv4", "name_m", "name_f")
        return F.struct(*[e[c].alias(c) for c in ("m", "t", "s", "salt")], F.when(~fixed, _characters(e["m"], e["s"], e["head"], e["tail"], e["hexes"])).alias("d"))

    def finish(e: Column) -> Column:
        m, t = e["m"], e["t"]
        ip = F.array_join(F.transform(F.array(*map(F.lit, range(4))), lambda i: (_byte(e["s"], i) % 254 + 1).cast("string")), ".")
        new = F.when(t.startswith("name"), _name(m, t, e["s"])).when(t == "ipv4", ip).when(t == "card", _card(m, e["d"])).otherwise(e["d"])
        return _longer(new, t, e["s"], e["salt"])

    return F.transform(F.transform(F.transform(entities_, prepare), draw), finish)


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """Distinct type ``t`` and canonical form ``c`` of the entities of all texts, with one spelling ``m``."""
    found = docs.select(F.explode(_matches(F.col(text))).alias("m")).groupBy("m").agg(F.count("*").alias("n"))
    return found.select("n", F.explode(typed(F.array("m"))).alias("e")).groupBy("e.t", "e.c").agg(F.min("e.m").alias("m"), F.sum("n").alias("n"))


def salts(found: DataFrame, key: str) -> DataFrame | None:
    """``t``, ``c`` and ``salt`` of the entities that collide at salt 0; None if there are none.

    Of entities that draw the same replacement the least keeps it. A replacement that is an entity of
    the corpus is given up in any case.
    """
    real = found.select("t", F.col("c").alias("drawn"), F.lit(True).alias("real"))
    current = found.select("t", "c", "m", F.lit(0).alias("salt"))
    entity = F.array(F.struct("m", "t", "c"))
    while True:
        drawn = current.select("*", F.explode(replaced(entity, key, lambda e: F.col("salt"))).alias("x"))
        drawn = drawn.select("t", "c", canonical(F.col("x"), F.col("t")).alias("drawn"))
        first = drawn.groupBy("t", "drawn").agg(F.min("c").alias("first"), F.count("*").alias("n"))
        clash = first.join(real, ["t", "drawn"], "left").filter((F.col("n") > 1) | F.col("real"))
        bad = words.store(drawn.join(clash, ["t", "drawn"]).filter(F.coalesce("real", F.lit(False)) | (F.col("c") != F.col("first"))).select("t", "c"))
        if bad.isEmpty():
            changed = current.filter(F.col("salt") > 0).select("t", "c", "salt")
            return None if changed.isEmpty() else changed
        current = words.store(current.join(bad.withColumn("bad", F.lit(1)), ["t", "c"], "left").select("t", "c", "m", (F.col("salt") + F.coalesce("bad", F.lit(0))).alias("salt")))
        words.release(bad)


def _rewrite(text: Column, key: str, salt) -> Column:
    """The text with every entity replaced."""
    new = F.concat(replaced(typed(_matches(text)), key, salt), F.array(F.lit("")))
    return F.when(_hinted(text) & text.rlike(PATTERN), F.array_join(F.zip_with(F.split(text, PATTERN, -1), new, lambda gap, x: F.concat(gap, x)), "")).otherwise(text)


def pseudonymise(docs: DataFrame, key: str = KEY, text: str = "text") -> DataFrame:
    """The documents, personal data replaced; all other columns as they are."""
    redrawn = salts(words.store(entities(docs, text)), key)
    if redrawn is None:
        return docs.withColumn(text, _rewrite(F.col(text), key, lambda e: F.lit(0)))
    # Which texts hold a redrawn entity, by the text's own hash: equal texts are rewritten alike.
    name = lambda t, c: F.concat_ws("\u0001", t, c)
    x, by = words.unused(docs, "x", "salts")
    held = docs.select(F.xxhash64(text).alias(x), F.explode(typed(_matches(F.col(text)))).alias("e")).select(x, "e.t", "e.c")
    by_text = held.join(redrawn, ["t", "c"]).select(x, F.struct(name(F.col("t"), F.col("c")).alias("k"), "salt").alias("e")).groupBy(x).agg(F.map_from_entries(F.collect_set("e")).alias(by))
    joined = docs.withColumn(x, F.xxhash64(text)).join(by_text, x, "left")
    salt = lambda e: F.coalesce(F.try_element_at(by, name(e["t"], e["c"])), F.lit(0))
    return joined.withColumn(text, _rewrite(F.col(text), key, salt)).select(*docs.columns)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(words.read(spark, sf_dir, "documents").select("doc_id", "text"))
