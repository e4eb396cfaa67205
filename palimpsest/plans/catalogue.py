"""The registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions.parse import parse_pages
from palimpsest.functions.text import clean, slug, utf16_length
from palimpsest.operators import annotate, candidates, diff, extract, fragments, history, maps, sparse
from palimpsest.plans import made  # noqa: F401  registers its queries
from palimpsest.plans.registry import QUERIES, SQL, query, read  # noqa: F401

FLAGSHIP = "page_content_hash"


def parsed(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    """The page table with these fields of the record, or all."""
    return parse_pages(read(spark, sf_dir, "pages"), fields=fields)


# Pages ------------------------------------------------------------------------------------------

_TEXT = "replace(replace(replace(replace(replace(replace({}, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"


@query("SELECT page_id, url, sha256(html) AS html_sha256, strlen(html) AS byte_length FROM pages")
def page_content_hash(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", "url", F.sha2("html", 256).alias("html_sha256"), F.octet_length("html").cast("long").alias("byte_length"))


#: Body of a page without comments; its text, as the format cleans it; plain text of a piece of markup.
_BODY = "regexp_replace(regexp_replace(html, '^.*?<body>', '', 's'), '<!--.*?-->', '', 'gs')"
_CLEAN = r"trim(regexp_replace(regexp_replace(replace({}, chr(160), ' '), '[ \t]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(13))"


def _plain(piece: str) -> str:
    return _CLEAN.format(_TEXT.format(f"regexp_replace({piece}, '<[^>]*>', '', 'g')"))


@query("SELECT page_id, " + _plain("regexp_extract(html, '<title>([^<]*)</title>', 1)") + " AS title FROM pages")
def page_titles(spark, sf_dir):
    return parsed(spark, sf_dir, "title").select("page_id", "doc.title")


_ELEMENTS = f"""WITH t AS (SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '<script>.*?</script>', '<script>', 'gs'), '<([a-z0-9]+)', 1)) AS tag FROM pages) t GROUP BY 1, 2),
s AS (SELECT page_id, unnest(parts) AS part, unnest(range(len(parts))) AS i FROM (SELECT page_id, regexp_split_to_array({_BODY}, '</?(?:p|footer|article|div|nav|ul|li|h1|body|html)(?: [^>]*)?>') AS parts FROM pages) x),
b AS (SELECT page_id, i, len(regexp_extract_all(part, '<b>')) AS own, regexp_matches(part, '<br>|<b>') OR regexp_matches(regexp_replace(part, '<[^>]*>', '', 'g'), '\\S') AS shown FROM s),
r AS (SELECT page_id, shown, coalesce(sum(own) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b),
more AS (SELECT page_id, sum(CASE WHEN shown THEN least(3, before) ELSE 0 END) AS n FROM r GROUP BY 1)
SELECT t.page_id, tag, CAST(t.n + CASE WHEN tag = 'b' THEN more.n ELSE 0 END AS BIGINT) AS n FROM t JOIN more USING (page_id)"""


@query(_ELEMENTS)
def page_element_counts(spark, sf_dir):
    """Elements of the tree by tag; a formatting element that nothing closes opens again in each later
    block with content, at most three of a kind."""
    return extract.element_counts(parsed(spark, sf_dir, "tags"))


@query("WITH h AS (SELECT page_id, regexp_extract_all(html, '<h1>(.*?)</h1>', 1, 's') AS hs FROM pages) SELECT page_id, CAST(i AS INTEGER) AS ord, 1 AS level, " + _plain("h") + " AS text, CAST(NULL AS VARCHAR) AS id FROM (SELECT page_id, unnest(hs) AS h, unnest(range(len(hs))) AS i FROM h) t")
def page_headings(spark, sf_dir):
    return extract.headings(parsed(spark, sf_dir, "headings"))


@query("WITH h AS (SELECT page_id, regexp_extract_all(html, '<li>(.*?)</li>', 1, 's') AS hs FROM pages) SELECT page_id, 0 AS list_ord, false AS ordered, CAST(i AS INTEGER) AS ord, " + _plain("h") + " AS text FROM (SELECT page_id, unnest(hs) AS h, unnest(range(len(hs))) AS i FROM h) t")
def page_list_items(spark, sf_dir):
    return extract.list_items(parsed(spark, sf_dir, "lists"))


@query("""SELECT page_id, original_href, text, count(*) AS n FROM (SELECT page_id, m[1] AS original_href, m[2] AS text FROM (SELECT page_id, unnest([[regexp_extract(x, 'href="([^"]*)"', 1), regexp_extract(x, '>([^<]*)</a>', 1)] FOR x IN regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')]) AS m FROM pages) s) t GROUP BY 1, 2, 3""".replace("m[1]", _TEXT.format("m[1]")).replace("m[2]", _TEXT.format("m[2]")))
def page_links(spark, sf_dir):
    return extract.links(parsed(spark, sf_dir, "links")).groupBy("page_id", "original_href", "text").agg(F.count("*").alias("n"))


@query("SELECT page_id, sha256(m) AS sha256, strlen(m) AS byte_length FROM (SELECT page_id, unnest(regexp_extract_all(html, '<script>(.*?)</script>', 1, 's')) AS m FROM pages) t")
def page_scripts(spark, sf_dir):
    return extract.scripts(parsed(spark, sf_dir, "scripts")).select("page_id", "sha256", "byte_length")


@query(f"SELECT page_id, {_plain(_BODY)} AS visible_text FROM pages")
def page_visible_text(spark, sf_dir):
    return parsed(spark, sf_dir, "visible_text").select("page_id", "doc.visible_text")


@query(f"""WITH s AS (SELECT page_id, unnest(parts) AS part, unnest(range(len(parts))) AS i FROM (SELECT page_id, string_split({_BODY}, '<p>') AS parts FROM pages) x),
t AS (SELECT page_id, i, {_plain("regexp_extract(part, '^(.*?)(?:</p>|</?(?:article|footer|div|h1|ul|nav)|$)', 1, 's')")} AS text FROM s WHERE i > 0)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS ord, text FROM t WHERE text <> ''""")
def page_paragraphs(spark, sf_dir):
    return extract.paragraphs(parsed(spark, sf_dir, "paragraphs"))


@query()
def page_markdown(spark, sf_dir):
    return parsed(spark, sf_dir, "markdown").select("page_id", "doc.markdown")


@query()
def page_inspection(spark, sf_dir):
    from palimpsest.sources.sinks import inspection

    return inspection(parsed(spark, sf_dir))


@query()
def page_blocks(spark, sf_dir):
    return fragments.numbered_blocks(parsed(spark, sf_dir, "blocks"))


_TREE = fragments.Budget(target=600, maximum=1000, minimum=80)


def _page_fragments(spark: SparkSession, sf_dir: str, body: bool = False) -> DataFrame:
    return fragments.of_pages(read(spark, sf_dir, "pages"), _TREE, body=body)


@query()
def page_fragments(spark, sf_dir):
    return _page_fragments(spark, sf_dir)


@query()
def page_fragment_bodies(spark, sf_dir):
    return fragments.bodies(_page_fragments(spark, sf_dir, body=True))


@query()
def page_fragment_stats(spark, sf_dir):
    return fragments.size_stats(_page_fragments(spark, sf_dir))


# Packing and splitting ----------------------------------------------------------------------------

_LINES = """l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, length(line) AS len FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents) t WHERE line <> '')"""
_PACK = f"""WITH RECURSIVE {_LINES},
p AS (
  SELECT doc_id, n, 1 AS chunk, 1 AS blocks, CAST(len AS BIGINT) AS chars FROM l WHERE n = 1
  UNION ALL
  SELECT l.doc_id, l.n, CASE WHEN (chars >= 600 AND chars >= 80) OR chars + 2 + len > 1000 THEN chunk + 1 ELSE chunk END,
    CASE WHEN (chars >= 600 AND chars >= 80) OR chars + 2 + len > 1000 THEN 1 ELSE blocks + 1 END,
    CASE WHEN (chars >= 600 AND chars >= 80) OR chars + 2 + len > 1000 THEN len ELSE chars + 2 + len END
  FROM p JOIN l ON l.doc_id = p.doc_id AND l.n = p.n + 1
),
packed AS (SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, CAST(max(blocks) AS INTEGER) AS blocks, CAST(max(chars) AS INTEGER) AS chars FROM p GROUP BY doc_id, chunk)
"""


@query(_PACK + "SELECT * FROM packed")
def doc_line_packing(spark, sf_dir):
    return fragments.document_lines(read(spark, sf_dir, "documents"))


@query(_PACK + "SELECT doc_id, count(*) AS chunks, min(chars) AS min_chars, max(chars) AS max_chars FROM packed GROUP BY 1")
def doc_chunk_stats(spark, sf_dir):
    return fragments.document_lines(read(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.min("chars").alias("min_chars"), F.max("chars").alias("max_chars"))


# History -----------------------------------------------------------------------------------------


@query("SELECT sha256(text) AS sha256, min(doc_id) AS first_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def doc_exact_duplicates(spark, sf_dir):
    d = read(spark, sf_dir, "documents").filter(F.col("text").isNotNull())
    return d.groupBy(F.sha2("text", 256).alias("sha256")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")


@query("SELECT a.event_id, b.event_id AS previous_id FROM events a ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events GROUP BY 1, 2) b ON a.user_id = b.user_id AND a.ts > b.ts")
def events_previous(spark, sf_dir):
    """The user's last event strictly before each event: as-of lookup."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return history.as_of(e, e, "ts", "event_id", "previous_id", by=["user_id"]).select("event_id", "previous_id")


@query("SELECT user_id, max_by(event_id, (ts, event_id)) AS latest_id FROM events GROUP BY 1")
def events_latest(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return history.first_of(e, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", F.col("event_id").alias("latest_id"))


def _snapshots(spark, sf_dir):
    """Two captures of documents: some gone, some new, some edited, some moved."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "doc_id", "text", "lang", "source")
    common = lambda x: x.withColumn("fragment_kind", F.lit(None).cast("string")).withColumn("row_content_hash", F.lit(None).cast("string")).withColumn("item_content_hash", F.lit(None).cast("string")).withColumn("content_hash", F.sha2("text", 256)).withColumn("heading", F.col("lang")).withColumn("parent_id", F.col("source")).withColumn("source_order", F.col("doc_id"))
    before = common(d.filter(F.col("doc_id") % 10 != 3))
    after = common(d.filter(F.col("doc_id") % 10 != 7).withColumn("text", F.when(F.col("doc_id") % 10 == 1, F.concat("text", F.lit(" edited"))).otherwise(F.col("text"))).withColumn("lang", F.when(F.col("doc_id") % 10 == 2, F.lit("xx")).otherwise(F.col("lang"))))
    return after, before


_SNAP = """WITH b AS (SELECT doc_id, sha256(text) AS h, lang FROM documents WHERE doc_id % 10 <> 3),
a AS (SELECT doc_id, sha256(CASE WHEN doc_id % 10 = 1 THEN text || ' edited' ELSE text END) AS h, CASE WHEN doc_id % 10 = 2 THEN 'xx' ELSE lang END AS lang FROM documents WHERE doc_id % 10 <> 7),
j AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.doc_id AS ad, b.doc_id AS bd, a.h AS ah, b.h AS bh, a.lang AS al, b.lang AS bl FROM a FULL JOIN b ON a.doc_id = b.doc_id),
c AS (SELECT doc_id, 'added' AS change, NULL AS before, NULL AS after FROM j WHERE bd IS NULL UNION ALL SELECT doc_id, 'removed', NULL, NULL FROM j WHERE ad IS NULL
UNION ALL SELECT doc_id, 'changed', bh, ah FROM j WHERE ad IS NOT NULL AND bd IS NOT NULL AND ah <> bh UNION ALL SELECT doc_id, 'heading', bl, al FROM j WHERE ad IS NOT NULL AND bd IS NOT NULL AND al <> bl)
"""


@query(_SNAP + "SELECT CAST(doc_id AS VARCHAR) AS id, change, before, after FROM c")
def snapshot_diff(spark, sf_dir):
    return diff.fragments(*_snapshots(spark, sf_dir))


@query(_SNAP + "SELECT change, count(*) AS n FROM c GROUP BY 1 UNION ALL SELECT 'unchanged', count(*) FROM j WHERE ah = bh")
def snapshot_summary(spark, sf_dir):
    return diff.summary(*_snapshots(spark, sf_dir))


@query("SELECT doc_id, (doc_id % 10 NOT IN (1, 3, 5)) AS unchanged FROM documents WHERE doc_id % 10 <> 7")
def unchanged_check(spark, sf_dir):
    """Unchanged only where a previous capture exists and every hash is known and equal."""
    after, before = _snapshots(spark, sf_dir)
    shape = lambda d: d.select("doc_id", F.col("content_hash").alias("map_sha256"), F.sha2("source", 256).alias("codex_sha256"), F.when(F.col("doc_id") % 10 != 5, F.sha2("id", 256)).alias("image_digest"))
    return history.unchanged(shape(after), shape(before), "doc_id")


@query("SELECT (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT ALL SELECT DISTINCT l_orderkey FROM lineitem) x) AS only_left, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey FROM lineitem EXCEPT ALL SELECT o_orderkey FROM orders) y) AS only_right, (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT ALL SELECT DISTINCT l_orderkey FROM lineitem) x) = 0 AND (SELECT count(*) FROM (SELECT DISTINCT l_orderkey FROM lineitem EXCEPT ALL SELECT o_orderkey FROM orders) y) = 0 AS equal")
def set_equality(spark, sf_dir):
    return history.same_set(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")).distinct())


@query(r"""WITH c AS (SELECT conv_id, turn, text AS y, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS x FROM conversations),
l AS (SELECT *, string_split(regexp_replace(x, '\n$', ''), chr(10)) AS a, string_split(regexp_replace(y, '\n$', ''), chr(10)) AS b FROM c WHERE x IS NOT NULL),
f AS (SELECT *, least(len(a), len(b)) AS least_, coalesce(list_position([a[i] = b[i] FOR i IN range(1, least(len(a), len(b)) + 1)], false) - 1, least(len(a), len(b))) AS first_ FROM l),
g AS (SELECT *, least(coalesce(list_position([a[len(a) - i] = b[len(b) - i] FOR i IN range(0, least_)], false) - 1, least_), least_ - first_) AS last_ FROM f),
h AS (SELECT *, greatest(0, first_ - 3) AS start_, least(3, last_) AS tail_ FROM g)
SELECT conv_id, turn, CASE WHEN x = y THEN '' ELSE array_to_string(list_concat(['--- previous', '+++ current', '@@ -' || (start_ + 1) || ',' || (len(a) - last_ + tail_ - start_) || ' +' || (start_ + 1) || ',' || (len(b) - last_ + tail_ - start_) || ' @@'],
  [' ' || z FOR z IN a[start_ + 1 : first_]], ['-' || z FOR z IN a[first_ + 1 : len(a) - last_]], ['+' || z FOR z IN b[first_ + 1 : len(b) - last_]], [' ' || z FOR z IN a[len(a) - last_ + 1 : len(a) - last_ + tail_]]), chr(10)) || chr(10) END AS diff FROM h""")
def turn_text_diff(spark, sf_dir):
    """Unified diff of each turn against the one before."""
    c = read(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = c.withColumn("before", F.lag("text").over(w)).filter(F.col("before").isNotNull())
    return pairs.select("conv_id", "turn", diff.unified(F.col("before"), F.col("text")).alias("diff"))


def _manifests(spark, sf_dir):
    """Every event as a capture's manifest: some of an old version, incomplete, or without a hash."""
    e = read(spark, sf_dir, "events")
    k = F.col("event_id")
    return e.select(
        F.when(k % 7 == 0, 1).otherwise(2).alias("schema_version"), F.concat(F.lit("c"), k).alias("capture_id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("started_at"), F.when(k % 13 != 0, F.lit("done")).alias("completed_at"), F.when(k % 17 != 0, F.lit("m")).otherwise("").alias("map_sha256"), F.lit("x").alias("codex_sha256"),
    )


_VALID = "v AS (SELECT event_id, 'c' || event_id AS capture_id, user_id, date_trunc('second', ts) AS started FROM events WHERE event_id % 7 <> 0 AND event_id % 13 <> 0 AND event_id % 17 <> 0)"


@query(f"WITH {_VALID} SELECT a.capture_id, b.capture_id AS previous_capture_id FROM v a ASOF LEFT JOIN (SELECT user_id, started, max(capture_id) AS capture_id FROM v GROUP BY 1, 2) b ON a.user_id = b.user_id AND a.started > b.started")
def valid_capture_chain(spark, sf_dir):
    """Each complete capture of a user with the one that started before it."""
    e = read(spark, sf_dir, "events").select(F.concat(F.lit("c"), "event_id").alias("capture_id"), "user_id")
    v = history.valid_captures(_manifests(spark, sf_dir)).join(e, "capture_id")
    return history.as_of(v, v, "started", "capture_id", "previous_capture_id", by=["user_id"]).select("capture_id", "previous_capture_id")


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS capture_date, strftime(ts, '%Y-%m-%dT%H-%M-%SZ') AS capture_id FROM events")
def capture_identities(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select("event_id", history.capture_identity(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("c")).select("event_id", "c.capture_date", "c.capture_id")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, 'https://i/' || l_partkey || chr(0) || l_linestatus || chr(0) || l_returnflag || chr(0) || l_suppkey || chr(0) || 'image/png' || chr(0) || chr(0) || chr(0) AS row FROM lineitem)
SELECT l_orderkey AS capture_id, sha256(string_agg(row, chr(10) ORDER BY l_linenumber, row)) AS image_digest FROM r GROUP BY 1""")
def image_digests(spark, sf_dir):
    """Order lines as image rows."""
    none = F.lit(None).cast("string")
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("capture_id"), F.col("l_linenumber").alias("source_order"), F.concat(F.lit("https://i/"), "l_partkey").alias("url"), F.col("l_linestatus").alias("status"), F.col("l_returnflag").alias("sha256"), F.col("l_suppkey").alias("http_status"), F.lit("image/png").alias("content_type"), none.alias("byte_length"), none.alias("reason"), none.alias("error"))
    return history.image_digest(rows)


@query("""SELECT CAST(p_partkey AS VARCHAR) AS source, coalesce(p_partkey % 9 = 0, false) OR p_partkey % 3 = 0 AS raw_changed, p_partkey % 9 = 0 OR p_partkey % 4 = 0 AS text_changed, p_partkey % 9 = 0 OR p_partkey % 5 = 0 AS structure_changed FROM part""")
def change_flags(spark, sf_dir):
    """Flags of two versions of every part: a ninth is new, others differ in one hash or more."""
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    base = p.select(k.alias("k"), k.cast("string").alias("source"), *[F.sha2("p_name", 256).alias(f"{n}_sha256") for n in ("raw", "text", "structure")])
    edited = base.withColumns({f"{n}_sha256": F.when(F.col("k") % m == 0, F.sha2(f"{n}_sha256", 256)).otherwise(F.col(f"{n}_sha256")) for n, m in (("raw", 3), ("text", 4), ("structure", 5))})
    return diff.flags(edited, base.filter("k % 9 <> 0")).select("source", "raw_changed", "text_changed", "structure_changed")


@query("""WITH c AS (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS id FROM part WHERE p_partkey % 8 <> 1), r AS (
SELECT id, 'added' AS change FROM c WHERE k % 8 = 2 UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'removed' FROM part WHERE p_partkey % 8 = 1
UNION ALL SELECT id, unnest(['moved', 'changed']) FROM c WHERE k % 8 = 3 UNION ALL SELECT id, unnest(['renamed', 'changed']) FROM c WHERE k % 8 = 4 UNION ALL SELECT id, unnest(['notes', 'changed']) FROM c WHERE k % 8 = 5 UNION ALL SELECT id, 'changed' FROM c WHERE k % 8 = 6) SELECT * FROM r""")
def map_changes(spark, sf_dir):
    """Two versions of the parts as map records: new, gone, moved, renamed, other notes, other type."""
    p = read(spark, sf_dir, "part").withColumn("k", F.col("p_partkey") % 8)
    text = lambda c: F.col(c).cast("string")
    before = p.select("k", text("p_partkey").alias("id"), F.lit("part").alias("kind"), F.col("p_type").alias("type"), F.col("p_name").alias("name"), text("p_size").alias("coordinates"), F.lit("n").alias("notes"), F.lit("$").alias("source_path"), F.lit("{}").alias("source"), F.lit("{}").alias("extra"))
    edit = lambda c, k, to: F.when(F.col("k") == k, to).otherwise(F.col(c))
    after = before.withColumns({"coordinates": edit("coordinates", 3, F.lit("moved")), "name": edit("name", 4, F.concat("name", F.lit("!"))), "notes": edit("notes", 5, F.lit("m")), "type": edit("type", 6, F.lit("t"))})
    return diff.maps(after.filter("k <> 1"), before.filter("k <> 2")).select("id", "change")


_WIDE = r"\t\n\x0b\x0c\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"


@query(rf"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(160), ' '), '[ \t]+', ' ', 'g'), '[{_WIDE}]*\n[{_WIDE}]*', chr(10), 'g'), '^[{_WIDE}]+|[{_WIDE}]+$', '', 'g')) AS sha256 FROM documents""")
def doc_clean_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(clean(F.col("text")), 256).alias("sha256"))


@query(r"""SELECT p_partkey, trim(regexp_replace(lower(p_type || ' ' || p_brand || ' ' || p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, CAST(length(p_name) AS INTEGER) AS units FROM part""")
def part_slugs(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", slug(F.concat_ws(" ", "p_type", "p_brand", "p_name")).alias("slug"), utf16_length(F.col("p_name")).alias("units"))


# Records -----------------------------------------------------------------------------------------


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def json_props(spark, sf_dir):
    v = F.try_parse_json("props")
    return read(spark, sf_dir, "events").select("event_id", F.try_variant_get(v, "$.k", "string").alias("k")).filter(F.col("k").isNotNull())


@query("""WITH r AS (SELECT p_partkey, 'part__' || regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS base FROM part)
SELECT p_partkey, base || CASE WHEN n = 1 THEN '' WHEN k = 1 THEN '__no-coordinates' ELSE '__no-coordinates#' || k END AS id FROM (SELECT *, count(*) OVER (PARTITION BY base) AS n, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS k FROM r) t""")
def record_ids(spark, sf_dir):
    none = F.lit(None).cast("string")
    rows = read(spark, sf_dir, "part").select(F.lit(1).alias("capture_id"), "p_partkey", F.lit("part").alias("kind"), F.col("p_name").alias("name"), none.alias("coordinates"), none.alias("source_id"), F.col("p_partkey").alias("ord"))
    return maps.assign_ids(rows, "capture_id").select("p_partkey", "id")


#: Keys of a block: a map holds the points of a nation and a block, so that maps stay small whatever the scale.
_BLOCK = 1000


def _candidates(spark, sf_dir):
    """Maps: suppliers of a nation as settlements, customers as markers, by blocks of keys, with odd fields."""

    def points(table: str, nation: str, k: str, point) -> DataFrame:
        d = read(spark, sf_dir, table).withColumn("capture_id", (F.col(nation) + 25 * F.floor(F.col(k) / _BLOCK)).cast("long"))
        listed = F.array_sort(F.collect_list(F.struct(k, F.to_json(point).alias("json"))))  # at most _BLOCK
        return d.groupBy("capture_id").agg(F.array_join(F.transform(listed, lambda x: x["json"]), ",").alias(table))

    s = points("supplier", "s_nationkey", "s_suppkey", F.struct(F.col("s_name").alias("name"), F.col("s_suppkey").alias("x"), (F.col("s_suppkey") % 97).alias("y"), F.col("s_acctbal").alias("balance")))
    c = points("customer", "c_nationkey", "c_custkey", F.struct(F.col("c_name").alias("title"), F.array(F.col("c_custkey") % 500, F.col("c_custkey") % 300).alias("coords"), F.col("c_mktsegment").alias("type")))
    both = s.join(c, "capture_id", "full_outer")
    text = F.concat(F.lit('{"img":{"w":400,"h":250},"settlements":['), F.coalesce("supplier", F.lit("")), F.lit('],"markers":['), F.coalesce("customer", F.lit("")), F.lit('],"routes":[1,2],"version":7}'))
    return both.select("capture_id", F.parse_json(text).alias("value"))


_S_MAP, _C_MAP = f"CAST(s_nationkey + 25 * (s_suppkey // {_BLOCK}) AS BIGINT)", f"CAST(c_nationkey + 25 * (c_custkey // {_BLOCK}) AS BIGINT)"


@query(f"""SELECT n AS capture_id, CAST(sum(s) AS BIGINT) AS settlements, CAST(sum(m) AS BIGINT) AS markers, CAST(sum(s) + sum(m) AS BIGINT) AS normalized_records, CAST(3 AS BIGINT) AS unclassified_records
FROM (SELECT {_S_MAP} AS n, 1 AS s, 0 AS m FROM supplier UNION ALL SELECT {_C_MAP}, 0, 1 FROM customer) t GROUP BY 1""")
def map_validation(spark, sf_dir):
    v = maps.validation(_candidates(spark, sf_dir))
    return v.select("capture_id", "settlements", "markers", "normalized_records", "unclassified_records")


@query(f"""SELECT {_S_MAP} AS capture_id, 'settlements' AS collection, s_name AS name, CAST(s_suppkey AS DOUBLE) AS x, CAST(s_suppkey % 97 AS DOUBLE) AS y FROM supplier
UNION ALL SELECT {_C_MAP}, 'markers', c_name, CAST(c_custkey % 500 AS DOUBLE), CAST(c_custkey % 300 AS DOUBLE) FROM customer""")
def map_records(spark, sf_dir):
    r = annotate.points(maps.records(_candidates(spark, sf_dir)))
    return r.select("capture_id", "collection", "name", "x", "y")


@query()
def map_annotation(spark, sf_dir):
    """Legend of each nation's map: status, overlap and label position of every record."""
    c = _candidates(spark, sf_dir)
    m = maps.header(c).withColumn("image_available", F.lit(True))
    return annotate.annotate(maps.records(c), m).select("capture_id", "ord", "id", "kind", "x", "y", "status", "overlap", "label_x", "label_y", "label_offset")


_POINTS = f"""r AS (SELECT {_S_MAP} AS capture_id, 'settlement' AS kind, s_name AS name, CAST(s_suppkey AS DOUBLE) AS x, CAST(s_suppkey % 97 AS DOUBLE) AS y, 0 AS c, s_suppkey AS k FROM supplier
UNION ALL SELECT {_C_MAP}, 'marker', c_name, CAST(c_custkey % 500 AS DOUBLE), CAST(c_custkey % 300 AS DOUBLE), 1, c_custkey FROM customer),
shown AS (SELECT * FROM r WHERE x >= 0 AND x < 400 AND y >= 0 AND y < 250)"""


@query(f"""WITH {_POINTS}, o AS (SELECT a.capture_id, a.kind, a.name, a.x, a.y, count(b.k) AS overlap FROM shown a LEFT JOIN shown b ON a.capture_id = b.capture_id AND (b.c, b.k) < (a.c, a.k) AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 36 GROUP BY ALL)
SELECT capture_id, kind, name, x, y, overlap, least(396.0, x + 9 + (overlap // 5) * 12) AS label_x, greatest(12.0, least(246.0, y - 8 + CASE WHEN overlap = 0 THEN 0 ELSE (CASE WHEN overlap % 2 = 1 THEN 1 ELSE -1 END) * ceil(overlap / 2) * 14 END)) AS label_y FROM o""")
def map_label_anchors(spark, sf_dir):
    """First label positions on each nation's map, before labels give way to each other."""
    c = _candidates(spark, sf_dir)
    m = maps.header(c).withColumn("image_available", F.lit(True))
    shown = annotate.classify(annotate.points(maps.records(c)), m).filter("status = 'rendered'")
    return annotate.label_anchors(shown.join(annotate.overlaps(shown), ["capture_id", "ord"])).select("capture_id", "kind", "name", "x", "y", "overlap", "label_x", "label_y")


@query(f"""WITH {_POINTS}, m AS (SELECT DISTINCT capture_id FROM r) SELECT capture_id, kind, name, 'point' AS place FROM r UNION ALL SELECT capture_id, 'unclassified', unnest(['version', NULL, NULL]), unnest(['$.version', '$.routes[0]', '$.routes[1]']) FROM m""")
def map_all_records(spark, sf_dir):
    """All that may be drawn, unclassified values included."""
    r = annotate.all_records(_candidates(spark, sf_dir))
    return r.select("capture_id", "kind", "name", F.when(F.col("coordinates").isNotNull(), "point").otherwise(F.col("source_path")).alias("place"))


@query(f"WITH {_POINTS} SELECT capture_id, kind, name, CASE WHEN x >= 0 AND x < 400 AND y >= 0 AND y < 250 THEN 'rendered' ELSE 'outside' END AS status FROM r")
def map_statuses(spark, sf_dir):
    c = _candidates(spark, sf_dir)
    m = maps.header(c).withColumn("image_available", F.lit(True))
    return annotate.classify(annotate.points(maps.records(c)), m).select("capture_id", "kind", "name", "status")


@query(f"""WITH {_POINTS}, s AS (SELECT capture_id, count(*) AS rendered FROM shown GROUP BY 1) SELECT r.capture_id, coalesce(max(s.rendered), 0) AS rendered, count(*) - coalesce(max(s.rendered), 0) AS skipped, CAST(0 AS BIGINT) AS missing_coordinates, CAST(0 AS BIGINT) AS invalid_coordinates, count(*) - coalesce(max(s.rendered), 0) AS outside_bounds FROM r LEFT JOIN s USING (capture_id) GROUP BY 1""")
def map_legend_counters(spark, sf_dir):
    c = _candidates(spark, sf_dir)
    m = maps.header(c).withColumn("image_available", F.lit(True))
    return annotate.validation(annotate.classify(annotate.points(maps.records(c)), m)).drop("skipped_ids")


@query(f"WITH {_POINTS} SELECT capture_id, kind, count(*) AS n, CASE kind WHEN 'settlement' THEN 'circle' ELSE 'square' END AS symbol FROM shown GROUP BY 1, 2")
def map_categories(spark, sf_dir):
    c = _candidates(spark, sf_dir)
    m = maps.header(c).withColumn("image_available", F.lit(True))
    return annotate.categories(annotate.classify(annotate.points(maps.records(c)), m).filter("status = 'rendered'"))


@query(f"SELECT capture_id, unnest(['routes', 'version']) AS name FROM (SELECT DISTINCT {_S_MAP} AS capture_id FROM supplier UNION SELECT {_C_MAP} FROM customer) t")
def map_unclassified(spark, sf_dir):
    return maps.unclassified(_candidates(spark, sf_dir)).filter("name <> 'seat'").select("capture_id", "name")


_PLACE = "SELECT vec_id AS ord, floor(embedding[1] * 1000 + 500) AS x, floor(embedding[2] * 1000 + 500) AS y FROM embeddings"


def _places(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    at = lambda i: F.floor(F.get("embedding", F.lit(i)) * F.lit(1000).cast("float") + F.lit(500).cast("float")).cast("double")
    return e.select(F.lit(1).alias("capture_id"), F.col("vec_id").alias("ord"), at(0).alias("x"), at(1).alias("y"))


@query(f"WITH p AS ({_PLACE}) SELECT a.ord, count(b.ord) AS overlap FROM p a LEFT JOIN p b ON b.ord < a.ord AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 36 GROUP BY 1")
def near_points(spark, sf_dir):
    return annotate.overlaps(_places(spark, sf_dir)).select("ord", "overlap")


@query(f"WITH p AS ({_PLACE}) SELECT CAST(count(*) - count(DISTINCT (x, y)) AS BIGINT) AS duplicate_coordinates FROM p")
def duplicate_coordinates(spark, sf_dir):
    return annotate.duplicate_coordinates(_places(spark, sf_dir)).select("duplicate_coordinates")


@query(f"WITH p AS ({_PLACE}) SELECT ord, CASE WHEN x >= 0 AND x < 600 AND y >= 0 AND y < 500 THEN 'rendered' ELSE 'outside' END AS status FROM p")
def bounds_filter(spark, sf_dir):
    m = spark.range(1).select(F.lit(1).alias("capture_id"), F.lit(600.0).alias("width"), F.lit(500.0).alias("height"), F.lit("image-pixel").alias("system"), F.lit("top-left").alias("origin"), F.lit(True).alias("image_available"))
    return annotate.classify(_places(spark, sf_dir).withColumn("state", F.lit("valid")), m).select("ord", "status")


# Storage -----------------------------------------------------------------------------------------


def _places_of(spark, sf_dir, body=False):
    """Places of two captures, which need the hashes of contents but not the contents."""
    p = read(spark, sf_dir, "pages")
    first = fragments.of_pages(p, _TREE, body=body).drop("content")
    edited = p.withColumn("html", F.when(F.col("page_id") % 5 == 0, F.concat("html", F.lit("<p>appended</p>"))).otherwise(F.col("html")))
    second = fragments.of_pages(edited, _TREE, body=body).drop("content")
    empty = first.limit(0).select("page_id", "id", *[F.lit(None).cast("string").alias(c) for c in sparse.LOCATION])
    old = sparse.materialize(first, empty, "page_id", "c1", "2025-01-01")
    return old, sparse.materialize(second, old, "page_id", "c2", "2025-01-02")


@query()
def merkle_reuse(spark, sf_dir):
    """Where each fragment of the second capture is stored."""
    _, new = _places_of(spark, sf_dir)
    return new.select("page_id", "id", "materialized_capture", "materialized_path")


@query()
def current_view(spark, sf_dir):
    """All fragments of the second capture, from wherever they are stored."""
    old, new = _places_of(spark, sf_dir, body=True)
    store = sparse.written(old, key="page_id", capture_id="c1").unionByName(sparse.written(new, key="page_id", capture_id="c2"))
    return sparse.current_view(new, store)


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), m AS (SELECT o_custkey AS c, o_orderkey AS k FROM orders)
SELECT CAST(c AS VARCHAR) AS document, CAST(k AS VARCHAR) AS id, 'missing body' AS error FROM m WHERE k NOT IN (SELECT k FROM l) UNION ALL SELECT CAST(c AS VARCHAR), CAST(k AS VARCHAR), 'hash mismatch' FROM m WHERE k IN (SELECT k FROM l) AND k % 50 = 0
UNION ALL SELECT CAST(c AS VARCHAR), CAST(k AS VARCHAR), 'missing child' FROM m WHERE k % 40 = 3 UNION ALL SELECT NULL, 'p/' || k, 'not referenced' FROM l WHERE k NOT IN (SELECT k FROM m)""")
def integrity_violations(spark, sf_dir):
    """Orders as fragments of customers, stored where they have lines; a part with wrong hashes or children."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page_id"), F.col("o_orderkey").alias("k"))
    path = F.concat(F.lit("p/"), F.col("k"))
    m = o.select("page_id", F.col("k").cast("string").alias("id"), path.alias("materialized_path"), F.when(F.col("k") % 40 == 3, F.array(F.lit("none"))).otherwise(F.array(F.col("k").cast("string"))).alias("child_ids"))
    l = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")).distinct()  # noqa: E741
    body = F.concat(F.lit("body "), F.col("k"))
    s = l.select(path.alias("materialized_path"), body.alias("body"), F.sha2(F.when(F.col("k") % 50 == 0, F.lit("?")).otherwise(body), 256).alias("materialized_hash"))
    return sparse.violations(m, s)
