"""Queries over pages made from the part table: markup, images, scripts and attributes that the page
table does not have. A page holds ten parts; its SQL states what must be found from the parts alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.parse import parse_pages
from palimpsest.operators import candidates, extract, fragments, sparse
from palimpsest.plans.registry import query, read
from palimpsest.sources import pages

PER_PAGE = 10


def _made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, html."""
    p = read(spark, sf_dir, "part").withColumn("page_id", F.floor(F.col("p_partkey") / PER_PAGE).cast("long"))
    part = F.struct("p_partkey", "p_name", "p_brand", "p_type")
    g = p.groupBy("page_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))  # at most PER_PAGE

    def each(template: str) -> Column:
        """The template for every part, {0} to {3} its key, name, brand and type."""
        fields = ["p_partkey", "p_name", "p_brand", "p_type"]
        pieces = template.replace("}", "{").split("{")
        text = lambda x: F.concat(*[x[fields[int(t)]].cast("string") if i % 2 else F.lit(t) for i, t in enumerate(pieces)])
        return F.array_join(F.transform("parts", text), "")

    k, n = F.col("page_id").cast("string"), F.array_join(F.transform("parts", lambda x: x["p_name"]), ", ")
    html = [
        F.lit("<!DOCTYPE html><html><head><title>\n Block  "), k, F.lit('</title><meta name="description" content="block '), k, F.lit('"><meta property="og:kind" content="parts"><meta name="empty" content=""></head><body>'),
        F.lit('<h1 id="top">Block '), k, F.lit("</h1><p hidden>never</p><p> of parts: "), n, F.lit(' <b>all</b></p><h2>Rows</h2><p style="display: none">styled</p><table><thead><tr><th>Key</th><th>Name</th></tr></thead>'), each("<tr><td>{0}</td><td>{1}</td></tr>"),
        F.lit('</table><h3></h3><ol start="3">'), each("<li>{2}<ul><li>inner</li></ul></li>"), F.lit("</ol>"), each('<img src="/img/{0}.png?t={3}" alt="{3}"><img src="../p/{1}.webp" title="x"><a href="?part={0}#{1}">{1}</a>'),
        F.lit('<img src="data:image/png;base64,'), F.base64(F.encode(n, "UTF-8")), F.lit('"><img src="data:,plain%20text">'), F.lit('<svg id="s'), k, F.lit('" class="a b" viewBox="0 0 9 9"><g><circle r="1"></circle></g><text>t'), k, F.lit("</text></svg>"),
        F.lit('<div data-region="'), k, F.lit('" class="box"></div><script>window.mapData = {"regions":["}",'), k, F.lit(']}; var t = JSON.parse("[1,'), k, F.lit(']"); small = [1];</script><script type="application/json"> {"locations":['), k, F.lit(']} </script><script src="/x'), k, F.lit('.js"></script></body></html>'),
    ]
    return g.select("page_id", F.concat(F.lit("https://parts.example.com/b/"), k, F.lit("/index.html")).alias("url"), F.concat(*html).alias("html"))


def _parsed(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    return parse_pages(_made(spark, sf_dir), fields=fields)


_P = f"p AS (SELECT *, p_partkey // {PER_PAGE} AS page_id, row_number() OVER (PARTITION BY p_partkey // {PER_PAGE} ORDER BY p_partkey) - 1 AS i FROM part), g AS (SELECT page_id, string_agg(p_name, ', ' ORDER BY p_partkey) AS names, count(*) AS n FROM p GROUP BY 1)"
_BASE = "'https://parts.example.com"
_NAME = "replace(p_name, ' ', '%20')"


@query(f"WITH {_P} SELECT page_id, 'Block ' || page_id AS title FROM g")
def made_titles(spark, sf_dir):
    return _parsed(spark, sf_dir, "title").select("page_id", "doc.title")


@query(f"WITH {_P} SELECT page_id, 'description' AS key, 'block ' || page_id AS content FROM g UNION ALL SELECT page_id, 'og:kind', 'parts' FROM g")
def made_metadata(spark, sf_dir):
    return extract.metadata(_parsed(spark, sf_dir, "metadata"))


@query(f"WITH {_P} SELECT page_id, 0 AS ord, 1 AS level, 'Block ' || page_id AS text, 'top' AS id FROM g UNION ALL SELECT page_id, 1, 2, 'Rows', NULL FROM g")
def made_headings(spark, sf_dir):
    return extract.headings(_parsed(spark, sf_dir, "headings"))


@query(f"WITH {_P} SELECT page_id, 0 AS ord, 'never' AS text FROM g UNION ALL SELECT page_id, 1, 'of parts: ' || names || ' all' FROM g UNION ALL SELECT page_id, 2, 'styled' FROM g")
def made_paragraphs(spark, sf_dir):
    return extract.paragraphs(_parsed(spark, sf_dir, "paragraphs"))


@query(f"""WITH {_P} SELECT page_id, 0 AS table_ord, CAST(i + 1 AS INTEGER) AS row_ord, 0 AS cell_ord, CAST(p_partkey AS VARCHAR) AS text FROM p UNION ALL SELECT page_id, 0, CAST(i + 1 AS INTEGER), 1, p_name FROM p
UNION ALL SELECT page_id, 0, 0, 0, 'Key' FROM g UNION ALL SELECT page_id, 0, 0, 1, 'Name' FROM g""")
def made_table_cells(spark, sf_dir):
    return extract.table_cells(_parsed(spark, sf_dir, "tables"))


@query(f"WITH {_P} SELECT page_id, 0 AS list_ord, true AS ordered, CAST(i AS INTEGER) AS ord, p_brand AS text FROM p")
def made_list_items(spark, sf_dir):
    return extract.list_items(_parsed(spark, sf_dir, "lists"))


@query(f"WITH {_P} SELECT page_id, CAST(i AS INTEGER) AS ord, p_name AS text, {_BASE}/b/' || page_id || '/index.html?part=' || p_partkey || '#' || {_NAME} AS href, '?part=' || p_partkey || '#' || p_name AS original_href FROM p")
def made_links(spark, sf_dir):
    return extract.links(_parsed(spark, sf_dir, "links"))


_FILES = f"""SELECT page_id, CAST(2 * i AS INTEGER) AS ord, {_BASE}/img/' || p_partkey || '.png?t=' || p_type AS src, '/img/' || p_partkey || '.png?t=' || p_type AS original_src, p_type AS alt, NULL AS title FROM p
UNION ALL SELECT page_id, CAST(2 * i + 1 AS INTEGER), {_BASE}/b/p/' || {_NAME} || '.webp', '../p/' || p_name || '.webp', '', 'x' FROM p"""


@query(f"WITH {_P}, f AS ({_FILES}) SELECT * FROM f")
def made_images(spark, sf_dir):
    return extract.images(_parsed(spark, sf_dir, "images")).filter(~F.col("original_src").startswith("data:"))


@query(f"WITH {_P}, f AS ({_FILES}), u AS (SELECT page_id, src AS url, min(ord) AS ord FROM f GROUP BY 1, 2) SELECT page_id, url, CAST(row_number() OVER (PARTITION BY page_id ORDER BY ord) AS INTEGER) AS source_order FROM u")
def made_image_urls(spark, sf_dir):
    return extract.image_urls(_parsed(spark, sf_dir, "images"))


@query(f"""WITH {_P} SELECT page_id, CAST(2 * n AS INTEGER) AS ord, 'image/png' AS mime_type, strlen(names) AS byte_length, sha256(names) AS sha256, lpad(CAST(2 * n + 1 AS VARCHAR), 3, '0') || '.png' AS output_file FROM g
UNION ALL SELECT page_id, CAST(2 * n + 1 AS INTEGER), 'application/octet-stream', 10, sha256('plain text'), lpad(CAST(2 * n + 2 AS VARCHAR), 3, '0') || '.bin' FROM g""")
def made_embedded(spark, sf_dir):
    return pages.embedded(extract.images(_parsed(spark, sf_dir, "images"))).select("page_id", "ord", "mime_type", "byte_length", "sha256", "output_file")


@query(f"""WITH {_P}, f AS ({_FILES}) SELECT page_id, ord, original_src, CASE WHEN alt = '' THEN src ELSE '../images/' || regexp_extract(original_src, '([0-9]+)\\.png', 1) || '.png' END AS target FROM f""")
def made_rewritten_images(spark, sf_dir):
    """Images that are stored (every other) lead to the stored file."""
    parsed = _parsed(spark, sf_dir, "images")
    stored = extract.image_urls(parsed).filter(F.col("url").contains("/img/")).select("page_id", "url", F.concat(F.regexp_extract("url", r"(\d+)\.png", 1), F.lit(".png")).alias("output_file"))
    return extract.rewritten_images(parsed, stored).filter(~F.col("original_src").startswith("data:"))


@query(f"WITH {_P} SELECT page_id, 1 AS index, 's' || page_id AS id, 'a b' AS classes, '0 0 9 9' AS view_box, 't' || page_id AS text, 3 AS child_count FROM g")
def made_svg(spark, sf_dir):
    return extract.svg(_parsed(spark, sf_dir, "svg"))


@query(f"WITH {_P} SELECT page_id, 1 AS n, 'data-region=' || page_id AS identifier, 'div attribute' AS source FROM g")
def made_identifiers(spark, sf_dir):
    return extract.identifiers(_parsed(spark, sf_dir, "attributes"))


_JS = """'window.mapData = {"regions":["}",' || page_id || ']}; var t = JSON.parse("[1,' || page_id || ']"); small = [1];'"""


@query(f"""WITH {_P} SELECT page_id, 1 AS source_order, 'text/javascript' AS type, true AS inline, NULL AS src, strlen({_JS}) AS byte_length, sha256({_JS}) AS sha256, '001.js' AS output_file FROM g
UNION ALL SELECT page_id, 2, 'application/json', true, NULL, strlen(' {{"locations":[' || page_id || ']}} '), sha256(' {{"locations":[' || page_id || ']}} '), '002.js' FROM g
UNION ALL SELECT page_id, 3, 'text/javascript', false, {_BASE}/x' || page_id || '.js', 0, sha256(''), NULL FROM g""")
def made_scripts(spark, sf_dir):
    return extract.scripts(_parsed(spark, sf_dir, "scripts")).select("page_id", "source_order", "type", "inline", "src", "byte_length", "sha256", "output_file")


_CANDIDATES = f"""SELECT page_id, 1 AS ord, 1 AS source_script, 'JSON.parse argument' AS method, 'json-parse-' || (strpos({_JS}, 'JSON.parse') - 1) AS name, '[1,' || page_id || ']' AS raw, true AS parsed FROM g
UNION ALL SELECT page_id, 2, 1, 'named assignment', 'mapData', '{{"regions":["}}",' || page_id || ']}}', true FROM g UNION ALL SELECT page_id, 3, 2, 'JSON script block', 'script-2', '{{"locations":[' || page_id || ']}}', true FROM g"""


@query(f"WITH {_P}, c AS ({_CANDIDATES}) SELECT *, strlen(raw) AS approximate_size, lpad(CAST(ord AS VARCHAR), 3, '0') || '-' || name || '.json' AS output_file FROM c")
def made_candidates(spark, sf_dir):
    return candidates.candidates(extract.scripts(_parsed(spark, sf_dir, "scripts"))).drop("value")


@query(f"WITH {_P}, c AS ({_CANDIDATES}) SELECT page_id, name, '001-' || name || '.json' AS output_file, raw FROM c WHERE ord = 1")
def made_selected(spark, sf_dir):
    return candidates.selected(candidates.candidates(extract.scripts(_parsed(spark, sf_dir, "scripts"))))


@query(f"""WITH {_P} SELECT g.page_id, 'Block ' || g.page_id || ' of parts: ' || names || ' allRowsKeyName' || string_agg(p_partkey || p_name, '' ORDER BY p_partkey) || string_agg(p_brand || 'inner', '' ORDER BY p_partkey)
  || string_agg(p_name, '' ORDER BY p_partkey) || 't' || g.page_id AS visible_text FROM g JOIN p ON p.page_id = g.page_id GROUP BY g.page_id, names""")
def made_visible_text(spark, sf_dir):
    return _parsed(spark, sf_dir, "visible_text").select("page_id", "doc.visible_text")


@query(f"""WITH {_P}, t AS (SELECT unnest(['html', 'head', 'title', 'meta', 'body', 'h1', 'p', 'b', 'h2', 'table', 'thead', 'tbody', 'tr', 'th', 'td', 'h3', 'ol', 'li', 'ul', 'img', 'a', 'svg', 'g', 'circle', 'text', 'div', 'script']) AS tag)
SELECT page_id, tag, CAST(CASE tag WHEN 'meta' THEN 3 WHEN 'p' THEN 3 WHEN 'tr' THEN n + 1 WHEN 'th' THEN 2 WHEN 'td' THEN 2 * n WHEN 'li' THEN 2 * n WHEN 'ul' THEN n WHEN 'img' THEN 2 * n + 2 WHEN 'a' THEN n WHEN 'script' THEN 3 ELSE 1 END AS BIGINT) AS n FROM g, t""")
def made_element_counts(spark, sf_dir):
    return extract.element_counts(_parsed(spark, sf_dir, "tags"))


# Fragments and their storage ---------------------------------------------------------------------

_SIZES = fragments.Budget(target=60, maximum=90, minimum=20)


def _article_pages(spark: SparkSession, sf_dir: str, edited: bool = False) -> DataFrame:
    """A heading and a paragraph for each part; in the edited version every fifth page has one more."""
    g = read(spark, sf_dir, "part").withColumn("page_id", F.floor(F.col("p_partkey") / PER_PAGE).cast("long")).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name", "p_brand", "p_type"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda x: F.concat(F.lit("<p>"), x["p_name"], F.lit(" of "), x["p_brand"], F.lit(", "), x["p_type"], F.lit("</p>"))), "")
    more = F.when((F.col("page_id") % 5 == 0) & F.lit(edited), F.lit("<p>appended</p>")).otherwise("")
    html = F.concat(F.lit("<h1>Block "), "page_id", F.lit("</h1>"), text, more)
    return g.select("page_id", F.lit("https://parts.example.com/").alias("url"), html.alias("html"))


def _fragments(spark: SparkSession, sf_dir: str, edited: bool = False, body: bool = False) -> DataFrame:
    return fragments.of_pages(_article_pages(spark, sf_dir, edited), _SIZES, body=body)


def _packed(v: int, edited: bool) -> str:
    """Chunks of one version: c{v} (page_id, chunk, chars, content, n), and f{v}, the fragments with bodies."""
    more = f" UNION ALL SELECT page_id, 'appended', count(*) FROM p WHERE page_id % 5 = 0 GROUP BY 1" if edited else ""  # noqa: F541
    new = f"(chars >= {_SIZES.target} AND chars >= {_SIZES.minimum}) OR chars + 2 + length(l{v}.t) > {_SIZES.maximum}"
    return f"""l{v} AS (SELECT page_id, p_name || ' of ' || p_brand || ', ' || p_type AS t, i FROM p{more}),
w{v} AS (SELECT page_id, i, 1 AS chunk, length(t) AS chars FROM l{v} WHERE i = 0 UNION ALL SELECT l{v}.page_id, l{v}.i, CASE WHEN {new} THEN chunk + 1 ELSE chunk END, CASE WHEN {new} THEN length(l{v}.t) ELSE chars + 2 + length(l{v}.t) END FROM w{v} JOIN l{v} ON l{v}.page_id = w{v}.page_id AND l{v}.i = w{v}.i + 1),
c{v} AS (SELECT w{v}.page_id, chunk, max(chars) AS chars, string_agg(t, chr(10) || chr(10) ORDER BY w{v}.i) AS content, max(max(chunk)) OVER (PARTITION BY w{v}.page_id) AS n FROM w{v} JOIN l{v} ON l{v}.page_id = w{v}.page_id AND l{v}.i = w{v}.i GROUP BY 1, 2),
f{v} AS (SELECT page_id, 'block-' || page_id AS id, CASE WHEN n = 1 THEN 'leaf' ELSE 'aggregate' END AS kind, CAST(NULL AS VARCHAR) AS fragment_kind, CASE WHEN n = 1 THEN chars ELSE 0 END AS chars, CASE WHEN n = 1 THEN content ELSE '' END AS content, CAST(NULL AS VARCHAR) AS parent_id, 1 AS source_order, 'fragments/001-block-' || page_id || '.md' AS file,
    '# Block ' || page_id || chr(10) || chr(10) || CASE WHEN n = 1 THEN content ELSE array_to_string(['![[' || lpad(CAST(k + 1 AS VARCHAR), 3, '0') || '-part-' || k || '.md]]' FOR k IN range(1, n + 1)], chr(10) || chr(10)) END AS body FROM c{v} WHERE chunk = 1
  UNION ALL SELECT page_id, 'block-' || page_id || '__part-' || chunk, 'leaf', 'content-chunk', chars, content, 'block-' || page_id, chunk + 1, 'fragments/' || lpad(CAST(chunk + 1 AS VARCHAR), 3, '0') || '-part-' || chunk || '.md', '# Block ' || page_id || ' (part ' || chunk || ')' || chr(10) || chr(10) || content FROM c{v} WHERE n > 1)"""


_ONE = f"WITH RECURSIVE {_P}, {_packed(1, False)}"
_BOTH = f"""{_ONE}, {_packed(2, True)},
s AS (SELECT f2.*, coalesce(f1.body = f2.body AND f1.kind = f2.kind AND NOT (f2.parent_id IS NULL AND f2.page_id % 5 = 0), false) AS same FROM f2 LEFT JOIN f1 USING (page_id, id)),
places AS (SELECT *, CASE WHEN same THEN 'c1' ELSE 'c2' END AS capture, 'captures/' || CASE WHEN same THEN '2025-01-01/c1' ELSE '2025-01-02/c2' END || '/codex/' || page_id || '/' || file AS path FROM s)"""


@query(f"{_ONE} SELECT page_id, id, kind, fragment_kind, CAST(chars AS INTEGER) AS character_count, sha256(content) AS content_hash, parent_id, CAST(source_order AS INTEGER) AS source_order, file FROM f1")
def made_fragments(spark, sf_dir):
    return _fragments(spark, sf_dir).select("page_id", "id", "kind", "fragment_kind", "character_count", "content_hash", "parent_id", "source_order", "file")


@query(f"{_ONE} SELECT page_id, id, file, CAST(source_order AS INTEGER) AS source_order, body FROM f1")
def made_bodies(spark, sf_dir):
    return fragments.bodies(_fragments(spark, sf_dir, body=True))


@query(f"{_ONE} SELECT page_id, count(*) AS fragments, CAST(min(chars) AS INTEGER) AS min_characters, CAST(max(chars) AS INTEGER) AS max_characters, count(*) FILTER (kind = 'leaf') AS leaves FROM f1 GROUP BY 1")
def made_fragment_sizes(spark, sf_dir):
    return fragments.size_stats(_fragments(spark, sf_dir))


@query(f"WITH {_P}, b AS (SELECT page_id, 1 AS block_index, 'h1' AS tag, 1 AS heading_level, 'Block ' || page_id AS heading_text, '# Block ' || page_id AS markdown FROM g UNION ALL SELECT page_id, CAST(i + 2 AS INTEGER), 'p', NULL, NULL, p_name || ' of ' || p_brand || ', ' || p_type FROM p) SELECT * FROM b")
def made_blocks(spark, sf_dir):
    return fragments.numbered_blocks(parse_pages(_article_pages(spark, sf_dir), fields=["blocks"])).select("page_id", "block_index", "tag", "heading_level", "heading_text", "markdown")


@query(f"""{_ONE}, h AS (SELECT page_id, '["Block ' || page_id || '"' AS path FROM g),
span AS (SELECT page_id, chunk, min(i) + 2 AS b0, max(i) + 2 AS b1 FROM w1 GROUP BY 1, 2), whole AS (SELECT page_id, min(b0) AS b0, max(b1) AS b1 FROM span GROUP BY 1)
SELECT f1.page_id, id, file, '---' || chr(10) || 'generated: true' || chr(10) || 'capture_id: "c1"' || chr(10) || 'capture_date: "2025-01-01"' || chr(10) || 'source_key: "codex"' || chr(10) || 'fragment_id: "' || id || '"' || chr(10)
  || 'parent_id: ' || coalesce('"' || parent_id || '"', 'null') || chr(10) || 'fragment_kind: "' || coalesce(fragment_kind, kind) || '"' || chr(10) || 'source_block_start: ' || coalesce(span.b0, whole.b0) || chr(10) || 'source_block_end: ' || coalesce(span.b1, whole.b1) || chr(10)
  || 'source_order: ' || source_order || chr(10) || 'heading_path: ' || h.path || CASE WHEN parent_id IS NULL THEN '' ELSE ', "Part ' || (source_order - 1) || '"' END || ']' || chr(10) || 'content_sha256: "' || sha256(content) || '"' || chr(10) || '---' || chr(10) || chr(10) || body || chr(10) AS text
FROM f1 JOIN h USING (page_id) JOIN whole ON whole.page_id = f1.page_id LEFT JOIN span ON span.page_id = f1.page_id AND f1.parent_id IS NOT NULL AND span.chunk = f1.source_order - 1""")
def made_exported(spark, sf_dir):
    """Whole files of fragments, with their front matter."""
    return fragments.exported(_fragments(spark, sf_dir, body=True), "c1", "2025-01-01")


def _places(spark: SparkSession, sf_dir: str, body: bool = False):
    """Places of two captures, which need the hashes of contents but not the contents."""
    first, second = (_fragments(spark, sf_dir, edited, body).drop("content") for edited in (False, True))
    none = first.limit(0).select("page_id", "id", *[F.lit(None).cast("string").alias(c) for c in sparse.LOCATION])
    old = sparse.materialize(first, none, "page_id", "c1", "2025-01-01")
    return old, sparse.materialize(second, old, "page_id", "c2", "2025-01-02")


@query(f"{_BOTH} SELECT page_id, id, capture AS materialized_capture, path AS materialized_path FROM places")
def made_reuse(spark, sf_dir):
    """Where each fragment of the second capture is stored."""
    _, new = _places(spark, sf_dir)
    return new.select("page_id", "id", "materialized_capture", "materialized_path")


@query(f"{_BOTH} SELECT page_id, id, path AS materialized_path, sha256(body) AS materialized_hash, body FROM places")
def made_current_view(spark, sf_dir):
    """All fragments of the second capture, from wherever they are stored."""
    old, new = _places(spark, sf_dir, body=True)
    store = sparse.written(old, key="page_id", capture_id="c1").unionByName(sparse.written(new, key="page_id", capture_id="c2"))
    return sparse.current_view(new, store).select("page_id", "id", "materialized_path", "materialized_hash", "body")


@query(f"{_BOTH} SELECT page_id, '![[' || path || ']]' AS pointers FROM places WHERE parent_id IS NULL")
def made_pointers(spark, sf_dir):
    """Pointers to the root fragments of every page."""
    return sparse.composite(_places(spark, sf_dir)[1]).select("page_id", F.array_join("pointers", "\n").alias("pointers"))
