"""HTML pages as nested records: one parse a page, Arrow batches, everything else built-in."""

from __future__ import annotations

import re
from urllib.parse import quote, urljoin, urlsplit

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from palimpsest.functions import html as H
from palimpsest.functions.text import clean_text

_S, _I, _B = T.StringType(), T.IntegerType(), T.BooleanType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


BLOCK = _struct(block_index=_I, tag=_S, heading_level=_I, heading_text=_S, list_type=_S, markdown=_S)
DOCUMENT = _struct(
    title=_S, metadata=T.MapType(_S, _S),
    headings=T.ArrayType(_struct(level=_I, text=_S, id=_S)),
    paragraphs=T.ArrayType(_S),
    lists=T.ArrayType(_struct(ordered=_B, items=T.ArrayType(_S))),
    tables=T.ArrayType(T.ArrayType(T.ArrayType(_S))),
    links=T.ArrayType(_struct(text=_S, href=_S, original_href=_S)),
    images=T.ArrayType(_struct(src=_S, original_src=_S, alt=_S, title=_S)),
    svg=T.ArrayType(_struct(index=_I, id=_S, classes=_S, view_box=_S, text=_S, child_count=_I)),
    scripts=T.ArrayType(_struct(source_order=_I, type=_S, inline=_B, src=_S, original_src=_S, content=_S)),
    tags=T.ArrayType(_S),
    attributes=T.ArrayType(_struct(tag=_S, name=_S, value=_S)),
    visible_text=_S, markdown=_S,
    blocks=T.ArrayType(BLOCK),
)

#: Fields that are made from the body alone.
_OF_BODY = {"visible_text", "markdown", "blocks"}
#: Elements that blocks are looked for inside.
CONTAINERS = {"body", "main", "article", "section", "div"}


def absolute(value: str | None, base: str | None) -> str | None:
    """The resolved URL, non-ASCII percent-encoded; the value itself if it cannot be resolved."""
    if not value:
        return None
    try:
        joined = urljoin(base or "", value.strip())
        if not urlsplit(joined).scheme:
            return value
        return quote(joined, safe="%/:=&?~#+!$,;'@()*[]|")
    except ValueError:
        return value


def blocks(body: H.Node) -> list[dict]:
    """Outermost elements and loose texts outside containers, numbered before empty ones drop."""
    found: list = []

    def enter(n) -> None:
        for c in n.children:
            if isinstance(c, str):
                if clean_text(c):
                    found.append(c)
            elif H.hidden_block(c):
                continue
            elif c.tag in CONTAINERS:
                enter(c)
            else:
                found.append(c)

    enter(body)
    out = []
    for i, n in enumerate(found, 1):
        tag = None if isinstance(n, str) else n.tag
        level = int(tag[1]) if tag and re.fullmatch("h[1-6]", tag) else None
        heading = H.page_text(n, H.hidden_block) if level else None
        md = H.markdown(n, H.hidden_block)
        out.append({"block_index": i, "tag": tag, "heading_level": level, "heading_text": heading, "list_type": {"ol": "ordered", "ul": "unordered"}.get(tag), "markdown": md})
    return out


def document(html: str, url: str | None, fields=None) -> dict:
    """Projections of one page: all, or those of ``fields``."""
    root = H.parse(html)
    every = [] if fields and set(fields) <= _OF_BODY else [root, *root.walk()]
    body = next(n for n in root.children if isinstance(n, H.Node) and n.tag == "body")
    of = lambda *tags: [n for n in every if n.tag in tags]

    def metadata() -> list:
        meta = {}
        for n in of("meta"):
            key = n.attrs.get("name") or n.attrs.get("property") or n.attrs.get("http-equiv")
            if key and n.attrs.get("content"):
                meta[key] = n.attrs["content"]
        return list(meta.items())

    def lists() -> list:
        inner = {id(x) for n in of("ul", "ol") for x in n.find("ul", "ol")}
        return [{"ordered": n.tag == "ol", "items": items(n)} for n in of("ul", "ol") if id(n) not in inner]

    items = lambda n: [t for i in n.children if isinstance(i, H.Node) and i.tag == "li" and (t := clean_text("".join(c if isinstance(c, str) else c.text() for c in i.children if isinstance(c, str) or c.tag not in ("ul", "ol"))))]
    cells = lambda t: [r for row in t.find("tr") if (r := [H.page_text(c) for c in row.children if isinstance(c, H.Node) and c.tag in ("td", "th")])]
    projections = {
        "title": lambda: next((clean_text(n.text()) for n in of("title")), ""),
        "metadata": metadata,
        "headings": lambda: [{"level": int(n.tag[1]), "text": t, "id": n.attrs.get("id") or None} for n in of("h1", "h2", "h3", "h4", "h5", "h6") if (t := H.page_text(n))],
        "paragraphs": lambda: [t for n in of("p") if (t := H.page_text(n))],
        "lists": lists,
        "tables": lambda: [cells(n) for n in of("table")],
        "links": lambda: [{"text": H.page_text(n), "href": absolute(n.attrs["href"], url), "original_href": n.attrs["href"]} for n in of("a") if "href" in n.attrs],
        "images": lambda: [{"src": absolute(n.attrs.get("src"), url), "original_src": n.attrs.get("src") or None, "alt": n.attrs.get("alt", ""), "title": n.attrs.get("title") or None} for n in of("img")],
        "svg": lambda: [{"index": i, "id": n.attrs.get("id") or None, "classes": n.attrs.get("class") or None, "view_box": n.attrs.get("viewbox") or None, "text": H.page_text(n), "child_count": sum(1 for _ in n.walk())} for i, n in enumerate(of("svg"), 1)],
        "scripts": lambda: [{"source_order": i, "type": n.attrs.get("type") or "text/javascript", "inline": not n.attrs.get("src"), "src": absolute(n.attrs.get("src"), url), "original_src": n.attrs.get("src") or None, "content": n.text()} for i, n in enumerate(of("script"), 1)],
        "tags": lambda: [n.tag for n in every],
        "attributes": lambda: [{"tag": n.tag, "name": k, "value": v} for n in every for k, v in n.attrs.items()],
        "visible_text": lambda: H.page_text(body, H.hidden),
        "markdown": lambda: H.markdown(body) + "\n",
        "blocks": lambda: blocks(body),
    }
    return {name: make() for name, make in projections.items() if not fields or name in fields}


def slices(batch: pa.RecordBatch, column: str, rows: int = 128, size: int = 1 << 22):
    """A batch in runs of at most ``rows`` rows and ``size`` bytes of a string column; a larger row is a run of
    its own. What Python holds at a time then depends on neither the batch nor the partition."""
    start = total = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if i > start and (i - start == rows or total + n > size):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if batch.num_rows > start:
        yield batch.slice(start)


def parse_pages(pages: DataFrame, html: str = "html", url: str = "url", rows: int = 128, fields=()) -> DataFrame:
    """Replace ``html`` by ``doc``: DOCUMENT, or only its ``fields``, so that the others are not computed. A
    null page gives a null doc. No shuffle."""
    from pyspark.sql.pandas.types import to_arrow_schema

    rest = [c for c in pages.columns if c not in (html, "doc")]
    schema = T.StructType([pages.schema[c] for c in rest] + [T.StructField("doc", T.StructType([f for f in DOCUMENT if not fields or f.name in fields]))])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, html, rows):
                docs = [None if h is None else document(h, u, fields) for h, u in zip(batch.column(html).to_pylist(), batch.column(url).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(c).cast(arrow.field(c).type) for c in rest] + [pa.array(docs, arrow.field("doc").type)], schema=arrow)

    return pages.select(*dict.fromkeys([*rest, html, url])).mapInArrow(run, schema)
