"""Hierarchical fragmentation of documents under size budgets, with stable ids."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.parse import _struct, document, slices
from palimpsest.functions.text import clean_text, slug_text, units, yaml_scalar

_S, _I = T.StringType(), T.IntegerType()
FRAGMENT = _struct(
    id=_S, kind=_S, fragment_kind=_S, heading=_S, heading_level=_I, heading_path=T.ArrayType(_S), source_order=_I, character_count=_I,
    content_hash=_S, row_content_hash=_S, item_content_hash=_S, parent_id=_S, child_ids=T.ArrayType(_S), block_start=_I, block_end=_I,
    table_index=_I, row_start=_I, row_end=_I, list_index=_I, list_type=_S, item_start=_I, item_end=_I, part_of=_S, file=_S, content=_S,
)
STATS = _struct(oversized_tables=_I, split_tables=_I, table_chunks=_I, oversized_lists=_I, split_lists=_I, list_chunks=_I, list_source_items=_I, omitted_list_items=_I, duplicated_list_items=_I, reordered_list_items=_I)


@dataclass(frozen=True)
class Budget:
    """Sizes in UTF-16 units; the defaults of the format."""

    target: int = 6000
    maximum: int = 10000
    minimum: int = 800
    depth: int = 4

    def __post_init__(self):
        if min(self.target, self.maximum, self.minimum) <= 0:
            raise ValueError("fragment sizes must be positive")
        if self.minimum > self.maximum:
            raise ValueError("minimum fragment size is above the maximum")


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def _greedy(sizes: list[int], fixed: int, joint: int, limit: int) -> list[range]:
    """Runs of items whose joined size stays within the limit; one item may exceed it."""
    out, start, size = [], 0, fixed
    for i, s in enumerate(sizes):
        if i > start and size + joint + s > limit:
            out.append(range(start, i))
            start, size = i, fixed
        size += s + (joint if i > start or fixed else 0)
    return out + [range(start, len(sizes))] if sizes else []


def split_table(md: str, budget: Budget = Budget()) -> list[dict]:
    """Chunks of whole rows under a repeated header, of a table above the maximum."""
    lines = md.strip().split("\n")
    if units(md) <= budget.maximum or len(lines) < 3 or not re.match(r"\s*\|", lines[0]) or not re.match(r"\s*\|?\s*:?-+", lines[1]):
        return []
    head, rows = "\n".join(lines[:2]), [r for r in lines[2:] if r.strip()]
    parts = _greedy([units(r) for r in rows], units(head), 1, min(budget.target, budget.maximum))
    return [{"start": p[0] + 1, "end": p[-1] + 1, "header": head, "body": "\n".join(rows[i] for i in p), "markdown": "\n".join([head, *(rows[i] for i in p)])} for p in parts]


def list_items(md: str, ordered: bool) -> list[str]:
    """Top-level items with all that belongs to them."""
    lines = md.strip().split("\n")
    marker = re.compile(r"\d+\.\s+" if ordered else r"[-+*]\s+")
    at = [i for i, line in enumerate(lines) if marker.match(line)]
    return ["\n".join(lines[a:b]).rstrip() for a, b in zip(at, [*at[1:], len(lines)], strict=True)]


def split_list(md: str, ordered: bool, budget: Budget = Budget()) -> list[dict]:
    """Chunks of whole top-level items, of a list above the maximum."""
    if units(md) <= budget.maximum:
        return []
    items = list_items(md, ordered)
    parts = _greedy([units(i) for i in items], 0, 1, min(budget.target, budget.maximum))
    return [{"start": p[0] + 1, "end": p[-1] + 1, "items": [items[i] for i in p], "body": (body := "\n".join(items[i] for i in p)), "markdown": body} for p in parts]


def pack(blocks: list[dict], budget: Budget) -> list[list[dict]]:
    """Blocks in runs, joined by blank lines: a run ends before it passes the maximum, and once it
    reaches the target. A large block stays whole."""
    out, run, size = [], [], 0
    for b in blocks:
        s = units(b["markdown"])
        if run and size + 2 + s > budget.maximum:
            out.append(run)
            run = []
        size = size + 2 + s if run else s
        run = [*run, b]
        if size >= budget.target and size >= budget.minimum:
            out.append(run)
            run = []
    return out + [run] if run else out


@dataclass
class _Section:
    id: str | None
    heading: str | None = None
    level: int = 0
    path: list = field(default_factory=list)
    parent: str | None = None
    blocks: list = field(default_factory=list)
    below: list = field(default_factory=list)


def outline(blocks: list[dict], depth: int) -> list[_Section]:
    """Sections by heading, relative to the highest level used; content before any is the preamble.

    A heading that skips levels hangs on the nearest one above; later headings of its level that
    have no section in the level just above become roots.
    """
    base = min((b["heading_level"] for b in blocks if b["heading_level"]), default=1)
    root, seen = _Section(None), {}
    chain: list = [root]
    for b in blocks:
        d = b["heading_level"] - base + 1 if b["heading_level"] else None
        if d is None or d > depth:
            chain[-1].blocks.append(b)
            continue
        chain = chain[:d]
        over = chain[-1] or root
        name = "__".join(map(slug_text, [*over.path, b["heading_text"]]))
        seen[name] = n = seen.get(name, 0) + 1
        new = _Section(name if n == 1 else f"{name}__{n}", b["heading_text"], b["heading_level"], [*over.path, b["heading_text"]], over.id)
        over.below.append(new)
        chain = [*chain, *[None] * (d - len(chain)), new]
    if root.blocks or not root.below:
        root.below.insert(0, _Section("preamble", "Preamble", 1, ["Preamble"], None, root.blocks))
    return root.below


def fragment(blocks: list[dict], budget: Budget = Budget()) -> tuple[list[dict], dict]:
    """Fragment records in pre-order, and counters. blocks: rows of a document's ``blocks``."""
    tables = lists = 0
    usable = []
    for b in sorted(blocks, key=lambda b: b["block_index"]):
        tables += b["tag"] == "table"
        lists += b["list_type"] is not None
        b = b | {"table_index": tables if b["tag"] == "table" else None, "list_index": lists if b["list_type"] else None}
        if b["markdown"] and (not b["heading_level"] or b["heading_text"]):
            usable.append(b)
    stats = dict.fromkeys(STATS.names, 0)
    out: list[dict] = []

    def record(**values) -> dict:
        r = dict.fromkeys(FRAGMENT.names) | {"child_ids": [], "source_order": len(out) + 1} | values
        out.append(r)
        return r

    def pieces(b: dict) -> list[dict]:
        what = "table" if b["tag"] == "table" else "list" if b["list_type"] else None
        if not what or units(b["markdown"]) <= budget.maximum:
            return []
        stats[f"oversized_{what}s"] += 1
        chunks = split_table(b["markdown"], budget) if what == "table" else split_list(b["markdown"], b["list_type"] == "ordered", budget)
        if chunks:
            stats[f"split_{what}s"] += 1
            stats[f"{what}_chunks"] += len(chunks)
            if what == "list":
                source, kept = list_items(b["markdown"], b["list_type"] == "ordered"), [i for c in chunks for i in c["items"]]
                stats["list_source_items"] += len(source)
                stats["omitted_list_items"] += max(0, len(source) - len(kept))
                stats["duplicated_list_items"] += max(0, len(kept) - len(source))
                stats["reordered_list_items"] += sum(a != k for a, k in zip(source, kept, strict=False))
        return [c | {"what": what, "block": b} for c in chunks]

    def add(s: _Section) -> str:
        segments, run, heads = [], [], []
        for b in s.blocks:
            chunks = pieces(b)
            if not chunks:
                run.append(b)
                continue
            segments += [{"what": "content", "run": r} for r in pack(run, budget)] + chunks
            run = []
            heads += [chunks[0]["header"]] if chunks[0]["what"] == "table" else []
        segments += [{"what": "content", "run": r} for r in pack(run, budget)]
        for g in segments:
            if g["what"] == "content":
                g["markdown"] = "\n\n".join(b["markdown"] for b in g["run"])
        parts = len(segments) > 1 or any(g["what"] != "content" for g in segments)
        own = segments[0]["markdown"] if segments and not parts else ""
        me = record(id=s.id, kind="aggregate" if s.below or parts else "leaf", heading=s.heading, heading_level=s.level, heading_path=s.path, character_count=units(own), content_hash=sha("\n\n".join(heads) if heads else own), parent_id=s.parent, block_start=s.blocks[0]["block_index"] if s.blocks else None, block_end=s.blocks[-1]["block_index"] if s.blocks else None, content=own)
        n = 0
        for g in segments if parts else []:
            if g["what"] == "content":
                n += 1
                name, title, heading = f"part-{n}", f"Part {n}", f"{s.heading} (part {n})"
                extra = {"block_start": g["run"][0]["block_index"], "block_end": g["run"][-1]["block_index"]}
            else:
                index, unit, b = g["block"][f"{g['what']}_index"], {"table": "row", "list": "item"}[g["what"]], g["block"]
                name, title, heading = f"{g['what']}-{index}__{unit}s-{g['start']}-{g['end']}", f"{g['what'].capitalize()} {index}, {unit}s {g['start']}-{g['end']}", None
                extra = {f"{g['what']}_index": index, f"{unit}_start": g["start"], f"{unit}_end": g["end"], f"{unit}_content_hash": sha(g["body"]), "block_start": b["block_index"], "block_end": b["block_index"]} | ({"list_type": b["list_type"]} if unit == "item" else {})
            child = record(id=f"{s.id}__{name}", kind="leaf", fragment_kind=f"{g['what']}-chunk", heading=heading, heading_level=s.level, heading_path=[*s.path, title], character_count=units(g["markdown"]), content_hash=sha(g["markdown"]), parent_id=s.id, part_of=s.id, content=g["markdown"], **extra)
            me["child_ids"].append(child["id"])
        for b in s.below:
            me["child_ids"].append(add(b))
        return s.id

    for s in outline(usable, budget.depth):
        add(s)
    for r in out:
        r["file"] = f"fragments/{r['source_order']:03d}-{slug_text(r['id'].split('__')[-1])}.md"
    return out, stats


def fragments(parsed: DataFrame, budget: Budget = Budget(), key: str = "page_id") -> DataFrame:
    """A row for each fragment of each parsed page: ``key`` and the fields of FRAGMENT, without shuffle."""
    return _run(parsed, budget, key).select(key, F.explode("fragments").alias("f")).select(key, "f.*")


def of_pages(pages: DataFrame, budget: Budget = Budget(), key: str = "page_id", html: str = "html", url: str = "url", body: bool = False) -> DataFrame:
    """``fragments`` of pages: parsed and cut in one Python step, a few pages at a time, without shuffle. With
    ``body``, each fragment's own rendering stands beside it."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([pages.schema[key], *FRAGMENT, *[T.StructField("body", _S)] * body])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, html):
                at, rows = [], []
                for i, (h, u) in enumerate(zip(batch.column(html).to_pylist(), batch.column(url).to_pylist(), strict=True)):
                    found, _ = fragment([] if h is None else document(h, u, ["blocks"])["blocks"], budget)
                    rows += _rendered(found) if body else found
                    at += [i] * len(found)
                keys = batch.column(key).cast(arrow.field(key).type).take(pa.array(at, pa.int32()))
                yield pa.RecordBatch.from_arrays([keys, *[pa.array([r[f.name] for r in rows], f.type) for f in list(arrow)[1:]]], schema=arrow)

    return pages.select(*dict.fromkeys([key, html, url])).mapInArrow(run, schema)


def _rendered(found: list[dict]) -> list[dict]:
    """The fragments of a document, with their ``body``: what ``bodies`` gives."""
    names, pointers = defaultdict(list), defaultdict(list)
    for r in found:
        names[r["id"]].append(r["file"].split("/")[-1])
    for r in found:
        pointers[r["id"]] += [(n, name) for n, c in enumerate(r["child_ids"]) for name in names[c]]
    for r in found:
        heading = f"{'#' * max(1, min(6, r['heading_level']))} {r['heading']}" if r["heading"] else ""
        r["body"] = "\n\n".join(p for p in [heading, r["content"], *[f"![[{name}]]" for _, name in sorted(pointers[r["id"]])]] if p)
    return found


def statistics(parsed: DataFrame, budget: Budget = Budget(), key: str = "page_id") -> DataFrame:
    """The counters of each parsed page."""
    return _run(parsed, budget, key).select(key, "stats.*")


def _run(parsed: DataFrame, budget: Budget, key: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([parsed.schema[key], T.StructField("fragments", T.ArrayType(FRAGMENT)), T.StructField("stats", STATS)])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in (whole.slice(at, 64) for whole in batches for at in range(0, whole.num_rows, 64)):
            done = [fragment(b or [], budget) for b in batch.column("blocks").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([d[0] for d in done], arrow.field("fragments").type), pa.array([d[1] for d in done], arrow.field("stats").type)], schema=arrow)

    return parsed.select(key, F.col("doc.blocks").alias("blocks")).mapInArrow(run, schema)


def size_stats(fragments_: DataFrame, key: str = "page_id") -> DataFrame:
    """Fragments, smallest and largest size, and leaves of each document."""
    n = F.col("character_count")
    return fragments_.groupBy(key).agg(F.count("*").alias("fragments"), F.coalesce(F.min(n), F.lit(0)).alias("min_characters"), F.coalesce(F.max(n), F.lit(0)).alias("max_characters"), F.count_if(F.col("kind") == "leaf").alias("leaves"))


def title(parsed: DataFrame, fragments_: DataFrame, key: str = "page_id") -> DataFrame:
    """The page's title, else its first root heading."""
    first = fragments_.filter("parent_id IS NULL AND part_of IS NULL").groupBy(key).agg(F.min_by("heading", "source_order").alias("h"))
    return parsed.select(key, "doc.title").join(first, key, "left").select(key, F.coalesce(F.nullif("title", F.lit("")), "h", F.lit("Codex")).alias("title"))


#: Fields of the head of an exported fragment, in the order of the format (fixed values), with the field of the
#: record that holds each; those marked True are left out where they do not apply.
FRONT_MATTER = [
    ("generated", None, False), ("capture_id", None, False), ("capture_date", None, False), ("source_key", None, False), ("fragment_id", "id", False), ("parent_id", "parent_id", False), ("fragment_kind", None, False),
    ("table_index", "table_index", True), ("source_row_start", "row_start", True), ("source_row_end", "row_end", True), ("list_index", "list_index", True), ("list_type", "list_type", True),
    ("source_item_start", "item_start", True), ("source_item_end", "item_end", True), ("source_block_start", "block_start", True), ("source_block_end", "block_end", True),
    ("source_order", "source_order", False), ("heading_path", "heading_path", False), ("content_sha256", "content_hash", False),
]


def front_matter(r: dict, capture_id: str | None, capture_date: str | None) -> str:
    """The YAML head of an exported fragment."""
    given = {"generated": True, "capture_id": capture_id, "capture_date": capture_date, "source_key": "codex", "fragment_kind": r["fragment_kind"] or r["kind"]}
    lines = []
    for name, own, optional in FRONT_MATTER:
        value = r[own] if own else given[name]
        if value is not None or not optional:
            lines.append(f"{name}: {yaml_scalar(value)}\n")
    return f"---\n{''.join(lines)}---\n\n"


def exported(fragments_: DataFrame, capture_id: str, capture_date: str, key: str = "page_id") -> DataFrame:
    """key, id, file and the text of each fragment's file: front matter and body."""
    from pyspark.sql.pandas.types import to_arrow_schema

    if "body" not in fragments_.columns:
        fragments_ = fragments_.join(bodies(fragments_, key).select(key, "id", "body"), [key, "id"])
    fields = ["kind", "fragment_kind", *[own for _, own, _ in FRONT_MATTER if own], "file", "body"]
    schema = T.StructType([fragments_.schema[key], *[T.StructField(c, _S) for c in ("id", "file", "text")]])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "body", 1024):
                texts = [f"{front_matter(r, capture_id, capture_date)}{r['body']}\n" for r in batch.to_pylist()]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).cast(arrow.field(c).type) for c in (key, "id", "file")], pa.array(texts, pa.string())], schema=arrow)

    return fragments_.select(*dict.fromkeys([key, *fields])).mapInArrow(run, schema)


def bodies(fragments_: DataFrame, key: str = "page_id") -> DataFrame:
    """Own rendering of each fragment: heading line, content, a pointer for each child. Fragments that come with
    a ``body`` keep it."""
    if "body" in fragments_.columns:
        return fragments_.select(key, "id", "file", "source_order", "body")
    child = fragments_.select(key, F.col("id").alias("child"), F.element_at(F.split("file", "/"), -1).alias("name"))
    pointers = fragments_.select(key, "id", F.posexplode("child_ids").alias("n", "child")).join(child, [key, "child"]).groupBy(key, "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "name"))), lambda c: F.concat(F.lit("![["), c["name"], F.lit("]]"))).alias("pointers"))
    heading = F.when(F.coalesce("heading", F.lit("")) != "", F.concat(F.repeat(F.lit("#"), F.greatest(F.lit(1), F.least(F.lit(6), "heading_level"))), F.lit(" "), "heading")).otherwise("")
    parts = F.filter(F.concat(F.array(heading, "content"), F.coalesce("pointers", F.array().cast("array<string>"))), lambda p: p != "")
    return fragments_.join(pointers, [key, "id"], "left").select(key, "id", "file", "source_order", F.array_join(parts, "\n\n").alias("body"))


def packed_lines(text: Column, target: int, maximum: int, minimum: int, length=F.char_length) -> Column:
    """Greedy packing of a text's non-empty lines as one fold: an array of (chunk, lines, characters)."""
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    nothing = F.array().cast("array<struct<chunk:int,blocks:int,chars:int>>")
    chunk = lambda n, b, c: F.struct(n.cast("int").alias("chunk"), b.cast("int").alias("blocks"), c.cast("int").alias("chars"))
    start = F.struct(nothing.alias("done"), F.lit(0).alias("n"), F.lit(0).alias("chars"))

    def step(a: Column, line: Column) -> Column:
        size = length(line).cast("int")
        flush = (a["n"] > 0) & (a["chars"] + 2 + size > maximum)
        done = F.when(flush, F.array_append(a["done"], chunk(F.size(a["done"]) + 1, a["n"], a["chars"]))).otherwise(a["done"])
        n = F.when(flush, 1).otherwise(a["n"] + 1)
        chars = F.when(flush | (a["n"] == 0), size).otherwise(a["chars"] + 2 + size)
        full = (chars >= target) & (chars >= minimum)
        return F.struct(F.when(full, F.array_append(done, chunk(F.size(done) + 1, n, chars))).otherwise(done).alias("done"), F.when(full, 0).otherwise(n).alias("n"), F.when(full, 0).otherwise(chars).alias("chars"))

    end = lambda a: F.when(a["n"] > 0, F.array_append(a["done"], chunk(F.size(a["done"]) + 1, a["n"], a["chars"]))).otherwise(a["done"])
    return F.aggregate(lines, start, step, end)


def document_lines(docs: DataFrame, target: int = 600, maximum: int = 1000, minimum: int = 80) -> DataFrame:
    """doc_id, chunk, blocks, chars of every text's lines."""
    return docs.select("doc_id", F.explode(packed_lines(F.col("text"), target, maximum, minimum)).alias("c")).select("doc_id", "c.*")


def numbered_blocks(parsed: DataFrame, key: str = "page_id") -> DataFrame:
    """Blocks as rows, with running ordinals of tables and lists."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("block_index").rowsBetween(Window.unboundedPreceding, 0)
    b = parsed.select(key, F.explode("doc.blocks").alias("b")).select(key, "b.*")
    is_table, is_list = F.col("tag") == "table", F.col("list_type").isNotNull()
    count = lambda c: F.sum(F.coalesce(c.cast("int"), F.lit(0))).over(w)
    return b.withColumn("table_index", F.when(is_table, count(is_table))).withColumn("list_index", F.when(is_list, count(is_list)))


__all__ = ["Budget", "FRAGMENT", "STATS", "bodies", "clean_text", "document_lines", "exported", "fragment", "fragments", "front_matter", "numbered_blocks", "of_pages", "packed_lines", "size_stats", "split_list", "split_table", "statistics", "title"]
