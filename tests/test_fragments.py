import re

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.parse import document, parse_pages
from palimpsest.operators import fragments as G


def build(html, **budget):
    return G.fragment(document(html, None)["blocks"], G.Budget(**budget))


def table(n):
    return "<h1>T</h1><table><tr><th>n</th><th>text</th></tr>" + "".join(f"<tr><td>{i}</td><td>{'row ' * 12}</td></tr>" for i in range(n)) + "</table>"


def test_split_table_keeps_rows_and_header():
    parts, stats = build(table(300), target=3000, maximum=4000, minimum=100)
    chunks = [p for p in parts if p["fragment_kind"] == "table-chunk"]
    rows = [line for c in chunks for line in c["content"].split("\n")[2:]]
    assert [int(re.match(r"\| (\d+)", r)[1]) for r in rows] == list(range(300)) and stats["split_tables"] == 1 and stats["table_chunks"] == len(chunks) > 3
    assert all(c["content"].startswith("| n | text |\n| --- | --- |") and c["character_count"] <= 3000 for c in chunks)
    assert chunks[0]["id"] == f"t__table-1__rows-1-{chunks[0]['row_end']}" and [c["row_start"] for c in chunks[1:]] == [c["row_end"] + 1 for c in chunks[:-1]]
    assert parts[0]["kind"] == "aggregate" and parts[0]["child_ids"] == [c["id"] for c in chunks] and parts[0]["content"] == ""


def test_single_large_row_and_item_stay_whole():
    big = "| a |\n| --- |\n| " + "x" * 5000 + " |\n| y |"
    assert [c["body"] for c in G.split_table(big, G.Budget(500, 1000, 10))] == [big.split("\n")[2], big.split("\n")[3]]
    item = "-   " + "x" * 5000
    assert len(G.split_list(f"{item}\n-   y", False, G.Budget(500, 1000, 10))) == 2
    assert G.split_table("| a |\n| --- |", G.Budget()) == [] and G.split_list("- a", False) == []


def test_list_chunks_keep_nested_items():
    html = "<h1>L</h1><ul>" + "".join(f"<li>item {i} {'word ' * 20}<ul><li>nested {i}</li></ul></li>" for i in range(60)) + "</ul>"
    parts, stats = build(html, target=1500, maximum=2000, minimum=100)
    text = "\n".join(p["content"] for p in parts if p["fragment_kind"] == "list-chunk")
    assert [int(x) for x in re.findall(r"^-   item (\d+)", text, re.M)] == list(range(60)) and all(f"nested {i}" in text for i in range(60))
    assert stats["list_source_items"] == 60 and stats["omitted_list_items"] == stats["duplicated_list_items"] == stats["reordered_list_items"] == 0


def test_tree_ids_and_order():
    parts, _ = build("loose<h1>A</h1><p>1</p><h2>B</h2><p>2</p><h2>B</h2><h1>A</h1>")
    assert [(p["id"], p["parent_id"], p["source_order"]) for p in parts] == [("preamble", None, 1), ("a", None, 2), ("a__b", "a", 3), ("a__b__2", "a", 4), ("a__2", None, 5)]
    assert [p["file"] for p in parts][:3] == ["fragments/001-preamble.md", "fragments/002-a.md", "fragments/003-b.md"] and parts[1]["kind"] == "aggregate" and parts[2]["kind"] == "leaf"
    more, _ = build("loose<h1>A</h1><p>1</p><h2>B</h2><p>2</p><h2>B</h2><h1>A</h1><h2>New</h2><p>x</p>")
    assert [p["id"] for p in more][:5] == [p["id"] for p in parts]


def test_skipped_levels():
    parts, _ = build("<h1>A</h1><h3>B</h3><h3>C</h3>")
    assert [(p["id"], p["parent_id"]) for p in parts] == [("a__b", "a")] * 0 + [("a", None), ("a__b", "a"), ("c", None)]


def test_packing_and_empty_page():
    parts, _ = build("<h1>P</h1>" + "".join(f"<p>{'word ' * 40}</p>" for _ in range(10)), target=900, maximum=1200, minimum=100)
    chunks = [p for p in parts if p["fragment_kind"] == "content-chunk"]
    assert len(chunks) == 2 and all(c["character_count"] <= 1200 for c in chunks) and chunks[0]["heading"] == "P (part 1)"
    assert [p["id"] for p in build("")[0]] == ["preamble"]
    with pytest.raises(ValueError):
        G.Budget(minimum=11000)


def test_frames(spark):
    pages = spark.createDataFrame([(1, "http://a/", table(300)), (2, None, None), (3, "http://b/", "")], "page_id long, url string, html string")
    parsed = parse_pages(pages)
    parts = G.fragments(parsed)
    assert parts.filter("page_id = 2").select("id").collect()[0][0] == "preamble" and G.size_stats(parts).count() == 3
    assert G.bodies(parts).filter("page_id = 1 AND id = 't'").first()["body"].startswith("# T\n\n![[002-")
    assert {r["title"] for r in G.title(parsed, parts).collect()} == {"T", "Preamble"} and G.statistics(parsed).filter("split_tables = 1").count() == 1
    text = "\n".join("x" * n for n in (500, 90, 10, 700, 1200, 3))
    got = [tuple(c) for c in spark.createDataFrame([(1, text)], "doc_id long, text string").select(F.explode(G.packed_lines(F.col("text"), 600, 1000, 80))).select("col.*").collect()]
    assert got == [(1, 3, 604), (2, 1, 700), (3, 1, 1200), (4, 1, 3)]


def test_front_matter():
    parts, _ = build(table(300), target=3000, maximum=4000, minimum=100)
    head = G.front_matter(parts[1], "2025-01-01T00-00-00Z", "2025-01-01")
    keys = [line.split(":")[0] for line in head.strip().split("\n")[1:-1]]
    assert keys == ["generated", "capture_id", "capture_date", "source_key", "fragment_id", "parent_id", "fragment_kind", "table_index", "source_row_start", "source_row_end", "source_block_start", "source_block_end", "source_order", "heading_path", "content_sha256"]
    assert 'heading_path: ["T", "Table 1, rows 1-' in head and 'parent_id: "t"' in head and G.front_matter(parts[0], None, None).count("null") == 3
