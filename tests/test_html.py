from palimpsest.functions import html as H
from palimpsest.functions.parse import blocks, document
from palimpsest.functions.text import clean_text, name_key_text, slug_text, units

PAGE = """<!doctype html><html lang="en"><head><meta charset="utf-8"><meta property="og:kind" content="harbour"><meta property="og:kind" content="harbours">
<title>Ports
 of  call</title><template><p>spare</p></template></head><body class="wide"><main><p style="visibility:hidden">ghost</p><h2 id="north">North</h2>
<ol start="7"><li>quay <i>one</i><ul><li>crane</li></ul></li><li></li><li>quay two</li></ol><p aria-hidden="true">whisper</p><h4>Tides</h4>
<table><tr><td>high<td>4 m</tr><tr></tr></table><p>Seen from <a href="/ü/pier?x=1">the pier</a><img alt="" src="//cdn.test/p.webp" title="Pier"></p>
<svg viewBox="0 0 2 2"><g><title>dot</title><circle r="1"/></g></svg><script src="//cdn.test/a.js"></script><script type="text/json">[1]</script></main></body></html>"""


def test_document_record():
    d = document(PAGE, "https://ports.test/list/all")
    assert d["title"] == "Ports\nof call" and d["metadata"] == [("og:kind", "harbours")]
    assert [(h["level"], h["text"], h["id"]) for h in d["headings"]] == [(2, "North", "north"), (4, "Tides", None)]
    assert d["paragraphs"] == ["spare", "ghost", "whisper", "Seen from the pier"] and d["lists"] == [{"ordered": True, "items": ["quay one", "quay two"]}]
    assert d["tables"] == [[["high", "4 m"]]] and d["links"][0]["href"] == "https://ports.test/%C3%BC/pier?x=1"
    assert d["images"] == [{"src": "https://cdn.test/p.webp", "original_src": "//cdn.test/p.webp", "alt": "", "title": "Pier"}]
    assert [(s["child_count"], s["view_box"], s["text"]) for s in d["svg"]] == [(3, "0 0 2 2", "dot")]
    assert [(s["inline"], s["type"], s["src"]) for s in d["scripts"]] == [(False, "text/javascript", "https://cdn.test/a.js"), (True, "text/json", None)]
    assert not any(w in d["visible_text"] for w in ("ghost", "whisper", "spare")) and "Seen from the pier" in d["visible_text"]


def test_tolerance():
    body = lambda h: next(n for n in H.parse(h).children if n.tag == "body")
    assert H.markdown(body("<p><b>x<p>y</p>z")) == "**x**\n\n**y**\n\n**z**"
    assert [n.tag for n in body("<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table>").walk()] == ["ul", "li", "li", "table", "tbody", "tr", "td", "td", "tr", "td"]
    assert H.markdown(body('<script>var t="</p>"</script><p>a<br>b')) == "a  \nb"
    assert document("", None)["blocks"] == [] and document("just text", None)["visible_text"] == "just text"


def test_ordered_lists_keep_their_numbers():
    md = H.markdown(next(H.parse('<ol start="41"><li>a</li><li>b<ol><li>x</li></ol></li><li value="47">c</li><li>d</li></ol>').find("ol")))
    assert [line.split(".")[0] for line in md.split("\n") if line[0] != " "] == ["41", "42", "47", "48"] and "    1.  x" in md


def test_blocks_descend_only_into_containers():
    found = blocks(next(n for n in H.parse("<body>loose<div><h1>h</h1><section><p>p</p></section></div><nav><ul><li>n</li></ul></nav><p hidden>no</p></body>").children if n.tag == "body"))
    assert [(b["tag"], b["heading_level"]) for b in found] == [(None, None), ("h1", 1), ("p", None), ("nav", None)] and [b["block_index"] for b in found] == [1, 2, 3, 4]


def test_strings():
    assert clean_text("a  b \n\n  c﻿") == "a b\nc" and units("🗺 a") == 4
    assert slug_text("Ünïcode  Héading!") == "unicode-heading" and slug_text("字") == "untitled" and name_key_text("  Ñorth—Village ３ ") == "ñorth-village-3"
