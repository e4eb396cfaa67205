"""What a Python step holds and how often pages are parsed do not depend on the size of the table."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import parse
from palimpsest.functions.parse import parse_pages
from palimpsest.operators import candidates, sparse
from palimpsest.operators import fragments as G
from palimpsest.plans import catalogue

SF = "/root/testdata/sf0.001"
BUDGET = G.Budget(target=60, maximum=90, minimum=20)
HTML = ["<h1>A</h1><p>one</p><h2>B</h2><p>two</p><h2>2</h2><h1>A</h1>", None, "", "loose<h1></h1>" + "".join(f"<p>{'word ' * n}</p>" for n in range(20)), "<h1>T</h1><table>" + "<tr><td>cell<td>cell</tr>" * 20 + "</table>", "<h6>deep</h6><ol>" + "<li>item of a list" * 20 + "</ol>"]


def pages(spark):
    return spark.createDataFrame([(i, "u", h) for i, h in enumerate(HTML)], "page_id long, url string, html string")


def rows(df):
    return sorted(map(str, df.collect()))


class Step:
    """A table that hands out the function of its Python step."""

    filter = select = lambda self, *_: self

    def mapInArrow(self, run, schema):  # noqa: N802
        self.run = run
        raise StopIteration


def test_slices():
    texts = ["x" * 10, None, "y" * 95, "z" * 300, *["w"] * 7]
    runs = [b.column("html").to_pylist() for b in parse.slices(pa.record_batch({"html": texts}), "html", rows=3, size=100)]
    assert sum(runs, []) == texts and [len(r) for r in runs] == [2, 1, 1, 3, 3, 1]
    assert list(parse.slices(pa.record_batch({"html": pa.array([], pa.string())}), "html")) == []


def python_steps(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("MapInArrow") + plan.count("ArrowEvalPython")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name, steps", [("page_fragments", 1), ("page_fragment_bodies", 1), ("page_fragment_stats", 1), ("made_fragments", 1), ("made_exported", 2)])
def test_pages_are_parsed_once(spark, name, steps):
    assert python_steps(catalogue.QUERIES[name](spark, SF)) == steps


def test_one_step_gives_the_same_fragments(spark):
    apart = G.fragments(parse_pages(pages(spark)), BUDGET)
    assert rows(G.of_pages(pages(spark), BUDGET)) == rows(apart)
    together = G.of_pages(pages(spark), BUDGET, body=True)
    assert rows(G.bodies(together)) == rows(G.bodies(apart)) and rows(G.exported(together, "c", "d").filter("id <> 'a__2'")) == rows(G.exported(apart, "c", "d").filter("id <> 'a__2'"))


def test_fragments_are_made_once(spark):
    """However many steps of the storage read them."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    parts = G.of_pages(pages(spark).filter("page_id > 1"), BUDGET)
    n = parts.count()
    none = spark.createDataFrame([], "page_id long, id string, " + ", ".join(f"{c} string" for c in sparse.LOCATION))
    places = sparse.materialize(parts.mapInArrow(counted, parts.schema), none, "page_id", "c1", "2025-01-01")
    assert places.count() == n == made.value and places.filter(F.col("materialized_path").isNull()).isEmpty()


def test_scripts_are_read_in_parts():
    step = Step()
    with pytest.raises(StopIteration):
        candidates.candidates(step)
    batch = pa.record_batch({"page_id": list(range(5000)), "source_order": [1] * 5000, "type": ["application/json"] * 5000, "content": ["[1]"] * 5000})
    out = list(step.run([batch]))
    assert sum(b.num_rows for b in out) == 5000 and max(b.num_rows for b in out) <= 1024
