"""The pipeline: its stages keep whole rows, take effect, and handle edges; the package works without them."""

import subprocess
import sys

import corpus_pipeline as P
from weekpanel.llm.text import table
from weekpanel.session import materialize

from . import brute
from .conftest import SF01, document_frame

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_on_the_test_tables(spark):
    docs = table(spark, SF01, "documents")
    was = {r.doc_id: tuple(r) for r in docs.collect()}
    kept = {}
    for name, stage in P.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF01), f"t-{name}")  # as the pipeline does: written and read again
        rows = docs.collect()
        assert docs.columns == COLUMNS and all(was[r.doc_id] == tuple(r) for r in rows) and len({r.doc_id for r in rows}) == len(rows)
        kept[name] = {r.doc_id: r.text for r in rows}
    assert len(kept["language"]) > 0.99 * len(was)
    want = {i for i, (_, c) in brute.components(kept["quality"].items()).items() if i == c}
    assert kept["near_duplicates"].keys() == want
    items = [(r.item_id, r.text) for r in table(spark, SF01, "benchmark").collect()]
    leaked = {d for d, _ in brute.leaks(kept["near_duplicates"].items(), items)}
    assert leaked and kept["decontamination"].keys() == want - leaked
    pieces = P.packing(spark, docs, SF01).collect()
    assert {r.doc_id for r in pieces} == kept["decontamination"].keys()


def test_run_gives_pieces(spark):
    assert P.run(spark, "/root/testdata/sf0.001").select("doc_id").distinct().count() > 0


def test_first_stages_on_edges(spark, edges, empty):
    for stage in (P.language, P.quality):
        assert stage(spark, edges, SF01).columns == edges.columns
        assert stage(spark, empty, SF01).count() == 0


def test_later_stages_on_edges(spark, edges):
    twice = document_frame(spark, [(21, "a b c", None, None), (21, "d e f", None, None), (22, "g h i", None, None)])
    rest = P.deduplicate(spark, edges.union(twice), SF01)
    assert rest.columns == edges.columns
    rows = sorted((r.doc_id or 0, r.text or "") for r in rest.collect())
    assert [i for i, _ in rows] == [0, 1, 2, 3, 4, 5, 7, 8, 9, 10, 21, 22] and (21, "a b c") in rows
    assert P.decontaminate(spark, rest, SF01).columns == edges.columns


def test_other_queries_do_not_import_the_subpackage():
    code = "import sys; import weekpanel.plans.queries, weekpanel.cli; assert not [m for m in sys.modules if m.startswith('weekpanel.llm')]"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
