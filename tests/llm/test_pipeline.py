"""The pipeline's stages on the smallest tables: columns, whole decisions, and the rest of the library without this package."""

import os
import re
import subprocess
import sys
from pathlib import Path

import pytest

import corpus_pipeline
from lintlake.llm import mixing, near_dedup, pii

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ROOT = Path(corpus_pipeline.__file__).parent


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_stages_chain(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], SF).write.parquet(str(tmp_path / str(i)))
        seen.append(spark.read.parquet(str(tmp_path / str(i))))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "near duplicates", "personal data", "mixing", "packing"]
    assert all(s.columns == columns for s in seen[:-1])
    ids = [[r.doc_id for r in s.select("doc_id").collect()] for s in seen]
    assert set(ids[1]) <= set(ids[0]) and 0.7 * len(ids[0]) < len(ids[1]) < len(ids[0])
    kept = {r.doc_id for r in near_dedup.near_duplicates(seen[1], percent=corpus_pipeline.SIMILAR).where("kept").select("doc_id").collect()}
    assert sorted(ids[2]) == sorted(kept) and sorted(ids[3]) == sorted(ids[2])
    assert not any(pii.base_spans(r.text) for r in seen[3].collect())
    copies = {r.doc_id: r.copies for r in mixing.document_copies(seen[3]).collect()}
    assert {i: ids[4].count(i) for i in ids[3]} == copies
    pieces = seen[5].collect()
    assert {r.doc_id for r in pieces} == set(ids[4]) and len({(r.sequence_id, r.offset) for r in pieces}) == len(pieces)


def test_near_copies_from_080_go(spark):
    """Two words changed in 110: 96 of 116 five-word shingles in common (0.828), below op2's own 0.85; three: 91 of 121 (0.752)."""
    rows = []
    for family in range(20):
        words = [f"f{family}w{i}" for i in range(110)]
        for edits in ((), (30, 70), (20, 50, 80)):
            rows.append((len(rows), " ".join(f"{w}x{len(edits)}" if i in edits else w for i, w in enumerate(words))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()}
    assert left == {i for i, _ in rows if i % 3 != 1}
    own = near_dedup.near_duplicates(docs).where("kept").count()
    assert own == len(rows)


def test_nothing_else_imports_this_package():
    for path in [*ROOT.glob("lintlake/**/*.py"), *ROOT.glob("bindings/*.py"), *ROOT.glob("tests/*.py"), ROOT / "bench.py"]:
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import)\s+(lintlake\.llm|corpus_pipeline)", path.read_text(), re.M), path


def test_entry_imports_without_this_package():
    code = (
        "import sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path, target=None):\n"
        "        if name.startswith('lintlake.llm') or name == 'corpus_pipeline': raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "q = e.queries(); assert len(q) > 140 and 'pipeline' not in q and not any(x.startswith('op') for x in q)\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
