"""The registered queries of this part: SQL counterparts agree, and the rest of the library does without it."""

from __future__ import annotations

import pathlib
import subprocess
import sys

import pytest

import __spark_entry__ as entry
import oracle
from lustra.llm.oracle import ORACLE

SF = "/root/testdata/sf0.01"
TOP = pathlib.Path(entry.__file__).parent


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    assert oracle.differences(entry.queries()[name](spark, SF), oracle.connect(SF), ORACLE[name]) == []


def test_one_query_per_operator():
    names = [n.split("_")[0] for n in entry.queries() if n.startswith("op")]
    assert sorted(names) == sorted(f"op{k}" for k in range(1, 14)) and "pipeline" in entry.queries()


def test_nothing_else_imports_it():
    for path in (TOP / "lustra").rglob("*.py"):
        assert "llm" in path.parts or "lustra.llm" not in path.read_text()


def test_entry_without_it():
    hide = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    code = hide.replace("sys.modules['corpus_pipeline'] = None", "sys.meta_path.insert(0, type('H', (), {'find_spec': staticmethod(lambda n, *a: (_ for _ in ()).throw(ModuleNotFoundError(name=n)) if n in ('corpus_pipeline', 'lustra.llm') else None)}))")
    out = subprocess.run([sys.executable, "-c", code], cwd=TOP, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) == int(out[1]) >= 89
