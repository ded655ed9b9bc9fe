import importlib.util
import os

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"


def entry_module():
    spec = importlib.util.spec_from_file_location("__spark_entry__", os.path.join(ROOT, "__spark_entry__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def test_names():
    entry = entry_module()
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "p3_found" in entry.queries()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")
def test_entry_runs(spark):
    assert entry_module().entry(spark).columns == ["delivery_no"]


def test_core_does_not_import_the_text_operators():
    for folder, _, files in os.walk(os.path.join(ROOT, "recordloom")):
        if os.path.basename(folder) in ("llm", "__pycache__"):
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f), encoding="utf-8") as text:
                    assert "recordloom.llm" not in text.read(), f
