"""The driver's contract, and that the text subpackage can be taken out."""

import re
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_contract():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries)
    assert {f"p{n}_found" for n in range(1, 6)} <= set(queries)


def test_nothing_imports_the_text_subpackage():
    for path in (ROOT / "lodeline").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"lodeline[. ](?:import )?llm", path.read_text()), path


def test_entry_runs(spark):
    if Path("/root/testdata/sf0.001").exists():
        assert __spark_entry__.entry(spark).count() > 0
