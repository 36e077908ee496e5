import pytest
from helpers import DATA, rows_of, sql_rows

from attestra.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    df = catalog.QUERIES[name](spark, f"{DATA}/sf0.001")
    names, expected = sql_rows(catalog.ORACLES[name], f"{DATA}/sf0.001")
    assert sorted(df.columns) == names
    assert rows_of(df) == expected


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["o_orderkey", "count"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_text_package(tmp_path):
    import shutil
    import subprocess
    import sys
    from helpers import REPO

    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    shutil.copytree(REPO / "attestra", tmp_path / "attestra", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries())"], cwd=tmp_path, capture_output=True, text=True)
    assert "card_order_has_item" in said.stdout.split() and "pipeline" not in said.stdout, said.stderr
