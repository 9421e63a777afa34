"""Every registered query with a twin gives the rows of the twin; the others run."""

import pytest

from encodelens.plans.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, data, duck, same, name):
    same(QUERIES[name](spark, data), duck, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_optional_part():
    """The entry imports when the training-data part and its pipeline are absent."""
    import subprocess
    import sys

    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, *a):\n"
        "        if name == 'corpus_pipeline' or name.startswith('encodelens.llm'):\n"
        "            raise ImportError(name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert e.queries() and e.oracle_sql() and not any(k.startswith('op') for k in e.queries())\n"
    )
    from pathlib import Path

    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parent.parent)
