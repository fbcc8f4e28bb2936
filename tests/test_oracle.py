"""Every query of the engine against its SQL, and the rest for rows."""

import subprocess
import sys
from pathlib import Path

import pytest

from quakeframe import plans
from tests.compare import assert_same

SQL = plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, sf_dir, duck, name):
    assert_same(plans.queries()[name](spark, sf_dir), duck.sql(SQL[name]))


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(SQL)))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert not plans.queries()[name](spark, sf_dir).isEmpty()


@pytest.mark.parametrize("gone", ["corpus_pipeline", "quakeframe.llm", "tiktoken"])
def test_entry_works_without_the_text_operators(gone):
    root = Path(__file__).resolve().parent.parent
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        f"        if name == {gone!r}:\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'a29_threshold_sweep' in e.queries() and not [n for n in e.queries() if n.startswith('op') or n == 'pipeline']\n"
        "assert set(e.oracle_sql()) <= set(e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
