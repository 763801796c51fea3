"""Every query of the engine runs, and equals its SQL twin where it has one."""

import subprocess
import sys

import pytest

from fathomer.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, duck, sf, same_rows, name):
    assert same_rows(catalog.QUERIES[name](spark, sf).toPandas(), duck.execute(catalog.SQL[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES.keys() - catalog.SQL.keys()))
def test_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry_without_the_optional_package():
    """The entry points work where fathomer.llm and the pipeline can't be imported."""
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith('fathomer.llm') or name == 'corpus_pipeline':
            raise ModuleNotFoundError(f'No module named {name!r}', name=name.split('.queries')[0])
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert e.queries() and not any(q.startswith('op') for q in e.queries()) and 'pipeline' not in e.queries() and e.oracle_sql()
"""
    assert subprocess.run([sys.executable, "-c", code], cwd=__file__.rsplit("/tests/", 1)[0]).returncode == 0
