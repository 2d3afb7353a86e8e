import pathlib
import subprocess
import sys

import pytest

import __spark_entry__
from tessera.queries import catalogue, oracles


def test_names_match():
    assert set(oracles()) == set(catalogue())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_flagship(spark):
    directory = pathlib.Path("/root/testdata/sf0.001")
    if not directory.exists():
        pytest.skip("no test tables")
    assert __spark_entry__.entry(spark).first()[0] == 830


def test_core_does_not_need_the_optional_operators():
    code = "import sys; sys.modules['tessera.llm'] = None; import __spark_entry__ as e; assert 'graph_3_clique' in e.queries() and not any(n.startswith('op') for n in e.queries() if n[2:3].isdigit())"
    root = pathlib.Path(__file__).parent.parent
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True).returncode == 0
