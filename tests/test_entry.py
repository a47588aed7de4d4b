import os
import subprocess
import sys

import pytest

DATA = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1


def test_the_rest_stands_without_the_training_data_operators(tmp_path):
    code = "import sys; sys.modules['quernel.llm'] = None\nimport __spark_entry__ as e; q = e.queries(); assert q and not any(n[0] == 'p' and n[1].isdigit() for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, env={**os.environ, "PYTHONPATH": ROOT})


def test_nothing_else_imports_them():
    for folder, _, files in os.walk(os.path.join(ROOT, "quernel")):
        for f in files:
            if f.endswith(".py") and os.path.basename(folder) != "llm":
                with open(os.path.join(folder, f), encoding="utf-8") as h:
                    assert "quernel.llm" not in h.read(), f
