import os
import subprocess
import sys

import __spark_entry__ as entry

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(callable(f) for f in entry.queries().values())


def test_core_stands_without_the_training_data_subpackage():
    code = (
        "import sys, importlib.abc\n"
        "class No(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('plazario.llm'): raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, No())\n"
        "import __spark_entry__ as e\n"
        "assert 'p6_found' in e.queries() and 'p8_ids' not in e.queries()\n"
        "import plazario.plans.pipeline, plazario.sources.report, plazario.streaming.ingest\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=HERE, check=True)
