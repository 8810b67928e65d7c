"""The entry module without the parts that may be absent."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SCRIPT = """
import importlib.abc, sys

class Absent(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name == {name!r} or name.startswith({name!r} + "."):
            raise ModuleNotFoundError(name, name=name)

sys.meta_path.insert(0, Absent())
import __spark_entry__ as entry
names = entry.queries()
print(len([n for n in names if not n.startswith("op") and n != "pipeline"]), len(names), set(entry.oracle_sql()) <= set(names))
"""


def run(name):
    return subprocess.run([sys.executable, "-c", SCRIPT.format(name=name)], cwd=ROOT, capture_output=True, text=True)


@pytest.mark.parametrize("name", ["fleetlens.llm", "public_tokenizers", "tokenizers", "corpus_pipeline"])
def test_core_queries_need_nothing_of_the_others(name):
    from fleetlens.plans.catalog import QUERIES

    done = run(name)
    assert done.returncode == 0, done.stderr[-500:]
    core, every, consistent = done.stdout.split()
    assert int(core) == len(QUERIES) and consistent == "True"
    assert name == "corpus_pipeline" or int(every) == len(QUERIES)


def test_a_missing_core_module_is_an_error():
    assert run("fleetlens.operators.radius").returncode != 0
