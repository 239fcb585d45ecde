"""The entry module with and without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
HIDE = """
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("touchline.llm"):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Hidden())
"""
COUNT = """
import __spark_entry__ as e
print(len(e.queries()), len(e.oracle_sql()), "pipeline" in e.queries(),
      sum(q.startswith("op") and q[2].isdigit() for q in e.queries()))
"""


def counted(code):
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True,
                          text=True, check=True)
    return done.stdout.split()


def test_without_the_subpackage():
    queries, statements, pipeline, operators = counted(HIDE + COUNT)
    assert int(queries) >= 50 and int(statements) >= 45
    assert (pipeline, operators) == ("False", "0")


def test_nothing_else_imports_it():
    for path in (ROOT / "touchline").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "touchline").parts:
            assert "llm" not in path.read_text()
