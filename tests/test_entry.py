import os
import shutil
import subprocess
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n.startswith('op') or n == 'pipeline' for n in q), set(e.oracle_sql()) <= set(q))"


def copy(top, *without):
    shutil.copy(f"{HERE}/__spark_entry__.py", top)
    shutil.copytree(f"{HERE}/linkweave", top / "linkweave", ignore=shutil.ignore_patterns("__pycache__", *without))
    return top


def run(top):
    return subprocess.run([sys.executable, "-c", COUNT], cwd=top, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(top), "PYTHONDONTWRITEBYTECODE": "1"})


@pytest.mark.parametrize("left", [False, True])
def test_without_the_subpackage_the_other_queries_stay(tmp_path, left):
    copy(tmp_path, "llm")
    if left:  # a folder without modules
        (tmp_path / "linkweave" / "llm" / "__pycache__").mkdir(parents=True)
    out = run(tmp_path)
    n, corpus, sql = out.stdout.split()
    assert int(n) > 90 and corpus == "0" and sql == "True", out.stderr


def test_faults_within_the_subpackage_are_not_hidden(tmp_path):
    copy(tmp_path, "llm")
    (tmp_path / "linkweave" / "llm").mkdir()
    (tmp_path / "linkweave" / "llm" / "__init__.py").write_text("")
    (tmp_path / "linkweave" / "llm" / "registry.py").write_text("import no_such_library\n")
    out = run(tmp_path)
    assert out.returncode and "no_such_library" in out.stderr
