"""The library stands without the subpackage for training text."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "arcflow").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "arcflow.llm" not in path.read_text(), path


def test_contract_imports_without_it(tmp_path):
    for name in ("arcflow", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", ROOT / name, tmp_path], check=True)
    subprocess.run(["rm", "-rf", tmp_path / "arcflow/llm"], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'sync_part_chain' in q and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True)
