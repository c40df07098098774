import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_every_query_has_a_plan_and_every_sql_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 50


def test_the_rest_stands_without_llm(tmp_path):
    code = "import sys; sys.modules['pocketloom.llm'] = None\nimport pocketloom.cli, pocketloom.queries.pipeline, pocketloom.queries.data_problems, pocketloom.streaming.poses"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True).returncode == 0
    inside = [p for p in (ROOT / "pocketloom").rglob("*.py") if "llm" not in p.parts and "pocketloom.llm" in p.read_text(encoding="utf-8")]
    assert inside == []
