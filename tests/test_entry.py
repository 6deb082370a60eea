import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


def test_names():
    own, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(own) and {"segment_words", "turn_stream"} <= set(own)


def test_imports_without_a_session():
    """Importing must not need a Spark session; done apart, since this process has one."""
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries()"], cwd=ROOT, check=True, timeout=120)


def test_nothing_imports_the_training_data_operators():
    for path in (ROOT / "tsumugi").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "tsumugi").parts:
            assert "tsumugi.llm" not in path.read_text()
