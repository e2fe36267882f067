import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_imports_without_the_training_data_part(tmp_path):
    """The entry points work where the subpackage and the pipeline are absent."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'log_findings' in q and 'pipeline' not in q; assert e.oracle_sql().keys() <= q.keys()"
    subprocess.run([sys.executable, "-c", code], cwd=copy, env={"PYTHONPATH": str(copy), "PATH": "/usr/bin:/bin"}, check=True, timeout=120)


def test_entry_gives_findings(spark):
    sys.path.insert(0, str(ROOT))
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(5).count() == 5
