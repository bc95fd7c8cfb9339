import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_the_corpus_operators(tmp_path):
    """A copy without the llm folders and the pipeline still imports and lists its queries."""
    import shutil

    skip = shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", ".pytest_cache", "llm", "corpus_pipeline.py")
    shutil.copytree(ROOT, tmp_path / "copy", ignore=skip)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 20 and not any(n.startswith('op') and n[2].isdigit() for n in q), q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", check=True, env={"PATH": "/usr/bin:/bin"})
