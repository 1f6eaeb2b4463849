import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_and_keys(spark):
    import __spark_entry__

    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries)
    assert __spark_entry__.entry(spark).count() > 0


def test_the_rest_imports_without_the_corpus_operators(tmp_path):
    for name in ("__spark_entry__.py", "tideline"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else copy_without_llm(ROOT / name, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q), q; e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, timeout=100).returncode == 0


def copy_without_llm(source: Path, target: Path) -> None:
    import shutil

    shutil.copytree(source, target, ignore=shutil.ignore_patterns("llm", "__pycache__"))
