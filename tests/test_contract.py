import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry

REPO = os.path.dirname(os.path.abspath(entry.__file__))


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_gives_rows(spark):
    assert entry.entry(spark).columns == ["doc_id", "score"]


def test_works_without_the_training_data_part(tmp_path):
    """Without the pipeline and the llm folders the rest imports and keeps its queries."""
    shutil.copytree(f"{REPO}/textlake", tmp_path / "textlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{REPO}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bool_nested' in q and 'pipeline' not in q and not [k for k in q if k.startswith('op')]; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_a_broken_import_inside_is_not_hidden(tmp_path):
    shutil.copytree(f"{REPO}/textlake", tmp_path / "textlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{REPO}/__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_library\n")
    assert subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True).returncode != 0
