import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_the_rest_works_without_the_llm_folders(tmp_path):
    skip = shutil.ignore_patterns(".git", "llm", "__pycache__", "spark-warehouse", ".pytest_cache")
    for i, left in enumerate(("corpus_pipeline.py", None)):
        copy = tmp_path / str(i)
        shutil.copytree(ROOT, copy, ignore=skip)
        (copy / "collatio/llm").mkdir()  # an empty folder may stay behind
        if left is None:
            (copy / "corpus_pipeline.py").unlink(missing_ok=True)
        code = "import __spark_entry__ as e; q = e.queries(); assert 'model_summary' in q and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
        subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, check=True, timeout=120)
