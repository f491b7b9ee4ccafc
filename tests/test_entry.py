"""The driver's entry without its optional parts."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
SHOW = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries(), [k for k in e.queries() if k[:2] == 'op' and k[2].isdigit()])"


def loaded(folder, lines=SHOW):
    env = os.environ | {"PYTHONPATH": os.pathsep.join([str(folder), *os.environ.get("PYTHONPATH", "").split(os.pathsep)])}
    got = subprocess.run([sys.executable, "-c", lines], cwd=folder, env=env, capture_output=True, text=True, check=False)
    assert got.returncode == 0, got.stderr
    return got.stdout.split(None, 3)


def test_entry_without_the_optional_folders(tmp_path):
    for name in ("gridloom", "__spark_entry__.py"):
        copy = shutil.copytree if (ROOT / name).is_dir() else shutil.copy
        skip = {"ignore": shutil.ignore_patterns("llm", "__pycache__")} if copy is shutil.copytree else {}
        copy(ROOT / name, tmp_path / name, **skip)
    n, checks, pipeline, dealt = loaded(tmp_path)
    assert int(n) == int(checks) >= 80 and pipeline == "False" and dealt.strip() == "[]"
    if (ROOT / "corpus_pipeline.py").exists():  # the pipeline alone, without the operators it needs
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
        assert loaded(tmp_path)[2] == "False"


def test_entry_without_a_library_of_the_optional_folders():
    hidden = "import sys; sys.modules['regex'] = sys.modules['tokenizers'] = None; " + SHOW
    n, checks, pipeline, dealt = loaded(ROOT, hidden)
    assert int(n) == int(checks) >= 80 and pipeline == "False" and dealt.strip() == "[]"
