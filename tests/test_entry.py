"""The entry works without the corpus folders, with or without the pipeline's file."""

import os
import shutil
import subprocess
import sys

import pytest

from .conftest import HERE


@pytest.mark.parametrize("gone", [["tidewell/llm"], ["tidewell/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_entry_imports_without(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(HERE, copy, ignore=shutil.ignore_patterns(".git", "tests", "__pycache__", "*.json", "*.md"))
    for name in gone:
        if (copy / name).is_dir():
            shutil.rmtree(copy / name)
        elif (copy / name).exists():
            (copy / name).unlink()
    says = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, any(n.startswith('op') and n[2].isdigit() for n in q), set(e.oracle_sql()) <= set(q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONDONTWRITEBYTECODE": "1"}
    env["PYTHONPATH"] = os.pathsep.join(p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.abspath(p) != HERE)
    done = subprocess.run([sys.executable, "-c", says], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
    many, pipeline, corpus, known = done.stdout.split()[-4:]
    assert int(many) > 150 and pipeline == "False" and known == "True"
    assert corpus == str("tidewell/llm" not in gone and os.path.isdir(f"{HERE}/tidewell/llm"))


def test_no_query_hides_another():
    from tidewell.plans import catalog

    names = [name for m in catalog.MODULES for name in m.QUERIES]
    assert len(names) == len(set(names)) == len(catalog.QUERIES) and set(catalog.ORACLE) <= set(names)
