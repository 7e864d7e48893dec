"""The registered queries stand without the subpackage of training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("pipeline", [True, False])
def test_queries_without_the_training_data_operators(tmp_path, pipeline):
    for folder in ("barograph", "twins"):
        shutil.copytree(f"{ROOT}/{folder}", f"{tmp_path}/{folder}", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py"] + ["corpus_pipeline.py"] * pipeline:
        if os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", f"{tmp_path}/{name}")
    code = ("import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); "
            "assert 'pipeline' not in q and not any(n.startswith('op') and n[2].isdigit() for n in q); print(len(q))")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) >= 118
