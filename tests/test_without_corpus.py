"""The rest of the library where the corpus operators are not installed."""

import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from lumenweave.functions import durable
from lumenweave.plans.queries import ORACLES, QUERIES

ROOT = Path(__file__).resolve().parents[1]
ASK = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


def names(folder):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", ASK], cwd=folder, env=env, capture_output=True, text=True, check=True)
    return json.loads(said.stdout.splitlines()[-1])


def copied(folder):
    shutil.copytree(ROOT / "lumenweave", folder / "lumenweave", ignore=shutil.ignore_patterns("__pycache__", "llm"))
    shutil.copy(ROOT / "__spark_entry__.py", folder)


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_entry_without_the_corpus_folders(tmp_path, with_pipeline):
    copied(tmp_path)
    if with_pipeline and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    assert names(tmp_path) == [sorted(QUERIES), sorted(ORACLES)]


def test_nothing_else_imports_the_corpus_folder():
    for p in (ROOT / "lumenweave").rglob("*.py"):
        if "llm" not in p.parts:
            assert "lumenweave.llm" not in p.read_text(), p


class Session:
    """As much of a session of a cluster as ``shared_dir`` asks for."""

    def __init__(self, master):
        self.sparkContext = self
        self.master = master
        self._jsc = self

    def sc(self):
        return self

    getConf = getCheckpointDir = sc

    def isDefined(self):
        return False

    def get(self, _):
        return None


def test_no_folder_of_one_machine_on_a_cluster():
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            durable.shared_dir(Session(master))
