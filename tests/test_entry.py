"""The query registry stands without the training-data part, and without a library that only this part needs."""

from __future__ import annotations

import json
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]
NAMES = "import json, __spark_entry__ as e; print('NAMES', json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


def _names(folder: Path, before: str = "") -> tuple[list[str], list[str]]:
    said = subprocess.run([sys.executable, "-c", before + NAMES], cwd=folder, capture_output=True, text=True, timeout=120, check=True)
    return tuple(json.loads(said.stdout.rpartition("NAMES")[2]))


def _copy(to: Path, *without: str) -> Path:
    shutil.copytree(REPO, to, ignore=lambda d, names: [n for n in names if n in (".git", "__pycache__") or str((Path(d) / n).relative_to(REPO)) in without])
    return to


@pytest.mark.parametrize("without", [("sparkdigest/llm", "tests/llm"), ("sparkdigest/llm", "tests/llm", "corpus_pipeline.py")])
def test_without_the_training_data_part(tmp_path, without):
    queries, sql = _names(_copy(tmp_path / "repo", *without))
    assert "url_dedupe" in queries and "url_dedupe" in sql
    assert not [n for n in queries if n.startswith("op") or n == "pipeline"]


def test_with_an_empty_folder(tmp_path):
    folder = _copy(tmp_path / "repo", "sparkdigest/llm", "tests/llm")
    (folder / "sparkdigest/llm").mkdir()
    assert "url_dedupe" in _names(folder)[0]


def test_without_a_library():
    queries, _ = _names(REPO, "import sys; sys.modules['tiktoken'] = None; ")
    assert "url_dedupe" in queries and "pipeline" not in queries
