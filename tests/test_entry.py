"""The entry with parts taken out, in a process of its own."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
BLOCKED = """
import sys
for name in {names!r}:
    sys.modules[name] = None
import __spark_entry__
from parcelry_checks import queries
assert set(queries.queries()) <= set(__spark_entry__.queries())
assert set(queries.queries()) <= set(__spark_entry__.oracle_sql())
print(len(__spark_entry__.queries()) - len(queries.queries()))
"""


@pytest.mark.parametrize(
    "names", [["parcelry.llm"], ["public_tokenizers"], ["ahocorasick", "xxhash"], ["corpus_pipeline"]]
)
def test_other_queries_survive(names):
    done = subprocess.run(
        [sys.executable, "-c", BLOCKED.format(names=names)], cwd=ROOT, capture_output=True, text=True
    )
    assert done.returncode == 0, done.stderr
    assert names == ["corpus_pipeline"] or done.stdout.strip() == "0"
    assert "is left out" in done.stderr
