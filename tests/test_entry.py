"""The driver's entry works whether or not the training-data subpackage can be imported."""

import subprocess
import sys
from pathlib import Path

import pytest

CODE = """
import sys, warnings
sys.modules[{broken!r}] = None
with warnings.catch_warnings(record=True) as said:
    warnings.simplefilter("always")
    import __spark_entry__ as entry
assert any("left out" in str(w.message) for w in said), said
names = entry.queries()
assert "hybrid_topk" in names and "pipeline" not in names and set(entry.oracle_sql()) <= set(names)
"""


@pytest.mark.parametrize("broken", ["proofmill.llm.queries", "corpus_pipeline"])
def test_a_part_that_cannot_be_imported_leaves_the_rest(broken):
    root = Path(__file__).resolve().parents[1]
    done = subprocess.run([sys.executable, "-c", CODE.format(broken=broken)], cwd=root, capture_output=True, text=True, timeout=120)
    assert not done.returncode, done.stderr
