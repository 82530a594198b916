"""Workers must not need this package on their path: queries run from another folder, without PYTHONPATH."""

import os
import subprocess
import sys

import pytest

SF = "/root/testdata/sf0.001"
SCRIPT = """
import sys; sys.path.insert(0, {root!r})
from verisift.session import get_spark
from verisift.llm.queries import QUERIES
spark = get_spark("away", cores="2")
for name in ("op7_lm_scoring", "op4_sentencepiece", "op8_ngram_jaccard", "op2_html_extraction"):
    assert QUERIES[name](spark, {sf!r}).count() > 0
"""


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_from_another_folder(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=root, sf=SF)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
