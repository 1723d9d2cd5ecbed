"""Executors need no installed copy of the library."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[2]

SCRIPT = f"""
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
sys.path.insert(0, {str(REPO)!r})  # the driver alone
from regimeweave.llm import ngram_join, pieces, repeats, token_cache, word_runs
docs = spark.createDataFrame([(1, "a b c d e f g " * 90), (2, "x " + "a b c d e f g " * 90), (3, None)], "doc_id long, text string")
def seen(batches):
    import importlib.util, pyarrow as pa
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([importlib.util.find_spec("regimeweave") is not None] * b.num_rows)], ["seen"])
assert not any(r.seen for r in docs.select("doc_id").mapInArrow(seen, "seen boolean").collect())
for f in (pieces.digest, repeats.repeated_spans, ngram_join.near_copies, word_runs.digest):
    assert f(docs).count() == 3
print("done")
"""


def test_tasks_run_without_the_library(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400)
    assert out.stdout.strip().endswith("done"), out.stderr[-3000:]
