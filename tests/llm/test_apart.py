"""Queries whose executors can't import this package: what runs there travels with the job."""

import os
import subprocess
import sys

SCRIPT = """
import os, sys
sys.path.insert(0, {root!r})
from siltstone.session import session
from siltstone.llm import queries
spark = session("apart", "local[4]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": {work!r}}})
spark.sparkContext.setLogLevel("ERROR")
def reach(batches):
    import importlib.util
    for b in batches:
        b["found"] = importlib.util.find_spec("siltstone") is not None
        yield b
assert not spark.range(4).mapInPandas(reach, "id long, found boolean").where("found").head(1)
for name, query in queries.queries().items():
    if name.startswith("op") or name == "pipeline":
        print(name, query(spark, "/root/testdata/sf0.001").count(), flush=True)
"""


def test_all_queries_on_executors_without_the_package(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    script = tmp_path / "job.py"
    script.write_text(SCRIPT.format(root=root, work=f"file://{tmp_path}/shared"))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    counts = dict(line.split() for line in done.stdout.splitlines() if line.startswith(("op", "pipeline")))
    assert len(counts) == 14 and counts["op1_language_id"] == counts["op5_lm_scoring"] == counts["op10_quality_classifier"]
