"""Python workers that cannot import the package still run every operator with Python code."""

import os
import subprocess
import sys
import textwrap

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCRIPT = """
import sys
sys.path.insert(0, {root!r})  # the driver alone: workers inherit the environment, not this
import os
from lettermill.session import drop_work, local_session
from lettermill.llm import queries as q

spark = local_session(2, "shipping")
spark.sparkContext.setLogLevel("ERROR")

def seen(batches):
    for batch in batches:
        try:
            import lettermill
            batch["id"] = 1
        except ModuleNotFoundError:
            batch["id"] = 0
        yield batch

assert spark.range(4).mapInPandas(seen, "id long").agg({{"id": "sum"}}).first()[0] == 0
for name in {names!r}:
    n = q.QUERIES[name](spark, {sf!r}).count()
    print(name, n, flush=True)
drop_work(spark)
spark.stop()
"""

NAMES = [
    "op1_exact_dedup", "op3_quality_neighbours", "op4_token_counts", "op6_language_codes", "op7_toxicity",
    "op8_ngram_join", "op9_bpe_round_trip", "op10_source_mix", "op11_id_store", "op12_spelling_variants",
    "op13_source_divergence",
]


def test_workers_need_no_copy_of_the_package(tmp_path):
    script = tmp_path / "run.py"
    script.write_text(textwrap.dedent(SCRIPT.format(root=ROOT, names=NAMES, sf="/root/testdata/sf0.001")))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    env["PYSPARK_PYTHON"] = sys.executable
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    found = dict(line.split() for line in done.stdout.splitlines() if line.startswith("op"))
    assert list(found) == NAMES and all(int(n) > 0 for n in found.values())
