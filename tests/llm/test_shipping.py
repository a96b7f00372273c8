import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]

#: The driver alone knows the package: workers run elsewhere and without PYTHONPATH.
RUN = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__
from vellum.session import get_session

spark = get_session("shipping", spark__master="local[2]", spark__ui__enabled="false", spark__sql__shuffle__partitions="4", spark__checkpoint__dir="file://{tmp}/shared", spark__sql__warehouse__dir="file://{tmp}/warehouse")
spark.sparkContext.setLogLevel("OFF")
for name in {names!r}:
    __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    print("ran", name)
"""


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_executors_need_no_copy_of_the_package(tmp_path):
    names = ["op1_language_id", "op5_html", "op6_pii", "op7_hnsw", "op8_byte_bpe", "op9_simhash", "op10_exact_dedup", "op11_collocations", "op12_alignment", "op13_packing"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = RUN.format(root=str(ROOT), tmp=tmp_path, names=names)
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    assert [line.split()[1] for line in done.stdout.splitlines() if line.startswith("ran")] == names
