"""Sessions that name no shared folder, and what is left in it."""

import os
import subprocess
import sys
import tempfile
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

SCRIPT = """
import __spark_entry__ as entry
from tidegauge.session import get_session, shared_dir
spark = get_session(cores=2, partitions=2)
assert spark.conf.get("spark.checkpoint.dir", None) is None
print("ROWS", *(entry.queries()[name](spark, "/root/testdata/sf0.001").count() for name in {names}))
print("FOLDER", shared_dir(spark))
spark.stop()
"""


def run_without_a_preset_folder(*names):
    """Row counts of queries in a process whose defaults set nothing."""
    with tempfile.TemporaryDirectory(prefix="spark-conf-") as empty:
        env = os.environ | {"SPARK_CONF_DIR": empty, "PYTHONPATH": str(ROOT)}
        done = subprocess.run([sys.executable, "-c", SCRIPT.format(names=names)], cwd=ROOT, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    said = dict(line.split(" ", 1) for line in done.stdout.splitlines() if line.startswith(("ROWS", "FOLDER")))
    assert not os.path.exists(said["FOLDER"].removeprefix("file://"))
    return list(map(int, said["ROWS"].split()))


def test_a_laptop_needs_no_setting():
    assert min(run_without_a_preset_folder("t7_prefixes", "d4_scope")) > 0


def test_scratch_removes_what_is_written_within(spark):
    from tidegauge.session import exists, materialise, release, scratch

    with scratch(spark):
        outer = materialise(spark.range(3), "outer")
        with scratch(spark):
            inner = materialise(spark.range(4), "inner")
            gone = materialise(spark.range(5), "gone")
            release(gone)
            assert inner.count() == 4
        assert not exists(spark, inner._written_at) and exists(spark, outer._written_at)
    assert not exists(spark, outer._written_at)
