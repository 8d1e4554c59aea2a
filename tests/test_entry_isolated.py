"""The driver's view: the entry module loaded by path, from another folder,
in a plain session; Python-side code must not need the package on workers."""

import subprocess
import sys
from pathlib import Path

ENTRY = Path(__file__).resolve().parents[1] / "__spark_entry__.py"

SCRIPT = f"""
import importlib.util
spec = importlib.util.spec_from_file_location("entry_mod", {str(ENTRY)!r})
m = importlib.util.module_from_spec(spec); spec.loader.exec_module(m)
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").getOrCreate())
print("entry", m.entry(spark).count())
print("stream", m.queries()["stream_disposal_gate"](spark, "/root/testdata/sf0.001").count())
spark.stop()
"""


def test_entry_from_foreign_folder(tmp_path):
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, capture_output=True,
                         text=True, timeout=600)
    assert "entry 1" in out.stdout, out.stderr[-2000:]
    assert "stream 1000" in out.stdout, out.stderr[-2000:]
