"""The entry file must work from any working directory: executor Python
workers import the package through ``addPyFile``, not through the cwd."""

import subprocess
import sys
import textwrap
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_from_other_directory(tmp_path):
    script = textwrap.dedent(f"""
        import importlib.util
        spec = importlib.util.spec_from_file_location("entry", {str(ROOT / '__spark_entry__.py')!r})
        m = importlib.util.module_from_spec(spec); spec.loader.exec_module(m)
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
                 .config("spark.sql.shuffle.partitions", "4").getOrCreate())
        assert len(m.entry(spark).collect()) == 1
        assert m.queries()["topk_merge"](spark, "/root/testdata/sf0.001").count() == 500
        print("OK")
    """)
    run = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True,
                         text=True, timeout=600)
    assert "OK" in run.stdout, run.stderr[-2000:]
