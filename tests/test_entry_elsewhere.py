"""The driver may import __spark_entry__ from another working directory;
Python workers must still import the package (shipped with addPyFile)."""

import os
import subprocess
import sys
import textwrap

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_python_queries_run_from_another_cwd(tmp_path):
    script = textwrap.dedent(f"""
        import importlib.util
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
                 .config("spark.driver.host", "127.0.0.1").config("spark.driver.bindAddress", "127.0.0.1")
                 .config("spark.ui.showConsoleProgress", "false").getOrCreate())
        spark.sparkContext.setLogLevel("ERROR")
        spec = importlib.util.spec_from_file_location("entry", "{ROOT}/__spark_entry__.py")
        E = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(E)
        n = E.queries()["roundtrip_failures"](spark, "/root/testdata/sf0.001").count()
        print("ROWS", n)
        spark.stop()
    """)
    (tmp_path / "run.py").write_text(script)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "run.py"], cwd=tmp_path, env=env, capture_output=True, text=True,
                         timeout=600)
    assert "ROWS" in out.stdout, out.stderr[-2000:]
