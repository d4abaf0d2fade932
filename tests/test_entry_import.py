"""The entry module imports where PySpark is loaded from its zip, as spark-submit does."""

import glob
import os
import subprocess
import sys

import pyspark

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_imports_with_pyspark_zip_first_on_the_path():
    lib = os.path.join(os.path.dirname(pyspark.__file__), "python", "lib")
    zips = glob.glob(os.path.join(lib, "*.zip"))
    assert any(os.path.basename(z) == "pyspark.zip" for z in zips)
    env = os.environ | {"PYTHONPATH": os.pathsep.join([*sorted(zips, reverse=True), ROOT])}
    code = "import pyspark, __spark_entry__ as e; print('.zip' in pyspark.__file__, len(e.queries()) >= len(e.oracle_sql()) > 40)"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=env, capture_output=True, text=True, timeout=120)
    assert out.stdout.split() == ["True", "True"], out.stderr[-2000:]
