"""Workers that cannot import this package: everything they need is sent to them."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCRIPT = """
import sys, importlib.util
sys.path.insert(0, {repo!r})
from echorank.session import build_session
import __spark_entry__ as entry

spark = build_session("bare-workers", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
                      spark__ui__showConsoleProgress="false", spark__checkpoint__dir={scratch!r})
spark.sparkContext.setLogLevel("ERROR")
here = spark.sparkContext.parallelize([0], 1).map(lambda _: importlib.util.find_spec("echorank") is not None).collect()
assert here == [False], "the workers see the package"
queries = entry.queries()
for name in sorted(n for n in queries if n.startswith("op") or n == "pipeline"):
    assert queries[name](spark, "/root/testdata/sf0.001").count() > 0, name
    print("done", name)
"""


def test_operators_on_bare_workers(tmp_path):
    script = tmp_path / "run.py"
    script.write_text(SCRIPT.format(repo=REPO, scratch=str(tmp_path / "scratch")))
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME")}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    assert done.stdout.count("done") == 14
