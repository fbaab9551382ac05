"""The library must work when the llm folders are deleted."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_core_imports_without_the_llm_folders(tmp_path):
    keep = shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=keep)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), [n for n in e.queries() if n.startswith('op') or n == 'pipeline'])"], cwd=tmp_path / "repo", env=os.environ | {"PYTHONPATH": str(tmp_path / "repo")}, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    assert int(said.stdout.split()[-2]) > 60 and said.stdout.split()[-1] == "[]"


def test_nothing_outside_llm_imports_it():
    for path in ROOT.joinpath("lexgraph").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "lexgraph.llm" not in path.read_text(), path


FAR = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from lexgraph.operators import parse
from lexgraph.session import shared_dir, write_table, scratch, keep
sents = spark.createDataFrame([(1, ["a", "b", "c"])], "sent_id long, words array<string>")
values = spark.createDataFrame([("a", "b", 1.5)], "wa string, wb string, mi double")
assert parse.word_trees(sents, values).count() == 2
import os
path = lambda df: df.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
with scratch():
    one, two = write_table(sents, "one"), keep(write_table(sents, "two"))
    gone = path(one)
assert two.count() == 1 and not os.path.exists(gone) and os.path.exists(path(two))
print("FOLDER", path(two))
"""


def test_workers_get_the_package_wherever_the_driver_has_it(tmp_path):
    """No PYTHONPATH, another working folder: the package reaches the workers all the same. Scratch tables go, and others with the process."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", FAR.format(root=str(ROOT))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert said.returncode == 0, said.stderr[-3000:]
    assert not Path(said.stdout.rpartition("FOLDER ")[2].strip()).exists()
