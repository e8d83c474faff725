"""The entry works with and without the training-data operators."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_the_optional_part(tmp_path):
    for name in ("__spark_entry__.py", "tidewell"):
        subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "tidewell/llm")], check=True)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True)
    assert int(out.stdout.split()[0]) > 100 and out.stdout.split()[1] == "False"


def test_a_broken_optional_part_is_an_error(tmp_path):
    for name in ("__spark_entry__.py", "tidewell"):
        subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path)], check=True)
    (tmp_path / "tidewell/llm").mkdir(exist_ok=True)
    (tmp_path / "tidewell/llm/queries.py").write_text("import no_such_module")
    (tmp_path / "corpus_pipeline.py").write_text("")
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=False)
    assert out.returncode and "no_such_module" in out.stderr
