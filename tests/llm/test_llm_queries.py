"""Every query of the package runs on the smallest tables; those with SQL equal it."""

import pytest
from check import compare, duck

import __spark_entry__ as entry
from convlens import llm


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_query(spark, small_dir, name):
    got = entry.queries()[name](spark, small_dir).toPandas()
    assert len(got) > 0
    if name in entry.oracle_sql():
        assert compare(got, duck(small_dir).execute(entry.oracle_sql()[name]).df()).startswith("ok")


def test_names():
    assert [n.split("_")[0] for n in llm.queries()] == [f"op{i}" for i in range(1, 14)]
    assert {"pipeline", *llm.queries()} <= set(entry.queries())


def test_package_may_be_absent(tmp_path):
    """The rest imports and lists its queries without the package and the pipeline."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(entry.__file__).parent
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "convlens", tmp_path / "convlens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(n.startswith('op1') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
