import os
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
CHECKED = [
    "p3_found", "f07_legal_signals", "f08_metadata", "f14_truncated", "t03_windows", "r02_raw_scores", "r05_documents", "r18_fused", "r08_dense", "r11_exact", "r14_votes", "j04_titles_inside", "e03_chunk_scores", "k05_texts", "l01_final",
    "l04_features", "l08_answers", "l10_static_fusion", "v02_per_query", "v10_violations", "s_p02_components", "s_p08_flat", "q05_nations", "a07_rollup", "w02_margin", "x03_sessions", "s12_stored_index",
]


def plain(v):
    v = v.tolist() if hasattr(v, "tolist") else v
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return None if v is None or v is pd.NA or v != v else round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", CHECKED)
def test_equal_to_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    got, want = E.queries()[name](spark, SF).toPandas(), con.execute(E.oracle_sql()[name]).fetchdf()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda df: sorted((tuple(map(plain, r)) for r in df[cols].itertuples(index=False)), key=repr)
    assert rows(got) == rows(want)


def test_names():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry(spark):
    got = E.entry(spark).first()
    assert 0 <= got["recall"] <= 1 and got["n_queries"] > 0


def test_core_stands_without_the_subpackage(tmp_path):
    import shutil
    from pathlib import Path

    root = Path(E.__file__).parent
    shutil.copytree(root / "siltstone", tmp_path / "siltstone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'p3_found' in e.queries(), 'p1_found' in e.queries())"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.stdout.split()[1:] == ["True", "False"], out.stderr
