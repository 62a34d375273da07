import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_library_stands_without_the_corpus_operators(tmp_path):
    """A copy without llm, its tests and the pipeline still imports and keeps its queries."""
    import shutil

    skip = shutil.ignore_patterns("llm", ".git", "__pycache__", "corpus_pipeline.py", "*.zip")
    shutil.copytree(ROOT, tmp_path / "copy", ignore=skip)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) >= 50 and 'pipeline' not in q and not any(x.startswith('op1_') for x in q); assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env={"PYTHONPATH": "", "PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_them():
    for path in (ROOT / "kinesieve").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "kinesieve.llm" not in path.read_text()


def test_repeated_runs_sums_once(spark):
    """Both runs read one table of windows; sums made twice could differ in their last digits."""
    from kinesieve.plans import boards

    out = boards.repeated_runs(spark, "/root/testdata/sf0.001")
    assert not any("lineitem" in f for f in out.inputFiles()) and out.count()


def test_sign_continuity_is_of_sums_in_order(spark, tmp_path):
    """However rows are dealt over tasks, means and the halves that they decide stay as they are on one."""
    from kinesieve.plans import sequences

    rows = spark.range(64 * 40).selectExpr("id as event_id", "timestamp_micros(id * 1000003) as ts", "id % 40 as user_id", "'view' as event_type", "round((id * 7919 % 24677) / 100.0D, 2) as value", "'{}' as props")
    found = []
    for n in (1, 7):
        rows.repartition(n, "event_id").write.parquet(f"{tmp_path}/{n}/events.parquet")
        found.append({(r.clip_id, r.event_id): r.x for r in sequences.sign_continuity(spark, f"{tmp_path}/{n}").collect()})
    assert found[0] == found[1] and len(found[0]) == 64 * 40
