"""The core package and the driver's contract."""

import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans import core
from tessera.session import Scratch, shared_dir

DATA = Path("/root/testdata/sf0.001")


def rows(df):
    return sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())


@pytest.mark.parametrize("name", list(core.QUERIES))
def test_core_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    cur = con.execute(core.ORACLE_SQL[name])
    columns = [x[0] for x in cur.description]
    wanted = sorted(tuple(str(dict(zip(columns, r, strict=True))[c]) for c in sorted(columns)) for r in cur.fetchall())
    assert rows(core.QUERIES[name](spark, str(DATA))) == wanted


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_sql_only_for_registered_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_optional_part(tmp_path):
    """The entry module works in a copy of the repository that lacks the optional folder and module."""
    root = Path(entry.__file__).parent
    (tmp_path / "tessera").mkdir()
    for p in root.joinpath("tessera").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "tessera" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").write_text((root / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; print(sorted(e.queries()), sorted(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert "summary_by_status" in out.stdout and "op1" not in out.stdout, out.stderr


def test_imports_where_a_library_of_the_optional_part_is_absent():
    code = "import sys; sys.modules['tokenizers'] = None; import __spark_entry__ as e; print(sorted(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(entry.__file__).parent, capture_output=True, text=True, timeout=120)
    assert "summary_by_status" in out.stdout and "op1" not in out.stdout and "without tessera.llm.queries" in out.stderr, out.stderr


def test_only_local_sessions_do_without_a_shared_folder(spark):
    def session(master, named=None):
        conf = SimpleNamespace(get=lambda key, default=None: named)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))

    assert shared_dir(session("local[4]")).startswith("file:///")
    assert shared_dir(session("spark://host:7077", "hdfs://host/shared/")) == "hdfs://host/shared"
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_dir(session(master))


def test_scratch_tables_are_read_back_and_dropped(spark):
    scratch = Scratch(spark, "test")
    back = scratch.write(spark.range(5), "five")
    assert back.count() == 5
    scratch.drop("five")
    with pytest.raises(Exception):
        spark.read.parquet(scratch.path("five")).count()
