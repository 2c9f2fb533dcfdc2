from types import SimpleNamespace

from clickloom import scale
from clickloom.llm import work


def test_folders_are_qualified_registered_and_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scale, "_scratch", [])
    # The setting is fixed when a session starts; only what folder() reads of a session stands in for it.
    session = SimpleNamespace(conf={"spark.checkpoint.dir": str(tmp_path)}, _jvm=spark._jvm, _jsc=spark._jsc)
    where = work.folder(session, "x")
    assert where.startswith("file:/") and scale._scratch == [where]
    store, path = work.open_store(where)
    store.create_dir(path)
    assert path.startswith(str(tmp_path)) and len(list(tmp_path.iterdir())) == 1
    scale.remove_scratch(session)
    assert list(tmp_path.iterdir()) == []
    kept = work.folder(SimpleNamespace(conf={"spark.checkpoint.dir": "s3a://bucket/x/"}), "y")
    assert kept.startswith("s3a://bucket/x/llm-")


def test_a_free_column_name(spark):
    df = spark.createDataFrame([(1, 2)], "row_key int, _Row_Key2 int")
    assert work.free_name(df, "row_key") == "_row_key" and work.free_name(df, "x") == "x"
