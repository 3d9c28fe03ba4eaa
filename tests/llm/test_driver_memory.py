"""The driver gives memory back that it no longer uses, each time a table is stored."""

from spectraloom.llm import common


def test_freed_native_memory_goes_with_each_stored_table(spark, monkeypatch):
    said, ease = [], common.ease
    monkeypatch.setattr(common, "ease", lambda s: said.append(ease(s)))
    common.stored(spark.range(3))
    assert len(said) == 1 and (said[0] == "" or "rim native heap" in said[0])
