"""The driver's contract."""

import __spark_entry__ as entry


def test_names():
    q, o = entry.queries(), entry.oracle_sql()
    assert "voxel_histogram" in q and set(o) <= set(q)


def test_flagship(spark):
    assert entry.entry(spark).columns == ["scan_id", "i", "j", "k", "n"]


def test_optional_part(monkeypatch):
    monkeypatch.setattr(entry, "_corpus", None)
    monkeypatch.setattr(entry, "_pipeline", None)
    assert not [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()] and "pipeline" not in entry.queries()
