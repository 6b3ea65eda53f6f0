from catalith.llm import common as m


def test_a_task_drops_what_other_operators_remember(monkeypatch):
    monkeypatch.setattr(m, "_REMEMBERED", {})
    own, other = {"a": 1}, {"b": 2}
    m.remembers("own", own.clear)
    m.remembers("other", other.clear)
    m.begins("own")
    assert own == {"a": 1} and other == {}
    m.begins("third")
    assert own == {}


def test_slices_keep_every_row():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"x": list(range(1000))})
    parts = list(m.slices([batch, batch.slice(0, 0)], 300))
    assert [p.num_rows for p in parts] == [300, 300, 300, 100] and pa.Table.from_batches(parts)["x"].to_pylist() == list(range(1000))
