import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from catalith.sources import artifactstore as S
from catalith.streaming import recording as R

ANSWERS = "key string, response string, error_type string, error_message string, latency double, captured_at timestamp"


def answered(rows):
    """A provider that fails for keys that begin with x."""
    bad = F.startswith("key", F.lit("x"))
    return rows.select("key", F.concat(F.lit("answer to "), "key", F.lit(" token=abc")).alias("response"), F.when(bad, "Refused").alias("error_type"), F.when(bad, F.concat(F.lit("no secret=s1 for "), "key")).alias("error_message"), F.lit(-1.0).alias("latency"))


def test_a_stream_run_twice_leaves_one_record_a_key(spark, tmp_path):
    folder, store = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    for i in range(4):
        (folder / f"{i}.csv").write_text("".join(f"k{j}\n" for j in range(i, i + 3)) + f"x{i}\nk{i}\n")
    stream = lambda: spark.readStream.schema("key string").option("maxFilesPerTrigger", 1).csv(str(folder))
    seen = []
    for again in range(2):
        R.record_stream(stream(), store, str(tmp_path / f"cp{again}"), answered, "run").awaitTermination(120)
        rows = R.recorded(spark, store).collect()
        seen.append((sorted((r.key, r.outcome, r.response, r.error_type, r.error_message, r.latency) for r in rows), spark.read.parquet(store).count()))
    assert seen[0] == seen[1]
    keys = [r[0] for r in seen[0][0]]
    assert keys == [f"k{j}" for j in range(6)] + [f"x{i}" for i in range(4)]
    assert seen[0][0][0] == ("k0", "success", "answer to k0 token=[REDACTED]", None, None, 0.0)
    assert seen[0][0][-1] == ("x3", "error", None, "Refused", "no secret=[REDACTED] for x3", 0.0)


def test_replay_raises_what_was_recorded(spark, tmp_path):
    store = str(tmp_path / "store")
    ask = lambda *keys: spark.createDataFrame([(k,) for k in keys], "key string")
    out = R.run_interactions(ask("k", "x"), store, "RECORD", answered)
    assert sorted((r.key, r.outcome) for r in out.collect()) == [("k", "HIT"), ("x", "ERROR")]
    assert sorted((r.key, r.outcome) for r in R.run_interactions(ask("k", "x", "new"), store, "REPLAY").collect()) == [("k", "HIT"), ("new", "MISS"), ("x", "ERROR")]
    assert [r.outcome for r in R.run_interactions(ask("k"), store, "REPLAY", strict=True).collect()] == ["HIT"]
    for key, said in (("x", "recorded failure: Refused"), ("new", "no record of new")):
        with pytest.raises(Exception, match=said):
            R.run_interactions(ask(key), store, "REPLAY", strict=True).collect()
    with pytest.raises(R.RecordedError, match="x: Refused"):
        R.record(answered(ask("x", "y")), store, "1", fail=True)
    assert R.recorded(spark, store, "1").count() == 2  # the failure was written first
    for mode, kw in (("MIXED", {}), ("RECORD", {})):
        with pytest.raises(ValueError):
            R.run_interactions(ask("k"), store, mode, **kw)
    for call in (lambda: R.record(answered(ask("k")), store, "2", writable=False), lambda: R.run_interactions(ask("k"), store, "RECORD", answered, writable=False), lambda: R.record_stream(ask("k"), store, "cp", answered, "r", writable=False)):
        with pytest.raises(S.StoreError, match="READ_ONLY"):
            call()


def test_the_latest_record_counts(spark):
    rows = [("k", "old", None, None, 1.0, "2024-01-01"), ("k", None, "Late", "m", 1.0, "2024-01-03"), ("k", "mid", None, None, 1.0, "2024-01-02"), ("t", "b", None, None, 1.0, "2024-01-01"), ("t", "a", None, None, 1.0, "2024-01-01")]
    df = spark.createDataFrame([(*r[:5], None) for r in rows], ANSWERS).drop("captured_at")
    df = spark.createDataFrame(rows, ANSWERS.replace("captured_at timestamp", "captured_at string")).withColumn("captured_at", F.col("captured_at").cast("timestamp"))
    out = {r.key: (r.outcome, r.response, r.error_type) for r in R.latest(R.scrubbed(df)).collect()}
    assert out == {"k": ("error", None, "Late"), "t": ("success", "b", None)}


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("part-*")}


def test_delete_touches_its_own_prefixes(spark, tmp_path):
    store = str(tmp_path / "store")
    texts = spark.createDataFrame([(f"text {i}",) for i in range(300)], "text string")
    S.put(texts, store)
    before = files(store)
    S.put(texts, store)
    assert files(store) == before
    some = S.stored(spark, store).where("text IN ('text 1', 'text 2', 'text 3')").select("sha").collect()
    doomed = spark.createDataFrame([(r.sha,) for r in some] + [("0" * 64,)], "sha string")
    S.delete(doomed, store)
    assert S.stored(spark, store).count() == 297 and files(store) == before
    touched = S.purge(spark, store)
    after = files(store)
    assert touched == sorted({r.sha[:2] for r in some})
    own = lambda f: f.split("prefix=")[1][:2] in touched
    assert {k: v for k, v in after.items() if not own(k)} == {k: v for k, v in before.items() if not own(k)}
    assert S.stored(spark, store).count() == 297 == spark.read.parquet(store).count() and S.purge(spark, store) == []
    assert not os.path.exists(f"{store}-deleted") and not os.path.exists(f"{store}-purge")
    S.delete(doomed, store)
    S.put(texts, store)
    assert S.stored(spark, store).count() == 300


def test_a_broken_purge_is_taken_up_again(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    S.put(spark.createDataFrame([(f"text {i}",) for i in range(60)], "text string"), store)
    shas = [r.sha for r in S.stored(spark, store).orderBy("sha").limit(2).collect()]
    S.delete(spark.createDataFrame([(s,) for s in shas], "sha string"), store)
    real, calls = S._delete, []

    def broken(spark, path):
        calls.append(path)
        if path.endswith("-deleted"):
            raise OSError("lost")
        real(spark, path)

    monkeypatch.setattr(S, "_delete", broken)
    with pytest.raises(OSError):
        S.purge(spark, store)
    monkeypatch.setattr(S, "_delete", real)
    assert S.stored(spark, store).count() == 58
    S.purge(spark, store)
    assert spark.read.parquet(store).count() == 58 and S.stored(spark, store).where(F.col("sha").isin(shas)).count() == 0


def test_ingest_is_idempotent_and_refuses(spark, tmp_path):
    store = str(tmp_path / "store")
    pages = spark.createDataFrame([(1, "<p>a</p>"), (2, "<p>a</p>"), (3, ""), (4, None), (5, "<p>b</p>")], "id int, html string")
    for _ in range(2):
        assert sorted((r.id, r.status) for r in S.ingest(pages, "id", store).collect()) == [(1, "STORED"), (2, "STORED"), (3, "EMPTY"), (4, "EMPTY"), (5, "STORED")]
        assert S.stored(spark, store).count() == 2
    with pytest.raises(S.StoreError, match="READ_ONLY"):
        S.ingest(pages, "id", store, writable=False)
    with pytest.raises(S.StoreError, match="READ_ONLY"):
        S.delete(S.stored(spark, store), store, writable=False)
    with pytest.raises(S.StoreError, match="NOT_A_HASH"):
        S.delete(spark.createDataFrame([("abc",), (None,)], "sha string"), store)
