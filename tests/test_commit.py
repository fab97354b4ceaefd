import hashlib
import json

import pytest
from pyspark.sql import functions as F

from sievelight.operators.validate import DataIntegrityError
from sievelight.sources import commit, io
from sievelight.streaming import resume
from sievelight.streaming.resume import run_states

META = {"detector": "d", "variant": "v", "split": "test", "config_hash": "c", "prompt_version": "p"}


def run_rows(spark, scores):
    rows = [(f"S{i}", "test", "d", "v", s, "c", "p", None, None, None, None, None, "{}") for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, io.RECORD)


def test_a_run_that_stops_between_its_writes_leaves_the_old_one(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/run"
    io.write_run(run_rows(spark, [0.1, 0.9]), META, path, 0.5, "validation")
    write = io.write_jsonl

    def stops(df, where, overwrite=False):
        if where.endswith("/meta"):
            raise KeyboardInterrupt
        write(df, where, overwrite)

    monkeypatch.setattr(io, "write_jsonl", stops)
    with pytest.raises(KeyboardInterrupt):
        io.write_run(run_rows(spark, [0.2, 0.3, 0.4]), META, path, 0.35, "validation")
    records, meta = io.read_run(spark, path)
    assert sorted(r.score for r in records.collect()) == [0.1, 0.9] and meta.first().threshold == 0.5
    assert len(commit.names(spark, f"{path}/versions")) == 1  # what the stopped writer left is gone
    monkeypatch.undo()
    with pytest.raises(DataIntegrityError):
        io.write_run(run_rows(spark, [0.2, float("nan")]), META, path, 0.35, "validation")
    assert io.read_run(spark, path)[1].first().n_records == 2
    io.write_run(run_rows(spark, [0.2, 0.3, 0.4]), META, path, 0.35, "validation")
    assert [r.pred_label for r in io.read_run(spark, path)[0].orderBy("sample_id").collect()] == [0, 0, 1]
    # readers of the old version go on until it is dropped
    assert records.count() == 2 and len(commit.drop_versions(spark, path)) == 1 and io.read_run(spark, path)[0].count() == 3


def test_records_are_worked_out_once(spark, tmp_path):
    log = str(tmp_path / "asked")

    @F.pandas_udf("double")
    def slow(s):
        with open(log, "a") as f:
            f.write("x\n" * len(s))
        return s

    io.write_run(run_rows(spark, [0.1, 0.9]).withColumn("score", slow("score")), META, f"{tmp_path}/run", 0.5, "validation")
    assert len(open(log).read().split()) == 2


def test_files_and_pointers(spark, tmp_path):
    path = f"{tmp_path}/f/a.txt"
    assert commit.put_text(spark, path, "one") and commit.put_text(spark, path, "zwei é")
    assert commit.get_text(spark, path) == "zwei é" and not commit.put_text(spark, path, "drei", overwrite=False)
    assert commit.get_text(spark, path) == "zwei é" and commit.names(spark, f"{tmp_path}/f") == ["a.txt"]
    assert commit.current(spark, str(tmp_path)) is None and commit.version_folder(spark, str(tmp_path)) == str(tmp_path)
    with pytest.raises(ZeroDivisionError), commit.new_version(spark, f"{tmp_path}/v") as folder:
        commit.put_text(spark, f"{folder}/x", "x")
        1 / 0
    assert commit.current(spark, f"{tmp_path}/v") is None and commit.names(spark, f"{tmp_path}/v/versions") == []


@pytest.mark.parametrize("chunk", [1, 2, 3, 1 << 20])
def test_digests_are_streamed(spark, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(io, "CHUNK", chunk)
    for i, data in enumerate((b"a\r\nb\rc\r\r\nd\r", b"", b"\r\n", "é\r\n".encode() * 3)):
        (tmp_path / f"{i}").write_bytes(data)
        assert io.content_hash(spark, f"{tmp_path}/{i}") == hashlib.sha256(data.replace(b"\r\n", b"\n")).hexdigest()
        assert io.file_hash(spark, f"{tmp_path}/{i}") == hashlib.sha256(data).hexdigest()
    each = sorted(hashlib.sha256((tmp_path / f"{i}").read_bytes()).hexdigest() for i in range(4))
    assert io.file_hash(spark, str(tmp_path)) == hashlib.sha256("".join(each).encode()).hexdigest()
    with pytest.raises(FileNotFoundError):
        io.file_hash(spark, f"{tmp_path}/none")


def marked(name, asked=None):
    def score(df):
        if asked is not None:
            asked.append(sorted(r.k for r in df.select("k").collect()))
        return df.withColumn("by", F.lit(name))

    return score


def test_keys_are_finished_once(spark, tmp_path):
    path, asked = f"{tmp_path}/done", []
    rows = lambda *ks: spark.createDataFrame([(k, i) for i, k in enumerate(ks)], "k string, v int")
    out = resume.resume(rows("a", "b", "a", "b", "b"), path, "k", marked("one", asked), "batch 1")
    assert asked == [["a", "b"]] and sorted((r.k, r.v) for r in out.collect()) == [("a", 0), ("b", 1)]
    assert resume.resume(rows("a", "z"), path, "k", marked("two", asked), "batch 1").count() == 2 and len(asked) == 1  # a replay
    assert resume.resume(rows("a", "c"), path, "k", marked("two", asked)).count() == 3 and asked[-1] == ["c"]

    def failing(df):
        return df.withColumn("by", F.raise_error(F.lit("stop")).cast("string"))

    with pytest.raises(Exception, match="stop"):
        resume.resume(rows("d"), path, "k", failing, "batch 2")
    assert resume.resume(rows("d", "c"), path, "k", marked("again"), "batch 2").count() == 4
    with pytest.raises(DataIntegrityError, match="without key"):
        resume.resume(rows(None), path, "k", marked("x"))
    with pytest.raises(DataIntegrityError, match="repeated keys"):
        resume.resume(rows("e"), path, "k", lambda df: df.unionByName(df))
    table = commit.FinishedTable(spark, path, "k")
    assert table.rows().count() == 4 and len(commit.log_entries(spark, path)) == 3


def test_two_runners_that_meet(spark, tmp_path):
    path = f"{tmp_path}/done"
    rows = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k string")

    def slow(df):  # another runner finishes two of the keys, and one of its own, meanwhile
        resume.resume(rows("a", "b", "x"), path, "k", marked("fast"))
        return marked("slow")(df)

    out = resume.resume(rows("a", "b", "c"), path, "k", slow)
    assert sorted((r.k, r.by) for r in out.collect()) == [("a", "fast"), ("b", "fast"), ("c", "slow"), ("x", "fast")]

    def same_batch(df):
        resume.resume(rows("q"), path, "k", marked("first"), "s:7")
        return marked("second")(df)

    assert {r.by for r in resume.resume(rows("q", "r"), path, "k", same_batch, "s:7").filter("k in ('q', 'r')").collect()} == {"first"}
    table = commit.FinishedTable(spark, path, "k")
    assert table.compact() and len(commit.log_entries(spark, path)) == 1
    assert table.rows().count() == 5 and table.has("s:7") and table.has("s:3") and not table.has("s:8") and not table.has("other")
    assert resume.resume(rows("a", "n"), path, "k", marked("late")).count() == 6


def test_a_stream_that_is_replayed_adds_nothing(spark, tmp_path):
    path, schema = f"{tmp_path}/done", "k string"
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"k": "a"}\n{"k": "a"}\n{"k": "b"}\n')
    follow = lambda checkpoint: resume.follow(spark, f"{tmp_path}/in", schema, path, f"{tmp_path}/{checkpoint}", "k", marked(checkpoint))
    follow("cp")
    (tmp_path / "cp/commits/0").unlink()  # as if it had stopped after the table's commit and before the stream's
    (tmp_path / "cp/commits/.0.crc").unlink(missing_ok=True)
    follow("cp")
    (tmp_path / "in/2.json").write_text('{"k": "c"}\n')
    follow("cp")
    assert sorted((r.k, r.by) for r in commit.FinishedTable(spark, path, "k").rows().collect()) == [("a", "cp"), ("b", "cp"), ("c", "cp")]
    follow("other")  # a new checkpoint counts from 0 again; its batches are others
    assert commit.FinishedTable(spark, path, "k").rows().count() == 3


def test_older_tables_count(spark, tmp_path):
    spark.createDataFrame([("a",), ("b",)], "k string").withColumn("by", F.lit("old")).write.parquet(f"{tmp_path}/done")
    out = resume.resume(spark.createDataFrame([("b",), ("c",)], "k string"), f"{tmp_path}/done", "k", marked("new"))
    assert sorted((r.k, r.by) for r in out.collect()) == [("a", "old"), ("b", "old"), ("c", "new")]


STATE = io.schema_of("k string, config string, text string, score double, state string")


def test_rows_go_from_generated_to_scored(spark, tmp_path):
    table = commit.StateTable(spark, f"{tmp_path}/t", STATE, "k", ("generated", "scored"), buckets=4)
    asked = []

    def generate(df):
        asked.append(sorted(r.k for r in df.select("k").collect()))
        return df.withColumn("text", F.concat(F.lit("t-"), "k"))

    score = lambda df: df.withColumn("score", F.length("text").cast("double"))
    work = spark.createDataFrame([(f"k{i}", "c") for i in range(20)], "k string, config string")

    def stops(df):
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        run_states(work, table, generate, stops, ["config"])
    assert table.rows("generated").count() == 20 and table.rows("scored").count() == 0
    out = run_states(work, table, generate, score, ["config"]).collect()
    assert len(out) == 20 and {(r.state, r.text == f"t-{r.k}", r.score == len(r.text)) for r in out} == {("scored", True, True)}
    assert [k for ks in asked for k in ks] == sorted(f"k{i}" for i in range(20))  # each was generated once
    more = work.unionByName(spark.createDataFrame([("new", "c")], work.schema))
    assert run_states(more, table, generate, score, ["config"], parts=3).count() == 21 and sum(map(len, asked)) == 21
    with pytest.raises(DataIntegrityError, match="unknown keys"):
        run_states(work.limit(3), table, generate, score, ["config"])
    with pytest.raises(DataIntegrityError, match="provenance"):
        run_states(more.withColumn("config", F.lit("d")), table, generate, score, ["config"])


def test_only_the_next_state_and_only_changed_buckets(spark, tmp_path):
    table = commit.StateTable(spark, f"{tmp_path}/t", STATE, "k", ("generated", "scored"), buckets=8)
    rows = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k string")
    table.put(rows(*[f"k{i}" for i in range(40)]), "generated")
    before = commit.log_entries(spark, table.path)[-1]["buckets"]
    table.put(rows("k1"), "scored")
    after = commit.log_entries(spark, table.path)[-1]["buckets"]
    assert sum(before[b] != after[b] for b in before) == 1 and table.rows().count() == 40
    for bad, state in ((rows("k1"), "scored"), (rows("none"), "scored"), (rows("k2"), "generated"), (rows("n", "n"), "generated"), (rows(None), "generated")):
        with pytest.raises(DataIntegrityError):
            table.put(bad, state)
    assert commit.log_entries(spark, table.path)[-1]["buckets"] == after and table.rows("scored").count() == 1
    table.put(rows(), "generated")
    assert not commit.add_entry(spark, table.path, 0, {}) and json.loads(commit.get_text(spark, f"{table.path}/_log/00000001.json"))["buckets"] == after
