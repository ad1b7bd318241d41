from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import Observation
from pyspark.sql import functions as F

from lathework.functions.text import duration_seconds
from lathework.operators import benchruns as B
from lathework.operators import gridded as G
from lathework.operators import records
from lathework.sources import readers, synthetic, writers
from lathework.streaming import results as S


def test_json_folder(spark, tmp_path):
    schema = "a int, b string"
    with pytest.raises(FileNotFoundError):
        readers.read_json_dir(spark, str(tmp_path / "absent"), schema)
    folder = tmp_path / "in"
    folder.mkdir()
    assert readers.read_json_dir(spark, str(folder), schema).count() == 0
    (folder / "note.txt").write_text("no json")
    assert readers.read_json_dir(spark, str(folder), schema).count() == 0
    (folder / "bad.json").write_text("{bad")
    (folder / "lines.jsonl").write_text('{bad\n{"a": 1, "b": "x"}\n[1]\n3\nnull\n{oops}\n')
    assert [tuple(r) for r in readers.read_json_dir(spark, str(folder), schema).collect()] == [(1, "x")]
    (folder / "one.json").write_text('{"a": 2,\n "b": null}')
    (folder / "many.json").write_text('[{"a": 3}, {"a": 4, "b": "y"}, 5]')
    found = {tuple(r) for r in readers.read_json_dir(spark, str(folder), schema).collect()}
    assert found == {(1, "x"), (2, None), (3, None), (4, "y")}


def test_log_lines_keep_file_order(spark, tmp_path):
    for name, n in (("a.log", 5000), ("b.log", 3)):
        (tmp_path / name).write_text("".join(f"{name} line {i}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        out = readers.read_log_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(out) == 5003
    assert all(r["line"].endswith(f" line {r['line_number']}") for r in out)


def test_binaries_join_by_relative_path(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.bin").write_bytes(b"\x00\x01")
    table = spark.createDataFrame([("sub/x.bin",), ("sub/none.bin",)], "path string")
    out = readers.join_binaries(table, "path", str(tmp_path)).collect()
    assert [(r["path"], bytes(r["content"])) for r in out] == [("sub/x.bin", b"\x00\x01")]


def test_empty_splits_write_nothing_and_preview(spark, tmp_path):
    df = spark.createDataFrame([(1, "train")], "id int, split string")
    writers.write_splits(df, str(tmp_path / "out"))
    assert readers.read_split(spark, str(tmp_path / "out"), "test").count() == 0
    assert writers.preview(df, 0, ["id"]).count() == 0
    assert writers.preview(df, 5, ["id"]).first()["json"] == '{"id":1,"split":"train"}'


def test_random_text_is_full_length(spark):
    rows = synthetic.long_conversations(spark.range(20), "id", characters=500).collect()
    assert len(rows) == 40 and {len(r["content"]) for r in rows} == {500}
    letters = set("".join(r["content"] for r in rows))
    assert len(letters) == 63 and "/" not in letters and "+" not in letters
    assert len({r["content"] for r in rows}) == 40


LOG = """Benchmark Banana
itern_num: 2000
real\t0m1.500s
terminate called
what(): negative dimension
real\t0m2s
noise
terminate called
noise
real\t0m3s
Benchmark Truck
real\t1m0.25s
""".splitlines()


def test_sections(spark):
    df = spark.createDataFrame(list(enumerate(LOG)), "n int, line string")
    value = duration_seconds(F.element_at(F.split("line", "\t"), -1))
    timings = B.section_timings(df, ["n"], "line", value)
    found = sorted((r["section"], r["cell"], r["seconds"], r["status"]) for r in timings.collect())
    assert found == [(1, 0, 1.5, "ok"), (1, 1, 2.0, "overflow"), (1, 2, 3.0, "error"), (2, 0, 60.25, "ok")]
    table = {r["header"]: r for r in B.section_table(timings, (4,)).collect()}
    assert table["Benchmark Banana"]["cell_1"] == "**Memory overflow**"
    assert table["Benchmark Truck"]["cell_1"] == "N/A"


def brute_sections(log):
    out, section, header, cell, before = [], 0, None, 0, None
    for i, line in enumerate(log):
        if line.startswith("Benchmark Truck"):
            section, header, cell, before = section + 1, line, 0, "header"
        elif "terminate" in line:
            before = "overflow" if i + 1 < len(log) and "negative dimension" in log[i + 1] else "error"
        elif line.startswith("real\t"):
            if section:
                out.append((section, header, cell, float(line.split("\t")[1]), before if before in ("overflow", "error") else "ok"))
            cell, before = cell + 1, "time"
        elif line.startswith("iter_num:"):
            before = "other"
    return sorted(out)


@pytest.mark.parametrize("block_rows", [1, 3, 1 << 16])
def test_sections_cross_blocks(spark, block_rows):
    draw = random.Random(block_rows)
    kinds = ["Benchmark Truck", "terminate called", "what(): negative dimension", "noise", "iter_num: 3", "real\t"]
    log = draw.choices(kinds, weights=[1, 4, 3, 2, 2, 8], k=400)
    log = [f"{line} {i}" if line.startswith("Bench") else f"{line}{i}" if line == "real\t" else line for i, line in enumerate(log)]
    df = spark.createDataFrame(list(enumerate(log)), "n int, line string").repartition(7)
    seconds = F.element_at(F.split("line", "\t"), -1).cast("double")
    found = B.section_timings(df, ["n"], "line", seconds, block_rows=block_rows)
    assert sorted(map(tuple, found.collect())) == brute_sections(log)


def test_sections_are_one_scan_without_a_self_join(spark, monkeypatch):
    from lathework.operators import ordering

    written = []
    monkeypatch.setattr(ordering, "materialize", lambda df, label="table": written.append(label) or df)
    df = spark.createDataFrame(list(enumerate(LOG)), "n int, line string")
    B.section_timings(df, ["n"], "line", F.lit(1.0)).explain()
    assert written == ["ordered"]


def test_log_means_and_rates(spark):
    line = "throughput per GPU (TFLOP/s/GPU): 1.5 | elapsed time per iteration (ms): 20 | mem usages: 0.5 |"
    df = spark.createDataFrame([("r", line), ("r", "nothing"), ("r", line.replace("1.5", "2.5"))], "run string, line string")
    patterns = {"tflops": r"throughput per GPU \(TFLOP/s/GPU\): ([0-9.]+)"}
    assert tuple(B.log_means(df, "line", patterns, ["run"]).first()) == ("r", "tflops", 2.0, 2)
    rates = [B.tokens_per_gpu(F.lit(2), F.lit(100), F.lit(ms).cast("double"), F.lit(4)) for ms in (50.0, 0.0, None, float("nan"))]
    assert list(spark.range(1).select(*rates).first()) == [1000.0, None, None, None]


def test_missing_ranks_drop_a_scene(spark):
    df = spark.createDataFrame([("a", r, 1.0) for r in range(4)] + [("b", r, 1.0) for r in range(3)], "s string, r int, m double")
    assert {r["s"] for r in B.complete_groups(df, ["s"], "r", 4).collect()} == {"a"}


def test_markdown(spark):
    df = spark.createDataFrame([("x", None, 1.5)], "a string, b string, c double")
    assert df.select(B.markdown_rows(df, df.columns)).first()[0] == "| x | N/A | 1.5 |"
    assert B.markdown_head(["a", "b"]) == ["| a | b |", "|-------|-------|"]


def test_scenario_columns(spark):
    df = spark.createDataFrame([("m", "=4", "1")], "`model` string, `size` string, `export FLAG` string")
    arguments, environment = records.environment_map(df.columns)
    assert arguments == ["model", "size"]
    row = df.select(environment, records.command_line("t.py", arguments, F.lit("o.json"))).first()
    assert tuple(row) == ({"FLAG": "1"}, "python t.py --model m --size=4 --output-json o.json")


def test_checkpoints_compare_as_numbers(spark):
    names = ["checkpoint_9", "checkpoint_10", "checkpoint_11_tmp", "other"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert tuple(records.latest_checkpoint(df, "name").first()) == ("checkpoint_10", 10)


def test_assays_and_lengths(spark):
    df = spark.createDataFrame([("<5", "IC50"), ("7.5", "IC50"), ("x", "IC50"), ("1200", "IC50"), ("3", "Kd")], "`exp (nM)` string, m string")
    out = records.clean_assays(df.withColumn("id", F.lit(1)), "exp (nM)", "m", ["EC50", "Kd"], 1000, "IC50").collect()
    assert [r["IC50"] for r in out] == [7.5]
    text = spark.createDataFrame([("a b c",), ("a",)], "t string")
    assert records.limit_length(text, "t", "filter", 2).count() == 1
    assert {tuple(r["tokens"]) for r in records.limit_length(text, "t", "truncate", 2).collect()} == {("a", "b"), ("a",)}
    with pytest.raises(ValueError):
        records.limit_length(text, "t", "pad")


def test_dice_of_empty_labels_is_zero(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 0), ("b", 0, 0), ("c", 1, 0)], "k string, p int, l int")
    assert {r["k"]: r["dice"] for r in G.dice(df, ["k"], "p", "l").collect()} == {"a": pytest.approx(2 / 3), "b": 0.0, "c": 0.0}


def test_value_range(spark):
    df = spark.createDataFrame([(i, "v", float(i)) for i in range(101)] + [(200, "v", float("nan"))], "i int, k string, x double")
    assert tuple(G.value_range(df, "x", ["k"], ["i"], robust=True).first()) == ("v", pytest.approx(2.0), pytest.approx(98.0))
    assert tuple(G.value_range(df, "x", ["k"], ["i"], center=20.0).first()) == ("v", -60.0, 100.0)


def test_status_takes_the_last_update_before_and_after_compaction(spark, tmp_path):
    data = tmp_path / "in"
    batches = [[(1, 1, "new"), (2, 1, "new")], [(1, 3, "done"), (1, 2, "busy")], [(2, 5, "busy"), (3, 1, "new")]]
    for batch in batches:
        spark.createDataFrame(batch, "id int, at int, status string").coalesce(1).write.mode("append").parquet(str(data))
    schema = spark.read.parquet(str(data)).schema
    stream = S.read_stream(spark, str(data), schema, files_per_batch=1)
    out = str(tmp_path / "out")
    S.publish_batches(stream, S.append_status(out, "id", ["at"]), str(tmp_path / "cp")).awaitTermination()
    expected = {(1, "done"), (2, "busy"), (3, "new")}
    for upto in (None, 0, 1, 2):
        if upto is not None:
            S.compact_status(spark, out, schema, "id", ["at"], upto)
        assert {(r["id"], r["status"]) for r in S.current_status(spark, out, schema, "id", ["at"]).collect()} == expected


def test_zipped_lines_are_counted_while_they_are_written(spark):
    left = spark.range(0, 1000, 1, 7).withColumnRenamed("id", "n")
    right = spark.range(0, 990, 1, 5).withColumnRenamed("id", "m")
    with pytest.warns(UserWarning, match="1000 rows against 990"):
        zipped, counts = records.zip_lines_counted(left, right, ["n"], ["m"])
    assert counts == {"left": 1000, "right": 990, "paired": 990, "cut": 10}
    assert zipped.count() == 990 and zipped.where("n <> m or n <> line_number").count() == 0


def test_files_of_other_kinds_are_refused_and_bad_records_counted(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{bad\n[2]\n{"a": 3}\n')
    (tmp_path / "b.json").write_text('[{"a": 4}, 5, {"a": 6}]')
    (tmp_path / "c.json").write_text('{\n "a": 7\n}')
    (tmp_path / "d.json").write_text("{broken")
    (tmp_path / "_SUCCESS").write_text("")
    seen = Observation()
    rows = readers.read_json_dir(spark, str(tmp_path), "a int", refuse=[".json", ".jsonl"], seen=seen).collect()
    assert sorted(r["a"] for r in rows) == [1, 3, 4, 6, 7]
    assert seen.get == {"records": 9, "bad": 4}
    (tmp_path / "e.pdf").write_bytes(b"%PDF")
    with pytest.raises(ValueError, match="e.pdf"):
        readers.read_json_dir(spark, str(tmp_path), "a int", refuse=[".json", ".jsonl"])
    with pytest.raises(ValueError, match="5 files"):
        readers.read_documents(spark, str(tmp_path))


def test_a_run_keeps_its_settings_and_prompts(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5)], "id int, score double")
    for run, depth in (("a", 1), ("b", 2), ("a", 3)):
        writers.write_run(rows, rows, str(tmp_path), run, {"depth": depth, "name": "é\n", "none": None}, {"q": "Ask {x}\nnow"})
    found = {(r["run_id"], r["kind"], r["name"]): r["value"] for r in writers.read_run_records(spark, str(tmp_path)).collect()}
    assert found["a", "config", "depth"] == "3" and found["b", "config", "depth"] == "2"
    assert found["a", "config", "name"] == "é\n" and found["a", "config", "none"] is None
    assert found["b", "prompt", "q"] == "Ask {x}\nnow" and len(found) == 8


def test_files_settle_with_age(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(b"x")
    now = F.current_timestamp()
    assert S.settled_files(spark, str(tmp_path), now).count() == 0
    assert S.settled_files(spark, str(tmp_path), now + F.expr("INTERVAL 2 MINUTES")).count() == 1


def test_a_failed_run_is_published_by_the_next(spark, tmp_path):
    """Run 1 dies after its rows and before its ledger; run 2 publishes its files and the new one, each row once."""
    source, out = tmp_path / "in", str(tmp_path / "out")
    later = datetime.now(timezone.utc) + timedelta(hours=1)

    def arrive(n):
        spark.createDataFrame([(n, f"v{n}")], "id int, v string").coalesce(1).write.mode("append").parquet(str(source))

    arrive(0)
    schema = spark.read.parquet(str(source)).schema
    assert S.published(spark, out, schema).count() == 0
    S.publish_settled(spark, str(source), schema, out, 0, later)
    arrive(1)
    S.publish_settled(spark, str(source), schema, out, 1, later)
    (tmp_path / "out" / "_ledger" / "run_id=1" / "_SUCCESS").unlink()
    assert {r["id"] for r in S.published(spark, out, schema).collect()} == {0}
    arrive(2)
    for _ in range(2):  # a repeated run changes nothing
        S.publish_settled(spark, str(source), schema, out, 2, later)
        assert sorted((r["id"], r["run_id"]) for r in S.published(spark, out, schema).collect()) == [(0, 0), (1, 2), (2, 2)]
        assert S.ledger(spark, out).count() == 3
    S.publish_settled(spark, str(source), schema, out, 3, later)
    assert S.published(spark, out, schema).count() == 3 and S.latest_run(spark, out).first()[0] == 3


def test_a_run_reads_the_ledger_and_no_published_rows(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "id int, v string").write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    later = datetime.now(timezone.utc) + timedelta(hours=1)
    S.publish_settled(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), 0, later)
    files = S.ledger(spark, str(tmp_path / "out")).inputFiles()
    assert files and all("/_ledger/" in f for f in files)


def test_texts_come_back_whole_from_a_folder_for_each_task(spark, tmp_path):
    rows = [(1, "a\n\nb"), (2, ""), (3, "Ünï 🙂\r\n"), (4, None), (1, "a\n\nb")]
    df = spark.createDataFrame(rows, "id int, t string").repartition(3)
    writers.write_texts(df, str(tmp_path / "texts"), "t")
    found = sorted(r["text"] for r in readers.read_documents(spark, str(tmp_path / "texts"), recursive=True).collect())
    assert found == sorted((t or "") + "\n" for _, t in rows)
    assert all(f.suffix == ".txt" for f in tmp_path.glob("texts/*/[!.]*"))
    nested = tmp_path / "texts" / "more"
    nested.mkdir()
    (nested / "x.pdf").write_bytes(b"%PDF")
    with pytest.raises(ValueError, match="1 files .* x.pdf"):
        readers.read_documents(spark, str(tmp_path / "texts"), recursive=True)


def test_the_driver_holds_no_names_of_documents(spark, tmp_path):
    """Files are listed and opened by tasks; paths are shown as Spark shows them, hidden and empty files are left out."""
    for folder in ("a/b c", "_x=1", "_h", ".q", "d.txt"):
        (tmp_path / folder).mkdir(parents=True)
    fit = ["1.txt", "a b.txt", "é#%41.txt", "_a=b.txt", "a/x.txt", "a/b c/[y].txt", "_x=1/z.txt", "d.txt/i.txt"]
    for name in [*fit, "_z.txt", ".h.txt", "_h/n.txt", ".q/n.txt", "_p.pdf", "_x=1/q.pdf"]:
        (tmp_path / name).write_bytes(f"text of {name}\r\n".encode() + b"\xff")
    (tmp_path / "empty.txt").write_bytes(b"")
    found = readers.read_documents(spark, str(tmp_path), recursive=True)
    assert not [name for name in found.inputFiles() if name.endswith(".txt")]
    listed = spark.read.option("pathGlobFilter", "*.txt").option("recursiveFileLookup", True).text(str(tmp_path), wholetext=True)
    wanted = sorted((r["p"], bytes(r["t"])) for r in listed.select(F.col("_metadata.file_path").alias("p"), F.col("value").cast("binary").alias("t")).collect())
    assert sorted((r["path"], bytes(r["t"])) for r in found.select("path", F.col("text").cast("binary").alias("t")).collect()) == wanted
    assert [t for _, t in wanted] and sorted(t for _, t in wanted) == sorted(f"text of {name}\r\n".encode() + b"\xff" for name in fit)
    none = tmp_path / "a" / "none"
    none.mkdir()
    assert readers.read_documents(spark, str(none)).count() == 0
    assert readers.read_documents(spark, str(tmp_path / "1.txt")).count() == 1
    for recursive in (False, True):
        with pytest.raises(AnalysisException):
            readers.read_documents(spark, str(tmp_path / "missing"), recursive)
    with pytest.raises(ValueError, match="2 files .* b c, none"):
        readers.read_documents(spark, str(tmp_path / "a"))


def test_names_of_fitting_files_stay_in_the_jvm(spark, tmp_path, monkeypatch):
    for n in range(3):
        (tmp_path / f"{n}.txt").write_text("x")
    listed = []
    monkeypatch.setattr(readers, "_name", lambda status: listed.append(1) or status.getPath().getName())
    readers.refuse_other_kinds(spark, str(tmp_path), [".txt"])
    assert not listed
    (tmp_path / "a+b.pdf").write_text("x")
    readers.refuse_other_kinds(spark, str(tmp_path), [".txt", "+b.pdf"])
    assert not listed
    with pytest.raises(ValueError, match="a.b.pdf"):
        readers.refuse_other_kinds(spark, str(tmp_path), [".txt"])


def test_random_texts_are_made_a_few_at_a_time(spark):
    """As Arrow batches; the text is that of the digests, one by one."""
    import base64
    import hashlib

    def plain(key, characters):
        drawn = "".join(base64.b64encode(hashlib.md5(f"{key}:{b}".encode()).digest())[:21].decode() for b in range(100))
        return drawn.replace("+", " ").replace("/", "")[:characters]

    keys = spark.createDataFrame([("a",), ("é",)], "k string")
    made = keys.select("k", synthetic.random_text(F.col("k"), 700).alias("t"))
    assert {r["k"]: r["t"] for r in made.collect()} == {k: plain(k, 700) for k in ("a", "é")}
    assert "ArrowEvalPython" in made._jdf.queryExecution().toString()
