from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lectern.sources import files, recognisers, reports, sinks
from lectern.streaming import upsert


@pytest.fixture
def tree(tmp_path):
    for name in ("train/1/2/10.jpg", "train/1/2/2.jpg", "val/1/3/1.PNG", "val/1/3/1.test.png", "val/1/3/2.after.png", "val/1/3/note.txt"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x")
    return str(tmp_path)


def names(df):
    return [r["relative"] for r in df.collect()]


def test_image_discovery(spark, tree):
    assert names(files.find_images(spark, tree)) == ["train/1/2/2.jpg", "train/1/2/10.jpg", "val/1/3/1.PNG"]
    assert names(files.find_images(spark, tree, limit=1)) == ["train/1/2/2.jpg"]
    assert len(names(files.find_images(spark, tree, files.RECOGNISER_IMAGES, derived=True))) == 5
    assert names(files.find_pngs(spark, tree)) == ["val/1/3/1.PNG", "val/1/3/2.after.png"]
    assert names(files.find_pngs(spark, tree, any_case=False)) == ["val/1/3/2.after.png"]
    found = files.find_images(spark, tree)
    assert files.page_folders(found).count() == 2
    assert files.page_range(found, 2, 3).count() == 3
    with pytest.raises(ValueError, match="4"):
        files.page_range(found, 2, 4)


def test_lines_and_logs(spark, tmp_path):
    log = tmp_path / "a/raw/results.jsonl"
    log.parent.mkdir(parents=True)
    log.write_text('{"input_path": "t/1/2/3.png", "status": "ok"}\n\n{bad\n', encoding="utf-8")
    got = files.read_log(spark, str(log)).orderBy("pos").collect()
    assert [(r["pos"], r["malformed"]) for r in got] == [(1, False), (3, True)]
    row = files.read_configurations(spark, str(tmp_path)).where("not malformed").first()
    assert (row["configuration"], row["model"], row["run"], row["record"]["status"]) == ("a/raw", "a", "raw", "ok")


def test_logs_of_several_splits(spark, tmp_path):
    """Every line has its own number whatever splits a file is read in, and the last attempt wins."""
    from lectern.operators import logs

    want = {}
    for name, n in (("one run", 3_000), ("b+c", 700), ("d", 1)):
        (tmp_path / name / "raw").mkdir(parents=True)
        lines = ["" if k % 50 == 7 else json.dumps({"input_path": f"s/1/2/{k % 400}.png", "status": "ok", "text": f"t{k}" + "x" * (k % 90)}) for k in range(n)]
        (tmp_path / name / "raw/results.jsonl").write_text("\ufeff" * (n == 700) + "\n".join(lines) + "\n" * (n != 700), encoding="utf-8")
        want |= {(f"{name}/raw", k + 1): json.loads(line)["text"] for k, line in enumerate(lines) if line}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        spark.conf.set("spark.sql.files.openCostInBytes", "10")
        parsed = files.read_configurations(spark, str(tmp_path))
        assert parsed.rdd.getNumPartitions() > 1
        got = {(r["configuration"], r["pos"]): r["record"]["text"] for r in parsed.collect()}
        assert got == want
        rows = parsed.select("configuration", "pos", "record.*")
        last = {(r["configuration"], r["input_path"]): r["pos"] for r in logs.latest(rows, ["configuration", "input_path"]).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    by_key = {}
    for (name, pos), _ in want.items():
        key = (name, f"s/1/2/{(pos - 1) % 400}.png")
        by_key[key] = max(by_key.get(key, 0), pos)
    assert last == by_key


def test_small_tables(spark, tmp_path):
    (tmp_path / "v.txt").write_text("﻿one\ntwo\n", encoding="utf-8")
    assert [tuple(r) for r in files.read_vocabulary(spark, str(tmp_path / "v.txt")).orderBy("vocab_id").collect()] == [(1, "one"), (2, "two")]
    (tmp_path / "e.txt").write_text("one\n\ntwo\n", encoding="utf-8")
    with pytest.raises(ValueError):
        files.read_vocabulary(spark, str(tmp_path / "e.txt"))
    (tmp_path / "train.txt").write_text("a/1.jpg x y\na/2.jpg z\n", encoding="utf-8")
    assert {tuple(r) for r in files.read_split_manifest(spark, str(tmp_path / "train.txt")).collect()} == {("a/1.jpg", "x y"), ("a/2.jpg", "z")}
    (tmp_path / "twice.txt").write_text("a x\na y\n", encoding="utf-8")
    with pytest.raises(ValueError):
        files.read_split_manifest(spark, str(tmp_path / "twice.txt"))
    (tmp_path / "m.tsv").write_text("image_path\tvocab_id\tlabel\np\t1\tw\n", encoding="utf-8")
    assert files.read_mapping(spark, str(tmp_path / "m.tsv")).count() == 1
    (tmp_path / "n.tsv").write_text("image_path\tlabel\np\tw\n", encoding="utf-8")
    with pytest.raises(ValueError):
        files.read_mapping(spark, str(tmp_path / "n.tsv"))
    (tmp_path / "inv.csv").write_text("image_path,other\n/a/sample_set/t/1/2/3.jpg,x\nbroken.jpg,y\n", encoding="utf-8")
    assert files.read_inventory(spark, str(tmp_path / "inv.csv")).count() == 1


def test_page_keys(tmp_path):
    (tmp_path / "k.json").write_text('{"page_keys": ["b", "a", "b", " "]}')
    (tmp_path / "l.json").write_text('["a"]')
    (tmp_path / "k.csv").write_text("page_key,x\n# no\nb,1\na\nb\n\n")
    assert files.read_page_keys(str(tmp_path / "k.json")) == ["b", "a"]
    assert files.read_page_keys(str(tmp_path / "l.json")) == ["a"]
    assert files.read_page_keys(str(tmp_path / "k.csv")) == ["b", "a"]


def test_responses_skip_broken_files(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps({"page_key": "p", "status": "ok"}))
    (tmp_path / "2.json").write_text("{oops")
    assert [r["page_key"] for r in files.read_responses(spark, str(tmp_path), "page_key string, status string").collect()] == ["p"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("p", None, ["a"], True)], "k string, v double, xs array<string>, b boolean")
    sinks.write_csv(rows, str(tmp_path / "csv"), one_file=True)
    text = next((tmp_path / "csv").glob("part-*")).read_text()
    assert text.splitlines()[0] == "k,v,xs,b" and text.splitlines()[1].startswith("p,,") and text.splitlines()[1].endswith("true")
    sinks.write_json(str(tmp_path / "s/x.json"), {"é": 1})
    assert json.loads((tmp_path / "s/x.json").read_text()) == {"é": 1} and list((tmp_path / "s").iterdir()) == [tmp_path / "s/x.json"]
    for _ in range(2):
        sinks.append_jsonl(rows, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    sinks.rebuild_jsonl(rows, str(tmp_path / "log"), ["k"])
    assert spark.read.json(str(tmp_path / "log")).count() == 1
    sinks.write_tsv(rows.select("k"), str(tmp_path / "tsv"))
    sinks.write_by_page(rows.withColumn("page_key", F.lit("q")), str(tmp_path / "pages"))
    assert (tmp_path / "pages/page_key=q").is_dir()
    sinks.write_texts(spark.createDataFrame([("a/1.txt", None), ("a/2.txt", "t")], "relative string, text string"), str(tmp_path / "texts"))
    assert (tmp_path / "texts/a/1.txt").read_text() == "\n"
    sinks.write_report(str(tmp_path / "report.txt"), spark.createDataFrame([("c1", 1), ("c2", None)], "configuration string, n int").orderBy("configuration"), ["configuration", "n"], ["c3: broken"])
    lines = spark.createDataFrame(list(enumerate((tmp_path / "report.txt").read_text().split("\n"))), "pos int, value string")
    assert {tuple(r) for r in reports.parse_report(lines, ["configuration", "n"]).collect()} == {("c1", "1"), ("c2", "")}


def test_recognisers_isolate_failures(spark):
    pages = spark.createDataFrame([("p",), ("q",)], "page_key string")
    out = {r["page_key"]: r for r in recognisers.apply(pages, recognisers.recorded({"p": {"text": "t"}}), "text string").collect()}
    assert (out["p"]["status"], out["p"]["text"]) == ("ok", "t")
    assert out["q"]["status"] == "error" and out["q"]["error"].startswith("KeyError") and out["q"]["text"] is None


def test_stream_keeps_the_latest(spark, tmp_path):
    source, table, checkpoint = (str(tmp_path / n) for n in ("in", "table", "check"))
    schema = "key long, pos long, status string"
    first = [(1, 1, "ok"), (2, 2, "error")]
    second = [(1, 5, "error"), (2, 1, "ok"), (3, 3, "ok"), (1, 5, "error")]
    for part in (first, second):
        spark.createDataFrame(part, schema).write.mode("append").parquet(source)
        upsert.keep_latest(spark.readStream.schema(schema).parquet(source), table, checkpoint, ["key"]).awaitTermination()
    from lectern.operators.logs import latest

    batch = latest(spark.read.parquet(source), ["key"])
    assert {tuple(r) for r in upsert.read_latest(spark, table).collect()} == {tuple(r) for r in batch.collect()} == {(1, 5, "error"), (2, 2, "error"), (3, 3, "ok")}


def test_batches_rewrite_their_own_buckets(spark, tmp_path):
    from lectern.operators.logs import latest

    source, table, checkpoint = (str(tmp_path / n) for n in ("in", "table", "check"))
    schema = "key long, pos long"
    parts = [[(k, k) for k in range(40)], [(3, 100)], [(3, 99), (3, 101)], [(3, 102), (41, 1)]]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        upsert.keep_latest(spark.readStream.schema(schema).parquet(source), table, checkpoint, ["key"], buckets=4).awaitTermination()
    want = {tuple(r) for r in latest(spark.read.parquet(source), ["key"]).collect()}
    assert {tuple(r) for r in upsert.read_latest(spark, table).collect()} == want and (3, 102) in want
    versions = upsert._versions(spark, table)
    assert sum(len(v) for v in versions.values()) < 4 * len(parts)  # untouched buckets stay
    of_three = [p for p in (tmp_path / "table/data").glob("_version=*/_bucket=*") if len(versions[int(p.name.split("=")[1])]) > 2]
    assert len(of_three) <= 2 * len([v for v in versions.values() if len(v) > 2])
