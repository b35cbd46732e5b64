"""Readers and writers on small files."""

import hashlib
import json

import pytest
from pyspark.errors import AnalysisException

from equiscreen.sources import readers, versions, writers
from equiscreen.streaming.market_stream import windowed_bars


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Symbol,Name\nA,Alpha\nB,Beta\nC,x,y\n", encoding="utf-8")
    df = readers.csv_text(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["Symbol", "Name"] and {tuple(r) for r in df.collect()} == {("A", "Alpha"), ("B", "Beta")}
    (tmp_path / "p.txt").write_text("Symbol|ETF\nA|N\nFile Creation Time: 1|\n")
    assert [tuple(r) for r in readers.pipe_directory(spark, str(tmp_path / "p.txt")).collect()] == [("A", "N")]
    (tmp_path / "x.csv").write_text("Title;;\nAs of;2024;\nISIN;Mnemonic;Type\nI1;AA;CS\nI2;BB;ETF\n")
    rows = readers.csv_with_preamble(spark, str(tmp_path / "x.csv"), words=["isin", "mnemonic"])
    assert rows.columns == ["ISIN", "Mnemonic", "Type"] and {tuple(r) for r in rows.collect()} == {("I1", "AA", "CS"), ("I2", "BB", "ETF")}
    assert readers.best_header(spark, str(tmp_path / "x.csv"), ["isin"]) == (2, ";")
    (tmp_path / "c.json").write_text(json.dumps({"fields": ["cik", "ticker"], "data": [["1", "A"], ["2", "B"]]}))
    assert {tuple(r) for r in readers.json_columns(spark, str(tmp_path / "c.json")).collect()} == {("1", "A"), ("2", "B")}
    (tmp_path / "m.json").write_text(json.dumps({"memos": [{"t": "A"}, {"t": "B"}]}))
    assert readers.json_records(spark, str(tmp_path / "m.json")).count() == 2
    assert [r["input_ordinal"] for r in readers.with_ordinal(df).orderBy("Symbol").collect()] == [1, 2]


def test_writers(spark, tmp_path):
    old = spark.createDataFrame([("A", 1, "old"), ("B", 2, "old")], "k string, v int, created string")
    new = spark.createDataFrame([("B", 3, "new"), ("C", 4, "new")], "k string, v int, created string")
    path = str(tmp_path / "t")
    writers.write_once(old, path)
    with pytest.raises(AnalysisException):
        writers.write_once(old, path)
    writers.save_cache(old, str(tmp_path / "cache"), name="x", date="2024-01-01")
    assert writers.load_cache(spark, str(tmp_path / "cache"), name="x").count() == 2
    assert readers.first_source(spark, str(tmp_path / "none"), path).count() == 2


def test_versions(spark, tmp_path):
    old = spark.createDataFrame([("A", 1, "old"), ("B", 2, "old")], "k string, v int, created string")
    new = spark.createDataFrame([("B", 3, "new"), ("C", 4, "new")], "k string, v int, created string")
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        versions.current(spark, path)
    assert versions.upsert(old, path, ["k"], "created") == 1
    first = versions.current(spark, path)
    assert versions.upsert(new, path, ["k"], "created") == 2
    after = {("A", 1, "old"), ("B", 3, "old"), ("C", 4, "new")}
    assert {tuple(r) for r in versions.current(spark, path).collect()} == after
    assert first.count() == 2 == versions.current(spark, path, 1).count()  # who reads the old version goes on reading it
    assert versions.update(spark, path, versions.F.col("k") == "A", v=9, created=None) == 3
    assert {tuple(r) for r in versions.current(spark, path).collect()} == {("A", 9, None), ("B", 3, "old"), ("C", 4, "new")}
    assert len(versions.expired(spark, path)) == 1


def test_a_job_killed_between_writes_leaves_the_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    versions.commit(spark.createDataFrame([("A", 1)], "k string, v int"), path)

    class Killed(Exception):
        pass

    def killed(*_, **__):
        raise Killed

    with monkeypatch.context() as m:  # after the data, before the commit
        m.setattr(versions.F, "current_timestamp", killed)
        with pytest.raises(Killed):
            versions.upsert(spark.createDataFrame([("A", 2)], "k string, v int"), path, ["k"])
    boom = spark.createDataFrame([("A", 3)], "k string, v int").selectExpr("k", "cast(raise_error('boom') as int) as v")
    with pytest.raises(Exception, match="boom"):  # while the data are written
        versions.upsert(boom, path, ["k"])
    assert [tuple(r) for r in versions.current(spark, path).collect()] == [("A", 1)]
    assert versions.upsert(spark.createDataFrame([("A", 4)], "k string, v int"), path, ["k"]) == 2
    assert [tuple(r) for r in versions.current(spark, path).collect()] == [("A", 4)]


def test_many_files_with_their_own_headers(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    want = set()
    for i in range(30):
        sep = ",;|\t"[i % 4]
        names = ["ISIN", "Mnemonic", "Type"][:: 1 if i % 3 else -1] + (["Note"] if i % 5 == 0 else [])
        rows = [{"ISIN": f"I{i}-{j}", "Mnemonic": f'"M{sep}{j}"', "Type": "CS", "Note": f"n{j}"} for j in range(40)]
        text = [f"Title {k}" for k in range(i % 7)] + [sep.join(names)] + [sep.join(r[n] for n in names) for r in rows] + ["short"]
        (folder / f"f{i:02}.csv").write_text("\n".join(text) + "\n")
        want |= {(f"f{i:02}.csv", r["ISIN"], r["Mnemonic"].strip('"'), "CS", r["Note"] if i % 5 == 0 else None) for r in rows}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "200")  # files in several splits
        df = readers.csv_with_preamble(spark, str(folder), words=["isin", "mnemonic"], file_column="file")
        assert {(r["file"].rpartition("/")[2], r["ISIN"], r["Mnemonic"], r["Type"], r["Note"]) for r in df.collect()} == want
        heads = readers.best_headers(readers.numbered_lines(spark, str(folder)), ["isin", "mnemonic"])
        assert {(r["file"].rpartition("/")[2], r["line"], r["sep"]) for r in heads.collect()} == {(f"f{i:02}.csv", i % 7, ",;|\t"[i % 4]) for i in range(30)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_named_and_given_headers(spark, tmp_path):
    (tmp_path / "n.csv").write_text("isin of what,x\nbats_name,isin,company_name\nB1,I1,C1\n")
    (tmp_path / "o.csv").write_text("bats,isin\nB2,I2\n")
    df = readers.csv_with_preamble(spark, str(tmp_path), header="named", words=["company_name", "bats_name", "isin"], lines=12)
    assert df.columns == ["bats_name", "isin", "company_name", "bats"] and {tuple(r) for r in df.collect()} == {("B1", "I1", "C1", None), (None, "I2", None, "B2")}
    given = readers.csv_with_preamble(spark, str(tmp_path / "n.csv"), header=1, sep=",")
    assert [tuple(r) for r in given.collect()] == [("B1", "I1", "C1")]


def test_manifest_hashes_large_files_in_pieces(spark, tmp_path):
    (tmp_path / "ABC_x.bin").write_bytes(b"x" * 1000)
    with (tmp_path / "BIG-1.bin").open("wb") as f:
        f.seek(20 << 20)
        f.write(b"end")
    found = {r["path"].rpartition("/")[2]: r for r in readers.file_manifest(spark, str(tmp_path), whole=1 << 20).collect()}
    for name, ticker in (("ABC_x.bin", "ABC"), ("BIG-1.bin", "BIG-1")):
        content = (tmp_path / name).read_bytes()
        assert (found[name]["size"], found[name]["sha256"], found[name]["ticker"]) == (len(content), hashlib.sha256(content).hexdigest(), ticker)


def test_stream(spark, tmp_path):
    spark.sql("select 'A' as ticker, timestamp'2024-01-01 01:00:00' as ts, 1e0 as close union all select 'A', timestamp'2024-01-01 02:00:00', 3e0").write.parquet(str(tmp_path / "bars"))
    bars = spark.readStream.schema("ticker string, ts timestamp, close double").parquet(str(tmp_path / "bars"))
    q = windowed_bars(bars).writeStream.outputMode("complete").format("memory").queryName("bars").start()
    q.processAllAvailable()
    q.stop()
    row = spark.sql("select * from bars").first()
    assert (row["n"], row["open"], row["close"], row["mean"]) == (2, 1.0, 3.0, 2.0)
