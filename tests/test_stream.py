import time
from pathlib import Path

from pyspark.sql import functions as F

from rowloom.plans.convert import Options, convert_batch
from rowloom.streaming.watch import arriving_files, watch_folder


def tables(spark, target, name):
    return spark.read.option("basePath", f"{target}/{name}").parquet(f"{target}/{name}")


def test_each_file_once_and_as_in_a_batch(spark, tmp_path):
    drop, target, state = tmp_path / "drop", str(tmp_path / "out"), str(tmp_path / "state")
    drop.mkdir()

    def run():
        watch_folder(spark, str(drop), target, state, Options(), available_now=True).awaitTermination()

    for i in range(3):
        (drop / f"f {i}%+.csv").write_text(f"id;preis\n{i};{i}.5\n")
    run()
    (drop / "late.TXT").write_text("a;b\n1;2\n")
    (drop / "bad.xlsx").write_bytes(b"nothing")
    (drop / "skip.pdf").write_bytes(b"x")
    (drop / "skip.log").write_text("a;b\n")
    run()
    run()
    report = tables(spark, target, "report").collect()
    assert sorted((r["path"].rsplit("/", 1)[1], r["status"]) for r in report) == [
        ("bad.xlsx", "failed"), ("f 0%+.csv", "ok"), ("f 1%+.csv", "ok"), ("f 2%+.csv", "ok"), ("late.TXT", "ok")]
    (drop / "skip.log").unlink()
    convert_batch(spark, str(drop), str(tmp_path / "batch"))
    batch = spark.read.parquet(str(tmp_path / "batch" / "cells" / "batch_id=0"))
    streamed = tables(spark, target, "cells").select(*batch.columns)
    assert streamed.exceptAll(batch).isEmpty() and batch.exceptAll(streamed).isEmpty()


def test_a_repeated_batch_replaces_its_output(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a;b\n1;2\n")
    for _ in range(2):
        convert_batch(spark, str(tmp_path / "a.csv"), str(tmp_path / "out"), batch_id=7, overwrite=True)
    assert tables(spark, str(tmp_path / "out"), "cells").count() == 4
    assert tables(spark, str(tmp_path / "out"), "report").count() == 1


def test_files_from_before_can_be_left_out(spark, tmp_path):
    (tmp_path / "old.csv").write_text("a\n")
    stream = arriving_files(spark, str(tmp_path), since="2999-01-01 00:00:00", settle=0)
    query = stream.writeStream.format("memory").queryName("arrivals").trigger(once=True).start()
    query.awaitTermination()
    assert spark.table("arrivals").count() == 0 and F is not None


def test_a_file_written_in_steps_is_converted_once_and_whole(spark, tmp_path):
    drop, target = tmp_path / "drop", str(tmp_path / "out")
    drop.mkdir()
    query = watch_folder(spark, str(drop), target, str(tmp_path / "state"), Options(header=False), settle=4)
    try:
        with open(drop / "slow.csv", "w") as file:
            for i in range(4):
                file.write(f"{i};x\n")
                file.flush()
                time.sleep(1.7)
        (drop / "_hidden.csv").write_text("h;1\n")
        (drop / "empty.csv").write_bytes(b"")
        (drop / "gone.csv").write_text("g;1\n")
        time.sleep(1)
        (drop / "gone.csv").unlink()
        deadline = time.time() + 90
        while time.time() < deadline and query.exception() is None:
            done = sorted(p.name for p in Path(target, "report").glob("batch_id=*")) if Path(target, "report").exists() else []
            if done and tables(spark, target, "report").count() >= 3:
                break
            time.sleep(1)
        time.sleep(4)
    finally:
        query.stop()
    assert query.exception() is None
    report = tables(spark, target, "report").collect()
    assert sorted((r["path"].rsplit("/", 1)[1], r["status"]) for r in report) == [
        ("_hidden.csv", "ok"), ("empty.csv", "ok"), ("slow.csv", "ok")]
    cells = tables(spark, target, "cells").filter("path like '%slow.csv'")
    assert sorted((r["row"], r["text"]) for r in cells.collect() if r["col"] == 0) == [(i + 1, str(i)) for i in range(4)]
