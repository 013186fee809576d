"""Beacons over a server in this process, and recorded sessions."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from aleatory.sources import beacon, records


class Pulses:
    """A beacon whose chain grows when told; rounds in ``lost`` aren't there."""

    def __init__(self):
        self.last, self.lost, self.asked, self.fail = 5, set(), [], 0
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):  # noqa: N802
                name = self.path.rsplit("/", 1)[-1]
                number = outer.last if name == "latest" else int(name)
                outer.asked.append(name)
                if outer.fail:
                    outer.fail -= 1
                    return self.answer(500, {})
                if number > outer.last or number in outer.lost:
                    return self.answer(404, {})
                self.answer(200, {"pulse": {"pulseIndex": number, "outputValue": f"{number:064x}"}})

            def answer(self, code, body):
                data = json.dumps(body).encode()
                self.send_response(code)
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def log_message(self, *_):
                pass

        self.server = HTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def options(self, **more):
        at = f"http://127.0.0.1:{self.server.server_port}"
        return {"latest": f"{at}/latest", "round": at + "/pulse/{round}", "id": "pulse.pulseIndex", "path": "pulse.outputValue", "pause": "0.01", "source": "b", **more}


@pytest.fixture
def pulses():
    p = Pulses()
    yield p
    p.server.shutdown()


def test_the_last_rounds_of_a_chain(spark, pulses):
    beacon.register(spark)
    got = spark.read.format("beacon").options(**pulses.options(rounds="3", partitions="2")).load()
    assert sorted((r["source"], r["round"], r["bytes"].hex()) for r in got.collect()) == [("b", i, f"{i:064x}") for i in (3, 4, 5)]
    chunks = beacon.byte_chunks(got, 32, 3).orderBy("off").collect()
    assert [(r["off"], r["bytes"][-1]) for r in chunks] == [(0, 3), (32, 4), (64, 5)]
    pulses.fail = 2
    assert beacon.Client(pulses.options()).latest() == 5
    with pytest.raises(ValueError, match="insufficient_entropy"):
        beacon._BeaconReader(pulses.options(rounds="6")).partitions()
    with pytest.raises(ValueError, match="bad_response"):
        beacon.Client(pulses.options(id="pulse.none")).latest()
    with pytest.raises(ValueError, match="bad_response"):
        list(beacon.Client(pulses.options(round_bytes="16")).rows(1, 2))
    pulses.lost = {4}
    with pytest.raises(OSError):
        list(beacon.Client(pulses.options()).rows(3, 6))
    assert [r[1] for r in beacon.Client(pulses.options(missing="skip")).rows(3, 6)] == [3, 5]


def run_until(q, count, many, seconds=60):
    until = time.time() + seconds
    while time.time() < until and count() < many:
        time.sleep(0.2)
    q.processAllAvailable()
    q.stop()


def test_a_stream_has_each_round_once_over_restarts(spark, pulses, tmp_path):
    beacon.register(spark)

    def start():
        rounds = spark.readStream.format("beacon").options(**pulses.options(first="2", partitions="2")).load()
        return rounds.drop("at").writeStream.format("parquet").option("path", str(tmp_path / "rows")).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="100 milliseconds").start()

    count = lambda: spark.read.schema("source string, round long, bytes binary").parquet(str(tmp_path / "rows")).count() if (tmp_path / "rows").exists() else 0
    q = start()
    run_until(q, count, 4)
    pulses.last = 11  # nobody polls meanwhile
    asked = len(pulses.asked)
    q = start()
    run_until(q, count, 10)
    pulses.last = 12
    q = start()
    run_until(q, count, 11)
    got = spark.read.parquet(str(tmp_path / "rows")).collect()
    assert sorted(r["round"] for r in got) == list(range(2, 13)) and all(r["bytes"].hex() == f"{r['round']:064x}" for r in got)
    assert not {"2", "3", "4", "5"} & set(pulses.asked[asked:])


def test_records_round_trip_and_faults(spark, tmp_path):
    trials = spark.createDataFrame([(s, t, (t * 7) % 200) for s in "ab" for t in range(500)], "source string, t long, sum int")
    records.write_session(trials, str(tmp_path / "good"), 200)
    back = records.read_session(spark, str(tmp_path / "good"))
    assert back.where("error is not null").count() == 0
    assert back.select("source", F.col("t").cast("long"), F.col("sum").cast("int")).exceptAll(trials).count() == 0 and back.count() == 1000
    fine = '{"v":1,"t":%d,"source":"a","sum":9,"bitsPerTrial":200}'
    lines = [fine % 1, "", "{", "[1]", fine.replace('"v":1', '"v":2') % 1, fine.replace("%d", '"x"'), fine.replace('"a"', '""') % 1, fine.replace('"a"', "5") % 1, fine.replace("200", "7") % 1, fine.replace(":9", ":201") % 1, fine.replace(":9", ":1.5") % 1, fine.replace(":9", ":-1") % 1, "  ", fine.replace("200", "300") % 1, fine % 2, "7", fine.replace(":9", ':"9"') % 1]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "one.jsonl").write_text("\n".join(lines) + "\n")
    got = {r["line"]: r["error"] for r in records.read_session(spark, str(tmp_path / "bad")).collect()}
    want = [None, "", "not JSON", "not JSON", "version", "timestamp", "source", "source", "bitsPerTrial", "sum", "sum", "sum", "", "changes bitsPerTrial", None, "not JSON", "sum"]
    assert got == {i + 1: w for i, w in enumerate(want) if w != ""}


def test_lines_are_numbered_over_splits(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, n in (("x", 5000), ("y", 3), ("z", 0)):
        (tmp_path / "in" / name).write_text("".join(f"{i}\n" for i in range(1, n + 1)))
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = records.numbered_lines(spark, str(tmp_path / "in"))
        assert got.where(F.col("line") != F.col("value").cast("long")).count() == 0 and got.count() == 5003
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)


def test_a_failed_task_leaves_no_lines(spark, tmp_path):
    good = spark.createDataFrame([("a", t, 1) for t in range(50)], "source string, t long, sum int")
    records.write_session(good, str(tmp_path / "out"), 200)
    broken = good.withColumn("sum", F.when(F.col("t") == 49, F.raise_error(F.lit("broken")).cast("int")).otherwise(F.col("sum")))
    with pytest.raises(Exception, match="broken"):
        records.write_session(broken, str(tmp_path / "out"), 200)
    assert records.read_session(spark, str(tmp_path / "out")).count() == 50


def test_a_recorded_stream_has_each_line_once(spark, tmp_path):
    trials = spark.createDataFrame([("a", t, t % 9) for t in range(100)], "source string, t long, sum int")
    trials.where("t < 60").write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema(trials.schema).parquet(str(tmp_path / "in"))
        records.record_stream(stream, str(tmp_path / "out"), 200, str(tmp_path / "state"), True).awaitTermination()
        trials.where("t >= 60").write.mode("append").parquet(str(tmp_path / "in")) if _ == 0 else None
    got = records.read_session(spark, str(tmp_path / "out"))
    assert got.where("error is null").count() == 100 == got.select("t").distinct().count()
