"""Writing to a service and following it as a stream."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from opsgraph.sources.paged import PagedSource


class Service:
    """Rows by key, in the order they came. The calls of `fails` fail after their work is done, as when an answer is lost; keys of `loses` are never taken."""

    def __init__(self, fails=(), loses=()):
        self.rows, self.runs, self.calls, self.fails, self.loses = {}, {}, [], set(fails), set(loses)
        service, lock = self, threading.Lock()

        class Handler(BaseHTTPRequestHandler):
            def told(self, code, answer, **headers):
                self.send_response(code)
                for k, v in headers.items():
                    self.send_header(k.replace("_", "-"), v)
                self.end_headers()
                self.wfile.write(json.dumps(answer).encode())

            def body(self):
                return json.loads(self.rfile.read(int(self.headers["Content-Length"])))

            def do_POST(self):
                asked = self.body()
                with lock:
                    service.calls.append(len(asked["records"]))
                    taken = [r for r in asked["records"] if r[asked["key"]] not in service.loses]
                    for r in taken:
                        service.rows[r[asked["key"]]] = r
                        service.runs[r[asked["key"]]] = asked["run"]
                    lost = len(service.calls) in service.fails
                self.told(500 if lost else 200, {"taken": len(taken)})

            def do_DELETE(self):
                run = self.body()["run"]
                with lock:
                    for k in [k for k, r in service.runs.items() if r == run]:
                        del service.rows[k], service.runs[k]
                self.told(200, {})

            def do_GET(self):
                q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
                a, n = int(q["sysparm_offset"]), int(q["sysparm_limit"])
                rows = list(service.rows.values())
                self.told(200, {"result": rows[a : a + n]}, X_Total_Count=str(len(rows)))

            def log_message(self, *a):
                pass

        self.server = HTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server.server_port}/table"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()


@pytest.fixture
def service(spark):
    made = []
    spark.dataSource.register(PagedSource)

    def start(**how):
        made.append(Service(**how))
        return made[-1]

    yield start
    for s in made:
        s.server.shutdown()


def written(df, service, **options):
    df.write.format("paged").options(url=service.url, key="event_id", page="50", **options).mode("append").save()


def test_events_written_are_read_back(spark, sf_dir, service):
    own = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id < 500").select("event_id", "event_type", "user_id")
    there = service(fails=(2, 5))  # the service has those pages, but its answers are lost
    written(own.repartition(3), there)
    assert len(there.rows) == own.count() and len(there.calls) >= 12
    kind = "event_id string, event_type string, user_id string"
    back = spark.read.format("paged").options(url=there.url, page="64").schema(kind).load()
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, own.select(*(F.col(c).cast("string") for c in own.columns)).collect()))
    written(own, there)
    assert len(there.rows) == own.count()


def test_a_write_that_falls_short_takes_its_rows_back(spark, service):
    there = service(loses={7})
    written(spark.range(5).select(F.col("id").alias("event_id")), there)
    with pytest.raises(Exception, match="1 of 20 rows"):
        written(spark.range(5, 25).select(F.col("id").alias("event_id")), there)
    assert sorted(there.rows) == [0, 1, 2, 3, 4]


def test_a_task_that_fails_takes_all_rows_back(spark, service):
    there = service(fails=range(3, 99))
    with pytest.raises(Exception, match="500"):
        written(spark.range(200).repartition(1).select(F.col("id").alias("event_id")), there, attempts="1")
    assert there.rows == {}


def test_rows_need_their_key_and_overwriting_is_refused(spark, service):
    there = service()
    with pytest.raises(Exception, match="no column event_id"):
        written(spark.range(3), there)
    with pytest.raises(Exception, match="append"):
        spark.range(3).write.format("paged").options(url=there.url, key="id").mode("overwrite").save()
    written(spark.range(0).select(F.col("id").alias("event_id")), there)
    assert there.rows == {}


def test_a_stream_goes_on_from_its_checkpoint(spark, service, tmp_path):
    there = service()
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "ck")

    def follow(fail=False):
        rows = spark.readStream.format("paged").options(url=there.url, page="10").schema("event_id string").load()

        def keep(batch, number):
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
            if fail:
                raise OSError("killed")

        spark_query = rows.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
        try:
            spark_query.processAllAvailable()
        finally:
            spark_query.stop()

    got = lambda: sorted(int(r.event_id) for r in spark.read.parquet(out).collect())
    written(spark.range(25).select(F.col("id").alias("event_id")), there)
    follow()
    assert got() == list(range(25))
    written(spark.range(25, 60).select(F.col("id").alias("event_id")), there)
    with pytest.raises(Exception, match="killed"):
        follow(fail=True)
    written(spark.range(60, 70).select(F.col("id").alias("event_id")), there)
    follow()
    follow()
    assert got() == list(range(70))
