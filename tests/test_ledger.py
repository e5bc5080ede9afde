"""Ledger fold, files, transactions and timers: against a walk event by event, plain file reads, and kills between steps."""

from __future__ import annotations

import json
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import ledger_fold
from tessera.sources import ledger, ledger_source, transaction_sink, transactions
from tessera.streaming import fold as streamed
from tessera.streaming import timers
from tests.ledger_walk import Walk, broken, history


def events(spark, runs):
    return spark.createDataFrame([(run, seq, kind, json.dumps(p)) for run, told in runs.items() for seq, kind, p in told], ledger_fold.EVENT)


def numbered(told):
    return [(n + 1, k, p) for n, (k, p) in enumerate(told)]


@pytest.mark.parametrize(("seed", "chunk"), [(1, 5), (2, 1 << 16)])
def test_fold_equals_walk(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(ledger_fold, "CHUNK", chunk)
    rng = random.Random(seed)
    runs = {"whole": numbered(history())} | {f"b{n}": broken(rng) for n in range(250)} | {None: numbered(history())[:9]}
    got = {r["run_id"]: tuple(r)[1:] for r in ledger_fold.fold(events(spark, runs).repartition(3)).collect()}
    want = {run: Walk().walk(told).row() for run, told in runs.items()}
    assert got == want
    assert len({k for _, k, _ in runs["whole"]}) == 26 and got["whole"] == (66, "completed", 1, 2, 3, 1, 1, 1, 3, 1, 1, None, None)
    assert len({w[-2] for w in want.values()}) > 35


#: A change of the whole history at an event, and the code: one rule that no other case reaches.
CASES = [
    ("run_created", 0, {"run": {"runId": "run", "executionEpoch": 1, "state": "created"}}, "initial-epoch"), ("run_created", 0, {"run": {"runId": "run", "executionEpoch": 0, "state": "planning"}}, "initial-run-state"),
    ("lock_recovered", 0, ("run_created", {"run": {"runId": "run2", "executionEpoch": 0, "state": "created"}}), "duplicate-run"), ("lock_recovered", 0, ("no_such_event", {}), "unknown-type"),
    ("lock_recovered", 0, ("run_completed", {"revisionId": "v1"}), "run-completion-state"), ("budget_amended", 0, ("state_changed", {"from": "planning", "to": "completed"}), "completion-event-required"),
    ("budget_amended", 0, ("state_changed", {"from": "planning", "to": "failed", "blocker": None}), "run-transition"), ("cancel_requested", 0, {"executionEpoch": 3, "reason": "user-pause"}, "cancel-epoch"),
    ("resume_epoch_started", 0, ("cancel_requested", {"executionEpoch": 0, "reason": "user-pause"}), "duplicate-cancel"), ("cancel_requested", 0, ("state_changed", {"from": "paused", "to": "recovering"}), "resume-transition"),
    ("run_completed", 0, {"revisionId": "v2"}, "revision-not-committed"), ("records_committed", 0, {"transactionId": "t2", "sourceResultSeq": 1}, "transaction-not-found")]


def test_fold_of_single_rules(spark):
    whole, runs = history(), {}
    for n, (kind, nth, change, _) in enumerate(CASES):
        at = [i for i, (k, _) in enumerate(whole) if k == kind][nth]
        runs[f"c{n}"] = numbered([*whole[:at], change if isinstance(change, tuple) else (kind, change), *whole[at + 1 :]])
    runs["abandoned"] = numbered([(k, p | {"reason": "user-abandon"} if k == "cancel_requested" else p) for k, p in whole])
    got = {r["run_id"]: (r["error"], r["error_seq"]) for r in ledger_fold.fold(events(spark, runs)).collect()}
    for n, (_, _, _, code) in enumerate(CASES):
        assert got[f"c{n}"][0] == f"reducer.{code}", (n, code, got[f"c{n}"])
    assert {run: (w[-2], w[-1]) for run, told in runs.items() for w in [Walk().walk(told).row()]} == got
    assert got["abandoned"][0] == "reducer.resume-terminal-cancel"
    bad = spark.createDataFrame([("x", 1, "run_created", None), ("y", 1, "run_created", "no json"), ("z", 2, "lock_recovered", "{}")], ledger_fold.EVENT)
    assert {r["run_id"]: (r["error"], r["error_seq"], r["seq"]) for r in ledger_fold.fold(bad).collect()} == {
        "x": ("reducer.payload", 1, 0), "y": ("reducer.payload", 1, 0), "z": ("reducer.sequence", 2, 0)}
    assert ledger_fold.fold(spark.createDataFrame([], ledger_fold.EVENT)).count() == 0


def test_fold_of_one_long_run_is_many_tasks(spark, monkeypatch):
    """One run in small chunks: no window or group holds more than a chunk's share of it."""
    monkeypatch.setattr(ledger_fold, "CHUNK", 64)
    told = [("run_created", {"run": {"runId": "run", "executionEpoch": 0, "state": "created"}})] + [("identity_reserved", {"kind": "request", "id": f"r{i}"}) for i in range(3000)] + [("identity_reserved", {"kind": "request", "id": "r7"})]
    rows = events(spark, {"one": numbered(told)})
    seen = ledger_fold.with_run(ledger_fold.parsed(rows))
    sizes = seen.groupBy(F.floor(F.col("seq") / 64)).count().agg(F.max("count")).first()[0]
    assert sizes <= 64 and "PartitionBy" not in seen._jdf.queryExecution().toString()
    r = ledger_fold.fold(rows).first()
    assert (r["seq"], r["error"], r["error_seq"]) == (3001, "reducer.duplicate-reservation", 3002)


def test_fold_stream_equals_batch(spark, tmp_path):
    runs = {f"r{n}": told for n, told in enumerate([numbered(history()), *[broken(random.Random(n)) for n in range(4)]])}
    rows = [(run, seq, kind, json.dumps(p)) for run, told in runs.items() for seq, kind, p in told]
    random.Random(0).shuffle(rows)
    for n in range(3):
        spark.createDataFrame(rows[n::3], ledger_fold.EVENT).coalesce(1).write.json(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema(ledger_fold.EVENT).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in/*"))
    for _ in range(2):  # the second time there is nothing new
        q = streamed.fold_stream(stream, str(tmp_path / "out"), 4).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None
    got = {tuple(r) for r in streamed.states(spark, str(tmp_path / "out")).collect()}
    assert got == {tuple(r) for r in ledger_fold.fold(events(spark, runs)).collect()}


# --- files


def plain(data: bytes, cap: int):
    """Lines of a file, read as a whole."""
    out, at = [], 0
    parts = data.split(b"\n")
    for i, line in enumerate(parts):
        ended = i < len(parts) - 1
        if ended or line:
            try:
                text = line.decode()
                json.loads(text)
                code = None
            except UnicodeDecodeError:
                code = "ledger.invalid-utf8"
            except ValueError:
                code = "ledger.invalid-json"
            code = "ledger.torn-tail" if not ended else "ledger.line-too-large" if len(line) > cap else "ledger.empty-line" if not line else code
            out.append((at, len(line), None if code else line.decode(), code))
        at += len(line) + 1
    return out


@pytest.mark.parametrize("torn", [False, True])
def test_lines_of_byte_ranges(tmp_path, torn):
    rng = random.Random(torn)
    data = b"".join(rng.choice((b'{"seq":%d,"x":"%s"}' % (i, "é".encode() * rng.randrange(40)), b"", b"\xff\xfe", b"{no", b"[" * 5, b'{"big":"' + b"y" * rng.randrange(300, 900) + b'"}')) + b"\n" for i in range(120))
    data += b'{"half":' if torn else b""
    path = tmp_path / "log.jsonl"
    path.write_bytes(data)
    want = plain(data, 400)
    for size in (1, 7, 64, 333, 1 << 20):
        for chunk in (3, 1 << 20):
            ledger_source.READ_BYTES = chunk
            reader = ledger_source.LedgerReader({"path": str(path), "rangeBytes": str(size), "maxLineBytes": "400"})
            got = [(r[1], r[2], r[4], r[5]) for part in reader.partitions() for r in reader.read(part)]
            assert got == want, (size, chunk)
    assert len(ledger_source.LedgerReader({"path": str(path), "rangeBytes": "64"}).partitions()) > 100


def test_scan_in_spark_with_conditions_on_seq(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_bytes(b"".join(b'{"payload":{"seq":-1},"seq":%d}\n' % i for i in range(1, 2001)))
    told = ledger.lines(spark, str(path), rangeBytes="1000")
    assert told.rdd.getNumPartitions() > 40 and told.agg(F.sum("seq")).first()[0] == 2001 * 1000
    assert sorted(r["seq"] for r in ledger.lines(spark, str(path), rangeBytes="1000", minSeq="700", maxSeq="703").collect()) == [700, 701, 702, 703]
    reader = ledger_source.LedgerReader({"path": str(path), "rangeBytes": "1000", "minSeq": "700", "maxSeq": "703"})
    assert len(reader.partitions()) <= 2
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        few = ledger.lines(spark, str(path), rangeBytes="1000").filter("seq > 1500 and seq <= 1502 and bytes > 0")
        assert sorted(r["seq"] for r in few.collect()) == [1501, 1502] and few.rdd.getNumPartitions() <= 2
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def entries(spark, names, start=0):
    rows = [("identity_reserved", json.dumps({"kind": "attempt", "id": n, "origin": {"source": "x"}}), f"e{start + i}", f"2024-01-01T00:00:{start + i:02d}.000Z") for i, n in enumerate(names)]
    return spark.createDataFrame(rows, ledger_source.ENTRIES)


def test_ledger_append_and_verify(spark, tmp_path):
    path = tmp_path / "ledger.jsonl"
    ledger.append(entries(spark, ["a", "b"]), str(path))
    ledger.append(entries(spark, ["c"], 2), str(path))
    issues, state = ledger.verified(spark, str(path))
    assert issues.collect() == [] and state.first()["seq"] == 3
    before = path.read_bytes()
    for rows, code in ((entries(spark, ["b"], 9), "duplicate-reservation"), (entries(spark, ["d", "d"], 9), "duplicate-reservation"), (entries(spark, ["e"], 1), "duplicate-event-id")):
        with pytest.raises(ValueError, match=code):
            ledger.append(rows, str(path))
    bad = spark.createDataFrame([("x", "no json", "e8", "2024-01-01T00:00:08.000Z")], ledger_source.ENTRIES)
    with pytest.raises(Exception):  # noqa: B017 - the task fails, the job is aborted
        ledger.append(bad, str(path))
    assert path.read_bytes() == before and [f.name for f in tmp_path.iterdir()] == ["ledger.jsonl"]
    path.write_bytes(before + b'{"torn')
    assert ledger.torn(spark, str(path))
    assert {(r["seq"], r["code"]) for r in ledger.verified(spark, str(path))[0].collect()} == {(None, "ledger.torn-tail")}
    ledger.append(entries(spark, ["d"], 3), str(path))  # what was never acknowledged goes
    assert path.read_bytes().startswith(before) and not ledger.torn(spark, str(path)) and ledger.verified(spark, str(path))[0].count() == 0
    lines = path.read_bytes().split(b"\n")
    path.write_bytes(b"\n".join([lines[0], lines[2].replace(b'"c"', b'"a"'), b"", b"\xff", lines[3], lines[3]]) + b"\n")
    codes = {(r["seq"], r["code"]) for r in ledger.verified(spark, str(path))[0].collect()}
    assert {(3, "ledger.hash-mismatch"), (3, "ledger.duplicate-reservation"), (3, "ledger.sequence-mismatch"), (4, "ledger.sequence-mismatch"), (4, "ledger.duplicate-event-id"), (None, "ledger.empty-line"), (None, "ledger.invalid-utf8")} <= codes


def test_ledger_writer_conflict_and_stream_batches(tmp_path):
    path = tmp_path / "ledger.jsonl"
    row = lambda n: {"type": "lock_recovered", "payload": "{}", "eventId": f"e{n}", "occurredAt": "2024-01-01T00:00:00.000Z"}
    one, two = (ledger_source.LedgerAppend({"path": str(path)}) for _ in range(2))
    first, second = one.write(iter([row(1)])), two.write(iter([row(2)]))
    one.commit([first, one.write(iter([]))])
    with pytest.raises(ValueError, match="writer-conflict"):
        two.commit([second])
    assert path.read_bytes().count(b"\n") == 1
    with pytest.raises(ValueError, match="one task"):
        one.commit([one.write(iter([row(3)])), one.write(iter([row(4)]))])
    stream = ledger_source.LedgerStreamAppend({"path": str(path)})
    for _ in range(2):  # the batch comes again after its append
        stream.commit([stream.write(iter([row(5), row(6)]))], 0)
    stream.commit([stream.write(iter([row(7)]))], 1)
    told = [json.loads(x) for x in path.read_text().splitlines()]
    assert [t["seq"] for t in told] == [1, 2, 3, 4] and [t["eventId"] for t in told] == ["e1", "e5", "e6", "e7"]
    assert all(a["entrySha256"] == b["prevSha256"] for a, b in zip(told, told[1:], strict=False))
    assert {f.name for f in tmp_path.iterdir()} == {"ledger.jsonl", "_ledger.jsonl.batch"}


def records(spark, told):
    return spark.createDataFrame([(name, "att-1", 7, kind, raw) for name, kind, raw in told], transaction_sink.ROWS)


def test_transactions_commit_in_two_phases(spark, tmp_path):
    root = tmp_path / "committed"
    told = [(f"tx-{n}", "claims", json.dumps({"claimId": f"c{i}", "b": 1, "a": 2})) for n in range(6) for i in range(n, 3)] + [("tx-9", None, None)]
    transactions.write(records(spark, told), str(root))
    lines = Counter((r["transaction_id"], r["raw"]) for r in transactions.scan(spark, str(root), "claims").collect())
    assert lines == Counter((n, json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"))) for n, k, x in told if k)
    assert transactions.issues(spark, str(root)).count() == 0 and {p.name for p in root.iterdir()} == {"tx-0", "tx-1", "tx-2", "tx-9"} and {p.name for p in tmp_path.iterdir()} == {"committed"}
    stamp = (root / "tx-1" / "manifest.json").stat().st_mtime_ns
    transactions.write(records(spark, told), str(root))  # the same again
    assert (root / "tx-1" / "manifest.json").stat().st_mtime_ns == stamp
    with pytest.raises(Exception, match="id-conflict"):
        transactions.write(records(spark, [("tx-1", "claims", "{}"), ("tx-7", "claims", "{}")]), str(root))
    with pytest.raises(Exception, match="invalid-record"):  # one task dies after others have staged
        transactions.write(records(spark, [*[(f"tx-{n}", "claims", "{}") for n in range(20, 30)], ("tx-40", "nothing", "{}")]), str(root))
    assert {p.name for p in root.iterdir()} == {"tx-0", "tx-1", "tx-2", "tx-9"} and {p.name for p in tmp_path.iterdir()} == {"committed"}


def test_transaction_of_a_lost_task_is_not_committed(tmp_path):
    w = transaction_sink.TransactionWriter({"path": str(tmp_path / "committed")})
    row = lambda name, raw: {"transaction_id": name, "attempt_id": "a", "result_seq": 1, "kind": "claims", "raw": raw}
    w.write(iter([row("tx-1", "{}")]))  # its executor is lost: no message
    again = w.write(iter([row("tx-1", "{}"), row("tx-2", "{}")]))
    assert not (tmp_path / "committed").exists()
    w.commit([again, None])
    assert sorted(p.name for p in (tmp_path / "committed").iterdir()) == ["tx-1", "tx-2"] and [p.name for p in tmp_path.iterdir()] == ["committed"]
    dying = transaction_sink.TransactionWriter({"path": str(tmp_path / "committed")})
    message = dying.write(iter([row("tx-3", "{}")]))
    dying.abort([message])
    assert sorted(p.name for p in (tmp_path / "committed").iterdir()) == ["tx-1", "tx-2"] and [p.name for p in tmp_path.iterdir()] == ["committed"]
    s = transaction_sink.TransactionStreamWriter({"path": str(tmp_path / "committed")})
    s.commit([s.write(iter([row("tx-2", "{}"), row("tx-4", "{}")]))], 3)
    assert (tmp_path / "committed/tx-4/manifest.json").exists()


def test_transaction_issues(spark, tmp_path):
    root = tmp_path / "committed"
    transactions.write(records(spark, [("tx-1", "claims", '{"claimId":"c1"}'), ("tx-1", "claims", '{"claimId":"c2"}')]), str(root))
    told = lambda: [(r["kind"], r["code"], r["detail"]) for r in transactions.issues(spark, str(root)).collect()]
    for text, detail in (('{"claimId":"c1"}\n', "count"), ('{"claimId":"c1"}\n{"claimId":"c3"}\n', "digest"), ('{"claimId":"c1"}\n{"claimId":"c33"}\n', "bytes"), ('{"claimId":"c1"}\n{"claimId": "c"}\n', "canonical")):
        (root / "tx-1" / "claims.jsonl").write_text(text)
        assert told() == [("claims", "transaction.corrupt", detail)]
    (root / "tx-1" / "more.txt").write_text("x")
    assert (None, "transaction.corrupt", "files") in told()


# --- timers


def test_timers_fire_when_due(spark, tmp_path):
    spark.conf.set(*timers.STORE)
    soon = lambda s: time.strftime("%Y-%m-%dT%H:%M:%S.000Z", time.gmtime(time.time() + s))
    told = [
        ("r", 1, "retry_scheduled", {"scheduleId": "due", "logicalOperationId": "o1", "notBeforeAt": soon(3)}), ("r", 2, "retry_scheduled", {"scheduleId": "started", "logicalOperationId": "o2", "notBeforeAt": soon(3)}),
        ("r", 3, "request_retry_scheduled", {"scheduleId": "asked", "logicalRequestId": "x", "notBeforeAt": soon(3)}), ("r", 4, "retry_started", {"scheduleId": "started"}), ("r", 5, "retry_started", {"scheduleId": "unknown"}),
        ("r", 6, "retry_scheduled", {"scheduleId": "late", "logicalOperationId": "o3", "notBeforeAt": soon(9000)}), ("q", 1, "retry_scheduled", {"scheduleId": "gone", "logicalOperationId": "o1", "notBeforeAt": soon(3)}),
        ("q", 2, "cancel_requested", {"executionEpoch": 0}), ("q", 3, "retry_scheduled", {"scheduleId": "passed", "logicalOperationId": "o1", "notBeforeAt": soon(-60)}), ("q", 4, "lock_recovered", {})]
    spark.createDataFrame([(a, b, c, json.dumps(d)) for a, b, c, d in told], ledger_fold.EVENT).coalesce(1).write.json(str(tmp_path / "in/0"))
    stream = spark.readStream.schema(ledger_fold.EVENT).json(str(tmp_path / "in/*"))
    q = timers.due_schedules(stream).writeStream.format("memory").queryName("due").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        ends = time.time() + 120
        while time.time() < ends and spark.table("due").count() < 3 and q.exception() is None:
            time.sleep(1)
        assert q.exception() is None
        got = {(r["run_id"], r["schedule_id"], r["kind"], r["operation"]) for r in spark.table("due").collect()}
        assert got == {("r", "due", "attempt", "o1"), ("r", "asked", "request", "x"), ("q", "passed", "attempt", "o1")}
        assert all(r["fired_at"] >= r["due_at"] for r in spark.table("due").collect())
    finally:
        q.stop()
        spark.conf.unset(timers.STORE[0])
