"""Transaction folders as a Spark sink with a two-phase commit.

Rows (transaction_id, attempt_id, result_seq, kind, raw) become one folder a transaction: a file of
canonical lines for each of the six kinds, in their order, and a manifest.  Each task stages the
transactions it was dealt (``deal`` brings all rows of one to one task; a transaction is bounded by
contract, 64 MiB) in a folder of this job and returns their manifests.  The commit writes the
manifest last and renames the folder; the same content again does nothing, other content under
a committed id is ``transaction.id-conflict``, and then nothing of the job is committed.  What a
lost or repeated task has staged, and all of an aborted job, is never renamed and goes with the
job's folder.

Format ``tessera_transactions``, batch and streaming; option ``path``: the folder of committed
transactions, on any file system that pyarrow knows and whose rename is atomic.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

from tessera.functions.canonical import canonical, canonical_json
from tessera.operators.records import KINDS

ROWS = "transaction_id string, attempt_id string, result_seq bigint, kind string, raw string"
MANIFEST = "manifest.json"
#: Caps of a line and of a transaction.
MOST_LINE, MOST_BYTES = 4 << 20, 64 << 20
RENAMES_AT_ONCE = 16


def deal(rows: DataFrame) -> DataFrame:
    """Rows with canonical texts, each transaction in one task and in the order in which it is written."""
    told = rows.select("transaction_id", "attempt_id", F.col("result_seq").cast("long").alias("result_seq"), "kind", canonical_json("raw").alias("raw"))
    at = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    return told.repartition("transaction_id").sortWithinPartitions("transaction_id", at, "raw")


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    manifests: list[tuple[str, str]]


class _Folder:
    """One transaction while its rows arrive."""

    def __init__(self, store, path: str, name: str, attempt: str | None, result_seq: int | None) -> None:
        self.store, self.path, self.name, self.attempt, self.result_seq = store, path, name, attempt, result_seq
        self.files, self.bytes = {}, 0
        store.create_dir(path)
        for kind in KINDS:
            store.open_output_stream(f"{path}/{kind}.jsonl").close()
            self.files[kind] = [0, 0, hashlib.sha256()]
        self.kind = self.out = None

    def add(self, kind: str, raw: str | None) -> None:
        if kind not in self.files or raw is None:
            raise ValueError("transaction.invalid-record")
        line = raw.encode() + b"\n"
        self.bytes += len(line)
        if len(line) > MOST_LINE or self.bytes > MOST_BYTES:
            raise ValueError("transaction.file-too-large")
        if kind != self.kind:
            self.close()
            self.kind, self.out = kind, self.store.open_output_stream(f"{self.path}/{kind}.jsonl")
        self.out.write(line)
        told = self.files[kind]
        told[0] += 1
        told[1] += len(line)
        told[2].update(line)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()

    def manifest(self) -> str:
        self.close()
        files = [{"kind": k, "relativePath": f"{k}.jsonl", "recordCount": n, "decodedBytes": b, "sha256": h.hexdigest()} for k, (n, b, h) in self.files.items()]
        return canonical({"schemaVersion": 1, "transactionId": self.name, "attemptId": self.attempt, "sourceResultSeq": self.result_seq, "files": files})


class TransactionWriter(DataSourceWriter):
    def __init__(self, options: dict) -> None:
        self.path, self.job = options["path"].rstrip("/"), uuid.uuid4().hex

    def _store(self) -> tuple:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))
        return store, path, f"{path.rpartition('/')[0]}/.staging-{self.job}"

    def write(self, iterator: Iterator) -> Staged:
        store, _, stage = self._store()
        folder, done, at = f"{stage}/{uuid.uuid4().hex}", [], None
        for row in iterator:
            if at is None or row["transaction_id"] != at.name:
                if at is not None:
                    done.append((at.name, at.manifest()))
                if not row["transaction_id"] or "/" in row["transaction_id"] or row["transaction_id"].startswith((".", "_")):
                    raise ValueError("transaction.invalid-input")
                at = _Folder(store, f"{folder}/{row['transaction_id']}", row["transaction_id"], row["attempt_id"], row["result_seq"])
            if (row["attempt_id"], row["result_seq"]) != (at.attempt, at.result_seq):
                raise ValueError("transaction.invalid-input")
            if row["kind"] is not None:  # a row without a kind makes an empty transaction
                at.add(row["kind"], row["raw"])
        if at is not None:
            done.append((at.name, at.manifest()))
        return Staged(folder, done)

    def commit(self, messages: list[Staged | None]) -> None:
        store, path, stage = self._store()
        told = [(m.folder, name, text) for m in messages if m is not None for name, text in m.manifests]
        try:
            names = [name for _, name, _ in told]
            if len(set(names)) < len(names):
                raise ValueError("a transaction came from two tasks: use deal()")
            store.create_dir(path)
            with ThreadPoolExecutor(RENAMES_AT_ONCE) as pool:
                known = list(pool.map(lambda x: self._committed(store, f"{path}/{x[1]}"), told))
                if any(k not in (None, text) for k, (_, _, text) in zip(known, told, strict=True)):
                    raise ValueError("transaction.id-conflict")
                fresh = [x for k, x in zip(known, told, strict=True) if k is None]
                list(pool.map(lambda x: self._rename(store, path, *x), fresh))
        finally:
            self._clear(store, stage)

    @staticmethod
    def _committed(store, folder: str) -> str | None:
        if not store.get_file_info(folder).type.value:  # nothing there
            return None
        if not store.get_file_info(f"{folder}/{MANIFEST}").is_file:
            return ""
        with store.open_input_stream(f"{folder}/{MANIFEST}") as f:
            return f.read().decode().rstrip("\n")

    @staticmethod
    def _rename(store, path: str, folder: str, name: str, text: str) -> None:
        with store.open_output_stream(f"{folder}/{name}/{MANIFEST}") as out:
            out.write(text.encode() + b"\n")
        store.move(f"{folder}/{name}", f"{path}/{name}")

    @staticmethod
    def _clear(store, stage: str) -> None:
        if store.get_file_info(stage).type.value:
            store.delete_dir(stage)

    def abort(self, messages: list[Staged | None]) -> None:
        store, _, stage = self._store()
        self._clear(store, stage)


class TransactionStreamWriter(TransactionWriter, DataSourceStreamWriter):
    """The same for each micro-batch; a batch that comes again finds its transactions committed."""

    def commit(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803
        TransactionWriter.commit(self, messages)

    def abort(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803
        TransactionWriter.abort(self, messages)


class TransactionSink(DataSource):
    """Format ``tessera_transactions``; register it with ``spark.dataSource.register``."""

    @classmethod
    def name(cls) -> str:
        return "tessera_transactions"

    def schema(self) -> str:
        return ROWS

    def writer(self, schema, overwrite: bool) -> TransactionWriter:
        if overwrite:
            raise ValueError("committed transactions are not overwritten")
        return TransactionWriter(dict(self.options))

    def streamWriter(self, schema, overwrite: bool) -> TransactionStreamWriter:  # noqa: N802
        return TransactionStreamWriter(dict(self.options))
