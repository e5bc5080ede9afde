"""A ledger file as a Spark source and sink: byte ranges read side by side, appends in two steps.

The reader (format ``tessera_ledger``) cuts each file into byte ranges.  A range owns the lines that
begin in it, so a line across a boundary is read once, by the range where it begins; a range in
the middle of a line owns nothing.  Lines are strict: bytes that are not UTF-8, empty lines, lines
beyond the cap, what is no JSON, and a last line without its line feed each get a code instead of
a text, so that a whole log can be judged.  Conditions on ``seq`` reach the reader: a log is in
order, so ranges whose first lines show that none of their lines can match are not read.

The writer appends rows (type, payload, eventId, occurredAt) to one file.  The chain of hashes is
sequential by contract, so one task makes the lines, into a staged file beside the ledger, from the
tail it finds there; the commit appends them if that tail is still the tail and removes what a
writer that died had left unterminated.  A task that fails, or an abort, leaves the ledger as it was.

Paths are of any file system that pyarrow knows; options: ``rangeBytes``, ``maxLineBytes``,
``minSeq``, ``maxSeq``, and ``pushFilters`` where the session has Spark's setting PUSHDOWN on.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamWriter, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

GENESIS = "0" * 64
#: Fixed value: the longest line, 4 MiB.
MOST_LINE = 4 << 20
RANGE_BYTES = 64 << 20
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
READ_BYTES = 1 << 20
LINES = "file string, offset bigint, bytes bigint, seq bigint, raw string, code string"
ENTRIES = "type string, payload string, eventId string, occurredAt string"


def _files(path: str) -> tuple:
    """The file system and the files (path, size) of a file or of all files in a folder."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    info = store.get_file_info(name)
    found = [info] if info.type != fs.FileType.Directory else store.get_file_info(fs.FileSelector(name))
    return store, [(f.path, f.size) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]


def exists(path: str) -> bool:
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return store.get_file_info(name).type != fs.FileType.NotFound


def _seq(line: bytes) -> int | None:
    try:
        told = json.loads(line)
    except ValueError:
        return None
    seq = told.get("seq") if isinstance(told, dict) else None
    return seq if isinstance(seq, int) and not isinstance(seq, bool) else None


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int
    size: int


def lines(store, part: Range, cap: int) -> Iterator[tuple[int, int, bytes | None, bool]]:
    """Lines that begin in the range: (offset, bytes, text or None beyond the cap, whether it is ended)."""
    with store.open_input_file(part.file) as f:
        at, held, begin, size, wanted = max(0, part.start - 1), [], part.start, 0, part.start == 0
        while at < part.size:
            chunk = f.read_at(min(READ_BYTES, part.size - at), at)
            if not chunk:
                return
            cursor = 0
            while cursor < len(chunk):
                feed = chunk.find(b"\n", cursor)
                stop = len(chunk) if feed < 0 else feed
                if wanted:
                    size += stop - cursor
                    if size <= cap:
                        held.append(chunk[cursor:stop])
                    else:
                        held.clear()  # too long: only its length is kept
                if feed < 0:
                    break
                if wanted:
                    yield begin, size, b"".join(held) if size <= cap else None, True
                cursor, begin, size, held, wanted = feed + 1, at + feed + 1, 0, [], True
                if begin >= part.end:
                    return
            at += len(chunk)
            if not wanted and at >= part.end:
                return
        if wanted and size:
            yield begin, size, b"".join(held) if size <= cap else None, False


class LedgerReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        told = {k.lower(): v for k, v in options.items()}  # Spark hands options over in small letters
        self.path = told["path"]
        self.range, self.cap = int(told.get("rangebytes", RANGE_BYTES)), int(told.get("maxlinebytes", MOST_LINE))
        self.low = int(told["minseq"]) if "minseq" in told else None
        self.high = int(told["maxseq"]) if "maxseq" in told else None

    @property
    def bounded(self) -> bool:
        return self.low is not None or self.high is not None

    def partitions(self) -> list[Range]:
        store, files = _files(self.path)
        out = []
        for file, size in files:
            ranges = [Range(file, a, min(size, a + self.range), size) for a in range(0, size, self.range)]
            if self.bounded and len(ranges) > 1:
                ranges = self._pruned(store, ranges)
            out += ranges
        return out

    def _pruned(self, store, ranges: list[Range]) -> list[Range]:
        """The ranges that can hold the wanted numbers, by bisection on the first number of a range."""

        def first(i: int) -> int | None:
            for r in ranges[i:]:
                for _, _, text, _ in lines(store, r, self.cap):
                    seq = _seq(text or b"")
                    if seq is not None:
                        return seq
            return None

        def place(value: int) -> int:
            """Ranges whose first number is at most ``value``."""
            low, high = 0, len(ranges)
            while low < high:
                mid = (low + high) // 2
                seq = first(mid)
                low, high = (mid + 1, high) if seq is not None and seq <= value else (low, mid)
            return low

        begin = max(0, place(self.low - 1) - 1) if self.low is not None else 0
        end = max(1, place(self.high)) if self.high is not None else len(ranges)
        return ranges[begin:end]

    def read(self, partition: Range) -> Iterator[tuple]:
        store, _ = _files(self.path)
        for offset, size, text, ended in lines(store, partition, self.cap):
            raw = seq = code = None
            if not ended:
                code = "ledger.torn-tail"
            elif text is None:
                code = "ledger.line-too-large"
            elif not text:
                code = "ledger.empty-line"
            else:
                try:
                    raw = text.decode("utf-8")
                    told = json.loads(raw, parse_constant=lambda x: 1 / 0)
                    seq = told.get("seq") if isinstance(told, dict) and type(told.get("seq")) is int else None
                except UnicodeDecodeError:
                    code = "ledger.invalid-utf8"
                except (ValueError, ZeroDivisionError, RecursionError):
                    raw, code = None, "ledger.invalid-json"
            if self.bounded and (seq is None or (self.low is not None and seq < self.low) or (self.high is not None and seq > self.high)):
                continue
            yield partition.file, offset, size, seq, raw, code


class FilteredLedgerReader(LedgerReader):
    """The reader that takes Spark's conditions on ``seq``; Spark wants its setting PUSHDOWN on for it."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and f.attribute == ("seq",):
                low, high = {EqualTo: (f.value, f.value), GreaterThan: (f.value + 1, None), GreaterThanOrEqual: (f.value, None), LessThan: (None, f.value - 1), LessThanOrEqual: (None, f.value)}[type(f)]
                self.low = low if self.low is None or (low is not None and low > self.low) else self.low
                self.high = high if self.high is None or (high is not None and high < self.high) else self.high
            else:
                yield f


# --- appending


def tail(store, path: str, cap: int = MOST_LINE) -> tuple[int, int, str]:
    """Bytes up to the last line feed, and the last event's number and hash."""
    from pyarrow import fs

    info = store.get_file_info(path)
    if info.type != fs.FileType.File:
        return 0, 0, GENESIS
    with store.open_input_file(path) as f:
        at, held = info.size, b""
        while at > 0:
            step = min(READ_BYTES, at)
            at -= step
            held = f.read_at(step, at) + held
            end = held.rfind(b"\n")
            begin = held.rfind(b"\n", 0, end) if end >= 0 else -1
            if end >= 0 and (begin >= 0 or at == 0):
                told = json.loads(held[begin + 1 : end])
                return at + end + 1, told["seq"], told["entrySha256"]
            if len(held) > 2 * cap + 2:
                raise ValueError("ledger.line-too-large")
    return 0, 0, GENESIS


@dataclass
class Staged(WriterCommitMessage):
    file: str | None
    base: int
    rows: int


class LedgerAppend(DataSourceWriter):
    """One task stages the new lines; the commit appends them."""

    def __init__(self, options: dict) -> None:
        told = {k.lower(): v for k, v in options.items()}
        self.path, self.cap = told["path"], int(told.get("maxlinebytes", MOST_LINE))
        self.job = uuid.uuid4().hex

    def _store(self) -> tuple:
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))

    def write(self, iterator: Iterator) -> Staged:
        from tessera.functions.canonical import canonical

        first = next(iterator, None)
        if first is None:
            return Staged(None, 0, 0)
        store, path = self._store()
        base, seq, prev = tail(store, path, self.cap)
        folder, _, name = path.rpartition("/")
        file, rows = f"{folder}/_{name}.{self.job}.{uuid.uuid4().hex}", 0
        with store.open_output_stream(file) as out:
            row = first
            while row is not None:
                seq += 1
                event = {"schemaVersion": 1, "seq": seq, "eventId": row["eventId"], "occurredAt": row["occurredAt"], "type": row["type"], "payload": json.loads(row["payload"]), "prevSha256": prev}
                prev = hashlib.sha256((canonical(event) + "\n").encode()).hexdigest()
                line = canonical(event | {"entrySha256": prev}).encode()
                if len(line) > self.cap:
                    raise ValueError("ledger.line-too-large")
                out.write(line + b"\n")
                rows += 1
                row = next(iterator, None)
        return Staged(file, base, rows)

    def commit(self, messages: list[Staged | None]) -> None:
        store, path = self._store()
        staged = [m for m in messages if m is not None and m.file]
        try:
            if len(staged) > 1:
                raise ValueError("a ledger is appended to by one task: sort and coalesce(1)")
            for m in staged:
                base, _, _ = tail(store, path, self.cap)
                if base != m.base:
                    raise ValueError("ledger.writer-conflict")
                self._append(store, path, m)
        finally:
            self._clear(store, path)

    def _append(self, store, path: str, staged: Staged) -> None:
        from pyarrow import fs

        if not isinstance(store, fs.LocalFileSystem):  # no appending there: the whole file anew, then one rename
            with store.open_output_stream(f"{staged.file}.all") as out:
                for source, size in ((path, staged.base), (staged.file, None)):
                    if size == 0:
                        continue
                    with store.open_input_stream(source) as f:
                        while chunk := f.read(READ_BYTES if size is None else min(READ_BYTES, size)):
                            out.write(chunk)
                            size = None if size is None else size - len(chunk)
            store.move(f"{staged.file}.all", path)
            return
        import os

        with open(path, "r+b" if os.path.exists(path) else "w+b") as out, open(staged.file, "rb") as f:
            out.truncate(staged.base)  # an unterminated last line was never acknowledged
            out.seek(staged.base)
            while chunk := f.read(READ_BYTES):
                out.write(chunk)
            out.flush()
            os.fsync(out.fileno())

    def _clear(self, store, path: str) -> None:
        from pyarrow import fs

        folder, _, name = path.rpartition("/")
        for f in store.get_file_info(fs.FileSelector(folder)):
            if f.base_name.startswith(f"_{name}.{self.job}."):
                store.delete_file(f.path)

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear(*self._store())


class LedgerStreamAppend(LedgerAppend, DataSourceStreamWriter):
    """The same for each micro-batch; one that was appended before its query knew so is not appended again.

    A mark beside the ledger says which batch was to end where; it is written before the lines.
    """

    def commit(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803
        store, path = self._store()
        folder, _, name = path.rpartition("/")
        mark = f"{folder}/_{name}.batch"
        staged = [m for m in messages if m is not None and m.file]
        end, _, _ = tail(store, path, self.cap)
        if store.get_file_info(mark).is_file:
            with store.open_input_stream(mark) as f:
                known = json.loads(f.read())
            if known == {"batch": batchId, "end": end}:
                self._clear(store, path)
                return
        if staged:
            with store.open_output_stream(mark) as out:
                out.write(json.dumps({"batch": batchId, "end": end + sum(store.get_file_info(m.file).size for m in staged)}).encode())
        LedgerAppend.commit(self, messages)

    def abort(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803
        LedgerAppend.abort(self, messages)


class LedgerSource(DataSource):
    """Format ``tessera_ledger``; register it with ``spark.dataSource.register``."""

    @classmethod
    def name(cls) -> str:
        return "tessera_ledger"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> LedgerReader:
        options = dict(self.options)
        return (FilteredLedgerReader if self.options.get("pushFilters", "false") == "true" else LedgerReader)(options)

    def writer(self, schema, overwrite: bool) -> LedgerAppend:
        if overwrite:
            raise ValueError("a ledger is only appended to")
        return LedgerAppend(dict(self.options))

    def streamWriter(self, schema, overwrite: bool) -> LedgerStreamAppend:  # noqa: N802
        return LedgerStreamAppend(dict(self.options))
