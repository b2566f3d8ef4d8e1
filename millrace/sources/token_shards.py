"""The token-shard file: a header of 256 little-endian 32-bit integers, then 16-bit token ids.

``read`` takes files through Spark's own binary reader, so any store that Spark reaches will do, and checks
magic number, version and size. ``TokenShardSource`` is a data source that opens ranges of bytes, for shards of any size.
``TokenShardSink`` is a data source (format "token_shards") that writes each
partition to a hidden file and renames all of them when the job commits, so a failed job leaves no shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

#: Fixed values of the format.
MAGIC, VERSION, HEADER = 20240520, 1, 256
HIGHEST = 65535
#: Tokens in a row, and about as many in a partition.
RUN, PARTITION = 1 << 16, 1 << 25


def head(n_tokens: int) -> bytes:
    out = np.zeros(HEADER, "<i4")
    out[:3] = MAGIC, VERSION, n_tokens
    return out.tobytes()


def body(tokens: np.ndarray, vocab: int | None = None) -> bytes:
    """Tokens as a shard holds them; ids must lie below the vocabulary and below 65535."""
    tokens = np.asarray(tokens)
    limit = min(vocab or HIGHEST, HIGHEST)
    if tokens.size and not 0 <= int(tokens.min()) <= int(tokens.max()) < limit:
        raise ValueError(f"token ids must lie in 0 .. {limit - 1}")
    return tokens.astype("<u2").tobytes()


def pack(tokens: np.ndarray, vocab: int | None = None) -> bytes:
    """A whole shard's bytes."""
    return head(len(tokens)) + body(tokens, vocab)


def unpack(data: bytes, name: str = "shard") -> np.ndarray:
    """A shard's tokens, after its header and size are checked."""
    first = np.frombuffer(data, "<i4", min(HEADER, len(data) // 4))
    if len(first) < HEADER or (first[:2] != (MAGIC, VERSION)).any():
        raise ValueError(f"{name} has no valid header")
    if len(data) != 4 * HEADER + 2 * int(first[2]):
        raise ValueError(f"{name} has not the size that its header says")
    return np.frombuffer(data, "<u2", offset=4 * HEADER)


def read(spark: SparkSession, path: str, rows: int = RUN) -> DataFrame:
    """(path, start, tokens): each shard in runs of ``rows`` tokens, so that no row is as large as a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                tokens = unpack(content.as_py(), name)
                for s in range(0, max(len(tokens), 1), rows):
                    yield pa.RecordBatch.from_pydict({"path": [name], "start": [s], "tokens": [tokens[s : s + rows].astype(np.int32)]}, schema=pa.schema([("path", pa.string()), ("start", pa.int64()), ("tokens", pa.list_(pa.int32()))]))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, start long, tokens array<int>")


@dataclass
class _Written(WriterCommitMessage):
    hidden: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.root, self.vocab = options["path"].rstrip("/"), int(options.get("vocab", 0)) or None

    def write(self, rows: Iterator) -> _Written:
        """Rows (name, n_tokens, tokens): those of one name, in a row, are one shard of ``n_tokens`` tokens in all.

        Tokens are written as they come, so a shard never is in memory as a whole.
        """
        from pyspark import TaskContext

        fs, root = _store(self.root)
        fs.create_dir(root, recursive=True)
        task, out, name, left, stream = TaskContext.get().taskAttemptId(), [], None, 0, None

        def close() -> None:
            if stream is not None:
                stream.close()
                if left:
                    raise ValueError(f"{name} lacks {left} of the tokens that it should have")

        for row in rows:
            if row["name"] != name:
                close()
                name, left = row["name"], int(row["n_tokens"])
                hidden = f"{root}/.{name}.{task}"
                if any(h == hidden for h, _ in out):
                    raise ValueError(f"the rows of {name} do not come in a row")
                stream = fs.open_output_stream(hidden)
                out.append((hidden, f"{root}/{name}.bin"))
                stream.write(head(left))
            tokens = np.array(row["tokens"], np.int64)
            left -= len(tokens)
            stream.write(body(tokens, self.vocab))
        close()
        return _Written(out)

    def commit(self, messages: list) -> None:
        """Shards appear one by one; a list of them, ``_SUCCESS.txt``, appears last, so a folder without it is not whole."""
        fs, root = _store(self.root)
        for hidden, final in (x for m in messages if m for x in m.hidden):
            fs.move(hidden, final)
        names = sorted(final.rpartition("/")[2] for m in messages if m for _, final in m.hidden)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/_SUCCESS.txt") as out:
            out.write("".join(f"{n}\n" for n in names).encode())

    def abort(self, messages: list) -> None:
        fs, _ = _store(self.root)
        for hidden, _final in (x for m in messages if m for x in m.hidden):
            fs.delete_file(hidden)


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class TokenShardSink(DataSource):
    """``df.write.format("token_shards").mode("append").save(path)`` with columns name, n_tokens (of the whole shard) and
    tokens; a shard's rows must come in a row, in their order, in one partition."""

    @classmethod
    def name(cls) -> str:
        return "token_shards"

    def schema(self) -> str:
        return "name string, n_tokens long, tokens array<int>"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options))


def _header(stream, size: int, name: str) -> int:
    """The count of tokens that a shard's first bytes tell, checked against its size."""
    first = np.frombuffer(stream.read(4 * HEADER), "<i4")
    if len(first) < HEADER or (first[:2] != (MAGIC, VERSION)).any():
        raise ValueError(f"{name} has no valid header")
    n = int(first[2])
    if size != 4 * HEADER + 2 * n:
        raise ValueError(f"{name} has not the size that its header says")
    return n


@dataclass
class _Range(InputPartition):
    """Whole runs of one shard: tokens ``first`` up to ``last``."""

    path: str
    first: int
    last: int


class _Reader(DataSourceReader):
    """Shards by ranges of bytes: the header gives a shard's length, and each partition opens what it reads."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.run, self.each = int(options.get("rows", RUN)), int(options.get("partition", PARTITION))
        if self.run <= 0 or self.each <= 0:
            raise ValueError("rows and partition must be positive")
        self.low, self.high, self.paths = 0, None, None

    def pushFilters(self, filters: list[Filter]):
        """Bounds of ``start`` and names of ``path`` are answered here; Spark checks all others."""
        for f in filters:
            own = len(getattr(f, "attribute", ())) == 1 and f.attribute[0]
            if own == "path" and isinstance(f, EqualTo | In):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.paths = names if self.paths is None else self.paths & names
            elif own == "start" and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    bound = f.value + (not isinstance(f, LessThan))
                    self.high = bound if self.high is None else min(self.high, bound)
            else:
                yield f

    def partitions(self) -> list[_Range]:
        from pyarrow import fs as store

        fs, root = _store(self.path)
        info = fs.get_file_info(root)
        files = [info] if info.type == store.FileType.File else fs.get_file_info(store.FileSelector(root))
        out, each = [], max(self.each // self.run, 1) * self.run
        for f in sorted((f for f in files if f.path.endswith(".bin") and not f.base_name.startswith(".")), key=lambda f: f.path):
            if self.paths is not None and f.path not in self.paths:
                continue
            with fs.open_input_file(f.path) as stream:
                n = _header(stream, f.size, f.path)
            # The runs whose start lies within the bounds; an empty shard has none.
            first = -(-self.low // self.run) * self.run
            last = n if self.high is None else min(n, max(-(-self.high // self.run), 0) * self.run)
            out += [_Range(f.path, s, min(s + each, last)) for s in range(first, last, each)]
        return out

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        fs, _ = _store(self.path)
        kinds = pa.schema([("path", pa.string()), ("start", pa.int64()), ("tokens", pa.list_(pa.int32()))])
        with fs.open_input_file(partition.path) as stream:
            stream.seek(4 * HEADER + 2 * partition.first)
            for s in range(partition.first, partition.last, self.run):
                data = stream.read(2 * self.run)
                tokens = np.frombuffer(data, "<u2").astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([partition.path]), pa.array([s], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(tokens)], pa.int32()), pa.array(tokens))], schema=kinds)


class TokenShardSource(DataSource):
    """``spark.read.format("token_shard_runs").option("rows", 65536).load(path)``: (path, start, tokens) in runs of ``rows``
    tokens, of a shard or of all shards of a folder in a store that Arrow opens. No task holds more than a run; a
    partition has about ``partition`` tokens, so a shard of any size lies in many. Filters on ``start`` and ``path`` open
    only what they ask for; ``register`` sets ``spark.sql.python.filterPushdown.enabled``, which Spark wants for that."""

    @classmethod
    def name(cls) -> str:
        return "token_shard_runs"

    def schema(self) -> str:
        return "path string, start long, tokens array<int>"

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TokenShardSink)
    spark.dataSource.register(TokenShardSource)
