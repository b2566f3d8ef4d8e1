"""Training batches as a stream: a data source whose offsets are (step, cursors).

A plan says what each step reads: the phases of the mixture and the shards in their order, as ``mixture`` works them
out. It is a small file, one line a shard and one a phase and source. The stream goes from step to step; its checkpoint
holds the step and each source's cursor, so a run that is broken off goes on with the batch it would have read next,
and a plan that no longer agrees with the checkpoint is an error. Tokens are read by ranges of bytes.

    loader.write_plan(mixture.numbered(train, width), scheduled, width, path)
    spark.readStream.format("training_batches").option("plan", path).option("shards", folder).option("until", 400).load()
"""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from millrace.sources.token_shards import HEADER, _store

SCHEMA = "step long, row long, source string, path string, start long, x array<int>, y array<int>"


def write_plan(entries: DataFrame, scheduled: DataFrame, width: int, path: str) -> None:
    """One JSON file of ``mixture.numbered`` shards and ``mixture.schedule`` phases under the folder ``path``, which it replaces."""
    shards = entries.select(F.struct("source", "path", "first_row", "n_rows").alias("s")).agg(F.array_sort(F.collect_list("s")).alias("shards"))
    phases = scheduled.select(F.struct("first_step", "source", "steps", "rows_per_step", "from_row").alias("p")).agg(F.array_sort(F.collect_list("p")).alias("phases"))
    whole = shards.join(F.broadcast(phases)).select(F.to_json(F.struct(F.lit(width).alias("width"), "phases", "shards")).alias("value"))  # one row each
    whole.coalesce(1).write.mode("overwrite").text(path)


class Plan:
    """What each step reads, by arithmetic on running row numbers."""

    def __init__(self, text: str):
        told = json.loads(text)
        self.width, self.phases = told["width"], told["phases"]
        self.steps = max((p["first_step"] + p["steps"] for p in self.phases), default=0)
        self.shards: dict[str, list[dict]] = {}
        for s in told["shards"]:
            if s["n_rows"] > 0:
                self.shards.setdefault(s["source"], []).append(s)
        for own in self.shards.values():
            own.sort(key=lambda s: s["first_row"])
        self.firsts = {source: [s["first_row"] for s in own] for source, own in self.shards.items()}

    def cursors(self, step: int) -> dict[str, int]:
        """Rows that each source has given before a step."""
        out: dict[str, int] = {}
        for p in self.phases:
            done = max(0, min(step - p["first_step"], p["steps"]))
            out[p["source"]] = out.get(p["source"], 0) + done * p["rows_per_step"]
        return dict(sorted(out.items()))

    def rows(self, step: int) -> Iterator[tuple[int, str, str, int]]:
        """(row, source, path, start) of a step, in order of source, then position; a source that lacks a row is an error."""
        row = 0
        for p in sorted((p for p in self.phases if p["first_step"] <= step < p["first_step"] + p["steps"]), key=lambda p: p["source"]):
            first = p["from_row"] + (step - p["first_step"]) * p["rows_per_step"]
            for k in range(first, first + p["rows_per_step"]):
                own = self.shards.get(p["source"], [])
                at = bisect.bisect_right(self.firsts.get(p["source"], []), k) - 1
                if at < 0 or k >= own[at]["first_row"] + own[at]["n_rows"]:
                    raise ValueError(f"exhausted: source {p['source']}")
                yield row, p["source"], own[at]["path"], (k - own[at]["first_row"]) * self.width
                row += 1


@dataclass
class _Steps(InputPartition):
    first: int
    last: int


class _Batches(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.plan_path, self.shards = options["plan"], options["shards"].rstrip("/")
        self.plan = Plan(_text(self.plan_path))
        self.until = min(int(options.get("until", self.plan.steps)), self.plan.steps)
        self.first, self.each = int(options.get("first", 0)), int(options.get("stepsPerPartition", 1))

    def _offset(self, step: int) -> dict:
        return {"step": step, "cursors": self.plan.cursors(step)}

    def initialOffset(self) -> dict:
        return self._offset(min(self.first, self.until))

    def latestOffset(self) -> dict:
        return self._offset(self.until)

    def partitions(self, start: dict, end: dict) -> list[_Steps]:
        for told in (start, end):
            if told["cursors"] != self.plan.cursors(told["step"]):
                raise ValueError(f"the plan does not agree with the checkpoint at step {told['step']}")
        return [_Steps(s, min(s + self.each, end["step"])) for s in range(start["step"], end["step"], self.each)]

    def read(self, partition: _Steps) -> Iterator[pa.RecordBatch]:
        fs, root = _store(self.shards)
        width, open_ = self.plan.width, {}
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for step in range(partition.first, partition.last):
            out = []
            for row, source, path, start in self.plan.rows(step):
                if path not in open_:
                    if len(open_) >= 64:
                        open_.pop(next(iter(open_))).close()
                    open_[path] = fs.open_input_file(path if path.startswith("/") else f"{root}/{path}")
                open_[path].seek(4 * HEADER + 2 * start)
                tokens = np.frombuffer(open_[path].read(2 * (width + 1)), "<u2").astype(np.int32)
                if len(tokens) < width + 1:
                    raise ValueError(f"{path} ends within a row")
                out.append((step, row, source, path, start, tokens[:-1].tolist(), tokens[1:].tolist()))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        for f in open_.values():
            f.close()

    def commit(self, end: dict) -> None:
        """Nothing is held back: the checkpoint is Spark's."""


def _text(path: str) -> str:
    from pyarrow import fs as store

    fs, root = _store(path)
    files = [root] if fs.get_file_info(root).type == store.FileType.File else sorted(f.path for f in fs.get_file_info(store.FileSelector(root)) if f.base_name.startswith("part-"))
    return "".join(fs.open_input_file(f).read().decode() for f in files)


class TrainingBatches(DataSource):
    """The stream: options ``plan``, ``shards``, and optionally ``first`` and ``until`` (steps) and ``stepsPerPartition``."""

    @classmethod
    def name(cls) -> str:
        return "training_batches"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> _Batches:
        return _Batches(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TrainingBatches)
