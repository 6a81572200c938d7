"""Many tree models at once over one table: folds, targets and kinds in a single job."""

from __future__ import annotations

import base64
import os
import shutil
import tempfile
import time
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param.shared import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremorframe.functions.windows import finite
from tremorframe.models import trees

#: Rows that one task fits alone. A larger table is dealt to all task slots, which sum their histograms.
SHARD_ROWS = 1_000_000
BINS = 64
#: Most models of a dealt table that grow side by side, and what they may take of a task's memory (ROW_BYTES for each row).
WAVE = 32
WAVE_BYTES = 256 << 20
ROW_BYTES = 48
#: Bytes up to which a task of a dealt table keeps its rows in memory; more lie in files of its own, read chunk by chunk.
HELD_BYTES = 320 << 20
#: Bytes that all tasks of a dealt table exchange at a time where they share no folder.
EXCHANGE = 32 << 20
#: Numbers of all tasks up to which each task sums all parts itself; of more, each task sums a piece.
PIECES = 1 << 19


@dataclass(frozen=True)
class Fit:
    """One model: the rows that train it, those that it predicts, its label and weight (columns of the table)."""

    name: str
    train: Column
    label: Column
    score: Column | None = None
    weight: Column | None = None
    objective: str = "squared"
    size: trees.Size = trees.Size()
    classes: int = 1
    late_weight: float = 2.0
    leaf_edges: np.ndarray | None = None


def clean(columns: list[str]) -> Column:
    """Feature array; anything missing or not finite counts as zero (impute first)."""
    return F.array(*[F.coalesce(finite(F.col(c).cast("double")), F.lit(0.0)) for c in columns])


def bin_edges(df: DataFrame, columns: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Upper ends of each column's bins but the last: quantiles, or all values if there are fewer. They are numbers of the
    features only and shared by all models of the table."""
    asked = F.lit([i / bins for i in range(1, bins)])  # one for all columns: a list would become a call per number and column
    found = df.agg(*[F.percentile_approx(F.coalesce(finite(F.col(c).cast("double")), F.lit(0.0)), asked, 100 * bins).alias(f"e{k}")
                     for k, c in enumerate(columns)]).first()
    return [np.array(sorted(set(v or ()))) for v in found]


def _table(df: DataFrame, key: str, features: Column, fits: list[Fit], places: list[int], first: int = 0) -> DataFrame:
    def one(number: int, f: Fit) -> Column:
        label = finite(f.label.cast("double"))
        return F.struct(
            F.lit(number).alias("fit"), F.lit(places[number]).alias("place"), F.when(F.coalesce(f.train, F.lit(False)), label).alias("y"),
            F.lit(1.0).alias("w") if f.weight is None else f.weight.cast("double").alias("w"),
            (F.lit(False) if f.score is None else F.coalesce(f.score, F.lit(False))).alias("s"))

    return df.select(F.col(key).cast("long").alias("key"), features.alias("x"), F.array(*[one(k, f) for k, f in enumerate(fits, first)]).alias("fits"))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), width)


def _work(f: dict, y: np.ndarray, w: np.ndarray | None, active: np.ndarray | None = None) -> trees.Work:
    return trees.Work(f["objective"], f["size"], y, w if f["weighted"] else None, f["classes"], f["late_weight"], f["leaf_edges"], active)


_OUT = "key long, fit int, score array<double>, model binary"
_KIND = pa.schema([("key", pa.int64()), ("fit", pa.int32()), ("score", pa.list_(pa.float64())), ("model", pa.binary())])


def _rows(number: int, keys: np.ndarray, flags: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    picked = np.flatnonzero(flags)
    width = scores.shape[1]
    values = pa.ListArray.from_arrays(pa.array(np.arange(len(picked) + 1, dtype=np.int32) * width), pa.array(scores[picked].ravel()))
    return pa.RecordBatch.from_arrays(
        [pa.array(keys[picked]), pa.array(np.full(len(picked), number, np.int32)), values, pa.nulls(len(picked), pa.binary())], schema=_KIND)


def _model(number: int, model: trees.Model) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.nulls(1, pa.int64()), pa.array([number], pa.int32()), pa.nulls(1, pa.list_(pa.float64())), pa.array([model.write()], pa.binary())], schema=_KIND)


def _by_cost(df: DataFrame, fits: list[Fit]) -> tuple[int, list[int]]:
    """Rows of the table, and the place of each model when those with the most rows and trees come first. One job counts them."""
    rows, place = _distinct([F.coalesce(f.train, F.lit(False)) for f in fits])
    counts = df.agg(F.count(F.lit(1)), *[F.count_if(r).alias(f"r{k}") for k, r in enumerate(rows)]).first()
    cost = [counts[1 + at] * f.size.rounds * f.classes for at, f in zip(place, fits, strict=True)]
    order = sorted(range(len(fits)), key=lambda k: -cost[k])
    return counts[0], [order.index(k) for k in range(len(fits))]


def _coded(table: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """The table with the bin numbers of its features, a byte each, in place of the features."""
    width = len(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = np.ascontiguousarray(trees.coded(_matrix(b.column(1), width), edges))
            ends = np.arange(len(b) + 1, dtype=np.int32) * width
            x = pa.Array.from_buffers(pa.binary(), len(b), [None, pa.py_buffer(ends), pa.py_buffer(codes)])
            yield pa.RecordBatch.from_arrays([b.column(0), x, *b.columns[2:]], names=names)

    names = table.columns
    return table.mapInArrow(run, T.StructType([table.schema["key"], T.StructField("x", T.BinaryType()), *table.schema[2:]]))


def _alone(tables: list[DataFrame], edges: list[np.ndarray], facts: list[dict], keep: bool) -> DataFrame:
    """Each model in one task, all models side by side: for tables that a task holds. Features go there as bin numbers, and a
    task takes its rows as they come, unsorted: what is sampled and summed does not depend on their order."""
    width = len(edges)
    rows = reduce(DataFrame.unionAll, [
        _coded(t, edges).select("key", "x", F.explode("fits").alias("f")).select("key", "x", "f.*").filter("y IS NOT NULL OR s") for t in tables])
    rows = rows.repartitionById(len(facts), "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts = 0, ([], [], [], [], [])
        for b in batches:
            if not len(b):
                continue
            number = b.column("fit")[0].as_py()
            codes = np.frombuffer(b"".join(b.column("x").to_pylist()), np.uint8).reshape(len(b), width)
            flags = (b.column(n).to_numpy(zero_copy_only=False) for n in ("key", "y", "w", "s"))
            for part, values, kind in zip(parts, (codes, *flags), (np.uint8, np.int64, float, float, bool), strict=True):
                part.append(values.astype(kind))
        if not parts[0]:
            return
        codes, keys, y, w, s = (np.concatenate(part) for part in parts)
        parts[0].clear()
        (model, scores), = trees.fit(codes, keys, edges, [_work(facts[number], y, w)])
        yield _rows(number, keys, s, scores)
        if keep:
            yield _model(number, model)

    return rows.mapInArrow(run, _OUT)


def _distinct(columns: list) -> tuple[list, list[int]]:
    """The different ones of some columns, or tuples of columns, and the place of each among them."""
    def same(a, b) -> bool:
        if isinstance(a, tuple):
            return all(same(x, y) for x, y in zip(a, b, strict=True))
        return a is b or (a is not None and b is not None and a._jc.equals(b._jc))

    found, places = [], []
    for c in columns:
        place = next((k for k, other in enumerate(found) if same(c, other)), len(found))
        if place == len(found):
            found.append(c)
        places.append(place)
    return found, places


def _dealt_table(df: DataFrame, key: str, features: Column, fits: list[Fit]) -> tuple[DataFrame, list[dict]]:
    """``key, x, y, w, f``: each different label, weight and pair of row conditions of the models once, and where a model has its own."""
    labels, label = _distinct([f.label for f in fits])
    weights, weight = _distinct([F.lit(1.0) if f.weight is None else f.weight for f in fits])
    rows, row = _distinct([(f.train, f.score) for f in fits])

    def flag(train: Column, score: Column | None) -> Column:
        trains = F.when(F.coalesce(train, F.lit(False)), F.lit(1)).otherwise(F.lit(0))
        return (trains if score is None else trains + F.when(F.coalesce(score, F.lit(False)), F.lit(2)).otherwise(F.lit(0))).cast("byte")

    out = df.select(
        F.col(key).cast("long").alias("key"), features.alias("x"), F.array(*[finite(c.cast("double")) for c in labels]).alias("y"),
        F.array(*[c.cast("double") for c in weights]).alias("w"), F.array(*[flag(*r) for r in rows]).alias("f"))
    return out, [{"label": a, "weight": b, "rows": c} for a, b, c in zip(label, weight, row, strict=True)]


def _gathered(context, tasks: int, parts: np.ndarray) -> np.ndarray:
    """Sum over the tasks in pieces, so that the coordinator never holds more than EXCHANGE bytes. A gather takes a second."""
    piece = max(EXCHANGE // max(tasks, 1) // 8, 1024)
    total = np.zeros_like(parts)
    for at in range(0, len(parts), piece):
        message = base64.b64encode(zlib.compress(parts[at:at + piece].tobytes(), 1)).decode()
        for other in context.allGather(message):
            total[at:at + piece] += np.frombuffer(zlib.decompress(base64.b64decode(other)))
    return total


class _Shared:
    """Sums over the tasks of a barrier stage by files in a folder that all of them see.

    A task hands in its parts (``post``) and asks for the sums later, at most two steps at a time and in their order. It has four
    files of a kind and writes them in turn: who has read all files of a step has proof that all are done with the step two before,
    so by the time it hands in a step the file of four before may be replaced.
    """

    def __init__(self, folder: str, me: int, tasks: int):
        self.folder, self.me, self.tasks, self.step = folder, me, tasks, 0

    @staticmethod
    def _put(name: str, content: np.ndarray) -> None:
        """In place: a file system may write out at once what is cut off or renamed over another."""
        with os.fdopen(os.open(name, os.O_WRONLY | os.O_CREAT, 0o666), "wb", buffering=0) as f:
            rest = memoryview(np.ascontiguousarray(content)).cast("B")
            while len(rest):
                rest = rest[f.write(rest):]

    def _write(self, kind: str, step: int, values: np.ndarray) -> None:
        name = f"{self.folder}/{kind}-{self.me}-{step % 4}"
        if len(values):
            self._put(f"{name}.values", values)
        self._put(name, np.array([step], np.int64))  # only now the values count

    def _read(self, kind: str, step: int, who: int, first: int, count: int) -> np.ndarray:
        name, pause = f"{self.folder}/{kind}-{who}-{step % 4}", 0.0002
        while True:
            try:
                with open(name, "rb") as f:
                    if f.read(8) == np.int64(step).tobytes():
                        break
            except FileNotFoundError:
                pass
            time.sleep(pause)
            pause = min(pause * 1.5, 0.005)
        if not count:
            return np.zeros(0)
        with open(f"{name}.values", "rb", buffering=0) as f:
            f.seek(8 * first)
            out = np.empty(count)
            rest = memoryview(out).cast("B")
            while len(rest):
                got = f.readinto(rest)
                if not got:
                    raise EOFError(f"{name}: {len(rest)} bytes are missing")
                rest = rest[got:]
            return out

    def post(self, parts: np.ndarray) -> Callable[[], np.ndarray]:
        self.step += 1
        self._write("part", step := self.step, parts)
        return lambda: self._sum(step, len(parts))

    def __call__(self, parts: np.ndarray) -> np.ndarray:
        return self.post(parts)()

    def _sum(self, step: int, n: int) -> np.ndarray:
        cuts = [0, n] if n * self.tasks <= PIECES else [n * k // self.tasks for k in range(self.tasks + 1)]
        mine = 0 if len(cuts) == 2 else self.me
        total = np.zeros(cuts[mine + 1] - cuts[mine])
        for turn in range(self.tasks):
            total += self._read("part", step, (self.me + turn) % self.tasks, cuts[mine], len(total))
        if len(cuts) == 2:
            return total
        self._write("sum", step, total)
        return np.concatenate([self._read("sum", step, k, 0, cuts[k + 1] - cuts[k]) for k in range(self.tasks)])


def _exchange(tasks: int, folder: str | None):
    """``add`` for the tasks of a barrier stage, how many trees of a forest may share one call, and what ends it: by files in the
    checkpoint folder if all tasks see it, else by Spark's gathers."""
    from pyspark import BarrierTaskContext

    context = BarrierTaskContext.get()
    me, place = context.partitionId(), ""
    if me == 0 and folder:
        place = f"{folder}/exchange-{uuid.uuid4().hex}"
        try:
            os.makedirs(place)
        except OSError:
            place = ""
    place = context.allGather(place)[0]
    shared = all(seen == "1" for seen in context.allGather("1" if place and os.path.isdir(place) and os.access(place, os.W_OK) else "0"))
    files = _Shared(place, me, tasks) if shared else None

    def post(parts: list[np.ndarray]) -> Callable[[], list[np.ndarray]]:
        flat, shapes = np.concatenate([p.ravel() for p in parts]), [p.shape for p in parts]
        total = files.post(flat) if files else lambda: _gathered(context, tasks, flat)

        def sums() -> list[np.ndarray]:
            cuts = np.cumsum([int(np.prod(shape)) for shape in shapes])[:-1]
            return [part.reshape(shape) for part, shape in zip(np.split(total(), cuts), shapes, strict=True)]

        return sums

    def add(parts: list[np.ndarray]) -> list[np.ndarray]:
        return post(parts)()

    add.post = post
    def end() -> None:
        if shared:
            context.barrier()
            if me == 0:
                shutil.rmtree(place, ignore_errors=True)

    return add, 1 if shared else 10, end


class _Lines:
    """Rows that come in batches, by column: gathered in memory, or in nameless files of the folder of ``room``."""

    def __init__(self, lines: int, kind: type, room: trees.Room):
        self.kind, self.room, self.n = kind, room, 0
        self.parts = [[] if room.folder is None else tempfile.TemporaryFile(dir=room.folder) for _ in range(lines)]

    def add(self, rows: np.ndarray) -> None:
        self.n += len(rows)
        for part, line in zip(self.parts, np.ascontiguousarray(rows.T.astype(self.kind, copy=False)), strict=True):
            if self.room.folder is None:
                part.append(line)
            else:
                part.write(line.tobytes())

    def whole(self) -> np.ndarray:
        """Line by line; what was gathered is let go."""
        out = self.room.empty((len(self.parts), self.n), self.kind)
        for line, part in zip(out, self.parts, strict=True):
            if self.room.folder is None:
                line[:] = np.concatenate(part) if part else 0
                part.clear()
                continue
            part.seek(0)
            for s in trees.steps(self.n, trees.CHUNK):
                line[s] = np.frombuffer(part.read((s.stop - s.start) * line.itemsize), self.kind)
                self.room.rest()
            part.close()
        return out


def _own_folder() -> str:
    """A folder of this task's machine: the first that Spark spills to, if there is one."""
    for place in os.environ.get("SPARK_LOCAL_DIRS", "").split(","):
        if place and os.path.isdir(place) and os.access(place, os.W_OK):
            return place
    return tempfile.gettempdir()


def _dealt(table: DataFrame, edges: list[np.ndarray], facts: list[dict], keep: bool, tasks: int, wave: int, rows: int) -> DataFrame:
    """All models over the rows of many tasks: a barrier stage in which each keeps its rows once, and levels of histograms are
    summed, ``wave`` models at a time. Rows that outgrow HELD_BYTES of a task lie in files, so its memory does not grow with them.
    If a task is lost Spark starts the stage again."""
    from tremorframe.session import ensure_checkpoint_dir

    width = len(edges)
    place = urlparse(ensure_checkpoint_dir(table.sparkSession))
    folder = unquote(place.path) if place.scheme in ("", "file") and not place.netloc else None
    lines = [1 + max(f[n] for f in facts) for n in ("label", "weight", "rows")]
    spools = rows // tasks * (width + 8 + 8 * lines[0] + 8 * lines[1] + lines[2] + ROW_BYTES * min(wave, len(facts))) > HELD_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import BarrierTaskContext

        room = trees.Room(_own_folder() if spools else None)
        parts = [_Lines(n, kind, room) for n, kind in zip((1, width, *lines), (np.int64, np.uint8, float, float, np.uint8), strict=True)]
        for b in batches:
            parts[0].add(b.column(0).to_numpy()[:, None])
            parts[1].add(np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(len(b), width))
            for part, column in zip(parts[2:], b.columns[2:], strict=True):
                part.add(column.flatten().to_numpy(zero_copy_only=False).reshape(len(b), len(part.parts)))
        (ids,), matrix, y, w, flags = (part.whole() for part in parts)
        add, together, end = _exchange(tasks, folder)
        first = BarrierTaskContext.get().partitionId() == 0

        def work(f: dict) -> trees.Work:
            labels, active, rows = room.empty((len(ids),), float), room.empty((len(ids),), bool), flags[f["rows"]]
            for s in trees.steps(len(ids), trees.CHUNK):
                labels[s] = np.where(rows[s] & 1, y[f["label"], s], np.nan)
                np.greater_equal(rows[s], 2, out=active[s])
                room.rest()
            return _work(f, labels, w[f["weight"]], active)

        order = sorted(range(len(facts)), key=lambda k: (facts[k]["size"].bagged, facts[k]["objective"]))  # like ones draw the same rows
        for at in range(0, len(facts), wave):
            works = [work(facts[k]) for k in order[at:at + wave]]
            for k, (model, scores) in zip(order[at:at + wave], trees.fit(matrix.T, ids, edges, works, add, together, room), strict=True):
                for s in trees.steps(len(ids), 4 * trees.CHUNK):
                    yield _rows(k, ids[s], flags[facts[k]["rows"], s] >= 2, scores[s])
                    room.rest()
                if keep and first:
                    yield _model(k, model)
                room.back(scores)
            for used in works:
                room.back(used.labels, used.active)
        end()

    # in the order of the keys: a time fold's rows lie together
    return _coded(table, edges).repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(run, _OUT, barrier=True)


def fit_all(df: DataFrame, key: str, columns: list[str], fits: list[Fit], keep: bool = False, features: str | None = None,
            shard_rows: int | None = None) -> DataFrame:
    """``key, fit, score, model``: predictions of every model for the rows that it scores, by the number of the fit; with ``keep`` a
    row per model too, with its trees (and no key).

    ``key`` is a unique whole number; it decides what a model samples, so results do not depend on partitions. Up to
    ``shard_rows`` rows each model is one task and the models run side by side. Beyond that the rows stay dealt over all task slots
    and the models grow level by level together (waves of WAVE at most); both ways give the same trees. ``features`` names an array
    column of all ``columns`` if there is one already.
    """
    from tremorframe.session import durable, landed

    vector = F.col(features) if features else clean(columns)
    flat = df.select("*", *[F.get(features, k).alias(f"_x{k}") for k in range(len(columns))]) if features else df
    edges = bin_edges(flat, [f"_x{k}" for k in range(len(columns))] if features else columns)
    facts = [{"objective": f.objective, "size": f.size, "classes": f.classes, "late_weight": f.late_weight, "leaf_edges": f.leaf_edges,
              "weighted": f.weight is not None} for f in fits]
    limit = shard_rows or SHARD_ROWS
    n, order = _by_cost(df, fits)
    if n <= limit:
        # a wide array of models would not compile into one method
        tables = [_table(df, key, vector, fits[at:at + 24], order, at) for at in range(0, len(fits), 24)]
        return durable(_alone(tables, edges, facts, keep))
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, 1)
    wave = min(max(WAVE_BYTES * tasks // (n * ROW_BYTES), 1), WAVE)
    table, places = _dealt_table(df, key, vector, fits)
    # files, not a checkpoint: a checkpointed barrier stage would still count as one in what reads it
    return landed(_dealt(table, edges, [f | p for f, p in zip(facts, places, strict=True)], keep, tasks, wave, n), "dealt-models")


def scores_by_key(found: DataFrame, fits: list[Fit], where: str = "key") -> DataFrame:
    """A row per key with a column per name; several fits of one name (folds) fill it together. Arrays stay for several classes."""
    picked = {}
    for k, f in enumerate(fits):
        value = F.col("score") if f.classes > 1 else F.get("score", F.lit(0))
        before = picked.get(f.name)
        picked[f.name] = F.when(F.col("fit") == k, value) if before is None else before.when(F.col("fit") == k, value)
    return found.filter("key IS NOT NULL").groupBy(F.col("key").alias(where)).agg(*[F.max(v).alias(n) for n, v in picked.items()])


class TreeModel(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted trees as a pipeline stage: adds ``output`` from the ``columns``. Saves and loads with its trees."""

    columns = Param(Params._dummy(), "columns", "feature columns", TypeConverters.toListString)
    output = Param(Params._dummy(), "output", "name of the added column", TypeConverters.toString)
    content = Param(Params._dummy(), "content", "the trees", TypeConverters.toString)
    classes = Param(Params._dummy(), "classes", "values of an output array, or 1", TypeConverters.toInt)

    @keyword_only
    def __init__(self, columns: list[str] | None = None, output: str = "prediction", content: str = "", classes: int = 1):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @staticmethod
    def of(raw: bytes, columns: list[str], output: str, classes: int = 1) -> TreeModel:
        return TreeModel(columns=list(columns), output=output, content=base64.b64encode(raw).decode(), classes=classes)

    def trees(self) -> trees.Model:
        return trees.Model.read(base64.b64decode(self.getOrDefault("content")))

    def _transform(self, df: DataFrame) -> DataFrame:
        held = df.sparkSession.sparkContext.broadcast(base64.b64decode(self.getOrDefault("content")))
        many = self.getOrDefault("classes") > 1

        def predict(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = trees.Model.read(held.value)
            for x in parts:
                out = model.predict(np.stack(x.to_list())) if len(x) else np.zeros((0, 1))
                yield pd.Series(list(out)) if many else pd.Series(out[:, 0])

        predict.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
        scored = F.pandas_udf(predict, "array<double>" if many else "double")
        return df.withColumn(self.getOrDefault("output"), scored(clean(self.getOrDefault("columns"))))


def models_of(found: DataFrame, fits: list[Fit], columns: list[str]) -> dict[str, TreeModel]:
    """The kept models by name. The driver holds the trees, whose size does not depend on the rows."""
    rows = {r["fit"]: bytes(r["model"]) for r in found.filter("model IS NOT NULL").select("fit", "model").collect()}
    return {f.name: TreeModel.of(rows[k], columns, f.name, f.classes) for k, f in enumerate(fits) if k in rows}
