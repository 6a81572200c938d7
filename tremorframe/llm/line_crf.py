"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad from its own features and those of the lines before and after it; the
marginals of the forward-backward pass, weighted by the lines' lengths, are the document's score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorframe.llm.common import read_table, travels
from tremorframe.session import durable

travels(__name__)

THRESHOLD = 0.3
#: The bounded training sample: labelled documents, and lines in all; texts with more lines than LONG are left out of it.
SAMPLE_DOCS, SAMPLE_LINES, LONG = 6_000, 150_000, 5_000
BINS = 8
#: Rows that a task scores at a time.
ROWS = 1_000

# Byte classes; a byte may belong to several.
_CLASSES = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>@^~=+_\\{}[]", b"|", b"!?", b".,;:", b"\"'()-/", bytes(range(0xC2, 0xF5)))
_LETTER = np.zeros(256, bool)
_LETTER[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", *range(0x80, 0x100)]] = True
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\r\x0b\x0c")] = True
N_FEATURES = len(_CLASSES) + 7


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines, bytes of each line, lines of each text); every text has at least one, maybe empty, line."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    lengths = ends - starts
    text_ends = np.cumsum([len(r) + 1 for r in raw])
    of_text = np.searchsorted(text_ends, starts, side="right")
    n_lines = np.bincount(of_text, minlength=len(raw))

    def per_line(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return (total[ends] - total[starts]).astype(np.float64)

    size = np.maximum(lengths, 1)
    columns = []
    for members in _CLASSES:
        table = np.zeros(256, bool)
        table[list(members)] = True
        columns.append(per_line(table[data]) / size)
    blank = _BLANK[data]
    first = ~blank & np.concatenate([[True], blank[:-1]])
    begins = np.flatnonzero(first)
    stops = np.flatnonzero(~blank & np.concatenate([blank[1:], [True]])) + 1
    words = per_line(first)
    short = np.zeros(len(data), bool)
    short[begins[(stops - begins) <= 3]] = True
    columns += [per_line(_LETTER[data]) / size, np.log1p(lengths), (lengths - per_line(blank)) / np.maximum(words, 1),
                per_line(short) / np.maximum(words, 1), np.log1p(words)]
    # repeated lines of a text, and repeated words of a line
    seen: dict[tuple[int, bytes], int] = {}
    repeated, same = np.zeros(len(ends)), np.zeros(len(ends))
    view = data.tobytes()
    for i, (a, b, t) in enumerate(zip(starts.tolist(), ends.tolist(), of_text.tolist(), strict=True)):
        line = view[a:b]
        if b > a:
            key = (t, line)
            repeated[i] = key in seen
            seen[key] = i
            parts = line.split()
            same[i] = 1 - len(set(parts)) / len(parts) if parts else 0
    return np.column_stack([*columns, repeated, same]), lengths, n_lines


@dataclass
class Model:
    cuts: list[np.ndarray]   # per feature
    weights: np.ndarray      # (3 x bins of all features + border flags, 2): log-odds parts of the two states
    move: np.ndarray         # (2, 2)
    scale: tuple[float, float]  # calibration of the document's score


def _binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Column number of each line's bin, per feature."""
    out, at = np.empty((len(x), len(cuts)), np.int64), 0
    for j, c in enumerate(cuts):
        out[:, j] = at + np.searchsorted(c, x[:, j], side="left")
        at += len(c) + 1
    return out


def _places(binned: np.ndarray, n_lines: np.ndarray, width: int) -> np.ndarray:
    """Active weights of every line: its own bins, those of the lines before and after; a missing line is one more bin."""
    first = np.cumsum(n_lines) - n_lines
    last = first + n_lines - 1
    before, after = np.roll(binned, 1, axis=0) + width, np.roll(binned, -1, axis=0) + 2 * width
    before[first], after[last] = 3 * width, 3 * width + 1
    return np.concatenate([binned, before, after, np.full((len(binned), 1), 3 * width + 2)], axis=1)


def _marginals(emit: np.ndarray, move: np.ndarray, n_lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over all texts at once: P(state) of every line and the expected moves (2, 2)."""
    order = np.argsort(-n_lines, kind="stable")
    first = (np.cumsum(n_lines) - n_lines)[order]
    sizes = n_lines[order]
    most = int(sizes[0]) if len(sizes) else 0
    active = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(most)]  # texts with more than t lines
    table = np.exp(move)
    local = np.exp(emit - emit.max(axis=1, keepdims=True))
    alpha, beta = np.empty_like(local), np.ones_like(local)
    for t in range(most):
        at = first[:active[t]] + t
        a = local[at] if t == 0 else (alpha[at - 1] @ table) * local[at]
        alpha[at] = a / a.sum(axis=1, keepdims=True)
    moves = np.zeros((2, 2))
    for t in range(most - 2, -1, -1):
        at = first[:active[t + 1]] + t
        b = local[at + 1] * beta[at + 1]
        pair = alpha[at][:, :, None] * table[None] * b[:, None, :]
        moves += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        b = b @ table.T
        beta[at] = b / b.sum(axis=1, keepdims=True)
    post = alpha * beta
    return post / post.sum(axis=1, keepdims=True), moves


def _text_scores(good: np.ndarray, lengths: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    first = np.cumsum(n_lines) - n_lines
    weight = np.maximum(lengths, 1).astype(np.float64)
    return np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first) if len(n_lines) else np.zeros(0)


def fit(x: np.ndarray, lengths: np.ndarray, n_lines: np.ndarray, y: np.ndarray, rounds: int = 150, l2: float = 2.0) -> Model:
    """Maximise the likelihood of the lines' labels (the text's label on each), a text counting once.

    Adam with a fixed number of rounds; deterministic. With one label only, or no text, the model answers the base rate.
    """
    # quantiles for where the lines are, equal steps for the rare far ends
    inner = np.linspace(0, 1, BINS + 1)[1:-1]
    cuts = [np.unique(np.concatenate([np.quantile(c, inner), c.min() + inner * (c.max() - c.min())])) if len(c) else np.zeros(0) for c in x.T]
    width = sum(len(c) + 1 for c in cuts)
    weights, move = np.zeros((3 * width + 3, 2)), np.zeros((2, 2))
    rate = (y.sum() + 1) / (len(y) + 2)
    if not len(y) or y.min() == y.max():
        return Model(cuts, weights, move, (0.0, float(np.log(rate / (1 - rate)))))
    places = _places(_binned(x, cuts), n_lines, width)
    label = np.repeat(y.astype(np.int64), n_lines)
    per = np.repeat(1 / n_lines, n_lines)
    goes_on = np.ones(len(label), bool)
    goes_on[np.cumsum(n_lines) - 1] = False
    pair_at = np.flatnonzero(goes_on)
    seen_moves = np.zeros((2, 2))
    np.add.at(seen_moves, (label[pair_at], label[pair_at + 1]), 1)
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(move), np.zeros_like(move)]
    for k in range(1, rounds + 1):
        post, moves = _marginals(weights[places].sum(axis=1), move, n_lines)
        error = (np.eye(2)[label] - post) * per[:, None]
        grad = np.column_stack([np.bincount(places.ravel(), np.repeat(error[:, s], places.shape[1]), len(weights)) for s in (0, 1)])
        grads = (grad - l2 * weights / 10, (seen_moves - moves) * len(y) / max(len(label), 1) - l2 * move)
        for p, g, m, v in ((weights, grads[0], state[0], state[1]), (move, grads[1], state[2], state[3])):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p += 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    model = Model(cuts, weights, move, (1.0, 0.0))
    return Model(cuts, weights, move, _calibrated(_scores(x, lengths, n_lines, model), y))


def _log_odds(s: np.ndarray) -> np.ndarray:
    s = np.clip(s, 1e-4, 1 - 1e-4)
    return np.log(s / (1 - s))


def _calibrated(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on the score's log odds, by Newton steps with a small ridge."""
    z = np.column_stack([_log_odds(s), np.ones(len(s))])
    w = np.array([1.0, 0.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-z @ w))
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        w = w + np.linalg.solve(h, z.T @ (y - p) - 1e-2 * (w - [1.0, 0.0]))
    return max(float(w[0]), 1e-3), float(w[1])


def _scores(x: np.ndarray, lengths: np.ndarray, n_lines: np.ndarray, model: Model) -> np.ndarray:
    if not len(n_lines):
        return np.zeros(0)
    width = sum(len(c) + 1 for c in model.cuts)
    emit = model.weights[_places(_binned(x, model.cuts), n_lines, width)].sum(axis=1)
    post, _ = _marginals(emit, model.move, n_lines)
    return _text_scores(post[:, 1], lengths, n_lines)


def score_texts(texts: list[str | None], model: Model) -> np.ndarray:
    s = _scores(*line_features(texts), model)
    return 1 / (1 + np.exp(-(model.scale[0] * _log_odds(s) + model.scale[1])))


def held_out():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES,
          longest: int = LONG) -> Model:
    """Fit on at most ``sample_docs`` labelled, not held-out documents, chosen by a hash of the id.

    The sample also ends before the first text that would pass ``sample_lines`` lines in all, and texts of more than
    ``longest`` lines teach nothing (they are scored like any other): what the driver holds is bounded by these three.
    Rows with a null id or label teach nothing; of repeated labels of one id the lowest counts, of repeated
    documents each one does. The executors turn texts into features; only these reach the driver.
    """
    marks = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(~held_out()) \
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    chosen = durable(marks.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(sample_docs))
    # at most sample_docs rows
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = part.column(2).to_pylist()
                short = [i for i, t in enumerate(texts) if (t or "").count("\n") < longest]
                x, lengths, n_lines = line_features([texts[i] for i in short])
                ends = np.cumsum(n_lines)
                yield pa.RecordBatch.from_arrays([
                    pa.array([part.column(0)[i].as_py() for i in short], pa.int64()),
                    pa.array([float(part.column(1)[i].as_py()) for i in short], pa.float64()),
                    pa.array(n_lines, pa.int64()),
                    pa.array([x[e - n:e].astype("<f4").tobytes() for e, n in zip(ends, n_lines, strict=True)], pa.binary()),
                    pa.array([lengths[e - n:e].astype("<i8").tobytes() for e, n in zip(ends, n_lines, strict=True)], pa.binary()),
                ], ["doc_id", "quality", "n_lines", "x", "lengths"])

    found = durable(rows.mapInArrow(run, "doc_id long, quality double, n_lines long, x binary, lengths binary"))
    # a hash of the content breaks ties, so that the order is the same whatever the partitions
    ordered = found.withColumn("h", F.xxhash64("doc_id", F.lit(5))).orderBy("h", "doc_id", F.xxhash64("x")).limit(sample_docs)
    kept, total = [], 0
    for r in ordered.toLocalIterator():
        if total + r.n_lines > sample_lines:
            break
        total += r.n_lines
        kept.append(r)
    x = np.concatenate([np.frombuffer(r.x, "<f4").reshape(-1, N_FEATURES) for r in kept]).astype(np.float64) if kept else np.zeros((0, N_FEATURES))
    lengths = np.concatenate([np.frombuffer(r.lengths, "<i8") for r in kept]) if kept else np.zeros(0, np.int64)
    return fit(x, lengths, np.array([r.n_lines for r in kept], np.int64), np.array([float(r.quality > 0) for r in kept]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``.

    A null text is one empty line, like an empty one, and is scored as such. Other columns are never read; an empty
    table gives an empty result. The model (some thousand numbers) travels with the tasks.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(score_texts(rows.column(1).to_pylist(), model), pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with a score of at least the threshold, with their own columns: decided row by row, no join."""
    schema, place = docs.schema, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                texts = [None if t is None else str(t) for t in rows.column(place).to_pylist()]
                yield rows.filter(pa.array(score_texts(texts, model) >= THRESHOLD))

    return docs.mapInArrow(run, schema)


def op5_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return score(docs, train(docs, labels))
