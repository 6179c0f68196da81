"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is labelled good or bad from byte-level features of itself and of the lines before and
after it.  Forward-backward gives each line's marginal probability of being good; a document's
score is the mean of its marginals weighted by line length in bytes.

Training maximises the penalised conditional likelihood with L-BFGS on the driver.  Lines take the
label of their document.  It sees a bounded sample: at most ``SAMPLE_DOCS`` labelled documents of at
most ``SAMPLE_BYTES`` bytes, those with the smallest hash of their id.  Scoring covers every document
in one pass without a shuffle.

Defined cases: a document without any line (null or empty text, or blank lines only) scores the share of good
documents in the training sample; without usable labels every document scores 0.5.  Repeated rows
score alike.  Several labels of one id count by their mean.  A null id has no label.  Other columns
pass through unread; one named like the score column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from slatewise.llm.text import IS_SPACE, blocks, words

SAMPLE_DOCS = 4000
SAMPLE_BYTES = 200_000
PENALTY = 1.0
ROUNDS = 80

NEWLINE = ord("\n")
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)),
    "digit": b"0123456789",
    "stop": b".,;:'\"()-?",
    "bang": b"!",
    "bar": b"|",
    "symbol": b"#$%&*+/<=>@[\\]^_`{}~",
}
OWN = (*CLASSES, "space", "length", "word length", "repeats", "ends", "capital", "same as last")
NEIGHBOUR = ("upper", "digit", "bang", "bar", "symbol", "repeats")
FEATURES = ("bias", *OWN, *(f"{side} {x}" for side in ("before", "after") for x in NEIGHBOUR), "first", "last")

_TABLES = [np.isin(np.arange(256, dtype=np.uint8), np.frombuffer(chars, np.uint8)) for chars in CLASSES.values()] + [IS_SPACE]


def _counts(marks: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])[cuts])


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines x features), bytes of each line, and lines of each row, blank lines left out."""
    breaks = np.flatnonzero(data == NEWLINE) + 1
    cuts = np.unique(np.concatenate([offsets, breaks]))
    size = np.diff(cuts)
    per_class = [_counts(table[data], cuts) for table in _TABLES]
    solid = size - per_class[-1] > 0
    # words by line, with the share of words that repeat one of the three before
    hashes, bounds = words(data, cuts)
    n_words = np.diff(bounds)
    again = np.zeros(len(hashes), bool)
    for lag in (1, 2, 3):
        again[lag:] |= hashes[lag:] == hashes[:-lag]
    repeats = _counts(again, bounds) / np.maximum(n_words, 1)
    totals = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes, dtype=np.uint64)])
    print_of = np.diff(totals[bounds])
    lines = np.flatnonzero(solid)
    row = np.searchsorted(offsets, cuts[:-1], "right")[lines] - 1
    width = np.maximum(size[lines] - per_class[-1][lines], 1).astype(float)
    own = {name: per_class[i][lines] / width for i, name in enumerate(CLASSES)}
    own["space"] = per_class[-1][lines] / size[lines]
    own["length"] = np.log1p(size[lines]) / 5
    own["word length"] = np.log1p(width / np.maximum(n_words[lines], 1)) / 3
    own["repeats"] = repeats[lines]
    last = np.maximum(cuts[1:] - 1 - (data[cuts[1:] - 1] == NEWLINE if len(data) else 0), 0)[lines]
    own["ends"] = np.isin(data[last], np.frombuffer(b".!?:;\"", np.uint8)).astype(float)
    head = data[cuts[:-1]][lines]
    own["capital"] = ((head >= 65) & (head <= 90) | (head >= 194)).astype(float)
    same_row = np.zeros(len(lines), bool)
    same_row[1:] = row[1:] == row[:-1]
    marks = print_of[lines]
    own["same as last"] = np.zeros(len(lines))
    own["same as last"][1:] = same_row[1:] & (marks[1:] == marks[:-1])
    columns = [np.ones(len(lines)), *(own[x] for x in OWN)]
    follows = np.append(same_row[1:], False)
    for there, step in ((same_row, 1), (follows, -1)):
        columns += [np.where(there, np.roll(own[x], step), 0.0) for x in NEIGHBOUR]
    columns += [~same_row, ~follows]
    return np.stack(columns, 1).astype(np.float32) if len(lines) else np.zeros((0, len(FEATURES)), np.float32), size[lines], np.bincount(row, minlength=len(offsets) - 1)


def forward_backward(unary: np.ndarray, counts: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of 'good' per line, expected moves (2 x 2) and the summed log normaliser.

    unary: log potential of 'good' against 'bad' for each line, rows one after another; counts: lines of each row.
    All rows advance together, the longest first, so that step t works on a prefix of them.
    """
    rows = np.argsort(-counts, kind="stable")
    rows = rows[counts[rows] > 0]
    starts = (np.cumsum(counts) - counts)[rows]
    n = counts[rows]
    shape = np.exp(moves)
    unary = np.clip(unary, -60, 60)
    good = 1 / (1 + np.exp(-unary))
    here = np.stack([1 - good, good], 1)  # potentials scaled to sum to one; the scale goes into the normaliser
    scale = float(np.logaddexp(0, unary).sum())
    ahead = np.zeros((len(unary), 2))
    behind = np.ones((len(unary), 2))
    if not len(rows):
        return good, np.zeros((2, 2)), 0.0
    active = [int(np.searchsorted(-n, -t, "left")) for t in range(int(n[0]))]  # rows with more than t lines
    for t, m in enumerate(active):
        at = starts[:m] + t
        a = here[at] if t == 0 else (ahead[at - 1] @ shape) * here[at]
        total = a.sum(1, keepdims=True)
        scale += float(np.log(total).sum())
        ahead[at] = a / total
    expected = np.zeros((2, 2))
    for t in range(len(active) - 1, 0, -1):
        at = starts[: active[t]] + t
        b = here[at] * behind[at]
        back = b @ shape.T
        pair = ahead[at - 1][:, :, None] * shape[None] * b[:, None, :]
        expected += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
        behind[at - 1] = back / back.sum(1, keepdims=True)
    both = ahead * behind
    return both[:, 1] / both.sum(1), expected, scale


def _loss(theta: np.ndarray, x: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> tuple[float, np.ndarray]:
    w, moves = theta[:-4], theta[-4:].reshape(2, 2)
    unary = x @ w
    marginal, expected, scale = forward_backward(unary, counts, moves)
    each = np.repeat(labels, counts)
    seen = np.zeros((2, 2))
    steps = np.maximum(counts - 1, 0)
    seen[0, 0], seen[1, 1] = steps[labels == 0].sum(), steps[labels == 1].sum()
    likelihood = float((unary * each).sum() + (moves * seen).sum()) - scale
    gradient = np.concatenate([x.T @ (each - marginal), (seen - expected).ravel()])
    n = max(1, len(counts))
    return (-likelihood + PENALTY * float(theta @ theta) / 2) / n, (-gradient + PENALTY * theta) / n


def fit(x: np.ndarray, counts: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weights by limited-memory quasi-Newton steps with backtracking."""
    theta = np.zeros(x.shape[1] + 4)
    value, slope = _loss(theta, x, counts, labels)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, passed = slope.copy(), []
        for s, y in reversed(pairs):
            a = s @ q / (y @ s)
            passed.append(a)
            q -= a * y
        q *= pairs[-1][0] @ pairs[-1][1] / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(1.0, float(np.abs(slope).sum()))
        for (s, y), a in zip(pairs, reversed(passed), strict=True):
            q += s * (a - y @ q / (y @ s))
        step = 1.0
        while step > 1e-6:
            trial = theta - step * q
            new, new_slope = _loss(trial, x, counts, labels)
            if new <= value - 1e-4 * step * float(slope @ q):
                break
            step /= 2
        else:
            break
        if (new_slope - slope) @ (trial - theta) > 1e-12:
            pairs = [*pairs, (trial - theta, new_slope - slope)][-8:]
        done = value - new < 1e-7
        theta, value, slope = trial, new, new_slope
        if done:
            break
    return theta


def training_sample(documents: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_docs: int) -> DataFrame:
    """One row per sampled document: its features as bytes, its lines and its label."""
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).cast("long").alias("_id"))
        .agg((F.avg(label_col) >= 0.5).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(sample_docs)
    )
    texts = documents.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    # the chosen side has at most sample_docs rows of two numbers
    rows = texts.where(F.octet_length("_text") <= SAMPLE_BYTES).join(F.broadcast(chosen), "_id")
    # an id may hold a third of all rows: each map task keeps one text of it before anything is shuffled or measured
    first = rows.groupBy("_id", "_label").agg(F.min(F.struct(F.xxhash64("_text"), "_text")).alias("_row"))
    sampled = first.select("_id", F.col("_row._text").alias("_text"), "_label")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labelled = batch.column(0), batch.column(2)
            for a, b, data, offsets in blocks(batch.column(1)):
                x, _, counts = line_features(data, offsets)
                ends = np.cumsum(counts)
                cells = [x[e - c : e].tobytes() for c, e in zip(counts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), labelled.slice(a, b - a), pa.array(cells, pa.binary())], names=["_id", "_label", "x"])

    return sampled.select("_id", "_text", "_label").mapInArrow(measured, "_id long, _label int, x binary")


def train(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = SAMPLE_DOCS) -> dict:
    """Fit the field on the bounded sample; a model is its weights and the share of good documents."""
    rows = training_sample(documents, labels, id_col, text_col, label_col, sample_docs).toPandas()
    rows = rows.sort_values("_id") if len(rows) else rows
    marks = rows["_label"].to_numpy(int) if len(rows) else np.zeros(0, int)
    cells = [np.frombuffer(x, np.float32).reshape(-1, len(FEATURES)) for x in rows["x"]] if len(rows) else []
    counts = np.array([len(x) for x in cells], int)
    if not counts.sum():
        return {"theta": np.zeros(len(FEATURES) + 4), "prior": float(marks.mean()) if len(marks) else 0.5, "sampled": len(rows)}
    theta = fit(np.concatenate(cells).astype(np.float64), counts, marks)
    return {"theta": theta, "prior": float(marks.mean()), "sampled": len(rows)}


def score(documents: DataFrame, model: dict, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of `documents` and the length-weighted mean marginal of each whole text."""
    theta, prior = model["theta"], model["prior"]
    w, moves = theta[:-4], theta[-4:].reshape(2, 2)
    documents = documents.drop(score_col)
    names = documents.columns
    at = names.index(text_col)
    schema = StructType([*documents.schema.fields, StructField(score_col, DoubleType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full(batch.num_rows, prior)
            for a, _, data, offsets in blocks(batch.column(at)):
                x, size, counts = line_features(data, offsets)
                marginal, _, _ = forward_backward(x.astype(np.float64) @ w, counts, moves)
                row = np.repeat(np.arange(len(counts)), counts)
                weight = np.bincount(row, size, len(counts))
                mean = np.bincount(row, size * marginal, len(counts)) / np.maximum(weight, 1)
                full = np.flatnonzero(weight)
                out[a + full] = mean[full]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.clip(out, 0.0, 1.0))], names=[*names, score_col])

    return documents.mapInArrow(scored, schema)
