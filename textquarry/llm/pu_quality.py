"""Quality by positive-unlabelled learning with the non-negative risk.

Trusted positives and unlabelled web text are all that is learned from; labels of another kind are not read.  With
the squared loss ``(1 - y f)^2 / 4`` of a linear score ``f`` the risk

    prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)])

depends on the data through first and second moments alone.  One distributed pass over every training row
sums them, a fixed number of values whatever the input, and the risk is then minimised exactly: for a weight
``t`` in [0, 1] on the second term the minimiser solves a linear system, and bisection finds the largest ``t``
at which that term is not negative.

* **The class prior** is estimated from the same moments: ``prior * p_p(x) / p(x)`` that fits best in the sense of
  Pearson's divergence has ``prior = 1 / (m_p' G_u^-1 m_p)``, with the positives' means and all rows' second moments.
* **Features.**  Words, pairs of words and runs of four bytes are hashed into 2^18 buckets each; their damped counts,
  of length one, are projected by fixed random signs to ``SKETCH`` values, which keeps inner products in the mean.
  Beside them stand counts over the whole text (symbols, capitals, digits, repeats, lengths), as they are and as
  steps at fixed edges, all of them times the text's *familiarity*.
* **Familiarity** is the mean over a text's runs of four bytes of ``p / (p + 4 u)``: ``p`` is the bucket's share of the
  positives' runs, ``u`` that of a bucket if all were alike.  So surface counts speak for a text only as far as its
  letters do.
* **The offset** of ``f`` is -1 and not learned: a text is bad until its features say otherwise.

``1 / (1 + exp(-2 f))`` is the score.  Identifiers, sources, languages and labels are no features.

Defined cases: a null text counts as empty; empty texts have a score as any other; without positives or
training rows every score is 0.5; a document is positive if any of its label rows says 1; a null identifier
is unlabelled; rows may repeat; an empty table gives an empty result; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filter_bit, filter_bits, membership, possible_members, written
from .textstats import gram_buckets, repeated_window_words, slices, word_codes

EDGES = np.array([0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75])
RIDGE, OFFSET = 0.003, -1.0
STATS = 11
BITS, GRAM, SKETCH = 18, 4, 512
WIDTH = 1 + SKETCH + 1 + STATS + STATS * len(EDGES)
#: The damping of the estimated prior, at any size and by the number of rows (with few of them the moments fit their own
#: rows better than others, which would make the prior too small), and its bounds.
DAMPING, DAMPING_BY_ROWS, PRIOR_LEAST, PRIOR_MOST = 0.001, 10.0, 0.02, 0.98
#: Values of a sum that travel in one row, and texts whose features are held at a time.
BLOCK, HELD = 1024, 512
_MIX = np.uint64(0x9E3779B97F4A7C15)
_draw = np.random.default_rng(7)
PLACE, SIGN = _draw.integers(0, SKETCH, 1 << BITS), _draw.choice(np.array([-1.0, 1.0]), 1 << BITS)


def text_stats(data: bytes, words: list[bytes]) -> list[float]:
    """Statistics of one whole UTF-8 text, each about 0 to 1."""
    codes, distinct = word_codes(words)
    counts = np.bincount(np.frombuffer(data, "u1"), minlength=256)
    n, chars = max(len(words), 1), max(sum(map(len, words)), 1)
    symbols = counts[[35, 42, 36, 37, 38, 124, 60, 62]].sum()
    rows = [x for x in data.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    lines = max(len(rows), 1)
    same = int((codes[1:] == codes[:-1]).sum())
    upper, digits, calls = counts[65:91].sum(), counts[48:58].sum(), counts[33]
    repeated = repeated_window_words(codes, distinct)
    return [symbols / n, 5 * upper / chars, repeated / n, (len(rows) - len(set(rows))) / lines, 1 - distinct / n, 5 * digits / chars, calls / n, same / n, chars / n / 10, np.log1p(len(words)) / 10, n / lines / 50]


def word_buckets(words: list[bytes]) -> np.ndarray:
    """Buckets of the words and of the pairs of words that follow one another."""
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, words), "<u8", len(words))
    two = (one[:-1] * _MIX ^ one[1:]) * _MIX
    return (np.concatenate([one, two]) >> np.uint64(64 - BITS)).astype("i8")


def sketched(buckets: list[np.ndarray]) -> np.ndarray:
    """The projection of ``1 + log(count)`` of each bucket, divided by the length before it is projected."""
    if sum(map(len, buckets)) > 1 << BITS:
        counts = np.zeros(1 << BITS, "i8")
        for part in buckets:
            counts += np.bincount(part, minlength=1 << BITS)
        at = np.flatnonzero(counts)
        counts = counts[at]
    elif any(map(len, buckets)):
        at, counts = np.unique(np.concatenate(buckets), return_counts=True)
    else:
        return np.zeros(SKETCH)
    value = 1 + np.log(counts)
    return np.bincount(PLACE[at], weights=SIGN[at] * value, minlength=SKETCH) / np.sqrt((value * value).sum())


def features(data: bytes, known: np.ndarray) -> np.ndarray:
    """1, the sketch, and the surface counts times the familiarity under ``known``, the table of ``familiar``."""
    words = data.split()
    grams = [gram_buckets(part, GRAM, BITS) for part in slices(data, GRAM)]
    n = sum(map(len, grams))
    familiarity = sum(float(known[g].sum()) for g in grams) / n if n else 0.0
    sketch = (sketched([word_buckets(words)]) + sketched(grams)) / np.sqrt(2)
    stats = np.array(text_stats(data, words))
    steps = (stats[:, None] > EDGES).ravel()
    return np.concatenate([[1.0], sketch, familiarity * np.concatenate([[1.0], np.clip(stats, 0, 1), steps])])


@dataclass
class Model:
    weights: np.ndarray
    known: np.ndarray
    prior: float
    negative_risk: float


def held_out(identifier: Column) -> Column:
    """The fold whose labels are never learned from."""
    return F.coalesce(F.crc32(identifier.cast("string")) % 3 == 1, F.lit(False))


def positives(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``text`` of the training rows labelled 1.  A filter of bounded size keeps the other texts from moving."""
    sure = labels.where(F.col("id").isNotNull() & (F.col("label") == 1) & ~held_out(F.col("id"))).select(F.col("id").alias("of")).distinct()
    sure = written(sure, "sure")
    size = filter_bits(sure.count())
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).withColumn("bit", filter_bit(F.col("id").cast("string"), size))
    likely = possible_members(rows, membership(sure.select(filter_bit(F.col("of").cast("string"), size).alias("bit"))))
    # Labels grow with the corpus: never broadcast.
    return written(likely.join(sure.hint("merge"), F.col("id") == F.col("of")).select("text"), "positives")


def _blocks(sums: np.ndarray) -> pa.RecordBatch:
    parts = np.pad(sums, (0, -len(sums) % BLOCK)).reshape(-1, BLOCK)
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype="i4")), pa.array(list(parts), pa.list_(pa.float64()))], ["block", "sums"])


def _collected(parts: DataFrame, length: int) -> np.ndarray:
    """The sum of ``parts(block, sums)`` over all tasks; ``length`` values in all come to the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, sums in zip(batch.column(0).to_pylist(), batch.column(1)):
                total[block] = total.get(block, 0) + sums.values.to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], ["block", "sums"])

    found = np.zeros(-(-length // BLOCK) * BLOCK)
    kind = "block int, sums array<double>"
    for row in parts.repartition("block").mapInArrow(add, kind).collect():  # a fixed number of blocks
        found[row.block * BLOCK : (row.block + 1) * BLOCK] = row.sums
    return found[:length]


def familiar(texts: DataFrame) -> np.ndarray:
    """Per bucket ``p / (p + 4 u)`` of the runs of four bytes of ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, waiting = np.zeros(1 << BITS), [], 0
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                for part in slices(text.as_py() or b"", GRAM):
                    held.append(gram_buckets(part, GRAM, BITS))
                    waiting += len(held[-1])
                    if waiting >= 1 << BITS:
                        counts += np.bincount(np.concatenate(held), minlength=1 << BITS)
                        held, waiting = [], 0
        if held:
            counts += np.bincount(np.concatenate(held), minlength=1 << BITS)
        yield _blocks(counts)

    counts = _collected(texts.select("text").mapInArrow(run, "block int, sums array<double>"), 1 << BITS)
    share = counts / max(counts.sum(), 1.0)
    return share / (share + 4.0 / (1 << BITS))


def moments(texts: DataFrame, known: np.ndarray) -> np.ndarray:
    """Sums of ``x x'`` over all rows of ``text``; ``x[0]`` is 1."""
    upper = np.triu_indices(WIDTH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((WIDTH, WIDTH))
        for batch in batches:
            for at in range(0, batch.num_rows, HELD):
                part = batch.column(0).slice(at, HELD).cast(pa.binary())
                x = np.array([features(t.as_py() or b"", known) for t in part]).reshape(-1, WIDTH)
                total += x.T @ x
        yield _blocks(total[upper])

    sums = _collected(texts.select("text").mapInArrow(run, "block int, sums array<double>"), len(upper[0]))
    whole = np.zeros((WIDTH, WIDTH))
    whole[upper] = sums
    return whole + whole.T - np.diag(np.diag(whole))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled rows, from sums of ``x x'`` over both."""
    if not positive[0, 0] or not unlabelled[0, 0]:
        return 0.5
    mean, second = positive[0] / positive[0, 0], unlabelled / unlabelled[0, 0]
    damping = DAMPING + DAMPING_BY_ROWS / unlabelled[0, 0]
    found = 1 / (mean @ np.linalg.solve(second + damping * np.eye(len(second)), mean))
    return float(np.clip(found, PRIOR_LEAST, PRIOR_MOST))


def minimised(positive: np.ndarray, unlabelled: np.ndarray, prior: float, ridge: float = RIDGE, offset: float = OFFSET) -> tuple[np.ndarray, float]:
    """Weights of least non-negative risk with the first one at ``offset``, and the value of its second term."""
    if not positive[0, 0] or not unlabelled[0, 0]:
        return np.zeros(len(positive)), 0.0
    gp, gu = positive / positive[0, 0], unlabelled / unlabelled[0, 0]
    mp, mu = gp[0], gu[0]

    def at(t: float) -> tuple[np.ndarray, float]:
        form = prior * (1 - t) * gp + t * gu
        target = (1 + t) * prior * mp - t * mu - offset * form[0]
        w = np.concatenate([[offset], np.linalg.solve(form[1:, 1:] + ridge * np.eye(len(gp) - 1), target[1:])])
        loss = lambda g, m: (1 + 2 * w @ m + w @ g @ w) / 4
        return w, loss(gu, mu) - prior * loss(gp, mp)

    if at(1.0)[1] >= 0:
        return at(1.0)
    low, high = 0.0, 1.0
    for _ in range(40):
        t = (low + high) / 2
        low, high = (t, high) if at(t)[1] >= 0 else (low, t)
    return at(low)


def fit(docs: DataFrame, labels: DataFrame, prior: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on every row that is not held out.  ``labels`` has ``id`` and ``label`` (1: trusted positive)."""
    trusted = positives(docs, labels, id_col, text_col)
    known = familiar(trusted)
    training = docs.where(~held_out(F.col(f"`{id_col}`"))).select(F.col(f"`{text_col}`").alias("text"))
    positive, unlabelled = moments(trusted, known), moments(training, known)
    prior = class_prior(positive, unlabelled) if prior is None else prior
    weights, negative = minimised(positive, unlabelled, prior)
    return Model(weights, known, prior, negative)


def _scores(texts: pa.Array, model: Model) -> np.ndarray:
    f = np.array([features(t.as_py() or b"", model.known) @ model.weights for t in texts.cast(pa.binary())], "f8")
    return 1 / (1 + np.exp(-2 * f))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``id`` and ``score``; nothing moves between tasks."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(batch.column(1), model))], ["id", "score"])

    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"id {id_type}, score double")


def accepted(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The input's rows and columns that score ``least`` or more; nothing moves between tasks."""
    column = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(column), model) >= least))

    names = [f"c{i}" for i in range(len(docs.columns))]  # names may clash or differ in case only
    rows = docs.toDF(*names).mapInArrow(run, docs.toDF(*names).schema)
    return rows.toDF(*docs.columns)
