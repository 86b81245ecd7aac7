"""Toxicity by a classifier chain of linear models.

Categories are judged one after the other: the model of a category sees the words of a text and the probabilities of the earlier
categories. In training these come out of fold: the labelled sample is dealt over ``FOLDS`` folds, and each row gets the
probability from the model that was fitted without its fold. The last fit of a category, on all rows, scores texts.

Training takes at most ``SAMPLE`` labelled rows, chosen by a hash of doc_id (all, where there are fewer); this bound is the
only one. Folds are fitted by Spark tasks, which get the rows' features from a stored table and not from the driver, and every whole
text is scored. Features are the distinct words of a text, hashed to ``DIMS`` columns, and four numbers on its form; each fit
chooses the words that go with its label.

A label that is null or a document that is missing is left out of the fit; of several labels or texts of one doc_id one is taken, the
same in every run. Null and empty texts are scored by the intercepts; repeated rows are scored alike; a long text is one
block. Without any labelled row, or with one class only, the probability is near 0 or 1 as the class is (0 for none). An
empty table gives an empty one. Other columns stay; those called like an added one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import stored
from .textops import IS_WORD, LOWER, Words, blocks, flat_list

SAMPLE = 16_000
FOLDS = 4
DIMS = 1 << 17
ROUNDS = 20
PENALTY = 0.3
SHAPES = 4
CHOSEN = 512
LEAST_ROWS = 3
LEAST_Z = 4.0
NEVER = -30.0  # the intercept where no row, or none that is positive, is known
#: Category, the label column it comes from, the value that counts as positive; in the order of the chain.
CATEGORIES = (("low_quality", "quality", 0), ("toxic", "toxic", 1))


def features(data: np.ndarray, offs: np.ndarray, dims: int = DIMS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashed words of each row as flat columns and row offsets, and its ``SHAPES`` numbers on form."""
    words = Words(data, offs)
    row = np.repeat(np.arange(len(offs) - 1), words.counts())
    key = np.unique(row * dims + (words.hash % np.uint64(dims)).astype(np.int64))
    first = np.searchsorted(key, np.arange(len(offs)) * dims)
    size, n = np.diff(offs), np.maximum(words.counts(), 1)
    upper, sign = ((data >= 65) & (data <= 90)), (data < 128) & ~IS_WORD[LOWER[data]] & (data != 32)
    share = lambda hit: np.diff(np.append(0, np.cumsum(hit))[offs]) / np.maximum(size, 1)
    shape = np.column_stack([share(upper), share(sign), np.diff(first) / n, np.log1p(n) / 10])
    return (key % dims).astype(np.int32), first, shape


CHUNK = 1024


def _chunks(column: np.ndarray, first: np.ndarray, on: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, row of each word in the chunk, words) of the rows that take part, ``CHUNK`` rows at a time."""
    for a in range(0, len(on), CHUNK):
        some = on[a : a + CHUNK]
        size = np.diff(first[a : a + len(some) + 1])
        words = np.repeat(some, size)
        place = np.cumsum(some) - 1
        yield a + np.flatnonzero(some), np.repeat(place, size)[words], column[first[a] : first[a + len(some)]][words]


def select(column: np.ndarray, first: np.ndarray, y: np.ndarray, on: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """The words that go with the label, at most ``CHOSEN``: those farthest from independence in standard deviations."""
    holds, hits = np.zeros(dims), np.zeros(dims)
    for rows, row, words in _chunks(column, first, on):
        holds += np.bincount(words, minlength=dims)
        hits += np.bincount(words, weights=y[rows][row], minlength=dims)
    share = y[on].mean()
    z = np.abs(hits - holds * share) / np.sqrt(np.maximum(holds, 1) * share * (1 - share))
    fit = np.flatnonzero((holds >= LEAST_ROWS) & (z > LEAST_Z))
    return np.sort(fit[np.argsort(-z[fit], kind="stable")[:CHOSEN]])


def fit(column: np.ndarray, first: np.ndarray, extra: np.ndarray, y: np.ndarray, on: np.ndarray | None = None, dims: int = DIMS) -> np.ndarray:
    """Logistic regression with an L2 penalty by Newton's method on the rows ``on`` (None: all): weights of the words, of the extra
    columns, and the intercept. Slope and curvature are summed over chunks of rows, so only a chunk is dense."""
    on = np.ones(len(y), bool) if on is None else on
    out = np.zeros(dims + extra.shape[1] + 1)
    if not on.any() or y[on].min() == y[on].max():
        out[-1] = -NEVER if on.any() and y[on][0] else NEVER
        return out
    chosen = select(column, first, y, on, dims)
    place = np.full(dims, -1)
    place[chosen] = np.arange(len(chosen))
    kept = []
    for rows, row, words in _chunks(column, first, on):
        hit = place[words] >= 0
        kept.append((rows, row[hit], place[words[hit]]))
    w = np.zeros(len(chosen) + extra.shape[1] + 1)
    hold = np.full(len(w), PENALTY)
    hold[-1] = 1e-6
    for _ in range(ROUNDS):
        slope, curve = hold * w, np.diag(hold)
        for rows, row, words in kept:
            x = np.zeros((len(rows), len(w)))
            x[row, words] = 1
            x[:, len(chosen) : -1] = extra[rows]
            x[:, -1] = 1
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope += x.T @ (p - y[rows])
            curve += (x * (p * (1 - p))[:, None]).T @ x
        step = np.linalg.solve(curve, slope)
        w = w - step * min(1.0, 5.0 / np.abs(step).max())
        if np.abs(step).max() < 1e-4:
            break
    out[chosen], out[dims:] = w[: len(chosen)], w[len(chosen) :]
    return out


def probability(weights: np.ndarray, column: np.ndarray, first: np.ndarray, extra: np.ndarray) -> np.ndarray:
    dims = len(weights) - 1 - extra.shape[1]
    total = np.append(0.0, np.cumsum(weights[column]))
    return 1 / (1 + np.exp(-np.clip(total[first[1:]] - total[first[:-1]] + extra @ weights[dims:-1] + weights[-1], -30, 30)))


FITTED = T.StructType([T.StructField("fold", T.IntegerType()), *(T.StructField(c, T.ArrayType(kind)) for c, kind in (("at", T.LongType()), ("w", T.DoubleType()), ("p", T.DoubleType())))])


def _gathered(batches: Iterator[pa.RecordBatch], y: str) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(fold, doc_ids, words, row offsets of the words, numbers on form, labels y) of each fold of a task, in order of the doc_ids."""
    held = list(batches)
    if not held:
        return
    whole = pa.Table.from_batches(held)
    held.clear()
    folds = whole.column("fold").to_numpy()
    for k in np.unique(folds).tolist():
        on = np.flatnonzero(folds == k)
        ids = whole.column("doc_id").to_numpy()[on]
        order = np.argsort(ids, kind="stable")
        rows = whole.take(pa.array(on[order])).combine_chunks()
        column, first = flat_list(rows.column("columns").combine_chunks())
        extra = rows.column("shape").combine_chunks().flatten().to_numpy().reshape(-1, SHAPES)
        yield k, ids[order], column, first, extra, rows.column(y).to_numpy().astype(np.int64)


def train(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, sample: int = SAMPLE, folds: int = FOLDS) -> list[np.ndarray]:
    """The weights of the chain. Only they and the out-of-fold probabilities come to the driver, not the rows."""
    from pyspark.sql.pandas.types import to_arrow_schema

    fitted_kind = to_arrow_schema(FITTED)
    wanted = [F.when(F.col(source).isNotNull(), (F.col(source) == value).cast("int")).alias(f"y{k}") for k, (_, source, value) in enumerate(categories)]
    ys = [f"y{k}" for k in range(len(categories))]
    known = labels.where("doc_id is not null").select("doc_id", *wanted).dropna().groupBy("doc_id").agg(F.min(F.struct(*ys)).alias("y")).select("doc_id", "y.*")
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            for a, b, data, offs in blocks(get("text")):
                column, first, shape = features(data, offs)
                yield pa.RecordBatch.from_arrays([get(c).slice(a, b - a) for c in ("doc_id", *ys)] + [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(column)), pa.array(list(shape), pa.list_(pa.float64()))], names=["doc_id", *ys, "columns", "shape"])

    schema = "doc_id long, " + "".join(f"{y} int, " for y in ys) + "columns array<int>, shape array<double>"
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # at most ``sample`` rows of a few numbers
    # one text for each id, however often it is there; equal ones are collapsed before the shuffle
    rows = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("t"), *(F.first(y).alias(y) for y in ys)).select("doc_id", *ys, "t.text")
    # each fit takes all of these rows, so a copy of them goes to its task; none goes through the driver
    featured = stored(rows.mapInArrow(run, schema))
    dealt = featured.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds)))).repartitionById(folds + 1, "fold")
    models, outside = [], []
    for y in ys:

        def fold_fit(batches: Iterator[pa.RecordBatch], y: str = y, outside: list[np.ndarray] = outside) -> Iterator[pa.RecordBatch]:
            for k, ids, column, first, extra, labels in _gathered(batches, y):
                extra, own = np.column_stack([extra, *outside]), np.arange(len(ids)) % folds == k
                w = fit(column, first, extra, labels, ~own)
                some = np.flatnonzero(w)
                p = probability(w, column, first, extra)[own]
                yield pa.RecordBatch.from_pylist([{"fold": k, "at": some, "w": w[some], "p": p}], schema=fitted_kind)

        fitted = {r.fold: r for r in dealt.select("fold", "doc_id", y, "columns", "shape").mapInArrow(fold_fit, FITTED).collect()}
        w = np.zeros(DIMS + SHAPES + len(outside) + 1)
        if fitted:
            w[fitted[folds].at] = fitted[folds].w
        else:  # no labelled row
            w[-1] = NEVER
        models.append(w)
        p = np.zeros(sum(len(r.p) for r in fitted.values()))
        for k in range(folds if fitted else 0):
            p[k::folds] = fitted[k].p
        outside = [*outside, p]
    return models


def score(docs: DataFrame, models: list[np.ndarray], categories=CATEGORIES) -> DataFrame:
    """Add the column p_<category> of each category to the documents."""
    names = [f"p_{c}" for c, _, _ in categories]
    keep = [c for c in docs.columns if c not in names]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(n, T.DoubleType()) for n in names])
    sent = docs.sparkSession.sparkContext.broadcast([w.astype(np.float32) for w in models])  # DIMS numbers for each category

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            for a, b, data, offs in blocks(get("text")):
                column, first, extra = features(data, offs)
                for w in sent.value:
                    extra = np.column_stack([extra, probability(w.astype(np.float64), column, first, extra)])
                yield pa.RecordBatch.from_arrays([get(c).slice(a, b - a) for c in keep] + [pa.array(extra[:, SHAPES + k]) for k in range(len(names))], names=[*keep, *names])

    return docs.select(*keep).mapInArrow(run, schema)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Add p_low_quality, p_toxic and toxic to the documents."""
    return score(docs, train(docs, labels)).withColumn("toxic", F.col("p_toxic") >= threshold)
