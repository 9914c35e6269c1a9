"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight for each hashed text feature is shared by all grades; ordered thresholds cut the
latent score, P(grade >= g) = sigmoid(score - threshold[g]).  A document gets its expected
grade and the tail probability of every grade, and is selected by one of the tails.

Features of a text, each hashed to 2**BITS buckets: its words (A-Z lower-cased, ASCII
punctuation dropped from their edges), the words' openings of OPENINGS bytes, the shapes of its
words (runs of capitals, small letters, digits, other), words that repeat the word before them,
and the number of words in powers of two (value 1).  Any other feature's value is the root of its
share among the text's features of that kind, so a text's length doesn't scale its score.
Features in fewer than `least_docs` of the fitted documents weigh 0.

Fitted in numpy on the driver on the features of a bounded sample: about `per_grade` whole rated
documents of each grade, picked by a hash; grades weigh as the roots of their sizes.  Ratings with a null part
are left out.  A text without words (null, empty, blank) has no features: its score is 0.  With no
ratings at all every document gets the top grade with probability 1, so nothing is rejected.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textbytes as tb
from .packing import pack, unpack
from .shared import column_of, quoted

BITS = 18
OPENINGS = (4, 5, 6, 7)
#: Byte classes for word shapes: capitals, small letters, digits, bytes beyond ASCII; else the byte itself.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("A"):ord("Z") + 1] = ord("A")
_SHAPE[ord("a"):ord("z") + 1] = ord("a")
_SHAPE[ord("0"):ord("9") + 1] = ord("0")
_SHAPE[0x80:] = ord("a")
_EDGE = np.zeros(256, bool)  # dropped from words: ASCII that is no letter or digit
_EDGE[[c for c in range(128) if not chr(c).isalnum()]] = True


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text, value) of every feature of every text, each pair once."""
    n = len(offsets) - 1
    kinds = []
    # Words: edge bytes count as blanks.
    low = np.where(_EDGE[raw], np.uint8(0x20), tb.LOWER[raw])
    starts, ends, first = tb.word_spans(low, offsets)
    words = tb.span_hashes(low, starts, ends)
    text = np.repeat(np.arange(n), np.diff(first))
    kinds.append((words, text))
    h = tb.prefix_hashes(low)
    _, down = tb.powers(len(low) + 1)
    for k in OPENINGS:
        at = np.flatnonzero(ends - starts > k)
        kinds.append((tb.mix((h[starts[at] + k] - h[starts[at]]) * down[starts[at]] + np.uint64(k << 32)), text[at]))
    # Words that repeat the word before.
    again = np.flatnonzero((words[1:] == words[:-1]) & (text[1:] == text[:-1])) + 1
    repeated = np.bincount(text[again], minlength=n)
    # Shapes: runs of one class of bytes count once.
    starts, ends, first = tb.word_spans(raw, offsets)
    shape = _SHAPE[raw]
    if len(shape):
        fresh = np.concatenate([[True], shape[1:] != shape[:-1]])
        fresh[starts] = True
        place = np.cumsum(fresh)
        keep = np.flatnonzero(fresh)
        squeezed = shape[keep]
        a, b = place[starts] - 1, place[ends - 1]
        text2 = np.repeat(np.arange(n), np.diff(first))
        kinds.append((tb.span_hashes(squeezed, a, b) ^ np.uint64(0x5BD1E995), text2))
    out = []
    for h, t in kinds:
        if not len(h):
            continue
        # One sort brings equal (text, bucket) pairs together.
        key = np.sort((t.astype(np.uint64) << np.uint64(BITS)) | (h >> np.uint64(64 - BITS)))
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.append(head, len(key)))
        key = key[head]
        t2 = (key >> np.uint64(BITS)).astype(np.int64)
        share = count / np.bincount(t, minlength=n)[t2]
        out.append(((key & np.uint64((1 << BITS) - 1)).astype(np.int64), t2, np.sqrt(share)))
    if len(again):
        hit = np.flatnonzero(repeated)
        out.append((np.full(len(hit), 1, np.int64), hit, np.sqrt(repeated[hit] / np.bincount(text, minlength=n)[hit])))
    n_words = np.bincount(text, minlength=n)
    some = np.flatnonzero(n_words)
    if not len(some):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    out.append((2 + np.minimum(np.log2(n_words[some]), 15).astype(np.int64), some, np.ones(len(some))))
    return tuple(np.concatenate(x) for x in zip(*out))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class OrdinalModel:
    grades: list[int]  # ascending
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than grades
    cut: float = 0.5  # least tail probability of the top grade for selection

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.zeros(len(offsets) - 1)
        for i, j in tb.slices(offsets):
            bucket, text, value = features(raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
            out[i:j] = np.bincount(text, weights=value * self.weights[bucket], minlength=j - i)
        return out

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= grades[g + 1]) for each threshold g."""
        return sigmoid(score[:, None] - self.thresholds[None, :])

    def expected(self, tails: np.ndarray) -> np.ndarray:
        steps = np.diff(np.array(self.grades, float))
        return self.grades[0] + tails @ steps if len(steps) else np.full(len(tails), float(self.grades[0]))


#: Features in one piece of the fit.
_PIECE = 1 << 18


def train(rows: list[tuple[bytes, bytes]], grades: list[int], epochs: int = 400, rate: float = 1.0, decay: float = 3e-4,
          least_docs: int = 5, held_back: float = 0.15, seed: int = 11) -> OrdinalModel:
    """L1-penalised maximum likelihood by AdaGrad; thresholds stay ordered by construction.

    rows: packed (buckets, values) of each text; they are emptied on the way.
    """
    names = sorted(set(grades))
    g = len(names)
    y = np.array([names.index(x) for x in grades])
    rng = np.random.default_rng(seed)
    seen = np.zeros(1 << BITS, np.int64)
    for buckets, _ in rows:
        seen[unpack(buckets, np.uint32)] += 1  # a bucket may occur once for each kind; only once counts
    used = np.flatnonzero(seen >= least_docs)
    place = np.full(1 << BITS, -1, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    # Pieces of consecutive texts: the used features, values and texts as small numbers.
    pieces, held, size, begin = [], [], 0, 0
    for i in range(len(rows)):
        at, value = place[unpack(rows[i][0], np.uint32)], unpack(rows[i][1], np.float32)
        rows[i] = None
        keep = np.flatnonzero(at >= 0)
        held.append((at[keep], np.full(len(keep), i - begin, np.int32), value[keep]))
        size += len(keep)
        if size >= _PIECE or i == len(rows) - 1:
            ids, text, value = (np.concatenate(x) for x in zip(*held))
            pieces.append((begin, i + 1, ids, text, value))
            held, size, begin = [], 0, i + 1
    w = np.zeros(1 << BITS)
    model = OrdinalModel(names, w, np.zeros(g - 1))
    if g < 2:
        return model
    order = rng.permutation(len(y))
    cut = max(1, int(len(y) * (1 - held_back)))
    fit, kept = order[:cut], order[cut:] if cut < len(y) else order
    weight = np.zeros(len(y))
    weight[fit] = np.sqrt(len(fit) / (g * np.maximum(np.bincount(y[fit], minlength=g), 1)))[y[fit]]
    weight /= weight.sum()
    first, gaps = np.zeros(1), np.zeros(max(g - 2, 0))  # thresholds: first, then first + sums of exp(gaps)
    v, gv, gf, gg = np.zeros(len(used)), np.full(len(used), 1e-12), np.full(1, 1e-6), np.full(len(gaps), 1e-6)
    at, zero, s = np.arange(len(y)), np.zeros((len(y), 1)), np.zeros(len(y))

    def scored() -> None:
        for i, j, ids, text, value in pieces:
            s[i:j] = np.bincount(text, weights=value * v[ids], minlength=j - i)
    for epoch in range(epochs):
        step = rate * (1 - 0.9 * epoch / epochs)
        scored()
        t = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        c = sigmoid(s[:, None] - t[None, :])
        full = np.hstack([zero + 1, c, zero])
        p = np.maximum(full[at, y] - full[at, y + 1], 1e-9)
        slope = np.hstack([zero, c * (1 - c), zero])
        up, down = slope[at, y] / p * weight, slope[at, y + 1] / p * weight
        grad = np.zeros(len(used))
        for i, j, ids, text, value in pieces:
            grad += np.bincount(ids, weights=value * (down - up)[i:j][text], minlength=len(used))
        gv += grad * grad
        rates = step / np.sqrt(gv)
        v -= rates * grad
        v = np.sign(v) * np.maximum(np.abs(v) - rates * decay, 0)  # proximal step of the L1 penalty
        dt = np.zeros((len(y), g + 1))
        dt[at, y] += up
        dt[at, y + 1] -= down
        dt = dt[:, 1:g].sum(0)
        gf += dt.sum() ** 2
        first = first - step * dt.sum() / np.sqrt(gf)
        if len(gaps):
            dg = np.exp(gaps) * np.cumsum(dt[::-1])[::-1][1:]
            gg += dg * dg
            gaps = gaps - step * dg / np.sqrt(gg)
    w[used] = v
    scored()
    model.weights = w
    model.thresholds = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
    model.cut = selection_cut(model.tails(s[kept])[:, -1], y[kept] == g - 1)
    return model


def selection_cut(tail: np.ndarray, top: np.ndarray, keep: float = 0.995) -> float:
    """The tail probability that a share `keep` of held-back top grades reaches, 1/2 at most."""
    return float(min(0.5, np.quantile(tail[top], 1 - keep, method="lower") - 1e-6)) if top.any() else 0.5


def ratings(labels: DataFrame) -> DataFrame:
    """doc_id and grade: 0 poor, 1 good but toxic, 2 good and clean.  Toxic and poor is 0."""
    grade = F.when(F.col("quality") <= 0, 0).when(F.col("toxic") > 0, 1).otherwise(2)
    whole = labels.where("quality is not null and toxic is not null and doc_id is not null")
    return whole.select("doc_id", grade.alias("grade")).distinct()


def fit(docs: DataFrame, labels: DataFrame, per_grade: int = 3000) -> OrdinalModel | None:
    """A model from a bounded sample of the rated documents.

    The sample is drawn from the ratings first, so the join with the texts is small.  A rated id counts once for each of
    its grades: of several documents that have it, the one whose text has the least hash.  Texts stay on the executors:
    the driver gets their packed features, of bounded size for a text of any length.
    """
    rated = ratings(labels)
    counts = {r[0]: r[1] for r in rated.groupBy("grade").count().collect()}  # three grades
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    keep = F.lit(False)
    for value, n in counts.items():
        keep = keep | ((F.col("grade") == value) & (unit < min(1.0, per_grade / n)))
    picked = F.broadcast(rated.where(keep))  # about 3 * per_grade rows of two numbers
    doc_id, text = (F.col(quoted(column_of(docs, c))) for c in ("doc_id", "text"))
    rows = docs.select(doc_id.cast("long").alias("doc_id"), text.alias("text")).where("text is not null").join(picked, "doc_id")
    # One row for each picked id and grade, whatever the documents repeat; rows are combined before they are shuffled.
    rows = rows.groupBy("doc_id", "grade").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = tb.column_bytes(batch.column(1))
            buckets, values = [], []
            for i, j in tb.slices(offsets):
                bucket, text, value = features(raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                order = np.argsort(text, kind="stable")
                cuts = np.searchsorted(text[order], np.arange(1, j - i))
                buckets += [pack(x.astype(np.uint32)) for x in np.split(bucket[order], cuts)]
                values += [pack(x.astype(np.float32)) for x in np.split(value[order], cuts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(buckets, pa.binary()), pa.array(values, pa.binary())],
                                             ["doc_id", "grade", "buckets", "values"])
    found = rows.select("doc_id", "text", F.col("grade").cast("int")).mapInArrow(run, "doc_id long, grade int, buckets binary, values binary").toArrow()
    columns = [found.column(c).to_pylist() for c in ("doc_id", "grade", "buckets", "values")]
    del found
    order = sorted(range(len(columns[0])), key=lambda i: (columns[0][i], columns[1][i], columns[2][i]))
    examples, grades = [(columns[2][i], columns[3][i]) for i in order], [columns[1][i] for i in order]
    del columns
    return train(examples, grades) if grades else None


def score(docs: DataFrame, model: OrdinalModel | None) -> DataFrame:
    """The columns of docs, then expected_grade, tail_1, tail_2 and selected.

    A column of docs that has the name of one of these four, in any case, gives way to it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights: fixed by a parameter
    fresh = ["expected_grade", "tail_1", "tail_2", "selected"]
    taken = [c for c in docs.columns if c.lower() not in fresh]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            n = batch.num_rows
            if m is None or len(m.grades) < 2:
                t = np.ones((n, 2))
                mean, top, cut = np.full(n, 2.0), t[:, -1], 0.0
            else:
                s = m.scores(*tb.column_bytes(batch.column(len(taken))))
                raw = m.tails(s)
                t = np.stack([raw[:, np.searchsorted(m.grades[1:], g)] if g <= m.grades[-1] else np.zeros(n) for g in (1, 2)], 1)
                mean, top, cut = m.expected(raw), raw[:, -1], m.cut
            cols = [*batch.columns[:len(taken)], pa.array(mean, pa.float64()), pa.array(t[:, 0], pa.float64()),
                    pa.array(t[:, 1], pa.float64()), pa.array(top >= cut, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, schema=pa.schema([*batch.schema][:len(taken)] + [
                pa.field(c, pa.float64()) for c in fresh[:3]] + [pa.field(fresh[3], pa.bool_())]))
    # Columns are carried by number, so any name will do.
    kept = docs.select(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(taken)])
    schema = kept.schema.add("expected_grade", "double").add("tail_1", "double").add("tail_2", "double").add("selected", "boolean")
    text = F.col(quoted(column_of(docs, "text"))).alias("text")
    rows = docs.select(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(taken)], text)
    return rows.mapInArrow(run, schema).toDF(*taken, *fresh)


def select(docs: DataFrame, model: OrdinalModel | None) -> DataFrame:
    """The rows of docs that the model selects, with docs' own columns; null texts are kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = [c.lower() for c in docs.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if m is not None and len(m.grades) > 1:
                top = m.tails(m.scores(*tb.column_bytes(batch.column(at))))[:, -1]
                null = batch.column(at).is_null().to_numpy(zero_copy_only=False)
                batch = batch.filter(pa.array((top >= m.cut) | null, pa.bool_()))
            yield batch
    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # any names will do
    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)
