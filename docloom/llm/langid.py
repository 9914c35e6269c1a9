"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's vector is the mean of the embeddings of its hashed byte n-grams (3 to 5 bytes, inside
words and touching their edges); a linear layer and a softmax give the languages'
probabilities.  Embeddings and layer are trained together by stochastic gradient descent in
numpy, on the driver, from a bounded sample: `per_lang` different whole texts of every language,
picked by a hash of the text, and short spans of them, as counts of n-grams made on the executors.  Part of the
sample is kept back to fit a temperature and the probability below which a prediction is rejected.

A text that is null or has no letter is `und` with score 0.  Languages that never occur in
training are never predicted.  With no training rows at all, every text is `und`.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import textbytes as tb
from .packing import pack, unpack
from .shared import column_of, quoted

#: ASCII bytes that are no letters count as blanks; other bytes are kept.
_KEEP = np.zeros(256, bool)
_KEEP[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
ORDERS = (3, 4, 5)
BUCKET_BITS = 16


def subwords(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every n-gram of ORDERS that holds no blank but at its ends."""
    b = np.where(_KEEP[tb.LOWER[raw]], tb.LOWER[raw], np.uint8(0x20))
    # A blank before and after each text, so that its edges look like those of words.
    n = len(offsets) - 1
    lens = np.diff(offsets)
    at = offsets[:-1] + 2 * np.arange(n)
    buf = np.full(len(b) + 2 * n, 0x20, np.uint8)
    inner = np.ones(len(buf), bool)
    inner[at] = False
    inner[at + lens + 1] = False
    buf[inner] = b
    text = np.repeat(np.arange(n, dtype=np.int32), lens + 2)
    h = tb.prefix_hashes(buf)
    _, down = tb.powers(len(buf) + 1)
    blanks = np.concatenate([[0], np.cumsum(buf == 0x20)])
    buckets, texts = [], []
    for k in ORDERS:
        m = len(buf) - k + 1
        if m <= 0:
            continue
        ok = np.flatnonzero((blanks[k - 1:k - 1 + m] == blanks[1:1 + m]) & (text[k - 1:] == text[:m]))
        g = (h[ok + k] - h[ok]) * down[ok] + np.uint64(k)
        buckets.append(((g * np.uint64(tb.BASE)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
        texts.append(text[ok])
    if not buckets:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    return np.concatenate(buckets), np.concatenate(texts)


def examples(raw: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, how often) of each text; 2**BUCKET_BITS entries at most, however long the text."""
    out = []
    for i, j in tb.slices(offsets):
        bucket, text = subwords(raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
        by = np.argsort(text, kind="stable")
        ends = np.searchsorted(text[by], np.arange(1, j - i + 1))
        out += [np.unique(x, return_counts=True) for x in np.split(bucket[by], ends[:-1])]
    return out


@dataclass
class LanguageModel:
    """Its size is set by parameters and grows with the languages by `dim` numbers each only."""
    langs: list[str]
    embeddings: np.ndarray  # buckets x dim
    layer: np.ndarray  # dim x langs
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def __post_init__(self):
        # Few languages have one number a bucket for each; many share the embeddings.
        few = len(self.langs) <= self.embeddings.shape[1]
        self.tables = (self.embeddings @ self.layer if few else self.embeddings).T.astype(np.float64)
        self.last = np.eye(len(self.langs)) if few else self.layer.astype(np.float64)

    def __reduce__(self):
        return LanguageModel, (self.langs, self.embeddings, self.layer, self.bias, self.temperature, self.reject_below)

    def logits(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.zeros((len(offsets) - 1, len(self.tables)), np.float64)
        for i, j in tb.slices(offsets):
            bucket, text = subwords(raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
            count = np.maximum(np.bincount(text, minlength=j - i), 1)
            for c, row in enumerate(self.tables):
                out[i:j, c] = np.bincount(text, weights=row[bucket], minlength=j - i) / count
        return out @ self.last + self.bias

    def probabilities(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return softmax(self.logits(raw, offsets) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _spans(text: str, rng: np.random.Generator, spans: int) -> list[str]:
    """Short spans of whole words of a text, so that short texts are known too."""
    words = text.split()
    out = []
    for _ in range(spans if len(words) > 3 else 0):
        n = int(rng.integers(1, 12))
        k = int(rng.integers(0, max(1, len(words) - n)))
        out.append(" ".join(words[k:k + n]))
    return out


def train(rows: list[tuple[str, bool, bytes, bytes]], dim: int = 16, epochs: int = 4, rate: float = 0.5,
          max_error: float = 0.01, seed: int = 7) -> LanguageModel:
    """Fits embeddings and softmax layer by SGD, then temperature and rejection bound.

    rows: (language, whether it is held back, packed buckets, how often) of each text.
    """
    def counted(row: tuple[str, bool, bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
        return unpack(row[2], np.uint16).astype(np.int64), unpack(row[3], np.int64)
    names = sorted({r[0] for r in rows})
    rng = np.random.default_rng(seed)
    number = {x: i for i, x in enumerate(names)}
    fit = [r for r in rows if not r[1]] or rows
    kept = [r for r in rows if r[1]] or rows
    fit_y = np.array([number[r[0]] for r in fit], np.int64)
    emb = (rng.random((1 << BUCKET_BITS, dim), np.float32) - 0.5) / dim
    layer = np.zeros((dim, len(names)), np.float32)
    bias = np.zeros(len(names), np.float32)
    share = np.bincount(fit_y, minlength=len(names)) / len(fit_y)
    weight = (1 / np.maximum(share, 1e-9) / len(names)).astype(np.float32)
    steps, total = 0, epochs * len(fit)
    for _ in range(epochs):
        for d in rng.permutation(len(fit)):
            steps += 1
            ids, counts = counted(fit[d])
            if not len(ids):
                continue
            tf = (counts / counts.sum()).astype(np.float32)
            hidden = tf @ emb[ids]
            z = hidden @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[fit_y[d]] -= 1
            step = rate * (1 - steps / (total + 1)) * min(float(weight[fit_y[d]]), 10.0)
            back = layer @ p
            layer -= step * np.outer(hidden, p)
            bias -= 0.1 * step * p
            # A text moves each embedding by its share of the text, scaled up as shares are small.
            emb[ids] -= (step * 10) * tf[:, None] * back
    model = LanguageModel(names, emb, layer, bias.astype(np.float64))
    kept_y = np.array([number[r[0]] for r in kept], np.int64)
    z = np.array([(counts @ emb[ids] / max(counts.sum(), 1)) @ layer for ids, counts in map(counted, kept)], np.float64).reshape(len(kept), len(names)) + bias
    grid = np.exp(np.linspace(-3, 2, 51))
    at = np.arange(len(kept_y))
    model.temperature = float(min(grid, key=lambda t: -np.log(softmax(z / t)[at, kept_y] + 1e-12).mean()))
    p = softmax(z / model.temperature)
    model.reject_below = rejection_bound(p.max(1), p.argmax(1) == kept_y, max_error)
    return model


def rejection_bound(score: np.ndarray, right: np.ndarray, max_error: float) -> float:
    """The lowest bound whose accepted predictions have an error rate of max_error or less."""
    order = np.argsort(-score)
    rate = np.cumsum(~right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(rate <= max_error)
    return float(score[order][good[-1]]) if len(good) else 1.0


def sample(labelled: DataFrame, per_label: int, most_rows: int) -> DataFrame:
    """(label, text): per_label different texts of every label, or all if it has fewer; most_rows at most of all labels together.

    Those with the least hashes of the text are taken, so a text counts once, however often it is repeated, and ids play
    no part.  Every label has one row at least; more labels than most_rows are an error.  A label's texts are first thinned
    by a sketch of how many it has, so that only about as many as are wanted are shuffled, its least one among them.
    """
    keyed = labelled.select("label", "text", F.xxhash64("text").alias("h"))
    known = keyed.groupBy("label").agg(F.approx_count_distinct("h", 0.03).alias("n"), F.min("h").alias("least")).limit(most_rows + 1).collect()
    if len(known) > most_rows:
        raise ValueError(f"more than {most_rows} languages")
    each = max(1, min(per_label, most_rows // max(len(known), 1)))
    # So many that fewer than `each` are left by bad luck only, and then all that are left count.
    wanted = 1.2 * (each + 6 * each ** 0.5)
    shares = labelled.sparkSession.createDataFrame([(r[0], min(1.0, wanted / max(r[1], 1)), r[2]) for r in known], "label string, share double, least long")
    unit = F.col("h").cast("double") / float(1 << 64) + 0.5
    thin = keyed.join(F.broadcast(shares), "label").where((unit < F.col("share")) | (F.col("h") == F.col("least")))  # a row a label, most_rows at most
    once = thin.groupBy("label", "h").agg(F.first("text").alias("text"))  # equal texts: any is the first
    nth = F.row_number().over(Window.partitionBy("label").orderBy("h"))
    return once.withColumn("_nth", nth).where(F.col("_nth") <= each).select("label", "text")


def fit(docs: DataFrame, per_lang: int = 800, most_rows: int = 100_000, spans: int = 3, held_back: float = 0.15) -> LanguageModel | None:
    """A model of the rows of docs (text, lang) that have both.

    Fitted on per_lang different texts of every language (or all it has), fewer if all together would be more than
    most_rows.  Texts stay on the executors: the driver gets their n-grams' counts, of bounded size for a text of any
    length, and unpacks them one at a time.
    """
    text, lang = (F.col(quoted(column_of(docs, c))) for c in ("text", "lang"))
    labelled = docs.select(text.alias("text"), lang.cast("string").alias("label")).where(
        "text is not null and label is not null").where(F.col("text").rlike(r"\p{L}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                key = zlib.crc32(text.encode())
                rng = np.random.default_rng(key)
                held = bool(rng.random() < held_back)
                found = examples(*tb.column_bytes(pa.array([text, *_spans(text, rng, 1 if held else spans)], pa.large_string())))
                n = len(found)
                yield pa.RecordBatch.from_arrays([
                    pa.array([label] * n, pa.string()), pa.array([held] * n, pa.bool_()), pa.array([key] * n, pa.int64()), pa.array(range(n), pa.int32()),
                    pa.array([pack(x.astype(np.uint16)) for x, _ in found], pa.binary()), pa.array([pack(c.astype(np.int64)) for _, c in found], pa.binary())],
                    ["label", "held", "key", "number", "buckets", "counts"])
    found = sample(labelled, per_lang, most_rows).mapInArrow(run, "label string, held boolean, key long, number int, buckets binary, counts binary").toArrow()
    columns = [found.column(c).to_pylist() for c in ("key", "label", "number", "buckets", "counts", "held")]
    rows = sorted(zip(*columns))
    return train([(r[1], r[5], r[3], r[4]) for r in rows]) if rows else None


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """docs' doc_id with lang_pred, score and accepted, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**16 buckets x dim, and dim numbers a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            n = batch.num_rows
            lettered = np.array(batch.column(2).to_pylist(), bool)
            names, score = np.full(n, "und", object), np.zeros(n)
            if m is not None and n:
                p = m.probabilities(*tb.column_bytes(batch.column(1)))
                names = np.where(lettered, np.array(m.langs, object)[p.argmax(1)], "und")
                score = np.where(lettered, p.max(1), 0.0)
            accepted = lettered & (score >= (m.reject_below if m is not None else 2.0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names.tolist(), pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())],
                ["doc_id", "lang_pred", "score", "accepted"])
    text = F.col(quoted(column_of(docs, "text")))
    lettered = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    return docs.select(F.col(quoted(column_of(docs, "doc_id"))).cast("long").alias("doc_id"), text.alias("text"), lettered.alias("lettered")).mapInArrow(
        run, "doc_id long, lang_pred string, score double, accepted boolean")
