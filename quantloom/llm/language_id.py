"""Language identification by a byte convolutional network trained in numpy.

A text is cut into windows of 256 bytes.  Bytes are embedded, filters of several
widths slide over a window, each filter keeps its largest response, and a softmax
layer turns these into language probabilities.  A text gets the language with the
largest mean probability over all its windows, weighted by their bytes, so whole
texts are read.  Training takes a bounded sample of labelled texts: up to
`max_windows` windows, shared evenly by the languages (at most `max_languages`, the
most frequent), drawn by hash over the whole table and from whole texts; the same
rows give the same sample, whatever their order and partitions.

Defined results: a text that is null or has no letter is `und` with score 0, as is
every text if nothing can be learnt; null labels are not learnt from; ids may
repeat or be null; an empty table gives an empty result; further columns are
ignored by name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .text_arrays import buffers

WINDOW = 256
WIDTHS = ((2, 8), (3, 12), (4, 12))  # (bytes, filters)
DEPTH = 8
BATCH = 64


@dataclass
class ByteNet:
    """Parameters of the network; `filters` holds all widths, zero beyond a filter's own."""

    languages: list[str]
    embedding: np.ndarray  # [256, DEPTH]; byte 0 stays zero and pads
    filters: np.ndarray  # [widest * DEPTH, n filters]
    bias: np.ndarray
    out: np.ndarray  # [n filters, n languages]
    out_bias: np.ndarray

    def patches(self, windows: np.ndarray) -> np.ndarray:
        """[n * WINDOW, widest * DEPTH] inputs of the filters at every byte."""
        widest = WIDTHS[-1][0]
        padded = np.zeros((len(windows), WINDOW + widest - 1), np.uint8)
        padded[:, :WINDOW] = windows
        e = self.embedding[padded]
        return np.concatenate([e[:, k : k + WINDOW] for k in range(widest)], axis=2).reshape(-1, widest * DEPTH)

    def responses(self, windows: np.ndarray) -> np.ndarray:
        return (self.patches(windows) @ self.filters).reshape(len(windows), WINDOW, -1)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """[n, n languages] for uint8[n, WINDOW]."""
        out = np.empty((len(windows), len(self.languages)), np.float32)
        for i in range(0, len(windows), BATCH):
            pooled = np.maximum(self.responses(windows[i : i + BATCH]).max(axis=1) + self.bias, 0)
            out[i : i + BATCH] = _softmax(pooled @ self.out + self.out_bias)
        return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = 6, seed: int = 3, rate: float = 4e-3) -> ByteNet:
    """Fit by Adam on the cross-entropy, each language weighing the same."""
    rng = np.random.default_rng(seed)
    widest, n_filters = WIDTHS[-1][0], sum(n for _, n in WIDTHS)
    mask = np.concatenate([np.repeat((np.arange(widest * DEPTH) < w * DEPTH)[:, None], n, axis=1) for w, n in WIDTHS], axis=1)
    normal = lambda *shape: rng.standard_normal(shape).astype(np.float32)
    net = ByteNet(
        languages, normal(256, DEPTH) * 0.5, normal(widest * DEPTH, n_filters) * 0.25 * mask, np.zeros(n_filters, np.float32),
        normal(n_filters, len(languages)) * 0.3, np.zeros(len(languages), np.float32),
    )
    net.embedding[0] = 0
    names = ["embedding", "filters", "bias", "out", "out_bias"]
    first = {k: np.zeros_like(getattr(net, k)) for k in names}
    second = {k: np.zeros_like(getattr(net, k)) for k in names}
    counts = np.bincount(labels, minlength=len(languages))
    weight = (len(labels) / (len(languages) * np.maximum(counts, 1))).astype(np.float32)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for i in range(0, len(order), BATCH):
            at = order[i : i + BATCH]
            x, y = windows[at], labels[at]
            patches = net.patches(x)
            response = (patches @ net.filters).reshape(len(at), WINDOW, n_filters)
            best = response.argmax(axis=1)
            pooled = np.maximum(np.take_along_axis(response, best[:, None, :], axis=1)[:, 0] + net.bias, 0)
            p = _softmax(pooled @ net.out + net.out_bias)
            p[np.arange(len(at)), y] -= 1
            p *= weight[y][:, None] / len(at)
            back = (p @ net.out.T) * (pooled > 0)
            chosen = patches.reshape(len(at), WINDOW, -1)[np.arange(len(at))[:, None], best]  # [n, filters, inputs]
            inward = (back[:, :, None] * net.filters.T[None]).reshape(len(at), n_filters, widest, DEPTH)
            padded = np.zeros((len(at), WINDOW + widest - 1), np.uint8)
            padded[:, :WINDOW] = x
            touched = padded[np.arange(len(at))[:, None, None], best[:, :, None] + np.arange(widest)]
            embedding = np.zeros_like(net.embedding)
            np.add.at(embedding, touched.ravel(), inward.reshape(-1, DEPTH))
            embedding[0] = 0
            slopes = {"embedding": embedding, "filters": np.einsum("nf,nfk->kf", back, chosen) * mask, "bias": back.sum(axis=0), "out": pooled.T @ p, "out_bias": p.sum(axis=0)}
            step += 1
            for k, g in slopes.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                setattr(net, k, (getattr(net, k) - rate * move).astype(np.float32))
    return net


def remainder_of_three(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 3; null for null."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3


def sample_windows(labelled: DataFrame, max_windows: int, max_languages: int, per_text: int = 3) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(windows, labels, languages) from labelled(doc_id, text, lang): a bounded sample, drawn by hash."""
    usable = labelled.where("lang is not null and text is not null and length(text) > 0")
    common = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()  # part of the bounded sample
    languages = sorted(r["lang"] for r in common)
    if len(languages) == 0:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64), []
    share = max_windows / per_text / len(languages)
    chances = labelled.sparkSession.createDataFrame([(r["lang"], min(1.0, share / r["count"])) for r in common], "lang string, chance double")
    usable = usable.join(F.broadcast(chances), "lang")  # at most max_languages rows
    # Draws by id and text: rows that share an id are drawn apart, and equal windows count once, however often they occur.
    drawn = usable.where(F.pmod(F.xxhash64(F.lit(11), "doc_id", "text"), F.lit(1 << 30)) < F.col("chance") * (1 << 30))
    data = F.encode("text", "UTF-8")
    windows = F.ceil(F.length(data) / WINDOW)
    starts = F.array(*[F.pmod(F.xxhash64(F.lit(k), "doc_id", "text"), windows) * WINDOW + 1 for k in range(per_text)])
    rows = drawn.select("lang", data.alias("data"), F.explode(F.array_distinct(starts)).alias("at"))
    cut = rows.select("lang", F.expr(f"substring(data, cast(at as int), {WINDOW})").alias("w")).distinct()
    got = cut.orderBy(F.xxhash64(F.lit(12), "lang", "w"), "lang", "w").limit(2 * max_windows).collect()
    out = np.zeros((len(got), WINDOW), np.uint8)
    for i, r in enumerate(got):
        out[i, : len(r["w"])] = np.frombuffer(r["w"], np.uint8)
    number = {x: i for i, x in enumerate(languages)}
    return out, np.array([number[r["lang"]] for r in got], np.int64), languages


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _predictor(net: ByteNet | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            values, offsets = buffers(texts)
            able = np.array([_has_letter(t.as_py()) for t in texts], bool)
            best, score = np.zeros(len(able), np.int64), np.zeros(len(able))
            if net is not None:
                # Rows in runs of about a thousand windows.
                size = np.where(able, -(-np.diff(offsets) // WINDOW), 0)
                ends = np.cumsum(size)
                i = 0
                while i < len(able):
                    j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + 1024, side="right")))
                    _predict_rows(net, values, offsets, size, i, min(j, len(able)), best, score)
                    i = j
            named = [net.languages[b] if ok and net is not None else "und" for b, ok in zip(best, able, strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(named, pa.string()), pa.array(np.where(able, score, 0.0))], names=["doc_id", "lang_pred", "score"])

    return run


def _predict_rows(net: ByteNet, values: np.ndarray, offsets: np.ndarray, size: np.ndarray, i: int, j: int, best: np.ndarray, score: np.ndarray) -> None:
    rows = i + np.flatnonzero(size[i:j])
    if not len(rows):
        return
    windows = np.zeros((int(size[rows].sum()), WINDOW), np.uint8)
    lengths = np.empty(len(windows), np.float64)
    at, firsts = 0, []
    for r in rows:
        part, k = values[offsets[r] : offsets[r + 1]], int(size[r])
        windows[at : at + k].reshape(-1)[: len(part)] = part
        lengths[at : at + k] = WINDOW
        lengths[at + k - 1] = len(part) - (k - 1) * WINDOW
        firsts.append(at)
        at += k
    p = net.probabilities(windows) * lengths[:, None]
    mean = np.add.reduceat(p, firsts, axis=0) / np.add.reduceat(lengths, firsts)[:, None]
    best[rows] = mean.argmax(axis=1)
    score[rows] = np.minimum(mean.max(axis=1), 1.0)


def identify(docs: DataFrame, learn: Column, max_windows: int = 12_000, max_languages: int = 10_000) -> DataFrame:
    """(doc_id, lang_pred, score), a row for each row of docs; learns from text and lang of rows where `learn` holds."""
    ship_package(docs.sparkSession)
    windows, labels, languages = sample_windows(docs.where(learn).select("doc_id", "text", "lang"), max_windows, max_languages)
    net = train(windows, labels, languages) if len(labels) else None
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_predictor(net), f"doc_id {kind}, lang_pred string, score double")
