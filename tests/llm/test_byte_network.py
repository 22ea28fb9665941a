"""The byte network and its registered query against plain loops over the bytes of whole texts."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from quantloom.llm import language_id
from quantloom.llm.queries import queries

SF = "/root/testdata/sf0.001"


def _plain(net, window: bytes) -> np.ndarray:
    """Probabilities of one window: each filter moved over each byte, its largest response, softmax."""
    data = window.ljust(language_id.WINDOW + 3, b"\0")
    pooled, at = [], 0
    for width, n in language_id.WIDTHS:
        kernel = net.filters[: width * language_id.DEPTH, at : at + n].astype(float)
        best = np.full(n, -np.inf)
        for i in range(language_id.WINDOW):
            best = np.maximum(best, np.concatenate([net.embedding[b] for b in data[i : i + width]]).astype(float) @ kernel)
        pooled.append(np.maximum(best + net.bias[at : at + n], 0))
        at += n
    x = np.concatenate(pooled) @ net.out.astype(float) + net.out_bias
    e = np.exp(x - x.max())
    return e / e.sum()


def test_registered_query_by_plain_loops(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    learn = table.where(language_id.remainder_of_three(F.col("doc_id")) != 1).select("doc_id", "text", "lang")
    windows, labels, languages = language_id.sample_windows(learn, 12_000, 10_000)
    net = language_id.train(windows, labels, languages)
    assert not net.filters[2 * language_id.DEPTH :, :8].any() and not net.embedding[0].any()
    got = {r["doc_id"]: r for r in queries()["op1_byte_convolution"](spark, SF).collect()}
    rows = table.collect()
    assert len(got) == len(rows)
    for r in rows:
        own = got[r["doc_id"]]
        assert own["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        if not r["text"] or not any(map(str.isalpha, r["text"])):
            assert (own["lang_pred"], own["score"]) == ("und", 0.0)
            continue
        data = r["text"].encode()
        parts = [data[i : i + language_id.WINDOW] for i in range(0, len(data), language_id.WINDOW)]
        mean = sum(len(p) * _plain(net, p) for p in parts) / len(data)
        assert abs(own["score"] - mean.max()) < 1e-4
        assert own["lang_pred"] == languages[int(mean.argmax())] or np.sort(mean)[-2] > mean.max() - 1e-4
