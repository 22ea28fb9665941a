"""The default bands against the labelled texts they were set on."""

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from quantloom.llm import quality


def _kept(known: bool, bands=quality.BANDS):
    """Shares of bad and of good texts kept, of those that pass the base rules."""
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").merge(pd.read_parquet("/root/testdata/sf0.01/labels.parquet"), on="doc_id")
    m = quality.measure(pa.array(docs["text"].tolist(), pa.string()), docs["lang"].tolist() if known else [None] * len(docs), bands, quality.VOCABULARY)
    return [m["kept"][~m["base_failed"] & (docs["quality"] == q).to_numpy()].mean() for q in (0, 1)]


def test_bands_reject_most_bad_texts():
    bad, good = _kept(known=True)
    assert bad < 0.3 and good > 0.97


def test_null_languages_have_a_band_of_their_own():
    bad, good = _kept(known=False)
    by_script, _ = _kept(known=False, bands={k: b for k, b in quality.BANDS.items() if k != "none"})
    assert bad < by_script and good > 0.97


def test_fitted_bands_hold_on_held_out_texts(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(labels.select("doc_id", "quality"), "doc_id")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    known = docs.where(part > 0).select("text", "lang", (F.col("quality") == 1).alias("good"))
    rest = docs.where(part == 0).toPandas()
    vocabularies = {v: quality.fit_bands(known, v) for v in (quality.VOCABULARY, "word_bpe_49k.json")}
    own = vocabularies.pop(quality.VOCABULARY)
    assert {"en", "other"} <= set(own) and all(len(b.floors) == len(quality.LENGTHS) for k, b in own.items() if k != "other")
    texts, langs = pa.array(rest["text"].tolist(), pa.string()), rest["lang"].tolist()
    kept = {}
    for name, also in (("one", None), ("two", vocabularies)):
        m = quality.measure(texts, langs, own, quality.VOCABULARY, also)
        kept[name] = [m["kept"][~m["base_failed"] & (rest["quality"] == q).to_numpy()].mean() for q in (0, 1)]
    print(kept)
    assert kept["one"][0] < 0.4 and kept["one"][1] > 0.93
    assert kept["two"][0] <= kept["one"][0] and kept["two"][1] > 0.9


def test_bands_of_an_empty_table_take_everything(spark):
    assert quality.fit_bands(spark.createDataFrame([], "text string, lang string, good boolean")) == {"other": quality.OPEN}
