"""Quality rules from counts of words, lines and symbols and from tokeniser fertility.

Fertility is what a public vocabulary makes of a whole text: characters per token,
the share of tokens that are lone bytes of a longer character (byte fallback), and
the entropy of the token distribution as a share of its maximum for that many
tokens.  Each language, or else script, has a band for the three; text outside its
band is rejected, as the vocabulary then meets letter salad, broken encodings,
markup or loops instead of prose.

Defined results: null text is empty (all counts 0, base_failed, not kept); a text
without tokens has null measures; unknown languages use the band of the script that
most letters belong to, null languages too, but "none" if that is Latin; an empty
table gives an empty result; rows are judged one by one, so ids may repeat or be null; further columns pass through.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .text_arrays import buffers, hash_spans, releasing, slices, window_hashes, word_spans
from .tokens import text_groups, tokenizer

VOCABULARY = "byte_bpe_50k.json"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_WORD_SPACE = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Band:
    """Accepted ranges; entropy is a share of log2(tokens), from 0 to 1."""

    chars_per_token: tuple[float, float]
    byte_share: float
    entropy: tuple[float, float]
    #: Least entropy from each of LENGTHS tokens on, as the share falls with length; below the first, and if empty, that of `entropy`.
    floors: tuple[float, ...] = ()


LENGTHS = (100, 200, 400, 800, 1600, 6400)

#: By language ("none": null language in Latin letters), else by script. Languages: a twentieth of the range outside that of
#: good texts of 50 words or more among labelled ones; where fewer than 30 have a length, the range of all four languages.
BANDS = {
    "en": Band((2.335, 7.0), 0.022, (0.47, 1.0), (0.774, 0.724, 0.685, 0.635, 0.556, 0.482)),
    "de": Band((2.189, 7.0), 0.084, (0.47, 1.0), (0.765, 0.716, 0.669, 0.616, 0.543, 0.482)),
    "fr": Band((1.979, 7.0), 0.164, (0.47, 1.0), (0.765, 0.702, 0.654, 0.608, 0.527, 0.482)),
    "es": Band((1.93, 7.0), 0.153, (0.47, 1.0), (0.765, 0.701, 0.646, 0.604, 0.533, 0.482)),
    "none": Band((1.93, 7.0), 0.164, (0.45, 1.0), (0.765, 0.701, 0.646, 0.604, 0.527, 0.482)),
    "latin": Band((1.35, 7.0), 0.25, (0.45, 1.0)),
    "cyrillic": Band((0.7, 4.0), 0.6, (0.4, 1.0)),
    "greek": Band((0.5, 4.0), 0.7, (0.4, 1.0)),
    "han": Band((0.3, 2.0), 0.98, (0.4, 1.0)),
    "other": Band((0.2, 7.0), 1.0, (0.35, 1.0)),
}
MIN_TOKENS = 50
OPEN = Band((0.0, float("inf")), 1.0, (0.0, 1.0))
_SCRIPTS = ["latin", "cyrillic", "greek", "han", "other"]
# Script of a UTF-8 lead byte, good enough to choose a band: 1 + index into _SCRIPTS, 0 for no letter.
_LEAD = np.zeros(256, np.uint8)
_LEAD[[*range(65, 91), *range(97, 123), *range(0xC3, 0xCB)]] = 1
_LEAD[0xD0:0xD4] = 2
_LEAD[0xCD:0xD0] = 3
_LEAD[0xE3:0xEA] = 4
_LEAD[[*range(0xD4, 0xE3), *range(0xEA, 0xF5)]] = 5


def _repeated(windows: np.ndarray, n_words: int) -> int:
    """Words covered by three-word windows that occur twice or more."""
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(n_words, bool)
    for k in range(3):
        cover[k : n_words - 2 + k] |= twice
    return int(cover.sum())


def _repeated_lines(text: str | None) -> int:
    if not text or "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(_WORD_SPACE)]
    return len(lines) - len(set(lines))


def _partial_characters(name: str) -> np.ndarray:
    """Per id: whether the token is not a run of whole characters."""
    t = tokenizer(name)
    if not hasattr(t, "partial"):
        decode = {}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        decode.update((chr(b), b) for b in shown)
        decode.update((chr(256 + i), b) for i, b in enumerate(b for b in range(256) if b not in shown))
        t.partial = np.zeros(t.size, bool)
        for token, i in t.library.get_vocab(with_added_tokens=False).items():
            try:
                bytes(decode[c] for c in token).decode()
            except (UnicodeDecodeError, KeyError):
                t.partial[i] = True
    return t.partial


def _fertility(strings: list[str | None], chars: np.ndarray, vocabulary: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, [n, 3] characters a token, byte share and entropy) of whole texts under a vocabulary."""
    n_tokens, measures = np.zeros(len(strings), np.int64), np.full((len(strings), 3), np.nan)
    partial, kind = _partial_characters(vocabulary), tokenizer(vocabulary)
    for i, j in text_groups(strings):
        for d, ids in enumerate(kind.encode(strings[i:j]), i):
            ids = np.frombuffer(ids, kind.dtype)
            if len(ids):
                n_tokens[d] = len(ids)
                counts = np.bincount(ids) if len(ids) > 20_000 else np.unique(ids, return_counts=True)[1]
                p = counts[counts > 0] / len(ids)
                entropy = float(-(p * np.log2(p)).sum()) / max(1.0, float(np.log2(len(ids))))
                measures[d] = chars[d] / len(ids), partial[ids].mean(), entropy
    return n_tokens, measures


def _inside(chosen: list[Band], n_tokens: np.ndarray, measures: np.ndarray) -> np.ndarray:
    """Which texts lie in their bands; those of few tokens do."""
    inside = np.ones(len(chosen), bool)
    for d in np.flatnonzero(n_tokens >= MIN_TOKENS):
        b, (fertility, share, entropy) = chosen[d], measures[d]
        length = bisect_right(LENGTHS, n_tokens[d])
        least = b.floors[length - 1] if length and b.floors else b.entropy[0]
        inside[d] = b.chars_per_token[0] <= fertility <= b.chars_per_token[1] and share <= b.byte_share and least <= entropy <= b.entropy[1]
    return inside


def measure(texts: pa.Array, langs: list[str | None], bands: dict[str, Band], vocabulary: str, also: dict[str, dict[str, Band]] | None = None) -> dict[str, np.ndarray | list]:
    """All counts, measures and verdicts of a batch of whole texts."""
    n = len(texts)
    values, offsets = buffers(texts)
    out = {k: np.zeros(n, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens")}
    chars, scripts = np.zeros(n, np.int64), np.zeros((n, 6), np.int64)
    for i, j in slices(offsets):
        own = offsets[i : j + 1]
        starts, ends, first = word_spans(values, own)
        out["n_words"][i:j] = np.diff(first)
        windows = window_hashes(hash_spans(values, starts, ends), 3)
        for d in range(j - i):
            k = first[d + 1] - first[d]
            if k > 3:
                out["n_repeat_words"][i + d] = _repeated(windows[first[d] : first[d + 1] - 2], k)
        part = values[own[0] : own[-1]]
        total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[own - own[0]])
        head = (part & 0xC0) != 0x80
        chars[i:j] = total(head)
        space = (part == 0x20) | ((part >= 0x09) & (part <= 0x0D))
        out["word_chars"][i:j] = chars[i:j] - total(space)
        out["n_symbols"][i:j] = total(_SYMBOL[part])
        lead = _LEAD[part]
        ascii_letters = total(lead == 1)
        scripts[i:j, 1] = ascii_letters
        if len(part) and part.max() >= 0xCD:
            for s in range(2, 6):
                scripts[i:j, s] = total(lead == s)
    strings = texts.to_pylist()
    out["n_dup_lines"][:] = [_repeated_lines(t) for t in strings]

    out["n_tokens"], measures = _fertility(strings, chars, vocabulary)
    names = [_SCRIPTS[k] for k in np.maximum(scripts.argmax(axis=1) - 1, 0)]
    named = [("none" if script == "latin" else script) if lang is None else lang for lang, script in zip(langs, names, strict=True)]
    chosen = lambda b: [b.get(lang) or b.get(script) or b["other"] for lang, script in zip(named, names, strict=True)]
    out["language"], inside = named, _inside(chosen(bands), out["n_tokens"], measures)
    for other, own in (also or {}).items():
        inside &= _inside(chosen(own), *_fertility(strings, chars, other))
    out["base_failed"] = (out["n_words"] < 50) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
    out["chars_per_token"], out["byte_share"], out["entropy"] = measures.T
    out["kept"] = ~out["base_failed"] & inside
    return out


_FIELDS = [
    *((k, "long") for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens")),
    *((k, "double") for k in ("chars_per_token", "byte_share", "entropy")),
    *((k, "boolean") for k in ("base_failed", "kept")),
]


def _texts_and_langs(batch: pa.RecordBatch) -> tuple[pa.Array, list[str | None]]:
    langs = batch.column(batch.schema.get_field_index("lang")).to_pylist() if "lang" in batch.schema.names else [None] * batch.num_rows
    return batch.column(batch.schema.get_field_index("text")), langs


def fit_bands(labelled: DataFrame, vocabulary: str = VOCABULARY, margin: float = 0.05, min_rows: int = 30, max_languages: int = 1000) -> dict[str, Band]:
    """Bands for a vocabulary from the good texts of labelled(text, good[, lang]): `margin` of the range outside it,
    and 5 / n of it more, as five bounds that n texts set leave out about that share of new ones.

    Only texts that pass the base rules count; a language has a least entropy for each of LENGTHS, of all languages
    where it has fewer than min_rows texts of a length, and the most frequent max_languages get a band.  Other
    languages have one that takes everything, as no label says what is good in them.
    """
    ship_package(labelled.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = measure(*_texts_and_langs(batch), {"other": OPEN}, vocabulary)
            able = ~m["base_failed"] & (m["n_tokens"] >= MIN_TOKENS)
            arrays = [m["language"], np.searchsorted(LENGTHS, m["n_tokens"], side="right"), m["chars_per_token"], m["byte_share"], m["entropy"]]
            yield pa.record_batch([pa.array(x) for x in arrays], names=["language", "length", "chars", "share", "entropy"]).filter(pa.array(able))

    good = labelled.where("good").select("text", *(["lang"] if "lang" in labelled.columns else []))
    rows = good.mapInArrow(releasing(run), "language string, length long, chars double, share double, entropy double")
    ends = [f(k).alias(f"{f.__name__}_{k}") for k in ("chars", "share", "entropy") for f in (F.min, F.max)]
    by_length = rows.groupBy("language", "length").agg(F.count(F.lit(1)).alias("n"), *ends)
    of_all = by_length.groupBy(F.lit(None).cast("string").alias("language"), "length")
    fold = [F.sum("n").alias("n"), *(f(f"{f.__name__}_{k}").alias(f"{f.__name__}_{k}") for k in ("chars", "share", "entropy") for f in (F.min, F.max))]
    total = F.sum("n").over(Window.partitionBy("language"))  # a row for each length, seven at most
    ranked = by_length.withColumn("total", total).orderBy(F.desc("total"), "language", "length").limit(max_languages * (len(LENGTHS) + 1))
    found = ranked.drop("total").unionByName(of_all.agg(*fold)).toPandas()
    everyone = found[found["language"].isna()].set_index("length")

    def low(r, k: str) -> float:
        return r[f"min_{k}"] - (margin + 5 / r["n"]) * (r[f"max_{k}"] - r[f"min_{k}"])

    def high(r, k: str) -> float:
        return r[f"max_{k}"] + (margin + 5 / r["n"]) * (r[f"max_{k}"] - r[f"min_{k}"])

    out = {"other": OPEN}
    for language in sorted(found["language"].dropna().unique())[:max_languages]:
        own = found[found["language"] == language].set_index("length")
        whole = {f"{f}_{k}": getattr(own[f"{f}_{k}"], f)() for k in ("chars", "share", "entropy") for f in ("min", "max")} | {"n": own["n"].sum()}
        floors = []
        for n in range(1, len(LENGTHS) + 1):
            r = own.loc[n] if n in own.index and own.loc[n, "n"] >= min_rows else everyone.loc[n] if n in everyone.index else whole
            floors.append(low(r, "entropy"))
        out[language] = Band((low(whole, "chars"), high(whole, "chars")), high(whole, "share"), (low(whole, "entropy"), min(1.0, high(whole, "entropy"))), tuple(floors))
    return out


def score_documents(docs: DataFrame, bands: dict[str, Band] | None = None, vocabulary: str = VOCABULARY, also: dict[str, dict[str, Band]] | None = None) -> DataFrame:
    """doc_id with all counts, measures, base_failed and kept, a row for each row of docs(doc_id, text[, lang]).

    `also` holds bands by further vocabularies; a text is kept if it lies in its bands under all of them.
    """
    ship_package(docs.sparkSession)
    chosen = bands or BANDS
    columns = ["doc_id", "text", *(["lang"] if "lang" in docs.columns else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = measure(*_texts_and_langs(batch), chosen, vocabulary, also)
            arrays = [pa.array(m[k], from_pandas=True) for k, _ in _FIELDS]
            yield pa.record_batch([batch.column(0), *arrays], names=["doc_id", *(k for k, _ in _FIELDS)])

    schema = ", ".join([f"doc_id {docs.schema['doc_id'].dataType.simpleString()}", *(f"{k} {t}" for k, t in _FIELDS)])
    return docs.select(*columns).mapInArrow(releasing(run), schema)


def keep_good(docs: DataFrame, bands: dict[str, Band] | None = None, vocabulary: str = VOCABULARY, also: dict[str, dict[str, Band]] | None = None) -> DataFrame:
    """The rows of docs whose verdict is kept, all columns as they were."""
    ship_package(docs.sparkSession)
    chosen = bands or BANDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(measure(*_texts_and_langs(batch), chosen, vocabulary, also)["kept"]))

    return docs.mapInArrow(releasing(run), docs.schema)
