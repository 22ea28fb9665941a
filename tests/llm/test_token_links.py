"""Alignment of two tokenizers against whole-text encodings and naive loops."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quantloom.llm import token_links
from quantloom.llm.queries import queries

COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def _spans(words):
    ends = np.cumsum([len(w) for w in words]).tolist()
    return list(zip([0, *ends[:-1]], ends))


def _brute(rows):
    """{row number: columns} of (doc_id, text) rows, by loops over whole texts."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    alphabet, names = token_links.byte_alphabet(), {i: t for t, i in a.get_vocab().items()}
    found = {}
    for k, (_, text) in enumerate(rows):
        found[k] = None
        if not text:
            continue
        wanted = (" " + text).encode()
        a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        a_words = [bytes(alphabet[c] for c in names[i]) for i in a_ids]
        b_words = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else b"" if b.is_unknown(i) else p.replace("▁", " ").encode() for i in b_ids for p in [b.id_to_piece(i)]]
        if b"".join(a_words) != wanted or b"".join(b_words) != wanted:
            continue
        sa, sb = _spans(a_words), _spans(b_words)
        common = {e for _, e in sa} & {e for _, e in sb}
        owner_a, owner_b = ([i for i, (lo, hi) in enumerate(spans) for _ in range(lo, hi)] for spans in (sa, sb))
        links = [(a_ids[i], b_ids[j]) for i, j in sorted(set(zip(owner_a, owner_b)))]
        cut = lambda spans, ids: "".join(str(i) + (";" if e in common else ",") for (_, e), i in zip(spans, ids)).split(";")[:-1]
        groups = [f"{x}|{y}" for x, y in zip(cut(sa, a_ids), cut(sb, b_ids), strict=True)]
        found[k] = (len(a_ids), len(b_ids), groups, links)
    counts = Counter(p for x in found.values() if x for p in set(x[3]))
    most = defaultdict(int)
    for (i, _), n in counts.items():
        most[i] = max(most[i], n)
    out = {}
    for k, x in found.items():
        if x is None:
            out[k] = (0, 0, 0, 0, 0, 0, "")
        else:
            links = x[3]
            out[k] = (x[0], x[1], len(x[2]), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(";".join(x[2]).encode()).hexdigest())
    return out


ODD = [
    None, "", " ", "\n", "word ", "  two  blanks ", "a\nb\n\n c", "ﬁ ligature", "▁ mark", "<s> </s> <|endoftext|> <unk>", "a b", "<0x0A>", "\x00 a", "日本語 テキスト😀", "x" * 3000,
    "tab\there\t", "\x1c sep\x1cs", "don't we'll THEY'VE", "1234567890 3.14", "é é", "  line", "mixed \t\n \r\n end", "same text", "same text", "a b", "　wide", "q\n", "\U0001f468‍\U0001f469",
]


def test_units_are_coded_as_in_whole_texts():
    kinds = token_links.TwoTokenizers("byte_bpe_50k.json", "piece_bpe_32k.model")
    assert kinds.cuts
    for text in ODD:
        units = kinds.split(text) if text else []
        assert "".join(units) == (" " + text if text else "")
        if text:
            assert kinds.encode_a(units).ids.tolist() == kinds.a.encode(" " + text, add_special_tokens=False).ids
            assert kinds.encode_b(units).ids.tolist() == kinds.b.encode(text) or not kinds.encode_b(units).spelt.all()


def test_odd_texts_by_loops(spark):
    rows = [(f"d{i % 20}" if i else None, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id string, text string, block long, units string").repartition(3)
    got = sorted((tuple(r[c] for c in ["doc_id", *COLUMNS]) for r in token_links.align_documents(docs).collect()), key=str)
    want = _brute(rows)
    assert got == sorted(((rows[k][0], *v) for k, v in want.items()), key=str)
    assert not token_links.align_documents(docs.limit(0)).collect()


def test_small_blocks_and_forgetting(spark, monkeypatch):
    kinds = token_links.TwoTokenizers("byte_bpe_50k.json", "piece_bpe_32k.model")
    monkeypatch.setattr(token_links, "_UNITS", 3)
    texts = ["one two three four", "five six", "one one two", "unit of words " * 5]
    for text in [*texts, *texts]:
        block, alone = token_links.align_block([text], kinds), _brute([(0, text)])[0]
        assert (block.n_a[0], block.n_b[0], block.n_groups[0], block.n_links[0], block.sha256[0]) == (*alone[:4], alone[6])


def test_pointers_end_at_the_component():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        a, b = (np.append(np.sort(rng.choice(np.arange(1, n), int(rng.integers(0, n)), replace=False)), n) for _ in range(2))
        label, common = token_links.component_ends(a, b), np.intersect1d(a, b)
        want = [len(a) + int(np.searchsorted(b, common[np.searchsorted(common, e)])) for e in [*a, *b]]
        assert label.tolist() == want


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_registered_query(spark, folder):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in queries()["op11_pointer_jumping"](spark, folder).collect()}
    assert got == {rows[k][0]: v for k, v in _brute(rows).items()}
