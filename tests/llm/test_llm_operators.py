"""Brute-force, round-trip and edge cases of the training-data operators."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quantloom.llm import exact_dedup, language_id, line_dedup, mixing, near_dedup, packing, quality, sharding, token_files, url_lists
from quantloom.llm.components import connected_components
from quantloom.llm.queries import oracle_sql, queries
from quantloom.llm.scratch import Scratch
from quantloom.llm.sketching import bands_for, sketch
from quantloom.llm.text_arrays import LOWER, buffers, hash_spans, word_spans
from quantloom.llm.tokens import UnitTokenizer

WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size long"


def _words(rng, n):
    return " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    rng = random.Random(4)
    base = _words(rng, 120)
    near = base.split()
    near[60] = "changed"
    rows = [(i, _words(rng, rng.choice([1, 3, 60, 200])), "en", f"s{i % 3}") for i in range(40)]
    rows += [(50, base, "en", "s0"), (51, base, "en", "s1"), (52, " ".join(near), "en", None), (53, base.upper(), None, "s2"), (54, None, "en", "s0"), (55, "", None, None), (56, " \n\t ", "en", "s0")]
    rows += [(57, _words(rng, 6000), "en", "s1"), (58, "x" * 30_000, "en", "s1"), (59, "x\ny\nx\nlonger line of eight or more words here now\n", "en", "s1"), (60, "longer line of eight or more words here now", "en", "s1")]
    rows += [(60, "longer line of eight or more words here now", "en", "s1"), (None, "no id at all", "en", "s1"), (61, base + " \xa0   é", "fr", "s2")]
    return spark.createDataFrame([(*r, 0, False, 1) for r in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def test_words_and_hashes():
    texts = ["a b  c\n", None, "", "é\x0bz A", "word"]
    values, offsets = buffers(pa.array(texts))
    starts, ends, first = word_spans(values, offsets)
    got = [bytes(values[s:e]).decode() for s, e in zip(starts, ends)]
    assert got == [w for t in texts if t for w in re.findall(WORD, t)] and np.diff(first).tolist() == [3, 0, 0, 3, 1]
    h = hash_spans(values, starts, ends, LOWER)
    assert h[0] == h[5] and len(set(h.tolist())) == 6


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    b = np.concatenate([a[:270], rng.integers(0, 1 << 62, 30).astype(np.uint64)])
    assert abs((sketch(a) == sketch(b)).mean() - 270 / 330) < 0.15
    assert len(sketch(a[:1])) == 128 and (sketch(a[:1]) == sketch(a[:1])).all()
    bands, rows = bands_for(0.85)
    assert (1 - 0.85**rows) ** bands <= 1e-6


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    up = {}

    def find(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()
    assert all(r["root"] == find(r["node"]) for r in got)
    assert {r["node"] for r in got} == {x for e in edges if e[0] != e[1] for x in e}


def _groups(rows, width, percent):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = defaultdict(list)
    for i, t in rows:
        w = re.findall(WORD, (t or "").translate(low))
        if i is not None:
            sets[i].append({tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, width, percent):
    want = _groups(_rows(docs), width, percent)
    got = near_dedup.near_duplicates(docs, width, percent).collect()
    assert len(got) == docs.count()
    assert all(r["component_id"] == want[r["doc_id"]] for r in got if r["doc_id"] is not None)
    assert {r["doc_id"]: r["n_shingles"] for r in got}[54] == 0
    kept = near_dedup.keep_representatives(docs, width, percent)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in got if r["kept"])


def test_large_group_with_loose_members(spark):
    """A chain of copies, each a few words from the last: most links are not to any one leader."""
    rng = random.Random(8)
    words = _words(rng, 400).split()
    rows = []
    for i in range(150):
        for _ in range(5):
            words[rng.randrange(400)] = _words(rng, 1)
        rows.append((i, " ".join(words)))
    want = _groups(rows, 3, 85)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_exact_duplicates(docs):
    groups = defaultdict(list)
    for i, t in _rows(docs):
        groups[t or ""].append(i)
    got = exact_dedup.exact_duplicates(docs).collect()
    by = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    assert len(got) == docs.count()
    for r in got:
        ids = by[bytes(r["digest"]).hex()]
        best = max((i for i in ids if i is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (best, len(ids), r["doc_id"] == best)
    kept = exact_dedup.keep_winners(docs)
    assert kept.count() == len(groups) and kept.columns == docs.columns
    other = exact_dedup.exact_duplicates(docs, F.lit(True)).collect()
    assert sorted(map(str, other)) == sorted(map(str, got))


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(3)
    digests = rng.integers(0, 256, (3000, 32)).astype(np.uint8)
    digests[7, 8:16] = digests[8, 8:16]  # equal keys: told apart by their bytes
    sizes, bits, slots = exact_dedup.build_bucket(digests)
    assert sorted(slots) == list(range(3000))
    table = digests[np.argsort(slots)]
    assert (exact_dedup.find_slots(digests, sizes, bits, table) == slots).all()
    strangers = rng.integers(0, 256, (500, 32)).astype(np.uint8)
    assert (exact_dedup.find_slots(strangers, sizes, bits, table) == -1).all()


def test_mix(spark, docs):
    rows = mixing.mixed_counts(docs).collect()
    assert len(rows) == docs.count()
    want = Counter((i, len(re.findall(WORD, t or ""))) for i, t in _rows(docs))
    assert Counter((r["doc_id"], r["size"]) for r in rows) == want
    assert all(r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in rows)
    targets = {r["source"]: (r["source_size"], r["target"]) for r in rows}
    assert sum(t for _, t in targets.values()) == pytest.approx(sum(s for s, _ in targets.values()))
    assert all(t <= 3 * s + 1e-6 for s, t in targets.values())
    again = mixing.mixed_counts(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    taken = mixing.take_mix(docs)
    assert taken.columns == docs.columns and taken.count() == sum(r["copies"] for r in rows)


def test_mix_hits_targets(spark):
    rng = random.Random(3)
    rows = [(i, " w" * int(rng.paretovariate(1.2) * 20), f"s{i % 4}") for i in range(4000)]
    out = mixing.mixed_counts(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    g = out.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(g.taken / g.target - 1) < 0.02).all()


def test_quality_counts(docs):
    got = defaultdict(list)
    for r in quality.score_documents(docs).collect():
        got[r["doc_id"]].append(r)
    for i, t in _rows(docs):
        w = re.findall(WORD, t or "")
        seen = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        cover = {j + k for j in range(len(w) - 2) if seen[tuple(w[j : j + 3])] > 1 for k in range(3)}
        lines, dup = set(), 0
        for x in (t or "").split("\n"):
            if re.search(WORD, x):
                dup += x in lines
                lines.add(x)
        r = got[i][0]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), dup, len(cover)), i
        assert r["base_failed"] == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (r["base_failed"] and r["kept"])
    assert quality.keep_good(docs).columns == docs.columns


def test_quality_rejects_markup_and_keeps_prose():
    prose = "the water runs down to the old mill and the people of the town come to it in the morning with their bread and " * 1
    prose += "then they sit by the bank for an hour while children play among trees before all of them walk home along a narrow road that leads past fields where horses stand under heavy clouds waiting for rain"
    salad = " ".join("x%$#q&*z|" + chr(0x370 + k % 50) * 3 for k in range(80))
    m = quality.measure(pa.array([prose, salad]), ["en", "en"], quality.BANDS, quality.VOCABULARY)
    assert m["kept"].tolist() == [True, False]


def test_units_equal_whole_texts(docs):
    t = UnitTokenizer("byte_bpe_50k.json", bits=4, long_units=5, store=500)
    odd = ["it's  'll a.b x,y end. End, é. ß, 1. 2,", " a", "a ", "\x1c.\x1c a", "x\t\n\ny", "b\xa0\xa0c", "a\n b", "a \nb", "<|endoftext|> a.", " .　,"]
    for text in [*odd, *(x for _, x in _rows(docs) if x), *odd]:
        got = np.frombuffer(t.encode([text])[0], t.dtype).tolist()
        assert got == t.library.encode(text, add_special_tokens=False).ids, text[:40]


def test_token_files(spark, docs):
    path = Scratch(spark, "t").path("files")
    token_files.write_token_files(docs, path)
    rows = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r["start"])
    t = UnitTokenizer("byte_bpe_50k.json")
    want = Counter((i, tuple([*np.frombuffer(t.encode([x])[0], t.dtype).tolist(), 0])) for i, x in _rows(docs))
    assert Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in rows) == want
    at, last = 0, -1
    for r in rows:
        assert r["start"] == at and (r["doc_id"] if r["doc_id"] is not None else -1) >= last
        at, last = at + len(r["ids"]) // 4, r["doc_id"] if r["doc_id"] is not None else -1


def test_number_coding():
    for n in (0, 1, 5, 1000):
        x = np.random.default_rng(n).choice([0, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1], n).astype(np.uint32)
        control, data = token_files.encode_numbers(x)
        assert (token_files.decode_numbers(control, data, n) == x).all() and len(control) == -(-n // 4)


def test_pack(docs):
    rows = packing.pack(docs).collect()
    t = UnitTokenizer("byte_bpe_50k.json")
    want = sorted(len(np.frombuffer(t.encode([x])[0], t.dtype)) + 1 for _, x in _rows(docs))
    whole, places = defaultdict(int), defaultdict(list)
    for r in rows:
        whole[r["doc_id"]] += r["length"]
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        assert r["length"] == 1024 or r["piece"] == 0
    assert sum(whole.values()) == sum(want)
    for p in places.values():
        end = 0
        for offset, length in sorted(p):
            assert offset == end
            end += length
        assert end <= 1024


def test_bin_completion_beats_or_equals_best_fit():
    for seed in range(6):
        x = np.random.default_rng(seed).integers(1, 1025, 400)
        bins = packing.complete_bins(x, 1024)
        assert sorted(n for b in bins for n in b) == sorted(x.tolist()) and max(map(sum, bins)) <= 1024
        assert len(bins) <= len(packing.best_fit(x, 1024))
    hard = np.array([60, 50, 30, 20, 20, 20] * 3)
    assert len(packing.complete_bins(hard, 100, 200)) == 6


def test_shards(spark, docs):
    rows = sharding.shard_records(docs, 4, 64).collect()
    sizes = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in _rows(docs))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == sizes
    for s in range(4):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    many = spark.range(20000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab"), (F.col("id") % 50).cast("int")).alias("text"))
    placed = sharding.place_records(many, 512)
    sizes = sharding.slot_sizes(placed)
    one = sharding.first_map(sizes, 8)
    path = Scratch(spark, "t").path("map")
    sharding.save_map(one, path)
    two = sharding.grow_map(sharding.load_map(spark, path), sizes, 8)
    sharding.save_map(two, path)
    old, new = ({r["virtual_slot"]: r["shard"] for r in sharding.load_map(spark, path, v).collect()} for v in (1, 2))
    load = Counter()
    for r in sizes.collect():
        load[new[r["virtual_slot"]]] += r["bytes"]
    assert all(new[s] == old[s] or new[s] == 8 for s in old) and len(load) == 9
    assert max(load.values()) < 1.15 * min(load.values())


def test_language_id(spark, docs):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = language_id.remainder_of_three(F.col("doc_id"))
    out = language_id.identify(d, held != 1, max_windows=2000).join(d.select("doc_id", "lang", held.alias("r")), "doc_id").where("r = 1").toPandas()
    assert (out.lang == out.lang_pred).mean() > 0.97 and out.score.between(0, 1).all()
    odd = {r["doc_id"]: r for r in language_id.identify(docs, F.col("doc_id") > 0, max_windows=200).collect()}
    assert [(odd[i]["lang_pred"], odd[i]["score"]) for i in (54, 55, 56)] == [("und", 0.0)] * 3 and odd[57]["lang_pred"] in ("en", "fr")


def _plain_dedup(rows, between, sentence, min_chars):
    """What dedup_substrings must give for distinct (id, hash, text) rows, by first occurrences in plain dictionaries."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    parts, first, blocks = {}, {}, {}
    for doc, h, text in rows:
        units = []
        for b, block in enumerate(re.split(f"({between})", text)[::2]):
            units += [(b, " ".join(re.findall(r"[^\x20\x09-\x0D]+", u.lower()))) for u in re.split(sentence, block)]
        parts[doc, h] = units
        for k, (b, u) in enumerate(units):
            if u:
                first.setdefault(u, (doc, h, k))
        for b in {b for b, _ in units}:
            blocks.setdefault(" ".join(u for c, u in units if c == b and u), (doc, h, b))
    out = {}
    for key, units in parts.items():
        again = [bool(u) and first[u] != (*key, k) for k, (_, u) in enumerate(units)]
        whole = [bool(u) and blocks[" ".join(v for c, v in units if c == b and v)] != (*key, b) for b, u in units]

        def in_long_run(flags):
            runs, run = [], []
            for k, (_, u) in enumerate(units):
                if flags[k]:
                    run.append(k)
                elif u:
                    runs, run = [*runs, run], []
            return {k for r in [*runs, run] if sum(len(units[i][1]) for i in r) >= min_chars for k in r}

        gone = {k for k in range(len(units)) if again[k] and whole[k]} | in_long_run(again)
        passage = in_long_run([k in gone and first[u][:2] != key for k, (_, u) in enumerate(units)])
        out[key] = (gone, not passage and (any(u and k not in gone for k, (_, u) in enumerate(units)) or not any(u for _, u in units)))
    return out


@pytest.mark.parametrize("unit,between", [("line", "\n"), ("paragraph", r"\n[ \t]*\n\s*")])
def test_line_dedup_by_brute_force(spark, docs, unit, between):
    passage = "One sentence of the passage stands here. Then comes another one, which is longer. A third closes it"
    more = [(70, f"Words before {passage}. words behind", ""), (71, f"Other words {passage}. other ends\n\nlast. Odd\r\n", ""), (72, "last。第二句。 last. Odd", ""), (72, "last.\nlast. Odd", ""), (73, "\n\n \n\n", ""), (74, f"{passage}. {passage}. ", "")]
    own = spark.createDataFrame([(i, t, "x") for i, t, _ in more], "doc_id long, text string, kept string").union(docs.select("doc_id", "text", F.lit("x")))
    rows = line_dedup.dedup_substrings(own, unit, 60).collect()
    want = _plain_dedup({(r["doc_id"], r["text_hash"], t) for r, t in ((x, x["t"]) for x in own.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").alias("t")).collect()) if t}, between, r"(?<=[.!?])[ \t]+|(?<=[。！？])[ \t]*", 60)
    texts = {(r["doc_id"], r["h"]): r["text"] for r in own.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    assert len(rows) == own.count() and sum(len(g) > 0 for g, _ in want.values()) >= 3
    for r in rows:
        key = (r["doc_id"], r["text_hash"])
        text = texts[key]
        if not text:
            assert r["text"] == text and r["kept"] and not r["removed_spans"]
            continue
        starts = [a for a, *_ in line_dedup.units_of(text, unit)]
        gone, kept = want[key]
        assert {starts.index(s["start"]) for s in r["removed_spans"]} == gone and r["kept"] == kept, key
        left, at = "", 0
        for s in r["removed_spans"]:
            left, at = left + text[at : s["start"]], s["start"] + s["length"]
        assert r["text"] == left + text[at:]


def test_line_dedup_finds_passages_and_leaves_short_sentences(spark):
    passage = "The old mill stands by the river and turns all day. Its wheel was made of oak, and it has not stopped in years. Nobody knows who built it"
    texts = ["Begin. x " + passage + ". End of one.", "Start. y " + passage + ". End. Other words.", "End. Something else. Start.", "All rights reserved.\nFirst", "All rights reserved.\nSecond"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in line_dedup.dedup_substrings(rows, min_chars=80).collect()}
    assert [out[i]["kept"] for i in range(5)] == [True, False, True, True, True]
    assert out[2]["text"] == texts[2] and out[4]["text"] == "Second" and out[3]["text"] == texts[3]
    assert out[1]["removed_spans"][0]["keep_doc_id"] == 0 and "wheel" not in out[1]["text"]
    named = rows.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text", F.lit(1).alias("units"), F.lit(2).alias("removed_spans"))
    assert {r["doc_id"]: r["kept"] for r in line_dedup.dedup_substrings(named, min_chars=80).collect()}["d1"] is False


def test_url_lists(spark):
    ts = lambda d: F.expr(f"timestamp '2024-01-{d:02d} 00:00:00'")
    at = [("http://a.bad.com/x/y?q", 5), ("http://A.bad.com/x/y", 15), ("https://bad.com:80/", 25), ("https://bad.com/good/1", 5), ("notaurl", 5), (None, 5), ("http://bad.com.org/", 5), ("http://a.bad.com/x/y?q", 5)]
    caps = spark.createDataFrame([(i, u, d) for i, (u, d) in enumerate(at)], "id int, url string, d int").select("id", "url", F.expr("timestamp '2024-01-01 00:00:00' + make_dt_interval(d - 1)").alias("fetched"), F.lit(1).alias("pattern"))
    log = [("spam", "block", "bad.com", 3, "add"), ("spam", "block", "bad.com", 10, "remove"), ("spam", "block", "bad.com", 20, "add"), ("ok", "allow", "bad.com/good", 1, "add"), ("spam", "block", None, 1, "add")]
    entries = spark.createDataFrame(log, "list string, verdict string, pattern string, d int, action string").select("list", "verdict", "pattern", F.expr("timestamp '2024-01-01 00:00:00' + make_dt_interval(d - 1)").alias("dated"), "action")
    out = {r["id"]: r for r in url_lists.judge(caps, entries).collect()}
    assert [out[i]["blocked"] for i in range(8)] == [True, False, True, False, False, False, False, True]
    assert out[3]["matched_list"] == "ok" and len(out) == 8
    assert url_lists.judge(caps.limit(0), entries).count() == 0 and not any(r["blocked"] for r in url_lists.judge(caps, entries.limit(0)).collect())


def test_empty_tables(empty):
    assert near_dedup.near_duplicates(empty).count() == 0
    assert exact_dedup.exact_duplicates(empty).count() == 0 and exact_dedup.keep_winners(empty).count() == 0
    assert mixing.mixed_counts(empty).count() == 0 and mixing.take_mix(empty).count() == 0
    assert quality.score_documents(empty).count() == 0 and quality.keep_good(empty).count() == 0
    assert packing.pack(empty).count() == 0 and sharding.shard_records(empty).count() == 0
    assert language_id.identify(empty, F.lit(True)).count() == 0 and line_dedup.dedup_substrings(empty).count() == 0
    path = Scratch(empty.sparkSession, "t").path("none")
    token_files.write_token_files(empty, path)
    assert token_files.read_token_files(empty.sparkSession, path).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs
    for n, (_, stage) in enumerate(cp.STAGES):
        after = Scratch(spark, "t").save(stage(spark, before, sf), f"s{n}")
        if n < len(cp.STAGES) - 1:
            assert after.columns == columns and set(map(str, after.distinct().collect())) <= set(map(str, before.collect()))
        if n == 1:
            assert after.select("text").distinct().count() == after.count() == before.select("text").distinct().count()
        before = after
    assert before.count() > 0 and set(oracle_sql()) <= set(queries())


def test_clashing_columns_and_string_ids(spark, docs):
    names = ["m", "copies", "row", "id", "src", "size", "n", "_n", "_id", "_hash", "_digest", "_keep_id", "text_hash", "units", "kept", "digest", "winner"]
    rows = docs.select("doc_id", "text", "lang", "source", *[F.lit(k).alias(c) for k, c in enumerate(names)])
    assert mixing.take_mix(rows).columns == rows.columns and mixing.take_mix(rows).count() > 0
    assert exact_dedup.keep_winners(rows).count() == docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert near_dedup.keep_representatives(rows).columns == rows.columns and quality.keep_good(rows).columns == rows.columns
    named = rows.withColumn("doc_id", F.format_string("d%04d", "doc_id")).where("doc_id not like '%null%'")
    want = {("d%04d" % r["doc_id"], "d%04d" % r["keep_id"], r["group_size"]) for r in exact_dedup.exact_duplicates(docs.where("doc_id is not null")).collect()}
    for history in (None, F.lit(False), F.lit(True), F.crc32(F.encode("doc_id", "UTF-8")) % 2 == 0):
        assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.exact_duplicates(named, history).collect()} == want
    parts = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(named, 3, 85).collect()}
    assert parts == {"d%04d" % r["doc_id"]: "d%04d" % r["component_id"] for r in near_dedup.near_duplicates(docs.where("doc_id is not null"), 3, 85).collect()}
    assert packing.pack(named).where("doc_id is null").count() == 0


def test_saved_index_is_read_by_a_later_run(spark, docs):
    path = Scratch(spark, "t").path("index")
    keyed = docs.select("doc_id", exact_dedup.text_digest(F.col("text")).alias("digest"))
    exact_dedup.save_index(exact_dedup.build_index(exact_dedup.distinct_digests(keyed.where("doc_id < 30")), 3), path, 3)
    exact_dedup.save_index(exact_dedup.build_index(exact_dedup.distinct_digests(keyed.where("doc_id < 53")), 5), path, 5)
    known = {r["text"] or "" for r in docs.where("doc_id < 53").collect()}
    fresh = exact_dedup.drop_known(docs, path).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in fresh) == sorted((i or 0, t or "") for i, t in _rows(docs) if (t or "") not in known)
    assert exact_dedup.drop_known(docs, path, version=1).count() == docs.count() - 30
    assert exact_dedup.drop_known(docs.limit(0), path).count() == 0
    with pytest.raises(ValueError):
        exact_dedup.load_index(spark, path, buckets=4)


def _url_patterns(url):
    m = re.match(r"[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::\d*)?([^?#]*)", url or "")
    if not m:
        return []
    host, folders = m.group(1).lower(), [f for f in m.group(2).split("/") if f]
    labels = host.split(".")
    return [".".join(labels[k:]) for k in range(len(labels))] + [host + "/" + "/".join(folders[:k]) for k in range(1, len(folders) + 1)]


def test_url_query_by_brute_force(spark):
    """The registered query over whole pages, its list entries made again from the hosts in plain Python."""
    from datetime import datetime, timedelta

    sf = "/root/testdata/sf0.01"
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()
    hosts = {p[-1] if "/" not in p[-1] else next(x for x in p if "/" not in x) for p in (_url_patterns(r["url"])[:1] for r in pages) if p}
    entries = []
    for host in hosts:
        h = zlib.crc32(host.encode())
        if h % 3 == 0:
            entries += [("spam", "block", host, h % 200, h % 200 + 60 + h % 90), ("trusted", "allow", host + "/fr", h % 100, None)]
    want = {}
    for r in pages:
        fetched, asked = day(r["page_id"] % 366), set(_url_patterns(r["url"]))
        hits = [(len(p), v == "allow", p, name) for name, v, p, a, z in entries if p in asked and day(a) <= fetched and (z is None or fetched < day(z))]
        best = max(hits, default=None)
        want[r["page_id"]] = (best[3], best[2], not best[1]) if best else (None, None, False)
    got = {r["page_id"]: (r["matched_list"], r["matched_pattern"], r["blocked"]) for r in queries()["op3_dated_url_lists"](spark, sf).collect()}
    assert got == want and any(b for *_, b in got.values())


def test_near_dedup_recall_beside_the_threshold(spark):
    """1200 pairs of different texts with 85 to 90 % of their shingles in common are all linked."""
    rng, rows = random.Random(8), []
    for k in range(1200):
        words = [f"w{k}x{i}" for i in range(126)]
        swap = rng.choice([1, 2, 3])  # a changed word in the middle ends three shingles and makes three
        other = list(words)
        for i in range(swap):
            other[20 + 30 * i] = f"other{k}x{i}"
        a, b = ({tuple(w[i : i + 3]) for i in range(124)} for w in (words, other))
        rows += [(2 * k, " ".join(words), 100 * len(a & b) >= 85 * len(a | b)), (2 * k + 1, " ".join(other), True)]
    assert sum(not ok for _, _, ok in rows) == 0
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, ok boolean"), 3, 85)
    assert all(r["component_id"] == r["doc_id"] // 2 * 2 for r in found.collect())


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def _library_ids(table, end):
    library = UnitTokenizer("byte_bpe_50k.json").library
    return {i: np.array([*(library.encode(r["text"], add_special_tokens=False).ids if r["text"] else ()), end], "<u4") for i, r in table.items()}


def test_op8_query_by_the_library(spark, table):
    rows, at = {r["doc_id"]: r for r in queries()["op8_token_files"](spark, SF).collect()}, 0
    for i, ids in sorted(_library_ids(table, 0).items()):
        assert (rows[i]["start"], rows[i]["n_tokens"], rows[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len(rows) == len(table)


def test_op9_query_by_the_library(spark, table):
    ids, pieces, places = _library_ids(table, 2), defaultdict(list), defaultdict(list)
    for r in queries()["op9_bin_completion"](spark, SF).collect():
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(own) == r["length"] <= 1024 and zlib.crc32(own.tobytes()) == r["ids_crc32"]
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, own in ids.items():
        at = 0
        for k, (piece, start, length) in enumerate(sorted(pieces[i])):
            assert (piece, start) == (k, at) and (length == 1024 or k == 0)
            at += length
        assert at == len(own)
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own[:-1])]).tolist() and sum(n for _, n in own) <= 1024


def test_op5_query_by_brute_force(spark, table):
    size = {i: len(re.findall(WORD, r["text"] or "")) for i, r in table.items()}
    total = Counter()
    for i, r in table.items():
        total[r["source"]] += size[i]
    names = sorted(total, key=lambda x: (x is None, x or ""))
    weight, target, open_ = {x: (5, 2, 1)[k % 3] for k, x in enumerate(names)}, {}, set(names)
    while True:  # give each open source its share of what is left, close those that are full
        left, parts = sum(total.values()) - sum(target.values()), sum(weight[x] for x in open_)
        full = {x for x in open_ if left * weight[x] / parts >= 3 * total[x]}
        if not full:
            break
        target.update({x: 3 * total[x] for x in full})
        open_ -= full
    target.update({x: left * weight[x] / parts for x in open_})
    taken = Counter()
    for r in queries()["op5_mix_sources"](spark, SF).collect():
        source = table[r["doc_id"]]["source"]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == total[source] and r["target"] == pytest.approx(target[source])
        assert 0 <= r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[source] += r["taken"]
    longest = max(size.values())
    assert all(abs(taken[x] - target[x]) <= longest for x in names)


def test_op6_op7_queries_by_brute_force(spark, table):
    for r in queries()["op6_tokeniser_fertility"](spark, SF).collect():
        text = table[r["doc_id"]]["text"] or ""
        words = re.findall(WORD, text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(words), sum(map(len, words)), sum(text.count(x) for x in "#*$%&|<>"))
    loads, slots, sizes = Counter(), defaultdict(list), []
    for r in queries()["op7_virtual_slots"](spark, SF).collect():
        data = (table[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "bytes", None) and 0 <= r["shard"] < 8
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        sizes.append(r["size"])
    assert max(loads.values()) - min(loads.values()) <= max(sizes) and len(sizes) == len(table)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
