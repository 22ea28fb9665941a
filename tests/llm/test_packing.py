"""Bin completion: fillings of any number of pieces, and the improvement under the default step budget."""

from itertools import combinations

import numpy as np

from quantloom.llm import packing


def _all_undominated(pieces, room):
    """Brute force over distinct multisets of `pieces`."""
    found = set()
    for n in range(len(pieces) + 1):
        for at in combinations(range(len(pieces)), n):
            chosen = [pieces[i] for i in at]
            out = [p for i, p in enumerate(pieces) if i not in at]
            rest = room - sum(chosen)
            if rest < 0:
                continue
            sums = [(k, sum(s)) for k in range(n + 1) for s in combinations(chosen, k)]
            if not any(s <= x <= s + rest and (k > 1 or x > s) for x in out for k, s in sums):
                found.add(tuple(sorted(chosen, reverse=True)))
    return found


def test_fillings_are_all_undominated_ones():
    for seed in range(30):
        rng = np.random.default_rng(seed)
        pieces, room = sorted(map(int, rng.integers(3, 30, 9)), reverse=True), 60
        counts = np.bincount(pieces, minlength=room + 1).tolist()
        avail = sum(1 << n for n, c in enumerate(counts) if c)
        for share in (0, 60):
            got = [tuple(f) for f in packing._fillings(counts, avail, room, room, share, [0], 1 << 60)]
            assert len(got) == len(set(got)) and set(got) == _all_undominated(pieces, room)


def test_default_budget_beats_best_fit():
    hard = np.array([60, 50, 30, 20, 20, 20] * 3)
    assert len(packing.best_fit(hard, 100)) == 7 and len(packing.complete_bins(hard, 100)) == 6
    rng = np.random.default_rng(1)
    eights = []  # 60 sequences of eight short pieces, each exactly full
    for _ in range(60):
        q = np.diff(np.concatenate([[0], np.sort(rng.choice(np.arange(60, 1024), 7, replace=False)), [1024]]))
        eights += q.tolist()
    for x in (np.array(eights), rng.integers(150, 201, 8192), rng.integers(20, 121, 8192)):
        bins = packing.complete_bins(x, 1024)
        assert sorted(n for b in bins for n in b) == sorted(x.tolist()) and max(map(sum, bins)) <= 1024
        assert len(bins) < len(packing.best_fit(x, 1024))


def _fewest(pieces, room):
    """Brute force: fewest sequences by trying every place of every piece."""
    best = len(pieces)

    def put(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(pieces):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + pieces[i] <= room:
                put(i + 1, [*bins[:b], bins[b] + pieces[i], *bins[b + 1 :]])
        put(i + 1, [*bins, pieces[i]])

    put(0, [])
    return best


def test_search_without_budget_is_exact():
    for seed in range(40):
        rng = np.random.default_rng(seed)
        x = np.sort(rng.integers(15, 60, 11))[::-1]
        bins = packing.complete_bins(x, 100, None)
        assert sorted(n for b in bins for n in b) == sorted(x.tolist()) and max(map(sum, bins)) <= 100
        assert len(bins) == _fewest(x.tolist(), 100)


def test_pack_hands_the_budget_on(spark):
    words = [60, 50, 30, 20, 20, 20] * 3  # best-fit takes 7 sequences of 100
    docs = spark.createDataFrame([(i, " the" * (n - 1)) for i, n in enumerate(words)], "doc_id long, text string")
    used = lambda k: packing.pack(docs, room=100, nodes_per_piece=k).select("sequence_id").distinct().count()
    assert (used(0), used(None)) == (7, 6)
