"""Best-fit packing of token pieces into sequences by bin completion.

Documents are tokenised whole, get an end id, and only those longer than a
sequence are cut, so that the first piece may be shorter.  Full pieces are
sequences by themselves.  All others are dealt into blocks of bounded size, and
each block is packed by branch and bound: around its largest piece it enumerates
the undominated fillings of any number of pieces, lazily and depth first (one where
a single piece left out could replace some of its pieces is left out), and gives a
branch up once its waste allows no solution with fewer sequences than the incumbent.
Best-fit decreasing supplies the first incumbent; the search ends at the lower bound
or after `nodes_per_piece` steps for each piece of the block, keeping the incumbent
(None: no such end, so that a block takes as few sequences as can be).

Defined results: null or empty text is the end id alone; rows that repeat a doc_id
are packed as documents of their own; an empty table gives an empty result;
further columns are ignored by name.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .text_arrays import buffers, releasing, slices
from .tokens import tokenizer

VOCABULARY = "byte_bpe_50k.json"
BLOCK = 8192
NODES_PER_PIECE = 20
PATIENCE = 64


def best_fit(lengths: np.ndarray, room: int) -> list[list[int]]:
    """Best-fit decreasing; bins as lists of lengths."""
    bins: list[list[int]] = []
    by_rest: dict[int, list[int]] = {}
    rests: list[int] = []
    for n in sorted(map(int, lengths), reverse=True):
        at = bisect_left(rests, n)
        if at < len(rests):
            rest = rests[at]
            b = by_rest[rest].pop()
            if not by_rest[rest]:
                del by_rest[rest], rests[at]
            bins[b].append(n)
        else:
            rest, b = room, len(bins)
            bins.append([n])
        left = rest - n
        if left:
            if left not in by_rest:
                by_rest[left] = []
                insort(rests, left)
            by_rest[left].append(b)
    return bins


def _dominated(filling: list[int], rest: int, counts: list[int], avail: int) -> bool:
    """Whether a piece left out could take the place of some pieces of the filling (or of none) and still fit."""
    one, more, run = 0, 0, 0
    for k, y in enumerate(filling):
        more |= (more | one) << y
        one |= 1 << y
        run = run + 1 if k and filling[k - 1] == y else 1
        if counts[y] == run:
            avail &= ~(1 << y)
    # Sums that a piece up to `rest` longer replaces; two or more pieces also by one as long as they are.
    reach, width = one | 1, 1
    wide = (reach << 1 | more) if rest else more
    while width < rest:
        step = min(width, rest - width)
        wide |= wide << step
        width += step
    if rest:
        wide |= more << rest
    return bool(wide & avail)


def _fillings(counts: list[int], avail: int, room: int, spare: int, share: int, clock: list[int], limit: int) -> Iterator[list[int]]:
    """All undominated fillings of `room` that waste at most `spare`, depth first, of any number of pieces.

    Those that waste at most `share` come as they are found, fuller ones of the others after every PATIENCE
    steps; none is left out unless the steps of the whole search (clock, limit) run out.
    """
    chosen: list[int] = []
    held: list[tuple[int, list[int]]] = []
    rest, most, below, since = room, room, None, clock[0]
    while clock[0] < limit:
        x = (avail & ((1 << min(most, rest) + 1) - 1)).bit_length() - 1
        if x > 0:
            if counts[x] <= chosen.count(x):
                most = x - 1
                continue
            chosen.append(x)
            rest, most = rest - x, x
            clock[0] += 1
            continue
        if rest <= spare and not _dominated(chosen, rest, counts, avail):
            if rest <= share:
                since = clock[0]
                yield chosen.copy()
            else:
                heappush(held, (rest, chosen.copy()))
        clock[0] += 1
        if below is None:
            below = list(accumulate(n * c for n, c in enumerate(counts[: room + 1])))  # tokens in pieces of at most that length
        if held and clock[0] - since >= PATIENCE:
            since = clock[0]
            yield heappop(held)[1]
        while chosen:
            y = chosen.pop()
            rest, most = rest + y, y - 1
            if below[min(most, rest)] >= rest - spare:
                break
        else:
            break
    while held:
        yield heappop(held)[1]


def complete_bins(lengths: np.ndarray, room: int, nodes_per_piece: int | None = NODES_PER_PIECE) -> list[list[int]]:
    """Bins (lists of lengths) for pieces of at most `room`, by bin completion; without a budget (None) as few as can be."""
    best = best_fit(lengths, room)
    total = int(lengths.sum())
    bound = max(-(-total // room), int((2 * lengths > room).sum()))
    counts = np.bincount(lengths, minlength=room + 1).tolist()
    avail = sum(1 << n for n, c in enumerate(counts) if c)  # bit n: pieces of length n are left
    left, wasted, clock, limit = len(lengths), 0, [0], 1 << 62 if nodes_per_piece is None else nodes_per_piece * len(lengths)
    path: list[tuple[int, Iterator[list[int]], list[int] | None]] = []  # (largest piece, its fillings, the one in use)

    def take(n: int) -> None:
        nonlocal avail
        counts[n] -= 1
        if not counts[n]:
            avail ^= 1 << n

    def give(n: int) -> None:
        nonlocal avail
        counts[n] += 1
        avail |= 1 << n

    while len(best) > bound and clock[0] < limit:
        if left == 0:
            best = [[largest, *filling] for largest, _, filling in path]
        else:
            largest = avail.bit_length() - 1
            take(largest)
            spare = (len(best) - 1) * room - total - wasted
            share = spare // max(1, len(best) - 1 - len(path))
            path.append((largest, _fillings(counts, avail, room - largest, spare, share, clock, limit), None))
        while path:  # the next filling of the last bin, or back
            largest, fillings, used = path.pop()
            if used is not None:
                for x in used:
                    give(x)
                left += 1 + len(used)
                wasted -= room - largest - sum(used)
            spare = (len(best) - 1) * room - total - wasted
            used = next((f for f in fillings if room - largest - sum(f) <= spare), None)
            if used is not None:
                for x in used:
                    take(x)
                left -= 1 + len(used)
                wasted += room - largest - sum(used)
                path.append((largest, fillings, used))
                break
            give(largest)
        if not path:
            break
    return best


def _cutter(vocabulary: str, end_id: int, room: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = tokenizer(vocabulary)
        end = np.array([end_id], "<u4")
        for batch in batches:
            rows: list[tuple] = []
            ids, texts = batch.column(0), batch.column(1)
            at: list[int] = []
            for i, j in slices(buffers(texts)[1], 1_500_000):
                for d, coded in enumerate(kind.encode(texts.slice(i, j - i).to_pylist()), i):
                    data = np.concatenate([np.frombuffer(coded, kind.dtype).astype("<u4"), end])
                    first = len(data) % room or room
                    for piece, (a, b) in enumerate(zip([0, *range(first, len(data), room)], range(first, len(data) + 1, room), strict=True)):
                        at.append(d)
                        rows.append((piece, a, b - a, zlib.crc32(data[a:b].tobytes())))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.record_batch(
                [ids.take(pa.array(at, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return run


def _packer(room: int, nodes_per_piece: int | None):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], kind="stable").reset_index(drop=True)
        lengths = rows["length"].to_numpy(np.int64)
        starts = np.searchsorted(lengths, np.arange(room + 2))
        sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for b, content in enumerate(complete_bins(lengths, room, nodes_per_piece)):
            at = 0
            for n in content:
                i = starts[n]
                starts[n] += 1
                sequence[i], offset[i] = b, at
                at += n
        return rows.drop(columns="block").assign(sequence_id=(int(rows["block"].iloc[0]) << 32) + sequence, offset=offset)

    return run


def pack(docs: DataFrame, room: int = 1024, end_id: int = 2, vocabulary: str = VOCABULARY, nodes_per_piece: int | None = NODES_PER_PIECE) -> DataFrame:
    """One row for each piece of docs(doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    nodes_per_piece is the budget of the search of a block; None searches until no block can take fewer sequences.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    pieces = scratch.save(docs.select("doc_id", "text").mapInArrow(releasing(_cutter(vocabulary, end_id, room)), schema), "pieces")
    # Row numbers of a written table: the same in every attempt of a task, and even for repeated rows.
    numbered = pieces.withColumn("row", F.monotonically_increasing_id())
    alone = numbered.where(F.col("length") == room).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("row") + (1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    blocks = max(1, -(-pieces.where(F.col("length") < room).count() // BLOCK))
    dealt = numbered.where(F.col("length") < room).withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks))).drop("row")
    packed = dealt.groupBy("block").applyInPandas(_packer(room, nodes_per_piece), schema + ", sequence_id long, offset long")
    return packed.unionByName(alone)
