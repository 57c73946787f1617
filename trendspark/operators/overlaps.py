"""Pairs of token sets over tiles: what two items share is counted inside a task, so that no pair is shuffled before it is judged.

Sets are rows (item_id, node, size, tokens): node is what pairs are told by (the item, or the component it is known to be in),
size how many tokens the item has, and a token a number with its kinds as the lowest KINDS bits. Sides are dealt into
tiles of TILE items; a task takes two tiles, whatever number of items a token has. Work grows with the tokens that pairs
share and with the pairs of the two sides, rows shuffled with items times tiles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendspark.operators.graph import forest
from trendspark.session import materialize

#: Items of a tile, pairs and shared tokens that are counted at a time, bits of a number of tokens, kinds of tokens.
TILE, CELLS, MET, BITS, KINDS = 8192, 1 << 21, 1 << 20, 13, 3

#: From the numbers of tokens shared, of all and of each kind (the first kind last), and the sizes of both sides, whether a pair counts.
Rule = Callable[[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray], np.ndarray]


def _side(rows: pa.Table, side: int) -> tuple[np.ndarray, ...]:
    t = rows.filter(pc.equal(rows["side"], side)).combine_chunks()
    tokens = t["tokens"].combine_chunks() if isinstance(t["tokens"], pa.ChunkedArray) else t["tokens"]
    return t["item_id"].to_numpy(), t["node"].to_numpy(), t["size"].to_numpy(), np.asarray(tokens.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64), tokens.flatten().to_numpy()


def _counted(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...], own: bool) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(places left, places right, numbers shared: of all tokens and of each kind) of the pairs that share a token."""
    n, (known, starts) = len(left[0]), np.unique(left[4], return_inverse=True)
    if not len(known):
        return
    order = np.argsort(starts, kind="stable")
    holders = np.repeat(np.arange(n), left[3])[order]
    ends = np.cumsum(np.bincount(starts, minlength=len(known)))
    at = np.searchsorted(known, right[4])
    at[at == len(known)] = 0
    met = known[at] == right[4]
    of, token = np.repeat(np.arange(len(right[0])), right[3])[met], at[met]
    begin = np.where(token > 0, ends[token - 1], 0)
    many = ends[token] - begin
    kinds = known[token] & (1 << KINDS) - 1
    weight = 1 + sum((kinds >> k & 1) << BITS * (k + 1) for k in range(KINDS))
    # A chunk is a range of items of the right side, of few enough cells and meetings (or one item).
    per = np.bincount(of, weights=many, minlength=len(right[0])).astype(np.int64)
    first, rows = 0, max(1, CELLS // n)
    total = np.concatenate([[0], np.cumsum(per)])
    while first < len(right[0]):
        last = max(first + 1, min(first + rows, int(np.searchsorted(total, total[first] + MET, "right")) - 1))
        a, b = np.searchsorted(of, [first, last])
        if a < b:
            k = many[a:b]
            spot = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(begin[a:b], k)
            cell = np.repeat((of[a:b] - first) * n, k) + holders[spot]
            sums = np.bincount(cell, weights=np.repeat(weight[a:b], k), minlength=(last - first) * n)
            found = np.flatnonzero(sums)
            r, l = found // n + first, found % n
            if own:
                keep = left[0][l] < right[0][r]
                found, r, l = found[keep], r[keep], l[keep]
            value = sums[found].astype(np.int64)
            yield l, r, [value >> BITS * k & (1 << BITS) - 1 for k in range(KINDS + 1)]
        first = last


def _tiles(sets: DataFrame, some: DataFrame | None) -> DataFrame:
    """The rows of each pair of tiles: side 0 and 1; tiles of one set meet those before them and themselves."""
    parts = lambda df: max(1, -(-df.count() // TILE))
    n = parts(sets)
    part = lambda m: F.pmod(F.xxhash64("item_id"), F.lit(m)).cast("int")
    row = lambda p, q, side: F.struct(p.alias("p"), q.alias("q"), F.lit(side).alias("side"))
    upto = lambda m: F.sequence(F.lit(0), F.lit(m - 1))
    if some is not None:
        m = parts(some)
        every = sets.select("*", F.inline(F.transform(upto(m), lambda p: row(p, part(n), 1))))
        return some.select("*", F.inline(F.transform(upto(n), lambda q: row(part(m), q, 0)))).unionByName(every)
    both = F.concat(F.transform(F.sequence(part(n), F.lit(n - 1)), lambda q: row(part(n), q, 0)), F.transform(F.sequence(F.lit(0), part(n)), lambda p: row(p, part(n), 1)))
    return sets.select("*", F.inline(both))


def _checked(sets: DataFrame) -> DataFrame:
    most = (1 << BITS) - 1
    return sets.withColumn("tokens", F.when(F.size("tokens") <= most, F.col("tokens")).otherwise(F.raise_error(F.lit(f"an item has more than {most} tokens"))))


def alike(sets: DataFrame, rule: Rule) -> DataFrame:
    """(left_id, right_id, shared, left_size, right_size) of the pairs of items for which the rule holds, left_id < right_id; an item is one row."""

    def each(rows: pa.Table) -> pa.Table:
        own = rows["p"][0].as_py() == rows["q"][0].as_py()
        left, right = _side(rows, 0), _side(rows, 1)
        out = [np.empty((0, 5), dtype=np.int64)]
        for l, r, counts in _counted(left, right, own):
            good = rule(counts[0], counts[1:], left[2][l], right[2][r])
            l, r, shared = l[good], r[good], counts[0][good]
            swap = left[0][l] > right[0][r]
            ids, sizes = np.stack([left[0][l], right[0][r]]), np.stack([left[2][l], right[2][r]])
            ids[:, swap], sizes[:, swap] = ids[::-1, swap], sizes[::-1, swap]
            out.append(np.stack([*ids, shared, *sizes], axis=1))
        return pa.table(dict(zip(("left_id", "right_id", "shared", "left_size", "right_size"), np.concatenate(out).T, strict=True)))

    dealt = _tiles(_checked(sets), None)
    return dealt.groupBy("p", "q").applyInArrow(each, "left_id long, right_id long, shared long, left_size long, right_size long")


def bridges(sets: DataFrame, some: DataFrame, rule: Rule) -> DataFrame:
    """(src, dst) of nodes: for the pairs of one of `some` with one of all sets that the rule holds for, edges with the same components.

    A task of two tiles gives no more edges than they have nodes.
    """

    def each(rows: pa.Table) -> pa.Table:
        left, right = _side(rows, 0), _side(rows, 1)
        nodes, place = np.unique(np.concatenate([left[1], right[1]]), return_inverse=True)
        a, b, root = place[: len(left[1])], place[len(left[1]) :], np.arange(len(nodes))
        for l, r, counts in _counted(left, right, False):
            apart = root[a[l]] != root[b[r]]
            l, r, counts = l[apart], r[apart], [c[apart] for c in counts]
            good = rule(counts[0], counts[1:], left[2][l], right[2][r])
            root = forest(root, a[l[good]], b[r[good]])
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.table({"src": nodes[root[moved]], "dst": nodes[moved]})

    return _tiles(_checked(sets), _checked(some)).groupBy("p", "q").applyInArrow(each, "src long, dst long")


def numbered(tokens: DataFrame, kinds: list[str]) -> DataFrame:
    """tokens (token, ...) with `number`, one of each distinct row, and the kinds, boolean columns, in its lowest bits; written out, as numbers follow from where rows lie."""
    bits = sum((F.col(k).cast("long") * (1 << i) for i, k in enumerate(kinds)), F.lit(0).cast("long"))
    return materialize(tokens.withColumn("number", F.monotonically_increasing_id() * (1 << KINDS) + bits), "token-numbers")
