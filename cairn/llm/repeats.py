"""Removal of repeated byte strings by a distributed merge sort of suffixes that knows common prefixes.

Wanted is every byte within a string of SPAN bytes that starts anywhere else too, judged on the input.

1. Anchors. Each window of SPAN bytes is given the place in it whose GRAM bytes have the least hash. Equal
   windows have the same place, so only suffixes that start at anchors need to be sorted: about 2 of
   SPAN - GRAM + 2 places. All windows of one anchor together are a strip: the suffix from the anchor on, and
   what stands before it. Anchors whose GRAM bytes occur once in the corpus, by count of a 64-bit hash, have
   no equal window and are left out.
2. Runs. Each task sorts its strips' suffixes into a run, sets equal strips together, codes each suffix by the
   length of the prefix that it has in common with the one before and by the rest of it, and cuts the run at
   splitters: suffixes' first GRAM bytes from a sample of anchors, so that ranges have about as many strips.
3. Merge. A range's parts of all runs go through a loser tree that compares two suffixes only from the end of what
   is known to be common on; the ranges one after the other are all suffixes in order. Strips with a common prefix of
   GRAM bytes come out in a row as one group. A strip that occurs twice has all its windows repeated; others of a
   group are held against each other by the common lengths after and before the anchor, or in larger groups by
   the windows' hashes, and what these find is compared byte by byte.

Passages that very many documents quote would be one large group in one task. Anchors that occur more than HOT times
don't enter a range: each run sets their equal strips together and gives rows of single windows, which Spark counts by
128-bit hashes. The same is done with a group that turns out to have more than MANY different strips.
"""

from __future__ import annotations

import pickle
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

SPAN, GRAM = 200, 64
WINDOW = SPAN - GRAM + 1
CHUNK = 100_000  # windows that are looked at together; their places take 17 bits
FEW, MANY = 6, 2_000  # strips of a group that are compared pair by pair, by hash, or beyond that as rows
HOT = 20_000  # anchors with the same GRAM bytes beyond which windows are counted without a merge
SAMPLED = 64  # one in so many different anchors is in the sample for splitters
PER_RANGE = 20  # anchors of the sample for each range
RUN_BYTES = 48 << 20
STRIPS = 100_000  # strips for each range, so that ranges follow the input
BASE = 0x9E3779B97F4A7C15 | 1


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse, modulo 2**64."""
    base = np.full(n, BASE, dtype=np.uint64)
    back = np.full(n, pow(BASE, -1, 1 << 64), dtype=np.uint64)
    base[0] = back[0] = 1
    return np.multiply.accumulate(base), np.multiply.accumulate(back)


def _mix(v: np.ndarray) -> np.ndarray:
    v = (v ^ (v >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    v = (v ^ (v >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return v ^ (v >> np.uint64(32))


def _sums(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(CHUNK + 2 * SPAN if b.shape[-1] <= CHUNK + SPAN else b.shape[-1] + 1)
    sums = np.zeros((*b.shape[:-1], b.shape[-1] + 1), dtype=np.uint64)
    np.cumsum(b * up[: b.shape[-1]], axis=-1, out=sums[..., 1:])
    return sums, down


def strips(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each strip: hash of the anchor's GRAM bytes, anchor, first and last start of its windows."""
    found = [_strips(raw[at : at + CHUNK + SPAN - 1], at) for at in range(0, max(0, len(raw) - SPAN + 1), CHUNK)]
    if not found:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _strips(raw: bytes, offset: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.uint64)
    sums, down = _sums(b)
    gram = _mix((sums[GRAM:] - sums[:-GRAM]) * down[: len(b) - GRAM + 1])
    place = np.uint64((1 << 17) - 1)
    key = (gram & ~place) | np.arange(len(gram), dtype=np.uint64)
    blocks = -(-len(key) // WINDOW)
    padded = np.full(blocks * WINDOW, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(key)] = key
    padded = padded.reshape(blocks, WINDOW)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(b) - SPAN + 1
    least = (np.minimum(behind[:n], ahead[WINDOW - 1 : WINDOW - 1 + n]) & place).astype(np.int64)
    first = np.concatenate([[0], np.nonzero(least[1:] != least[:-1])[0] + 1])
    last = np.concatenate([first[1:] - 1, [n - 1]])
    anchor = least[first]
    return gram[anchor], anchor + offset, first + offset, last + offset


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which known bytes are certain."""
    n = min(len(a), len(b)) - known
    if n <= 0:
        return known
    other = int.from_bytes(a[known : known + n]) ^ int.from_bytes(b[known : known + n])
    return known + n - (other.bit_length() + 7) // 8


class Run:
    """A front-coded sorted run, read from its beginning."""

    def __init__(self, blocks: list[bytes]):
        self.items = (item for block in blocks for item in zip(*pickle.loads(pa.decompress(block[8:], int.from_bytes(block[:8]), codec="zstd", asbytes=True)), strict=True))
        self.text, self.rest = b"", None

    def advance(self) -> int:
        """Steps on; gives what the new suffix has in common with the one before, -1 after the last."""
        item = next(self.items, None)
        if item is None:
            return -1
        self.text = self.text[: item[0]] + item[1]
        self.rest = item[2:]
        return item[0]


def merge(runs: list[Run]) -> Iterator[tuple[int, bytes, tuple]]:
    """(length in common with the one before, suffix, rest) of all runs' items in order.

    Each loser keeps what it has in common with the winner over it. Of two contenders with other lengths in
    common with the last winner the one with more comes first; only with equal lengths are bytes compared, from
    there on.
    """
    size = 1
    while size < len(runs):
        size *= 2
    known = [run.advance() for run in runs] + [-1] * (size - len(runs))
    known = [min(k, 0) for k in known]

    def play(i: int, j: int) -> tuple[int, int]:
        """Winner and loser."""
        a, b = known[i], known[j]
        if a != b:
            return (i, j) if a > b else (j, i)
        if a < 0:
            return i, j
        x, y = runs[i].text, runs[j].text
        m = common(x, y, a)
        if m == len(x) or m < len(y) and x[m] < y[m]:
            known[j] = m
            return i, j
        known[i] = m
        return j, i

    loser, winner = [-1] * size, [-1] * (2 * size)
    winner[size:] = range(size)
    for node in range(size - 1, 0, -1):
        winner[node], loser[node] = play(winner[2 * node], winner[2 * node + 1])
    top = winner[1]
    while known[top] >= 0:
        yield known[top], runs[top].text, runs[top].rest
        known[top] = runs[top].advance()
        node = (top + size) // 2
        while node:
            top, loser[node] = play(top, loser[node])
            node //= 2


def build_run(items: list[tuple], splitters: list[bytes], number: int) -> tuple[list[tuple[int, int, bytes]], list[tuple], list[tuple]]:
    """Blocks (range, run, bytes) of one sorted run, marks of strips that occur twice in it, and windows of hot strips.

    items: (hot, suffix, before, low, high, doc_id, h, anchor); windows start low to high before the anchor.
    A strip that occurs once keeps its owner; of one that occurs more often every owner is marked here.
    """
    items.sort(key=lambda x: x[:5])
    out, marks, rows, at = [], [], [], 0
    block, last, here = [], b"", 0

    def close():
        if block:
            raw = pickle.dumps(list(zip(*block, strict=True)), protocol=5)
            out.append((here, number, len(raw).to_bytes(8) + pa.compress(raw, codec="zstd", asbytes=True)))

    while at < len(items):
        hot, suffix, before, low, high, *_ = items[at]
        end = at + 1
        while end < len(items) and items[end][:5] == items[at][:5]:
            end += 1
        if end - at > 1:
            marks += [(d, h, a - high, a - low + SPAN) for _, _, _, low, high, d, h, a in items[at:end]]
        owner = None if end - at > 1 else items[at][5:]
        if hot:
            rows += window_rows(suffix, before, low, high, 2 if owner is None else 1, owner)
        else:
            if (place := bisect_right(splitters, suffix[:GRAM])) != here:
                close()
                block, last, here = [], b"", place
            n = common(last, suffix)
            block.append((n, suffix[n:], before, low, high, owner))
            last = suffix
        at = end
    close()
    return out, marks, rows


def window_rows(suffix: bytes, before: bytes, low: int, high: int, n: int, owner: tuple | None) -> list[tuple]:
    """(w, v, n, doc_id, h, start) of a strip's windows: their digest, how often they are known, and of a single one whose it is."""
    text, place, out = before + suffix, len(before), []
    own = owner if n == 1 else (None, None, 0)
    for far in range(low, high + 1):
        digest = xxhash.xxh3_128_digest(text[place - far : place - far + SPAN])
        out.append((int.from_bytes(digest[:8], signed=True), int.from_bytes(digest[8:], signed=True), n, own[0], own[1], own[2] - far))
    return out


def settle(group: list[tuple[bytes, bytes, int, int, list]]) -> list[tuple]:
    """Marks (doc_id, h, start, stop) of the strips of one group; members: suffix, before, low, high, owners (None: two or more)."""
    marks = []
    for _, _, low, high, owners in group:
        if len(owners) > 1:
            marks += [(d, h, a - high, a - low + SPAN) for d, h, a in filter(None, owners)]
    alone = [i for i, m in enumerate(group) if len(m[4]) == 1 and m[4][0] is not None]
    if len(group) < 2 or not alone:
        return marks
    if len(group) <= FEW:
        for i in alone:
            suffix, before, low, high, ((d, h, a),) = group[i]
            for j, (other, ahead, *_) in enumerate(group):
                if i != j:
                    right, left = common(suffix, other), common(before[::-1], ahead[::-1])
                    first, last = max(low, SPAN - right), min(high, left)
                    if first <= last:
                        marks.append((d, h, a - last, a - first + SPAN))
        return marks
    hashes, valid = windows(group)
    order = np.argsort(np.where(valid, hashes, np.arange(len(group), dtype=np.uint64)[:, None]), axis=0, kind="stable")
    ranked, fine = np.take_along_axis(hashes, order, axis=0), np.take_along_axis(valid, order, axis=0)
    same = (ranked[1:] == ranked[:-1]) & fine[1:] & fine[:-1]
    doubtful = differing(group, order, same)
    twice = np.zeros_like(valid)
    pair = np.zeros_like(valid)
    pair[1:] |= same
    pair[:-1] |= same
    np.put_along_axis(twice, order, pair, axis=0)
    for far in doubtful:  # windows with one hash that differ: those of this distance are held against each other by their bytes
        own = [window(m, far, far) if valid[i, far] else None for i, m in enumerate(group)]
        often = Counter(own)
        twice[:, far] = [w is not None and often[w] > 1 for w in own]
    for i in alone:
        d, h, a = group[i][4][0]
        for before in np.nonzero(twice[i])[0].tolist():
            marks.append((d, h, a - before, a - before + SPAN))
    return marks


def window(strip: tuple, low: int, high: int) -> bytes:
    """The bytes of a strip's windows from low to high before the anchor."""
    return strip[1][len(strip[1]) - high :] + strip[0][: SPAN - low]


def differing(group: list[tuple], order: np.ndarray, same: np.ndarray) -> list[int]:
    """Distances at which windows with the same hash have other bytes; windows of two strips that follow on each other are compared as one."""
    k, far = np.nonzero(same)
    if not len(k):
        return []
    pair = order[k, far] * len(group) + order[k + 1, far]
    by = np.lexsort((far, pair))
    far, pair, out = far[by], pair[by], set()
    cuts = np.nonzero((pair[1:] != pair[:-1]) | (far[1:] != far[:-1] + 1))[0] + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(far)], strict=True):
        i, j = divmod(int(pair[a]), len(group))
        low, high = int(far[a]), int(far[b - 1])
        if window(group[i], low, high) != window(group[j], low, high):
            out.update(x for x in range(low, high + 1) if window(group[i], x, x) != window(group[j], x, x))
    return sorted(out)


def windows(group: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """(strip x distance from window to anchor) hashes of the windows, and which the strips have."""
    wide = WINDOW - 1
    b = np.zeros((len(group), wide + SPAN), dtype=np.uint64)
    for i, (suffix, before, *_) in enumerate(group):
        b[i, wide - len(before) : wide] = np.frombuffer(before, np.uint8)
        b[i, wide : wide + len(suffix)] = np.frombuffer(suffix, np.uint8)
    sums, down = _sums(b)
    at = wide - np.arange(wide + 1)
    far = np.arange(wide + 1)
    low, high = np.array([m[2] for m in group])[:, None], np.array([m[3] for m in group])[:, None]
    return _mix((sums[:, at + SPAN] - sums[:, at]) * down[at]), (far >= low) & (far <= high)


def merge_range(blocks: dict[int, list[bytes]]) -> Iterator[tuple[list[tuple], list[tuple]]]:
    """Marks, and windows as rows (w, v, n, doc_id, h, start) of groups too large to settle here."""
    group: dict[tuple, int] = {}
    members: list[tuple] = []
    large = False

    def rows() -> list[tuple]:
        out = []
        for suffix, before, low, high, owners in members:
            n = min(2, sum(2 if o is None else 1 for o in owners))
            out += window_rows(suffix, before, low, high, n, next(filter(None, owners), None))
        return out

    def repeated() -> list[tuple]:
        return [(d, h, a - high, a - low + SPAN) for _, _, low, high, owners in members if len(owners) > 1 or None in owners for d, h, a in filter(None, owners)]

    for shared, suffix, (before, low, high, owner) in merge([Run(b) for _, b in sorted(blocks.items())]):
        if shared < GRAM and members:
            yield (repeated(), rows()) if large else (settle(members), [])
            group, members, large = {}, [], False
        elif len(members) >= MANY:
            large = True
            yield repeated(), rows()
            group, members = {}, []
        key = (suffix, before, low, high)
        if (i := group.get(key)) is None:
            group[key] = len(members)
            members.append((suffix, before, low, high, [owner] if owner else [None, None]))
        else:
            members[i][4].append(owner)
    if members:
        yield (repeated(), rows()) if large else (settle(members), [])


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(names), kinds, strict=True)], names=names)


LONG = pa.int64()


def splitters_of(sample: list[tuple[bytes, int]], ranges: int) -> list[bytes]:
    """Bounds of so many ranges, about as many anchors in each, from a sample of (GRAM bytes, how often)."""
    if not sample:
        return []
    sample = sorted(sample)
    upto = np.cumsum([n for _, n in sample])
    at = np.searchsorted(upto, upto[-1] * np.arange(1, ranges) / ranges)
    return sorted({sample[i][0] for i in at.tolist()})


def marks(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """(doc_id, h, start, stop): stretches of repeated windows of every text; h is xxhash64 of the text."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") >= SPAN).withColumn("h", F.xxhash64("text"))

    def anchors(batches):
        for batch in batches:
            docs_, hs = batch.column(0), batch.column(2)
            grams, sizes, some = [], [], []
            for t in batch.column(1).to_pylist():
                raw = t.encode()
                gram, anchor, _, _ = strips(raw)
                grams.append(gram)
                sizes.append(len(gram))
                own = [None] * len(gram)
                for i in np.nonzero(gram % np.uint64(SAMPLED) == 0)[0].tolist():
                    own[i] = raw[anchor[i] : anchor[i] + GRAM]
                some += own
            take = pa.array(np.repeat(np.arange(len(docs_)), sizes))
            places = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes]) if sizes else np.zeros(0, np.int32)
            gram = np.concatenate(grams).view(np.int64) if grams else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([docs_.take(take), hs.take(take), pa.array(places), pa.array(gram), pa.array(some, pa.binary())], names=["doc_id", "h", "place", "gram", "first"])

    found = cut(rows.select("doc_id", "text", "h").mapInArrow(anchors, "doc_id long, h long, place int, gram long, first binary"))
    often = cut(found.groupBy("gram").agg(F.count("*").alias("n"), F.min("first").alias("first")).where("n > 1"))  # read again, so that a frequent gram's side of the join can be split
    place = F.when(F.col("n") > HOT, -1 - F.col("place")).otherwise(F.col("place"))
    per_doc = found.select("doc_id", "h", "place", "gram").join(often.select("gram", "n"), "gram").groupBy("doc_id", "h").agg(F.collect_set(place).alias("places"))
    per_doc = per_doc.select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), "places")
    sample = often.where((F.col("n") <= HOT) & F.col("first").isNotNull())
    total, seen = often.where(F.col("n") <= HOT).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], sample.count()
    if ranges is None:
        ranges = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // STRIPS))
    thin = max(1, seen // (PER_RANGE * ranges))  # PER_RANGE rows for each range reach the driver, as in Spark's own sorting by range
    sample = sample.where(F.pmod(F.xxhash64("gram"), F.lit(thin)) == 0).select("first", "n").collect()
    shared = docs.sparkSession.sparkContext.broadcast(splitters_of([(bytes(r["first"]), r["n"]) for r in sample], ranges))  # GRAM bytes for each range of STRIPS strips
    wanted = rows.join(per_doc, rows.doc_id.eqNullSafe(per_doc["_d"]) & (rows.h == per_doc["_h"])).select("doc_id", "h", "text", "places")
    names, kinds = ["range", "run", "block", "doc_id", "h", "start", "stop", "w", "v", "n"], [pa.int32(), LONG, pa.binary(), LONG, LONG, LONG, LONG, LONG, LONG, pa.int32()]

    def runs(batches):
        items, held, number = [], 0, TaskContext.get().partitionId() << 32  # runs are named by task and count, alike in every attempt
        splitters = shared.value

        def flush():
            out, found_here, hot = build_run(items, splitters, number)
            for block in out:
                yield _batch([(*block, *[None] * 7)], names, kinds)
            for at in range(0, len(found_here), 50_000):
                yield _batch([(None, None, None, *m, None, None, None) for m in found_here[at : at + 50_000]], names, kinds)
            for at in range(0, len(hot), 50_000):
                yield _batch([(None, None, None, d, h, start, start + SPAN, w, v, n) for w, v, n, d, h, start in hot[at : at + 50_000]], names, kinds)

        for batch in batches:
            for d, h, text, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode()
                _, anchor, first, last = strips(raw)
                hot = np.array([p < 0 for p in places])
                chosen = np.array([-1 - p if p < 0 else p for p in places])
                for g, a, p, q in zip(hot.tolist(), anchor[chosen].tolist(), first[chosen].tolist(), last[chosen].tolist(), strict=True):
                    items.append((g, raw[a : q + SPAN], raw[p:a], a - q, a - p, d, h, a))
                held += (SPAN + WINDOW) * len(chosen)
                if held > RUN_BYTES:
                    yield from flush()
                    items, held, number = [], 0, number + 1
        if items:
            yield from flush()

    made = cut(wanted.select("doc_id", "h", "text", "places").mapInArrow(_small_batches(runs), "range int, run long, block binary, doc_id long, h long, start long, stop long, w long, v long, n int"))
    out_names, out_kinds = ["doc_id", "h", "start", "stop", "w", "v", "n"], [LONG, LONG, LONG, LONG, LONG, LONG, pa.int32()]

    def join_runs(batches):
        bucket, blocks = None, {}

        def done():
            for own, rest in merge_range(blocks) if blocks else ():
                if own:
                    yield _batch([(*m, None, None, None) for m in own], out_names, out_kinds)
                for at in range(0, len(rest), 50_000):
                    yield _batch([(d, h, start, start + SPAN, w, v, n) for w, v, n, d, h, start in rest[at : at + 50_000]], out_names, out_kinds)

        for batch in batches:
            for b, run, block in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
                if b != bucket:
                    yield from done()
                    bucket, blocks = b, {}
                blocks.setdefault(run, []).append(block)
        yield from done()

    blocks = made.where("block IS NOT NULL").select("range", "run", "block").repartition(ranges, "range").sortWithinPartitions("range", "run")
    settled = cut(blocks.mapInArrow(_small_batches(join_runs), "doc_id long, h long, start long, stop long, w long, v long, n int"))
    both = made.where("block IS NULL").select(*settled.columns).unionByName(settled)
    rows_ = both.where("w IS NOT NULL")
    twice = cut(rows_.groupBy("w", "v").agg(F.sum("n").alias("s")).where("s > 1").select("w", "v"))
    large = rows_.where("h IS NOT NULL").join(twice, ["w", "v"]).select("doc_id", "h", "start", "stop")
    return both.where("w IS NULL").select("doc_id", "h", "start", "stop").unionByName(large)


def _small_batches(run):
    """run with its many small results set together."""

    def wrapped(batches):
        held, n = [], 0
        for batch in run(batches):
            held.append(batch)
            n += batch.num_rows
            if n >= 20_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return wrapped


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (binary: the bytes that stay, which may cut characters).

    Defined results: a null text is empty; texts of under SPAN bytes stay; repeated rows and copies of a text of
    at least SPAN bytes lose all bytes, as each of their strings starts elsewhere too; an empty table gives an
    empty table; other columns are ignored.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    per_doc = marks(docs).groupBy("doc_id", "h").agg(F.collect_set(F.struct("start", "stop")).alias("marks")).select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), "marks")
    both = rows.join(per_doc, rows.doc_id.eqNullSafe(per_doc["_d"]) & (rows.h == per_doc["_h"]), "left").select("doc_id", "text", "marks")
    spans = T.StructType().add("doc_id", "long").add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary")

    def apply(batches):
        for batch in batches:
            out = []
            for d, text, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw, kept, at, spans_, removed = text.encode(), [], 0, 0, 0
                end = -1
                for m in sorted(found or [], key=lambda m: (m["start"], m["stop"])):
                    if m["start"] > end:
                        kept.append(raw[at : m["start"]])
                        spans_ += 1
                        removed += m["stop"] - m["start"]
                        at = end = m["stop"]
                    elif m["stop"] > end:
                        removed += m["stop"] - end
                        at = end = m["stop"]
                kept.append(raw[at:])
                out.append((d, len(raw), removed, spans_, b"".join(kept)))
            yield _batch(out, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"], [LONG, LONG, LONG, LONG, pa.binary()])

    return both.mapInArrow(apply, spans)
