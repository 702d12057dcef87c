"""SimHash near-duplicates through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of at most 23 bits. The perfect binary Golay code maps any
23 bits to the one codeword within three bits of it. Flipping each bit of a segment and decoding gives about
six codewords, its list; the plain decoding is one of them. Two facts make these into keys:

* segments at distance two or less have a codeword in common in their lists (decode the point midway);
* if they differ in at most one bit, the plain decoding of either is in the list of the other.

Fingerprints at distance four or less spread at most four errors over three segments, so two segments have
(0, 0), (0, 1), (0, 2) or (1, 1) errors. The first three cases meet in a key of one segment as it is and a
codeword of the other's list; (1, 1) meets in a key of two codewords, as the plain decodings of either segment
are in the other's lists. All that meets is verified on the whole fingerprint.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, sliced
from ..functions.components import components

SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, bits
#: Generator polynomial of the binary Golay code of length 23 (fixed value).
GENERATOR = 0b101011100011
PAIRS = ((0, 1), (0, 2), (1, 2))
DIRECT = 8  # runs up to this length are compared by shifting the sorted column


@cache
def decoder() -> np.ndarray:
    """Number of the nearest codeword for each word of 23 bits."""
    code = np.zeros(4096, dtype=np.int64)
    for bit in range(12):
        code ^= np.where(np.arange(4096) >> bit & 1, GENERATOR << bit, 0)
    at, one = np.zeros(1 << 23, dtype=np.int16), [1 << i for i in range(23)]
    errors = [0, *one, *(a | b for i, a in enumerate(one) for b in one[:i]), *(a | b | c for i, a in enumerate(one) for j, b in enumerate(one[:i]) for c in one[:j])]
    for e in errors:
        at[code ^ e] = np.arange(4096)
    return at


def near_codewords(segment: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row x choice) codeword numbers of the segment and its one-bit neighbours, and which of them are first of their kind."""
    at = decoder()
    lists = np.sort(np.stack([at[segment], *(at[segment ^ (1 << i)] for i in range(bits))], axis=1), axis=1).astype(np.int64)
    return lists, np.concatenate([np.ones((len(lists), 1), bool), lists[:, 1:] != lists[:, :-1]], axis=1)


def keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row number, key) of every key of 64-bit fingerprints."""
    f = fingerprints.astype(np.uint64)
    seg = [((f >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.int64) for at, bits in SEGMENTS]
    lists = [near_codewords(s, bits) for s, (_, bits) in zip(seg, SEGMENTS, strict=True)]
    rows, found = [], []
    for i in range(3):
        for j in range(3):
            if i != j:
                words, first = lists[j]
                row, col = np.nonzero(first)
                rows.append(row)
                found.append((i * 3 + j << 34) | (seg[i][row] << 12) | words[row, col])
    compact = [_left(words, first) for words, first in lists]
    for i, j in PAIRS:
        (wi, ci), (wj, cj) = compact[i], compact[j]
        tag = 9 + i * 3 + j << 34
        for a in range(wi.shape[1]):
            for b in range(wj.shape[1]):
                row = np.nonzero((ci > a) & (cj > b))[0]
                rows.append(row)
                found.append(tag | wi[row, a] << 12 | wj[row, b])
    return np.concatenate(rows), np.concatenate(found)


def _left(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codewords of each row moved to its left, and how many they are."""
    count = first.sum(axis=1)
    out = np.zeros((len(words), int(count.max(initial=0))), dtype=np.int64)
    row, col = np.nonzero(first)
    out[row, (np.cumsum(first, axis=1) - 1)[row, col]] = words[row, col]
    return out, count


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))  # of signed numbers it would take the magnitude


def fingerprint(text: str | None) -> int:
    """64 bits; a bit is 1 if over half of the hashes of all 4-word shingles have it. Null counts as empty: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space alone
    if not words:
        return 0
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= 4:
        return hashed(joined, 42)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-4].tolist()]
    h = np.array([hashed(joined[a:b], 42) for a, b in zip(starts, (ends[3:] - 1).tolist(), strict=True)], dtype="<u8")
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 4096):
        total += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns carry and fp, a signed long, of every document."""

    def run(batches):
        for batch in sliced(batches):
            fps = np.array([fingerprint(t) for t in batch.column(len(carry)).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], pa.array(fps)], names=[*carry, "fp"])

    return docs.select(*carry, "text").mapInArrow(run, docs.select(*carry).schema.add("fp", "long"))


def _forest(f: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links within f: every fingerprint meets only those not reached before it."""
    edges, rest = [], f
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            node, front = front[0], front[1:]
            near = distance(rest, node) <= most
            if near.any():
                edges += [(int(node), int(x)) for x in rest[near]]
                front, rest = np.concatenate([front, rest[near]]), rest[~near]
    return edges


def _runs(batches, most: int):
    """Sorted batches of (key, fp), cut where the key changes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        key = batch.column(0).to_numpy()
        if not len(key):
            continue
        last = int(np.searchsorted(key, key[-1]))
        if last or held and held[-1].column(0)[-1].as_py() != key[0]:
            cut_at = last if last else 0
            table = pa.Table.from_batches([*held, batch.slice(0, cut_at)]) if held or cut_at else None
            if table is not None and table.num_rows:
                yield table
            held = [batch.slice(cut_at)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _link(table: pa.Table, most: int) -> np.ndarray:
    """Links (a, b) that join up what is linked among rows of the same key."""
    key, fp = table.column(0).to_numpy(), table.column(1).to_numpy()
    starts = np.concatenate([[0], np.nonzero(key[1:] != key[:-1])[0] + 1, [len(key)]])
    length = np.diff(starts)
    small = np.repeat(length <= DIRECT, length)
    out = []
    for shift in range(1, min(DIRECT, len(key))):
        at = np.nonzero(small[:-shift] & (key[:-shift] == key[shift:]))[0]
        if not len(at):
            break
        a, b = fp[at], fp[at + shift]
        near = (distance(a, b) <= most) & (a != b)
        out.append(np.stack([a[near], b[near]], axis=1))
    for run in np.nonzero(length > DIRECT)[0]:
        if found := _forest(np.unique(fp[starts[run] : starts[run + 1]]), most):
            out.append(np.array(found, dtype=np.int64))
    got = np.concatenate(out) if out else np.zeros((0, 2), dtype=np.int64)
    return np.unique(np.sort(got, axis=1), axis=0)


def links(distinct: DataFrame, most: int = 4) -> DataFrame:
    """Links (a, b) among different fingerprints (column fp) at most bits apart, enough to connect all that are linked.

    Each key's rows meet in one sorted run of eight-byte values. Within a run each fingerprint is compared only
    with those that no earlier one has reached, and a run gives fewer links than it has rows: a dense group is
    settled by few comparisons and no list of its pairs is ever made.
    """
    if not 0 <= most <= 4:
        raise ValueError("the keys find fingerprints that differ in at most four bits")

    def give(batches):
        for batch in batches:
            all_fps = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(all_fps), 2048):
                fps = all_fps[at : at + 2048]
                row, key = keys(fps)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[row].view(np.int64))], names=["key", "fp"])

    def meet(batches):
        for table in _runs(batches, most):
            got = _link(table, most)
            if len(got):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(got[:, 0])), pa.array(np.ascontiguousarray(got[:, 1]))], names=["a", "b"])

    keyed = distinct.select("fp").mapInArrow(give, "key long, fp long")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "a long, b long")


def groups(fps: DataFrame, first: Column, most: int = 4) -> DataFrame:
    """(fp, first) of every different fp of fps: the least value of first in the fingerprint's component."""
    nodes = cut(fps.groupBy("fp").agg(F.min(first).alias("least")))
    part = components(links(nodes, most))
    named = cut(nodes.join(part, nodes.fp == part.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root")))
    roots = cut(named.groupBy("root").agg(F.min("least").alias("first")))  # read again, so that a large component's side of the join can be split
    return named.join(roots, "root").select("fp", "first")


def near_duplicates(docs: DataFrame, most: int = 4) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest doc_id that links reach).

    Defined results: null and empty texts have fingerprint 0 and are linked like any other; repeated rows stay,
    each with the same component; an empty table gives an empty table; a component without any doc_id has null.
    """
    fps = cut(fingerprints(docs))
    return fps.join(groups(fps, F.col("doc_id"), most).withColumnRenamed("first", "component_id"), "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(column: str = "fp"):
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def one_of_each(docs: DataFrame, most: int = 4) -> DataFrame:
    """One row of docs, with all its columns, for each component.

    It is the one with the smallest doc_id (null last) and of rows that share it the one with the least hash
    over all columns, so rows with one doc_id and texts that resemble nothing all stay. An empty table gives an empty
    table; rows that are equal in every column are copies, and one of them stays.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d")
    row = F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(whole, row).withColumns({"doc_id": F.col("d.doc_id"), "text": F.col("d.text")})
    fps = cut(fingerprints(rows, ("doc_id", "row")))
    first = groups(fps, F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row"), most).select("first.doc_id", "first.row").distinct()
    first = cut(first.withColumnRenamed("doc_id", "_id").withColumnRenamed("row", "_row"))
    kept = rows.join(first, rows["row"].eqNullSafe(F.col("_row")) & rows["doc_id"].eqNullSafe(F.col("_id")), "left_semi")
    if not fps.groupBy("doc_id", "row").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "row"])
    return kept.select("d.*")
