"""Exact encoding and decoding with a merge-type (BPE) sentencepiece model, by backtracking.

A text is encoded from left to right with the longest piece that an Aho-Corasick automaton finds, as long as
it is compatible with the piece before it: merging the two pieces' characters anew must give just these two, which
the merges next to their border decide.
If nothing fits at a position, the position is marked in a bitfield as failed and the piece before it is
taken back for its next shorter choice. Each prefix has one encoding, so a failed position is never retried.

The model's vocabulary and scores are read with the sentencepiece library; it encodes nothing here.
"""

from __future__ import annotations

import heapq
import math
import re
import struct
from functools import cache, cached_property
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

SPACE = "▁"
MOST_PAIRS = 1_000_000  # whose compatibility a worker keeps
LONGEST = 48  # characters of words that are encoded together
GAP = "\U0010ffff"  # between them; a word with it is encoded alone
CACHED = 180_000  # words whose encoding a worker keeps, in each of two generations


class Kept(dict):
    """What was made for short strings, in two generations: what is used again outlives the change of them."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key: str):
        if (made := self.older.get(key)) is None:
            made = self.make(key)
            if len(key) > 64:
                return made
        self.put(key, made)
        return made

    def put(self, key: str, made: tuple[bytes, str]) -> None:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = made


class Pieces:
    """Encoder and decoder of one model (identity normalisation, dummy prefix, byte fallback)."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bos, self.eos, self.unk = model.bos_id(), model.eos_id(), model.unk_id()
        self.id, self.score, self.text, self.byte = {}, {}, {}, {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i)):
                self.id[piece], self.score[piece], self.text[i] = i, model.get_score(i), piece.replace(SPACE, " ")
        self.byte_of = {i: b for b, i in self.byte.items()}
        if len(self.byte) != 256:
            raise ValueError("a model with byte fallback is needed")
        if model.encode(" a  b ", out_type=str) != model.encode(" a  b", out_type=str) + [SPACE] or model.decode(model.encode("  ﬁ")) != "  ﬁ":
            raise ValueError("a model that keeps texts as they are is needed")
        letters = set(chain.from_iterable(self.id))
        self.loose = {c for c in letters if c not in self.id}  # parts of pieces that are no pieces: such texts are merged directly
        self.automaton = ahocorasick.Automaton()
        self.halves: dict[str, tuple[str, str]] = {}  # what the last merge of a piece joins
        for piece in self.id:
            if self.merge(piece) == [piece]:  # no other piece is ever made
                self.automaton.add_word(piece, piece)
                if len(piece) > 1:
                    self.halves[piece] = self.last
        self.automaton.make_automaton()
        #: Every merge comes after those of its halves: then merges take place in the order of their scores, wherever they are.
        self.in_order = all(self.score[p] < self.score[h] for p, halves in self.halves.items() if SPACE * 2 not in p for h in halves if len(h) > 1)
        self.starts, self.ends = {}, {}
        self.across = any(SPACE in p.lstrip(SPACE) for p in self.id)  # then a text is one part
        self.segment = re.compile("(?s).+" if self.across else _segments(self.id, letters))
        self.fits: dict[tuple[str, str], bool] = {}
        self.words, self.parts = Kept(self._word, CACHED), Kept(self._part, CACHED // 4)

    def merge(self, text: str) -> list[str]:
        """The pieces by merging: best score first, leftmost first of equals."""
        part, after, before = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        queue: list[tuple[float, int, int]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(part) and (s := self.score.get(part[a] + part[b])) is not None:
                heapq.heappush(queue, (-s, a, len(part[a]) + len(part[b])))

        for i in range(len(part) - 1):
            offer(i, i + 1)
        while queue:
            _, a, size = heapq.heappop(queue)
            if not part[a] or (b := after[a]) >= len(part) or len(part[a]) + len(part[b]) != size:
                continue
            self.last = part[a], part[b]
            part[a], part[b] = part[a] + part[b], ""
            after[a] = after[b]
            if after[b] < len(part):
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [p for p in part if p]

    def _edge(self, piece: str, side: int, known: dict[str, list[tuple[str, float]]]) -> list[tuple[str, float]]:
        """What a piece's first (side 0) or last (1) character belongs to while it is merged, each with the score of the merge that ends it."""
        if (own := known.get(piece)) is None:
            own = [(piece, -math.inf)]
            at = piece
            while at in self.halves:
                at, score = self.halves[at][side], self.score[at]
                own.append((at, score))
            own.reverse()
            known[piece] = own
        return own

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging the characters of two pieces anew gives just these two.

        The merges at both sides of their border are gone through in order. They are two as long as what stands at
        the border never makes a piece with a score over that of the next merge at either side; of equal scores
        the leftmost comes first.
        """
        if not self.in_order or SPACE * 2 in a + b or a not in self.halves and len(a) > 1 or b not in self.halves and len(b) > 1:
            return self.merge(a + b) == [a, b]
        left, right, i, j = self._edge(a, 1, self.ends), self._edge(b, 0, self.starts), 0, 0
        score = self.score
        while True:
            (x, p), (y, q) = left[i], right[j]
            if (s := score.get(x + y)) is not None and s > p and s >= q:
                return False
            if p >= q:
                if p == -math.inf:
                    return True
                i += 1
            else:
                j += 1

    def _fit(self, pair: tuple[str, str]) -> bool:
        if len(self.fits) > 4 * CACHED:
            self.fits.clear()
        known = self.fits[pair] = self.compatible(*pair)
        return known

    def backtrack(self, text: str) -> list[str]:
        """The pieces of a text without runs of spaces, whose pieces have scores that all differ."""
        n, fits, fit = len(text), self.fits, self._fit
        longest = [piece for _, piece in self.automaton.iter_long(text)]
        if sum(map(len, longest)) == n and all(fits.get(pair) or pair not in fits and fit(pair) for pair in zip(longest, longest[1:], strict=False)):
            return longest  # nothing had to be taken back
        choices: list[list[str]] = [[] for _ in range(n + 1)]
        for end, piece in self.automaton.iter(text):
            choices[end + 1 - len(piece)].append(piece)  # the same start's pieces come in order of length
        failed = bytearray(n // 8 + 1)
        out: list[str] = []
        left: list[int] = []  # of each piece in out: how many shorter choices its place has
        at, rest, last = 0, len(choices[0]), None
        while at < n:
            own = choices[at]
            if not own:  # a character of no piece: no merge reaches over it
                out.append(text[at])
                left.append(0)
                at += 1
                rest, last = len(choices[at]), None
                continue
            while rest:
                rest -= 1
                piece = own[rest]
                end = at + len(piece)
                if failed[end >> 3] >> (end & 7) & 1:
                    continue
                if last is not None:
                    pair = (last, piece)
                    if not (fits[pair] if pair in fits else fit(pair)):
                        continue
                out.append(piece)
                left.append(rest)
                at, rest, last = end, len(choices[end]), piece
                break
            else:
                failed[at >> 3] |= 1 << (at & 7)
                at -= len(out.pop())  # every text has an encoding, so there is one
                rest, last = left.pop(), out[-1] if out and out[-1] in self.id else None
        return out

    def pieces(self, segment: str) -> list[str]:
        """Pieces of a segment. Pieces of several spaces share one score, so segments with them are merged directly."""
        if segment.startswith(SPACE * 2) or not self.loose.isdisjoint(segment):
            return self.merge(segment)
        return self.backtrack(segment)

    def ids(self, pieces: list[str]) -> list[int]:
        try:
            return list(map(self.id.__getitem__, pieces))
        except KeyError:
            return [i for p in pieces for i in ((self.id[p],) if p in self.id else map(self.byte.__getitem__, p.encode("utf-8", "surrogatepass")))]

    def raw(self, ids: list[int]) -> str:
        """The characters of ids, spaces in place, the dummy prefix included."""
        try:
            return "".join(map(self.text.__getitem__, ids))
        except KeyError:
            pass
        out, run = [], bytearray()
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                run.append(b)
                continue
            if run:
                out.append(_characters(bytes(run)))
                run.clear()
            out.append(" ⁇ " if i == self.unk else self.text.get(i, ""))
        return "".join(out) + (_characters(bytes(run)) if run else "")

    def decode(self, ids: list[int]) -> str:
        """The text of ids; begin and end say nothing."""
        return self.raw(ids).removeprefix(" ")

    def _part(self, segment: str) -> tuple[bytes, str]:
        ids = self.ids(self.pieces(segment))
        return struct.pack(f"<{len(ids)}I", *ids), self.raw(ids)

    def _word(self, word: str) -> tuple[bytes, str]:
        """The ids and characters of a space and what follows it up to the next."""
        found = self.segment.findall(SPACE + word.replace(" ", SPACE))  # the last may be empty
        if len(found) == 2 and not found[1]:
            return self._part(found[0])
        made = [self.parts[s] for s in found]
        return b"".join([i for i, _ in made]), "".join([c for _, c in made])

    def both(self, text: str) -> tuple[bytes, str]:
        """The ids of a text, begin and end included, as little-endian unsigned 32-bit integers, and those decoded."""
        return self.both_of([text])[0]

    def both_of(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """both() of each text. What the texts have of words that are not known yet is encoded at once."""
        split = [[] if not t or self.across or "  " in t or SPACE in t or t[0] == " " or t[-1] == " " else t.split(" ") for t in texts]
        words = self.words
        new = {w for own in split for w in own if w not in words and w not in words.older and len(w) <= LONGEST and GAP not in w}
        if len(new) > 64:
            self.together.fill(sorted(new), words)
        bos, eos, out = self.bos.to_bytes(4, "little"), self.eos.to_bytes(4, "little"), []
        for text, own in zip(texts, split, strict=True):
            made = [words[w] for w in own] if own else [self._word(text)] if text else []  # runs of spaces belong together
            out.append((b"".join([bos, *[i for i, _ in made], eos]), "".join([c for _, c in made]).removeprefix(" ")))
        return out

    @cached_property
    def together(self) -> Together:
        return Together(self)

    def encode(self, text: str) -> list[int]:
        raw = self.both(text)[0]
        return [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)]


class Together:
    """backtrack() for many words at once: every step is taken by all words that are not done.

    The Aho-Corasick automaton is a table here, of states by characters, which all words go through together. From the
    longest match at each place follow the shorter ones, and all become a table of piece numbers by place and
    length. Failed places are one field of bits over all words. Pairs of pieces that have been held against each
    other are kept as a sorted table.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        chars = sorted(c for c in set(chain.from_iterable(pieces.id)) if ord(c) < 0x250 or c == SPACE)
        self.kind = np.zeros(0x110000, dtype=np.int16)  # 0: any other character
        self.kind[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        own = [p for p in pieces.automaton.keys() if not p.startswith(SPACE * 2) and all(self.kind[ord(c)] for c in p)]  # runs of spaces never get here
        self.longest = max(map(len, own))
        if self.longest > 31:
            raise ValueError("pieces of at most 31 characters are needed")
        self._automaton(own, len(chars) + 1)
        self.lone = np.full(128, -1, dtype=np.int32)  # ASCII characters of no piece are encoded as their byte
        for b in range(128):
            if chr(b) not in pieces.id:
                self.lone[b] = pieces.byte[b]
        self.text = [""] * (1 + max(max(pieces.text), max(pieces.byte_of)))
        for i, t in pieces.text.items():
            self.text[i] = t
        for i, b in pieces.byte_of.items():
            self.text[i] = chr(b) if b < 128 else ""
        self.chars = np.array([len(t) for t in self.text])
        self.is_byte = np.zeros(len(self.text), dtype=bool)
        self.is_byte[list(pieces.byte_of)] = True
        self.name = {i: p for p, i in pieces.id.items()}
        self.loose = np.array([ord(c) for c in sorted(pieces.loose)], dtype=np.uint32)
        self.pairs, self.fits = np.array([-1], dtype=np.int64), np.array([False])

    def _automaton(self, own: list[str], kinds: int) -> None:
        """step: next state by state and kind of character; last: the state of the longest piece that ends in a state, 0 if none does; shorter: that of the next shorter one."""
        at: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        for p in own:
            node = 0
            for c in p:
                node = at.setdefault((node, int(self.kind[ord(c)])), len(at) + 1)
            ends[node] = self.pieces.id[p]
        n = len(at) + 1
        parent, kind = (np.array(x, dtype=np.int64) for x in zip(*at, strict=True))
        self.depth = np.zeros(n, dtype=np.int64)
        for node, above in enumerate(parent.tolist(), 1):
            self.depth[node] = self.depth[above] + 1
        self.piece = np.full(n, -1, dtype=np.int32)
        self.piece[list(ends)] = list(ends.values())
        self.step, fail = np.zeros((n, kinds), dtype=np.uint16 if n < 1 << 16 else np.int32), np.zeros(n, dtype=np.int64)
        self.last, self.shorter = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int32)
        child = np.zeros((n, kinds), dtype=self.step.dtype)
        child[parent, kind] = np.arange(1, n)
        self.step[0] = child[0]
        for depth in range(1, self.longest + 1):
            level = np.nonzero(self.depth == depth)[0]
            above, by = parent[level - 1], kind[level - 1]
            fail[level] = self.step[fail[above], by] if depth > 1 else 0
            self.step[level] = np.where(child[level] > 0, child[level], self.step[fail[level]])
            self.shorter[level] = self.last[fail[level]]
            self.last[level] = np.where(self.piece[level] >= 0, level, self.shorter[level])

    def _matches(self, kind: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids (place x length) of all pieces, -1 where there is none, and which lengths there are as bits."""
        ids, mask = np.full((len(kind), self.longest), -1, dtype=np.int32), np.zeros(len(kind), dtype=np.int32)
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        state, found = np.zeros(len(start), dtype=self.step.dtype), np.zeros(len(kind), dtype=np.int32)
        for t in range(int(size[0])):
            here = start[: np.searchsorted(-size, -t)] + t  # words longer than t
            state = self.step[state[: len(here)], kind[here]]
            found[here] = self.last[state]
        place = np.nonzero(found)[0]
        node = found[place]
        while len(place):
            length = self.depth[node]
            ids[place + 1 - length, length - 1] = self.piece[node]
            np.bitwise_or.at(mask, place + 1 - length, np.left_shift(1, length - 1).astype(np.int32))
            node = self.shorter[node]
            place, node = place[node > 0], node[node > 0]
        return ids, mask

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging each two pieces' characters anew gives just these two."""
        pair = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        known = self.pairs[at] == pair
        if not known.all():
            new, name, fit = np.unique(pair[~known]).tolist(), self.name, self.pieces.compatible
            found = [fit(name[k >> 20], name[k & 0xFFFFF]) for k in new]
            keep = slice(None) if len(self.pairs) + len(new) <= MOST_PAIRS else np.unique(at[known])
            keys, fits = np.concatenate([self.pairs[keep], new]), np.concatenate([self.fits[keep], np.array(found)])
            order = np.argsort(keys, kind="stable")
            self.pairs, self.fits = keys[order], fits[order]
            at = np.searchsorted(self.pairs, pair)
        return self.fits[at]

    def fill(self, words: list[str], known: Kept) -> None:
        """Put what words are encoded to into known; words with other characters are left to be encoded alone."""
        for at in range(0, len(words), 20_000):
            self._fill(words[at : at + 20_000], known)

    def _fill(self, words: list[str], known: Kept) -> None:
        code = np.frombuffer((GAP.join(SPACE + w for w in words) + GAP).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        n = len(code)
        stop = np.nonzero(code == ord(GAP))[0]
        start = np.concatenate([[0], stop[:-1] + 1])
        ids, mask = self._matches(self.kind[code], start, stop - start)
        low = np.nonzero((code < 128) & (mask == 0))[0]
        ids[low, 0] = self.lone[code[low]]
        mask[low] = 1
        open_ = np.zeros(n + 1, dtype=np.int64)
        np.cumsum((mask == 0) | np.isin(code, self.loose), out=open_[1:])
        fine = open_[stop] == open_[start]  # each character starts some piece, and is one
        start, stop = start[fine], stop[fine]
        words = [w for w, f in zip(words, fine.tolist(), strict=True) if f]
        if not words:
            return
        width = int((stop - start).max())
        out, used = np.zeros((len(words), width), dtype=np.int32), np.zeros(len(words), dtype=np.int64)
        size = np.zeros((len(words), width), dtype=np.int8)
        failed = np.zeros(n // 8 + 1, dtype=np.uint8)
        at, rest, last = start.copy(), mask[start], np.full(len(words), -1, dtype=np.int32)
        todo = np.arange(len(words))
        while len(todo):
            stuck = rest[todo] == 0
            if stuck.any():  # the place has no way on: its piece before is taken back for a shorter one
                w = todo[stuck]
                np.bitwise_or.at(failed, at[w] >> 3, np.left_shift(1, at[w] & 7).astype(np.uint8))
                used[w] -= 1
                length = size[w, used[w]].astype(np.int64)
                at[w] -= length
                rest[w] = mask[at[w]] & ((1 << (length - 1)) - 1)
                last[w] = np.where(used[w] > 0, out[w, np.maximum(used[w] - 1, 0)], -1)
            w = todo[~stuck]
            if len(w):
                bit = np.frexp(rest[w].astype(float))[1].astype(np.int64) - 1  # the longest choice that is left
                piece, end, before = ids[at[w], bit], at[w] + bit + 1, last[w]
                good = failed[end >> 3] >> (end & 7) & 1 == 0
                check = np.nonzero(good & (before >= 0) & ~self.is_byte[np.maximum(before, 0)] & ~self.is_byte[piece])[0]
                good[check] = self.compatible(before[check], piece[check])
                bad, w, bit, piece, end = (w[~good], bit[~good]), w[good], bit[good], piece[good], end[good]
                rest[bad[0]] &= ~(1 << bad[1])
                out[w, used[w]], size[w, used[w]] = piece, bit + 1
                used[w] += 1
                at[w], last[w] = end, piece
                rest[w] = np.where(end < stop[w], mask[np.minimum(end, n - 1)], 0)
            todo = todo[at[todo] < stop[todo]]
        flat = out[np.arange(width) < used[:, None]]
        raw, text = flat.astype("<u4").tobytes(), "".join(map(self.text.__getitem__, flat.tolist()))
        ends = np.cumsum(used)
        chars = np.concatenate([[0], np.cumsum(self.chars[flat])])[ends].tolist()
        a = c = 0
        for word, b, d in zip(words, (4 * ends).tolist(), chars, strict=True):
            known.put(word, (raw[a:b], text[c:d]))
            a, c = b, d


def _segments(pieces: dict[str, int], letters: set[str]) -> str:
    """A pattern for parts of a text that no merge reaches over.

    A part ends before a space that follows anything else, and after a letter or digit before a mark, if no
    piece has these in a row; a character of no piece is never merged.
    """
    pairs = {pair for p in pieces for pair in zip(p, p[1:], strict=False)}
    marks = {c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "_"} - {b for a, b in pairs if a.isalnum()}
    line, mark = "" if "\n" in letters else "\n", re.escape("".join(sorted(marks)))
    other = rf"[^\w{SPACE}{line}]"
    return rf"{SPACE}*{other}*\w*(?:(?:[^\w{SPACE}{line}{mark}]|(?<=_){other}){other}*\w*)*" + ("|\n" if line else "")


def _characters(run: bytes) -> str:
    """Bytes as UTF-8; each byte that is not part of a character becomes U+FFFD."""
    out, at = [], 0
    while at < len(run):
        for size in (1, 2, 3, 4):
            try:
                out.append(run[at : at + size].decode())
            except UnicodeDecodeError:
                continue
            at += size
            break
        else:
            out.append("�")
            at += 1
    return "".join(out)


@cache
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def encode_texts(docs: DataFrame, model: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit), decoded.

    Defined results: a null text is encoded as an empty one, to the begin and end ids; repeated rows stay; texts
    of any length are encoded whole; an empty table gives an empty table; other columns are ignored.
    """
    out = docs.select("doc_id").schema.add("n_tokens", "long").add("ids", "binary").add("decoded", "string")

    def run(batches):
        pieces = pieces_of(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                made = pieces.both_of([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(i) // 4 for i, _ in made], pa.int64()), pa.array([i for i, _ in made], pa.binary()), pa.array([d for _, d in made], pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, out)
