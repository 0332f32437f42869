"""SentencePiece encoding and decoding with one forward pass shared by words with common prefixes.

The distinct marked words of a batch are sorted, so that words with a common prefix lie side by side and form
a trie.  Its nodes are worked out level by level, all prefixes of one length at once; a prefix is extended once,
however many words share it.  Words of more than ``LEVELS`` characters are walked depth first instead: each
reuses the forward states of the prefix it shares with the word before.  One walk finds two paths:

* The best-scored path (Viterbi): the state of a prefix is its best sum of piece scores, the start of the last piece on that path and
  the number of pieces.  For a unigram model this is the encoding.
* For a BPE model merges depend on priorities, not on sums, but the encoding of a prefix
  still has exactly one last piece ``t`` such that the encoding of the rest ends in a piece
  ``u`` and the string ``ut`` encodes as just ``u, t`` (a merge across a border of pieces would
  show in those two alone).  So the state of a prefix is its last piece, found among the pieces that
  end there, and the result equals that of the merges.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokens import sentence_pieces

MARK = "▁"
#: Words that a worker remembers, their characters, and checked pairs of pieces; beyond, it starts afresh.  Words of more characters
#: than ``LONG`` (texts without spaces) are encoded, but not remembered.
WORDS, CHARS, PAIRS, LONG, LEVELS = 500_000, 12_000_000, 1_000_000, 256, 40


class _Trie:
    """The prefixes of all pieces as numbered nodes: a child by node and character, and what is known of each node, as arrays."""

    def __init__(self, begins: dict[str, tuple[float, bool] | None], code: dict[str, bytes], unknown: float):
        self.names = list(begins)
        number = {p: i for i, p in enumerate(self.names)}
        chars = sorted({p[-1] for p in self.names})
        self.char = np.full(0x110000, -1, np.int32)
        self.char[[ord(c) for c in chars]] = np.arange(len(chars))
        self.first = np.array([number.get(c, -1) for c in chars] + [-1], np.int32)  # -1, no such character, takes the last
        self.n_chars = max(len(chars), 1)
        steps = sorted((number[p[:-1]] * self.n_chars + int(self.char[ord(p[-1])]), i) for p, i in number.items() if len(p) > 1)
        self.keys, self.child = np.array([k for k, _ in steps] or [-1], np.int64), np.array([i for _, i in steps] or [-1], np.int32)
        facts = [begins[p] for p in self.names]
        self.is_piece = np.array([f is not None for f in facts] + [False])
        self.whole = np.array([f is not None and f[1] for f in facts] + [False])
        self.score = np.array([unknown if f is None else f[0] for f in facts] + [unknown])
        self.code = np.array([int.from_bytes(code[p], "little") if p in code else -1 for p in self.names] + [-1], np.int64)

    def step(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The children of nodes by characters (both by number); -1 for none."""
        out = np.full(len(nodes), -1, np.int32)
        at = np.flatnonzero((nodes >= 0) & (chars >= 0))
        key = nodes[at].astype(np.int64) * self.n_chars + chars[at]
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[k] == key
        out[at[hit]] = self.child[k[hit]]
        return out


class PieceModel:
    """A vocabulary (piece, score) with byte pieces ``<0x00>``.. at ``bytes_at``, of kind "bpe" or "unigram"."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], kind: str = "bpe"):
        self.kind, self.byte_ids = kind, byte_ids
        self.score = {p: s for p, (_, s) in pieces.items()}
        self.code = {p: int(i).to_bytes(4, "little") for p, (i, _) in pieces.items()}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("pieces that span words are not supported")
        self.unknown = min(self.score.values(), default=0.0) - 10.0
        #: Every prefix of a piece: None, or (score, whether it encodes as itself) where it is a piece.
        self.begins: dict[str, tuple[float, bool] | None] = {}
        for p, s in self.score.items():
            for n in range(1, len(p)):
                self.begins.setdefault(p[:n], None)
            self.begins[p] = (s, kind != "bpe" or len(p) == 1 or self.merge(p) == [p])
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0
        self.trie = _Trie(self.begins, self.code, self.unknown)
        #: Of checked pairs of nodes u, t: u * nodes + t in order, and whether they stay.
        self.checked, self.stay = np.zeros(0, np.int64), np.zeros(0, bool)
        #: Of each word its ids, the number of pieces on its best-scored path and that path's score.
        self.words: dict[str, tuple[bytes, int, float]] = {}
        self.chars = 0

    def merge(self, text: str) -> list[str]:
        """The pieces by merging the best-scored pair of neighbours, the left-most first, until none is in the vocabulary."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stays(self, u: str, t: str) -> bool:
        """Whether the string ut encodes as u, t."""
        known = self.pairs.get(u)
        if known is None:
            known = self.pairs[u] = {}
        if t not in known:
            self.n_pairs += 1
            known[t] = self.merge(u + t) == [u, t]
        return known[t]

    def stays_all(self, u: np.ndarray, t: np.ndarray) -> np.ndarray:
        """``stays`` for nodes u and whole pieces t; a character that begins no piece (-1) joins nothing after it."""
        names, n = self.trie.names, len(self.trie.names)
        key = u.astype(np.int64) * n + t
        every = new = np.unique(key[u >= 0])
        if len(self.checked):
            new = every[self.checked[np.minimum(np.searchsorted(self.checked, every), len(self.checked) - 1)] != every]
        if len(self.checked) + len(new) > PAIRS:
            self.checked, self.stay, new = np.zeros(0, np.int64), np.zeros(0, bool), every
        if len(new):
            ok = [self.merge(names[x] + names[y]) == [names[x], names[y]] for x, y in zip((new // n).tolist(), (new % n).tolist(), strict=True)]
            at = np.searchsorted(self.checked, new)
            self.checked, self.stay = np.insert(self.checked, at, new), np.insert(self.stay, at, ok)
        out = np.ones(len(key), bool)
        at = np.flatnonzero(u >= 0)
        out[at] = self.stay[np.searchsorted(self.checked, key[at])]
        return out

    def spell(self, char: str) -> bytes:
        """The ids of one character: its piece, or its bytes."""
        return self.code.get(char) or b"".join(self.byte_ids[b].to_bytes(4, "little") for b in char.encode())

    def encode_words(self, words: Iterable[str]) -> dict[str, tuple[bytes, int, float]]:
        """Ids (little-endian 32-bit) of each marked word, and the number of pieces and the score of its best-scored path."""
        words = list(words)
        return self._by_levels([w for w in words if len(w) <= LEVELS]) | self._one_by_one([w for w in words if len(w) > LEVELS])

    def _by_levels(self, words: list[str]) -> dict[str, tuple[bytes, int, float]]:
        words = sorted(words)
        n, bpe, trie = len(words), self.kind == "bpe", self.trie
        size = np.fromiter(map(len, words), np.int64, n)
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        begin = np.cumsum(size) - size
        # by level: the node of each word's prefix; of each node the best score, pieces on that path, last piece, its length, and the node before it
        node_of, first_of, n_nodes = [np.zeros(n, np.int32)], [0], 1
        best, count, last, length, before = [np.zeros(1)], [np.zeros(1, np.int64)], [np.full(1, -1, np.int32)], [np.zeros(1, np.int32)], [np.zeros(1, np.int32)]
        rows, runs = np.arange(n), {}  # runs: by length, the trie's node of the characters that end here
        for i in range(1, int(size.max(initial=0)) + 1):
            rows = rows[size[rows] >= i]
            c, up = chars[begin[rows] + (i - 1)], node_of[-1][rows]
            new = np.ones(len(rows), bool)
            new[1:] = (up[1:] != up[:-1]) | (c[1:] != c[:-1])
            here = np.zeros(n, np.int32)
            here[rows] = np.cumsum(new) - 1
            word, up, c = rows[new], up[new], trie.char[c[new]]
            one = trie.first[c]
            runs = {1: one} | {d + 1: x for d, y in runs.items() if ((x := trie.step(y[up], c)) >= 0).any()}
            top, way, pieces = np.zeros(len(word)), np.zeros(len(word), np.int32), np.zeros(len(word), np.int64)
            at, node, prev = np.zeros(len(word), np.int32), one.copy(), first_of[i - 1] + up
            for d in sorted(runs, reverse=True)[:-1]:  # the longest come first, and just one piece can be the last
                k = np.flatnonzero(trie.is_piece[runs[d]])
                t, a = runs[d][k], i - d
                past = node_of[a][word[k]]
                sums = best[a][past] + trie.score[t]
                more = np.flatnonzero((way[k] == 0) | (sums > top[k]))
                top[k[more]], way[k[more]], pieces[k[more]] = sums[more], d, count[a][past[more]] + 1
                if bpe:
                    more = np.flatnonzero((at[k] == 0) & trie.whole[t])
                    if a and len(more):
                        more = more[self.stays_all(last[a][past[more]], t[more])]
                at[k[more]], node[k[more]], prev[k[more]] = d, t[more], first_of[a] + past[more]
            sums = best[i - 1][up] + trie.score[one]
            alone = np.flatnonzero((way == 0) | (sums >= top))
            top[alone], pieces[alone] = sums[alone], count[i - 1][up[alone]] + 1
            if not bpe:
                at[alone], node[alone], prev[alone] = 1, one[alone], first_of[i - 1] + up[alone]
            at[at == 0] = 1
            for states, x in ((node_of, here), (first_of, n_nodes), (best, top), (count, pieces), (last, node), (length, at), (before, prev)):
                states.append(x)
            n_nodes += len(word)
        end = np.zeros(n, np.int64)
        for i, x in enumerate(node_of):
            end[size == i] = first_of[i] + x[size == i]
        best, count, last, length, before = (np.concatenate(x) for x in (best, count, last, length, before))
        path, cur = [], end  # back from piece to piece
        while cur.any():
            path.append(cur.astype(np.int32))
            cur = before[cur]
        steps = np.stack(path[::-1], axis=1) if path else np.zeros((n, 0), np.int32)
        ids = np.where(steps > 0, trie.code[last[steps]], 0)
        raw, cuts = ids[steps > 0].astype("<u4").tobytes(), np.concatenate([[0], np.cumsum((steps > 0).sum(axis=1) * 4)]).tolist()
        out = {w: (raw[a:b], p, x) for w, a, b, p, x in zip(words, cuts, cuts[1:], count[end].tolist(), best[end].tolist(), strict=False)}
        for k in np.flatnonzero((ids < 0).any(axis=1)).tolist():  # words with characters that are spelled in bytes
            w, parts, i = words[k], [], 0
            for d in length[steps[k][steps[k] > 0]].tolist():
                parts.append(self.code.get(w[i : i + d]) or self.spell(w[i : i + d]))
                i += d
            out[w] = b"".join(parts), *out[w][1:]
        return out

    def _one_by_one(self, words: list[str]) -> dict[str, tuple[bytes, int, float]]:
        if self.n_pairs > PAIRS:
            self.pairs, self.n_pairs = {}, 0
        out, before = {}, ""
        # by prefix length: last piece, best score, pieces on that path, start of its last one, and the starts of what may still become a piece
        last, best, count, back, open_ = [""], [0.0], [0], [0], [[]]
        begins, code, pairs, bpe, unknown, absent = self.begins.get, self.code, self.pairs, self.kind == "bpe", self.unknown, ()
        for w in sorted(words):
            n = min(len(w), len(before))
            shared = 0
            while shared < n and w[shared] == before[shared]:
                shared += 1
            for state in (last, best, count, back, open_):
                del state[shared + 1 :]
            for i in range(shared + 1, len(w) + 1):
                starts, at, top, way = [], -1, 0.0, -1
                for a in open_[i - 1]:
                    t = w[a:i]
                    piece = begins(t, absent)
                    if piece == absent:
                        continue
                    starts.append(a)
                    if piece is None:
                        continue
                    if way < 0 or best[a] + piece[0] > top:
                        top, way = best[a] + piece[0], a
                    if at < 0 and bpe and piece[1]:  # the longest starts come first, and just one piece can be the last
                        u = last[a]
                        if not u:
                            at = a
                        else:
                            ok = pairs[u].get(t) if u in pairs else None
                            if ok if ok is not None else self.stays(u, t):
                                at = a
                starts.append(i - 1)
                alone = begins(w[i - 1], absent) or (unknown,)
                if way < 0 or best[i - 1] + alone[0] >= top:
                    top, way = best[i - 1] + alone[0], i - 1
                if at < 0:
                    at = i - 1
                last.append(w[at:i] if bpe else w[way:i])
                best.append(top)
                count.append(count[way] + 1)
                back.append(way)
                open_.append(starts)
            ids, i = [], len(w)
            while i:  # back from piece to piece
                t = last[i]
                ids.append(code.get(t) or self.spell(t))
                i -= len(t)
            ids.reverse()
            out[w] = b"".join(ids), count[-1], best[-1]
            before = w
        return out

    def encode(self, texts: list[str]) -> list[tuple[bytes, int, float]]:
        """Ids of whole texts, and the number of pieces and the score of their best-scored paths.  A text is marked: a mark in front, and for each space."""
        split = []
        for text in texts:
            parts = text.split(" ") if text else []
            if MARK in text or "" in parts:
                parts = re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", MARK + text.replace(" ", MARK)) if text else []
            else:
                parts = [MARK + p for p in parts]
            split.append(parts)
        known, missing = self.words, set().union(*split) - self.words.keys() if split else set()
        if missing:
            if len(self.words) + len(missing) > WORDS or self.chars > CHARS:
                self.words, self.chars = {}, 0
                missing = set().union(*split)
            fresh = self.encode_words(missing)
            long = {w: fresh.pop(w) for w in missing if len(w) > LONG}
            self.words |= fresh
            self.chars += sum(map(len, fresh))
            known = self.words | long if long else self.words
        out, get = [], known.__getitem__
        for parts in split:
            codes, counts, scores = zip(*map(get, parts), strict=True) if parts else ((), (), ())
            out.append((b"".join(codes), sum(counts), math.fsum(scores)))
        return out

    @functools.cached_property
    def spelled(self) -> dict[int, bytes]:
        known = {int.from_bytes(c, "little"): p.replace(MARK, " ").encode() for p, c in self.code.items()}
        return known | {i: bytes([b]) for b, i in enumerate(self.byte_ids)}

    def decode_all(self, codes: list[bytes]) -> list[str]:
        """``decode`` of many texts' ids (little-endian 32-bit): one look-up of all pieces, cut at the texts' ends."""
        ids = np.frombuffer(b"".join(codes), "<u4")
        none = max(self.spelled, default=-1) + 1
        raw = self.by_id.take(pa.array(np.minimum(ids, none)))
        at = np.frombuffer(raw.buffers()[1], np.int64)[: len(ids) + 1]
        data = raw.buffers()[2].to_pybytes() if len(ids) and at[-1] else b""
        cuts = at[np.cumsum([0, *[len(c) // 4 for c in codes]])].tolist()
        return [(x[1:] if x[:1] == b" " else x).decode(errors="replace") for x in (data[a:b] for a, b in zip(cuts, cuts[1:], strict=False))]

    @functools.cached_property
    def by_id(self) -> pa.Array:
        return pa.array([self.spelled.get(i, b"") for i in range(max(self.spelled, default=-1) + 2)], pa.large_binary())

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces and bytes joined, marks as spaces, without the mark in front; control ids stand for nothing."""
        get = self.spelled.get
        raw = b"".join([get(i, b"") for i in ids])
        return (raw[1:] if raw[:1] == b" " else raw).decode(errors="replace")


@functools.lru_cache(2)
def load_model(path: str | None = None, kind: str = "bpe") -> PieceModel:
    sp = sentence_pieces(path)
    every = range(sp.get_piece_size())
    byte_ids = sorted((i for i in every if sp.is_byte(i)), key=lambda i: int(sp.id_to_piece(i)[3:5], 16))
    plain = {sp.id_to_piece(i): (i, sp.get_score(i)) for i in every if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
    return PieceModel(plain, byte_ids, kind)


def _slices(column: pa.Array, most: int = 1 << 22) -> Iterator[tuple[int, list[str]]]:
    """Rows of a text column in runs of about ``most`` characters."""
    lo, rows, size = 0, [], 0
    for i, text in enumerate(column):
        rows.append(text.as_py() or "")
        size += len(rows[-1])
        if size >= most:
            yield lo, rows
            lo, rows, size = i + 1, [], 0
    if rows:
        yield lo, rows


def _lists(codes: list[bytes]) -> pa.ListArray:
    at = np.concatenate([[0], np.cumsum([len(c) // 4 for c in codes])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(codes), np.int32)))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` (any columns and a string column ``text``) with ``ids``, the piece ids of each whole text.

    A null or empty text has no ids; repeated rows each get theirs; an empty table
    gives an empty result.  A column that is already called ids is replaced.
    """
    d = docs.drop("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model(path)
        for batch in batches:
            for lo, rows in _slices(batch.column("text")):
                part = batch.slice(lo, len(rows))
                yield pa.RecordBatch.from_arrays([*part.columns, _lists([c for c, _, _ in model.encode(rows)])], names=[*part.schema.names, "ids"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema)
    return d.mapInArrow(run, f"{fields}, ids array<int>")


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """``coded`` (any columns and an array column ``ids``) with ``text``; null ids give an empty text."""
    d = coded.drop("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model(path)
        for batch in batches:
            texts = [model.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema)
    return d.mapInArrow(run, f"{fields}, text string")


def piece_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_ids, ids_crc32, n_best, best_score, decoded_crc32 and round_trip.

    Every whole text is encoded and decoded again.  ``n_best`` and ``best_score`` are the number of pieces and the summed piece
    scores of the best-scored path (a character that is no piece counts as one, 10 below the least score).
    ``round_trip`` is false only where a text holds the mark character itself, which decodes to a space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model(path)
        for batch in batches:
            for lo, rows in _slices(batch.column("text")):
                codes, counts, scores = zip(*model.encode(rows), strict=True)
                back = model.decode_all(codes)
                cols = [
                    pa.array([len(c) // 4 for c in codes], pa.int64()), pa.array([zlib.crc32(c) for c in codes], pa.int64()), pa.array(counts, pa.int64()), pa.array(scores, pa.float64()),
                    pa.array([zlib.crc32(x.encode()) for x in back], pa.int64()), pa.array([a == b for a, b in zip(rows, back, strict=True)]),
                ]
                names = ["doc_id", "n_ids", "ids_crc32", "n_best", "best_score", "decoded_crc32", "round_trip"]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, len(rows)), *cols], names=names)

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return d.mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, n_best long, best_score double, decoded_crc32 long, round_trip boolean")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digest(table(spark, sf_dir, "documents"))
