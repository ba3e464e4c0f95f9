"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The vocabulary (pieces with log scores) is read from a model file; nothing is
trained.  A text becomes ``marker + text`` with spaces written as the marker
U+2581, and the best-scoring segmentation into pieces is found by dynamic
programming over UTF-8 positions; a character that no piece covers costs
``lowest score - 10`` and is written as byte pieces.  If no piece has a marker
behind another character, every run of markers starts a new segment, as does a
character that stands in no piece at all; segments are then independent, and a
task solves each distinct segment once, many at a time with numpy.

Scores are summed in double precision.  Among equal sums the segmentation
whose last piece starts first is taken, at every position.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import trimmed

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE = 200_000


class PieceTable:
    """Pieces, scores and the double-array trie over their UTF-8 bytes."""

    def __init__(self, pieces: list[tuple[str, float]], byte_ids: list[int] | None, unk_id: int, skip: set[int],
                 add_prefix: bool = True):
        """``pieces`` by id; ``byte_ids``: the ids of the 256 byte pieces (None: unknown characters become
        ``unk_id``); ``skip``: ids that never match a text (control, unknown and byte pieces)."""
        self.unk_id, self.byte_ids, self.add_prefix = unk_id, byte_ids, add_prefix
        self.scores = np.array([s for _, s in pieces], np.float64)
        normal = {p.encode(): i for i, (p, _) in enumerate(pieces) if i not in skip and p}
        self.unk_score = min((self.scores[i] for i in normal.values()), default=0.0) - UNKNOWN_PENALTY
        self.base, self.check, self.value = _double_array(normal)
        self.surface = [b"" if i in skip else p.replace(MARK, " ").encode() for i, (p, _) in enumerate(pieces)]
        for b, i in enumerate(byte_ids or []):
            self.surface[i] = bytes([b])
        self.surface[unk_id] = " ⁇ ".encode()
        texts = [p for i, (p, _) in enumerate(pieces) if i not in skip]
        known = {c for p in texts for c in p}
        breaks = "".join(c for c in "\n\t\r" if c not in known)
        free = any(MARK in p.lstrip(MARK) for p in texts)
        mark = "" if free else MARK
        self.split = re.compile((f"{mark}+[^{mark}{breaks}]*|" if mark else "")
                                + (f"[{breaks}]|" if breaks else "") + (f"[^{mark}{breaks}]+" if mark + breaks else ".+"),
                                re.DOTALL)

    @classmethod
    def load(cls, path: str) -> "PieceTable":
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        skip = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)}
        return cls([(sp.id_to_piece(i), sp.get_score(i)) for i in range(n)],
                   byte_ids if all(sp.is_byte(i) for i in byte_ids) else None, sp.unk_id(), skip)

    def segments(self, text: str) -> list[str]:
        text = text.replace(" ", MARK)
        return self.split.findall(MARK + text if self.add_prefix else text) if text else []

    def solve(self, segments: list[str]) -> list[np.ndarray]:
        """Ids of each segment; segments of similar length are solved together."""
        raw = [s.encode("utf-8", "surrogatepass") for s in segments]
        out: list[np.ndarray | None] = [None] * len(raw)
        order = sorted(range(len(raw)), key=lambda i: len(raw[i]))
        at = 0
        while at < len(order):
            width = len(raw[order[at]])
            limit = max(8, width + width // 4)
            rows = max(1, (1 << 21) // max(limit, 1))
            to = at
            while to < len(order) and to - at < rows and len(raw[order[to]]) <= limit:
                to += 1
            for i, ids in zip(order[at:to], self._viterbi([raw[i] for i in order[at:to]])):
                out[i] = ids
            at = to
        return out

    def _viterbi(self, raw: list[bytes]) -> list[np.ndarray]:
        n, lengths = len(raw), np.array([len(r) for r in raw])
        width = int(lengths.max(initial=0))
        text = np.zeros((n, width + 1), np.uint8)
        for i, r in enumerate(raw):
            text[i, :len(r)] = np.frombuffer(r, np.uint8)
        begins = (text & 0xC0) != 0x80   # a character starts here (or the text ends)
        inside = np.arange(width + 1)[None, :] < lengths[:, None]
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0.0
        back = np.zeros((n, width + 1), np.int32)
        piece = np.full((n, width + 1), -1, np.int32)
        for i in range(width):
            rows = np.flatnonzero(begins[:, i] & inside[:, i])
            if not len(rows):
                continue
            start = best[rows, i]
            # bytes of the character that starts here
            lead = text[rows, i]
            step = np.minimum(1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0), lengths[rows] - i)
            single = np.zeros(len(rows), bool)
            live, state, depth = np.arange(len(rows)), np.zeros(len(rows), np.int64), 0
            while len(live):
                r = rows[live]
                more = i + depth < lengths[r]
                live, state, r = live[more], state[more], r[more]
                nxt = self.base[state] + text[r, i + depth]
                good = self.check[nxt] == state
                live, state, r = live[good], nxt[good], r[good]
                depth += 1
                ids = self.value[state]
                hit = ids >= 0
                if hit.any():
                    h, hr, hi = live[hit], r[hit], ids[hit]
                    single[h[step[h] == depth]] = True
                    score = start[h] + self.scores[hi]
                    better = score > best[hr, i + depth]
                    hr, hi = hr[better], hi[better]
                    best[hr, i + depth] = score[better]
                    back[hr, i + depth] = i
                    piece[hr, i + depth] = hi
            lone = np.flatnonzero(~single)
            if len(lone):
                r, end = rows[lone], i + step[lone]
                score = start[lone] + self.unk_score
                better = score > best[r, end]
                r, end = r[better], end[better]
                best[r, end] = score[better]
                back[r, end] = i
                piece[r, end] = -1
        out = []
        for k, r in enumerate(raw):
            ids: list[int] = []
            at = len(r)
            while at > 0:
                i, p = int(back[k, at]), int(piece[k, at])
                if p >= 0:
                    ids.append(p)
                elif self.byte_ids:
                    ids += [self.byte_ids[b] for b in reversed(r[i:at])]
                else:
                    ids.append(self.unk_id)
                at = i
            out.append(np.array(ids[::-1], np.int32))
        return out

    def encode(self, text: str) -> list[int]:
        return [int(x) for ids in self.solve(self.segments(text)) for x in ids]

    def decode(self, ids) -> str:
        surface, n = self.surface, len(self.surface)
        raw = b"".join([surface[i] if 0 <= i < n else surface[self.unk_id] for i in ids])
        if self.add_prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


def _double_array(words: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, value): the child of state s by byte b is ``base[s] + b`` if its check is s."""
    children: list[dict[int, int]] = [{}]
    ids = [-1]
    for w in sorted(words):
        s = 0
        for b in w:
            t = children[s].get(b)
            if t is None:
                t = children[s][b] = len(children)
                children.append({})
                ids.append(-1)
            s = t
        ids[s] = words[w]
    size = 1 << 12
    while size < 2 * len(children) + 512:
        size *= 2
    used = np.zeros(size, bool)
    base, check, value = (np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64))
    used[0], value[0] = True, ids[0]
    todo, first = [(0, 0)], 1 + min((w[i] for w in words for i in range(len(w))), default=0)
    while todo:
        node, slot = todo.pop()
        kids = sorted(children[node].items())
        if not kids:
            continue
        labels = np.array([b for b, _ in kids])
        while used[first]:
            first += 1
        at = max(first - int(labels[0]), 1)
        width = 1 if len(labels) == 1 else 32
        while True:  # the first place where all children find free slots, some places at a time
            if at + width + 512 >= len(used):
                grow = len(used)
                used = np.concatenate([used, np.zeros(grow, bool)])
                base = np.concatenate([base, np.zeros(grow, np.int64)])
                check = np.concatenate([check, np.full(grow, -1, np.int64)])
                value = np.concatenate([value, np.full(grow, -1, np.int64)])
            taken = used[at + labels] if width == 1 else used[at + np.arange(width)[:, None] + labels[None, :]].any(axis=1)
            if not taken.all():
                at += int(np.argmin(taken))
                break
            at += width
            width = min(2 * width, 4096)
        if at > first + 1024 and used[first:at].mean() > 0.9:
            first = at  # the few free slots below are left
        base[slot] = at
        for b, kid in kids:
            used[at + b], check[at + b], value[at + b] = True, slot, ids[kid]
            todo.append((kid, at + b))
    top = int(np.flatnonzero(used)[-1]) + 257
    pad = max(0, top - len(used))
    grow = lambda a, fill: np.concatenate([a, np.full(pad, fill, a.dtype)])[:top]
    return grow(base, 0), grow(check, -1), grow(value, -1)


@functools.lru_cache(maxsize=4)
def piece_table(path: str, stamp: float) -> PieceTable:
    return PieceTable.load(path)


def load(path: str) -> PieceTable:
    """The table of a model file on the driver (kept until the file changes)."""
    return piece_table(path, os.path.getmtime(path))


def _plain(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _portions(texts: list) -> Iterator[list]:
    """Parts of a batch of about a million characters, so that few segments are held at once."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t or "")
        if size >= 1 << 20:
            yield held
            held, size = [], 0
    if held:
        yield held


def _encoded(model: PieceTable, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.ListArray, pa.RecordBatch]]:
    """Each batch with the ids of its texts (column t); at most ``CACHE`` solved segments are kept."""
    cache: dict[str, bytes] = {}
    for batch in batches:
        raw: list[bytes] = []
        for texts in _portions(_plain(batch, "t").to_pylist()):
            split = [model.segments(t) if t else [] for t in texts]
            if len(cache) > CACHE:
                cache.clear()
            new = list({s for segs in split for s in segs if s not in cache})
            cache.update(zip(new, [x.tobytes() for x in model.solve(new)]))
            raw += [b"".join([cache[s] for s in segs]) for segs in split]
        offsets = np.zeros(len(raw) + 1, np.int32)
        np.cumsum([len(x) // 4 for x in raw], out=offsets[1:])
        yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), np.int32))), batch


def _decoded(model: PieceTable, lists: pa.ListArray) -> pa.Array:
    cuts, ids = lists.offsets.to_numpy(), pc.fill_null(lists.values, -1).to_numpy()
    return pa.array([model.decode(ids[x:y].tolist()) if ok else None
                     for x, y, ok in zip(cuts, cuts[1:], lists.is_valid().to_pylist())], pa.string())


def _inner(docs: DataFrame, text_col: str, *replaced: str) -> tuple[DataFrame, list[str]]:
    """The text as ``t`` and the other columns under positional names (clashing names do no harm in the task)."""
    gone = {c.lower() for c in (text_col, *replaced)}
    rest = [c for c in docs.columns if c.lower() not in gone]
    return docs.select(F.col(text_col).alias("t"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)]), rest


_IDS = T.StructField("ids", T.ArrayType(T.IntegerType()))


def encode(docs: DataFrame, model: PieceTable, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``ids_col`` (array of int) in place of ``text_col``.

    The table (bounded by the vocabulary) goes to every task.  Defined
    results: a null or empty text has no ids; other columns are passed
    through, ``ids_col`` replaces a column of its name; repeated rows are
    encoded alike; an empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    inner, rest = _inner(docs, text_col, ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, batch in _encoded(held.value, batches):
            yield pa.RecordBatch.from_arrays([ids, *batch.columns[1:]], names=["ids", *batch.schema.names[1:]])

    out = inner.mapInArrow(trimmed(run), T.StructType([_IDS] + list(inner.schema.fields[1:])))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(rest)], F.col("ids").alias(ids_col))


def encode_and_decode(docs: DataFrame, model: PieceTable, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``ids_col`` and the text decoded from it in place of ``text_col``.

    The same rows as ``decode(encode(docs))``, but one worker with one table
    does both for a task, where two stand in line otherwise.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    inner, rest = _inner(docs, text_col, ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, batch in _encoded(held.value, batches):
            yield pa.RecordBatch.from_arrays([ids, _decoded(held.value, ids), *batch.columns[1:]],
                                             names=["ids", "t", *batch.schema.names[1:]])

    fields = [_IDS, T.StructField("t", T.StringType())] + list(inner.schema.fields[1:])
    out = inner.mapInArrow(trimmed(run), T.StructType(fields))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(rest)], F.col("ids").alias(ids_col),
                      F.col("t").alias(text_col))


def decode(encoded: DataFrame, model: PieceTable, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``encoded`` with the decoded ``text_col`` added.

    Markers become spaces and the one that encoding put in front is dropped;
    byte pieces are read as UTF-8 (broken sequences become U+FFFD), an id
    outside the vocabulary and a null id like the unknown piece.  A null
    array gives a null text.
    """
    held = encoded.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in encoded.columns if c.lower() != text_col.lower()]
    inner = encoded.select(F.col(ids_col).alias("ids"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)])
    schema = T.StructType([T.StructField("t", T.StringType())] + list(inner.schema.fields[1:]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([_decoded(held.value, _plain(batch, "ids")), *batch.columns[1:]],
                                             names=["t", *batch.schema.names[1:]])

    out = inner.mapInArrow(trimmed(run), schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(rest)], F.col("t").alias(text_col))
