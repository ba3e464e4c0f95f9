"""Token ids in binary shards: independent zstandard frames with a trailing seek table.

A shard is a file of

*   frames: each an independent zstandard frame over the ids (little-endian
    unsigned 32-bit) of whole documents, closed at ``frame_tokens`` ids;
*   the table, in one skippable zstandard frame (so plain zstandard tools read
    the ids and skip it): a zstandard-packed block of the frames' rows
    (compressed size, ids, documents, crc32 of the ids' bytes) and of the
    documents' rows (id, ids);
*   a footer of 32 bytes at the end of that frame: frames, documents, length
    of the packed block, crc32 of it, and the magic number.

A reader takes the footer and the table from the end and then only the frames
that hold the documents it was asked for, and checks each frame's crc32.

Shards are written by tasks through ``pyarrow.fs`` under a name of the attempt
and then moved to their own, so a task that is run again replaces its file by
the same bytes.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import shuffle_partitions, stage

MAGIC = b"LADLTOK1"
SKIPPABLE = 0x184D2A5E
FOOTER = struct.Struct("<IIQQ8s")  # crc32 of the block, frames, documents, block length, magic
FRAME = np.dtype([("size", "<u8"), ("ids", "<u8"), ("docs", "<u8"), ("crc", "<u4")])
DOC = np.dtype([("id", "<i8"), ("ids", "<u8"), ("null", "u1")])
CACHE = 500_000  # chunks in one generation of an encoder's cache
LONGEST = 64  # characters of the longest chunk that is kept

_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"
_PLAIN = re.compile(rf"[{_LETTERS}0-9{_MARKS} \n]+")
_WORDS = re.compile(rf" ?[{_LETTERS}]+| ?[0-9]+| ?[{_MARKS}]+|\n")
_WORD_MARKS = re.compile(rf"([{_LETTERS}]+|[0-9]+)?([{_MARKS}]*)")
_SPLIT = re.compile(r"(?<=\S) (?=\S)")


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes printable bytes as themselves and the others, in order, from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + n)
    return table


class _NoBorder(Exception):
    """The space before a chunk may not be a border."""


class _Kept(dict):
    """Values of ``make`` by text, in two generations.

    When the newer one has ``size`` values it becomes the older, whose values
    come back as they are used: rare texts leave and frequent ones stay.
    """

    def __init__(self, make: Callable[[str], bytes], size: int):
        super().__init__()
        self.make, self.size, self.older = make, size, {}

    def __missing__(self, text: str) -> bytes:
        value = self.older.get(text)
        if value is None:
            value = self.make(text)
            if len(text) > LONGEST:
                return value
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[text] = value
        return value


class CachedEncoder:
    """Byte-level BPE ids by the tokenizers library, each frequent chunk encoded once.

    The pre-tokenizer always cuts before a space that stands between two
    characters that are not white space, so a text is encoded chunk by chunk.
    Chunks of plain words, numbers and marks are cut into words here, and the
    library's model gives each distinct word's ids; any other chunk goes
    through the whole tokenizer.  Two generations of at most ``CACHE`` chunks
    that follow a space, and of a quarter as many other words, are kept.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.chunks = _Kept(self._later, CACHE)
        self.words = _Kept(self._word, max(1, CACHE // 4))

    def _word(self, word: str) -> bytes:
        if word.isascii():  # words hold no other unprintable characters
            shown = word.replace(" ", "Ġ").replace("\n", "Ċ")
        else:
            shown = "".join([self.letters[b] for b in word.encode()])
        ids = [t.id for t in self.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: str) -> bytes:
        if _PLAIN.fullmatch(chunk) and "<|" not in chunk and "\n\n" not in chunk and " " not in chunk[1:]:
            parts = _WORDS.findall(chunk)
            if sum(map(len, parts)) == len(chunk):
                return b"".join([self.chunks[p[1:]] if p[0] == " " else self.words[p] for p in parts])
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def _later(self, chunk: str) -> bytes:
        """Ids of a chunk that a space precedes, that space included."""
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise _NoBorder
        plain = _WORD_MARKS.fullmatch(chunk)
        if plain is None:
            return self._chunk(" " + chunk)
        word, marks = plain.groups()
        return self.chunks[word] + self.words[marks] if word and marks else self._word(" " + chunk)

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        head, *parts = text.split(" ")
        if head and not head[-1].isspace():
            try:
                return self._chunk(head) + b"".join(map(self.chunks.__getitem__, parts))
            except _NoBorder:
                pass
        parts = _SPLIT.split(text)
        return self._chunk(parts[0]) + b"".join([self._chunk(" " + p) for p in parts[1:]])


class ShardWriter:
    """Writes one shard to a binary stream."""

    def __init__(self, out, frame_tokens: int = 1 << 20, level: int = 3):
        self.out, self.frame_tokens = out, frame_tokens
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames: list[tuple] = []
        self.docs: list[tuple] = []
        self.held: list[bytes] = []
        self.held_ids = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id or 0, len(ids) // 4, doc_id is None))
        self.held.append(ids)
        self.held_ids += len(ids) // 4
        if self.held_ids >= self.frame_tokens:
            self._close_frame()

    def _close_frame(self) -> None:
        if self.held:
            raw = b"".join(self.held)
            packed = self.packer.compress(raw)
            self.out.write(packed)
            self.frames.append((len(packed), self.held_ids, len(self.held), zlib.crc32(raw)))
            self.held, self.held_ids = [], 0

    def close(self) -> None:
        self._close_frame()
        block = self.packer.compress(np.array(self.frames, FRAME).tobytes() + np.array(self.docs, DOC).tobytes())
        footer = FOOTER.pack(zlib.crc32(block), len(self.frames), len(self.docs), len(block), MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE, len(block) + len(footer)) + block + footer)


class ShardReader:
    """Reads documents of one shard from a seekable binary stream; only their frames are decompressed."""

    def __init__(self, stream, size: int):
        self.stream = stream
        stream.seek(size - FOOTER.size)
        crc, frames, docs, length, magic = FOOTER.unpack(stream.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        stream.seek(size - FOOTER.size - length)
        block = stream.read(length)
        if zlib.crc32(block) != crc:
            raise ValueError("the seek table is damaged")
        raw = zstandard.ZstdDecompressor().decompress(block, max_output_size=frames * FRAME.itemsize + docs * DOC.itemsize) \
            if frames else b""
        self.frames = np.frombuffer(raw[:frames * FRAME.itemsize], FRAME)
        self.docs = np.frombuffer(raw[frames * FRAME.itemsize:], DOC)
        self.offsets = np.concatenate([[0], np.cumsum(self.frames["size"])]).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.frames["docs"])]).astype(np.int64)
        self.decompressed = 0

    def frame(self, k: int) -> bytes:
        self.stream.seek(int(self.offsets[k]))
        packed = self.stream.read(int(self.frames["size"][k]))
        raw = zstandard.ZstdDecompressor().decompress(packed, max_output_size=max(1, 4 * int(self.frames["ids"][k])))
        self.decompressed += 1
        if zlib.crc32(raw) != self.frames["crc"][k]:
            raise ValueError(f"frame {k} is damaged")
        return raw

    def read(self, rows: Iterable[int] | None = None) -> Iterator[tuple[int, int | None, bytes]]:
        """(row, document id, bytes of its ids) of the given rows of the document table, or of all."""
        rows = range(len(self.docs)) if rows is None else sorted(set(rows))
        at, raw, ends = -1, b"", np.zeros(0, np.int64)
        for row in rows:
            k = int(np.searchsorted(self.first, row, side="right")) - 1
            if k != at:
                at, raw = k, self.frame(k)
                ends = 4 * np.concatenate([[0], np.cumsum(self.docs["ids"][self.first[k]:self.first[k + 1]])]).astype(np.int64)
            i = row - int(self.first[k])
            doc = self.docs[row]
            yield row, None if doc["null"] else int(doc["id"]), raw[ends[i]:ends[i + 1]]

    def rows_of(self, doc_ids: Iterable[int]) -> list[int]:
        return np.flatnonzero(np.isin(self.docs["id"], list(doc_ids)) & (self.docs["null"] == 0)).tolist()


def _file_system(path: str):
    from pyarrow import fs

    uri = re.sub(r"^(\w+):/(?!/)", r"\1:///", path)
    return fs.FileSystem.from_uri(uri)


def write_shards(docs: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text", *, end_id: int = 0, frame_tokens: int = 1 << 20) -> DataFrame:
    """Encode every whole text, append ``end_id``, and write shards in ascending id order.

    Returns the manifest (shard, path, docs, tokens, start); ``start`` is the
    number of ids in the shards before.  The texts are range-partitioned by id
    once and encoded in the task that writes them, so ids are never shuffled.
    ``folder`` is a shared folder (default: below ``spark.checkpoint.dir``).

    Defined results: a null or empty text has only the end id; a null id comes
    first; rows with the same id are ordered by text (all are written); an
    empty table gives no shards; other columns are not read.
    """
    spark = docs.sparkSession
    folder = folder or f"{ensure_checkpoint_dir(spark)}/llm-tokens-{uuid.uuid4().hex[:12]}"
    end = np.array([end_id], "<u4").tobytes()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.repartitionByRange(shuffle_partitions(spark), "id").sortWithinPartitions("id", "t")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encoder, out, writer, tokens = None, None, None, 0
        files, base = _file_system(folder)
        name = f"{base}/shard-{shard:06d}.ltk"
        part = f"{base}/.shard-{shard:06d}-{uuid.uuid4().hex}"
        for pdf in batches:
            for i, text in zip(pdf["id"].astype("Int64"), pdf["t"]):
                if writer is None:
                    files.create_dir(base, recursive=True)
                    out = files.open_output_stream(part)
                    encoder, writer = encoder_of(tokenizer), ShardWriter(out, frame_tokens)
                ids = encoder.encode(text) + end
                writer.add(None if pd.isna(i) else int(i), ids)
                tokens += len(ids) // 4
        if writer is not None:
            writer.close()
            out.close()
            files.move(part, name)
            yield pd.DataFrame({"shard": [shard], "path": [f"{folder}/shard-{shard:06d}.ltk"], "docs": [len(writer.docs)],
                                "tokens": [tokens]})

    done = stage(rows.mapInPandas(run, "shard long, path string, docs long, tokens long"), "shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    return done.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


_ENCODERS: dict[str, CachedEncoder] = {}


def encoder_of(path: str) -> CachedEncoder:
    """The worker's encoder of a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = CachedEncoder(path)
    return _ENCODERS[path]


def read_shards(manifest: DataFrame, doc_ids: list[int] | None = None) -> DataFrame:
    """Documents of the shards: doc_id, start, n_tokens, ids (bytes), one row each.

    With ``doc_ids`` only the frames that hold them are decompressed.  Frames
    are read one at a time.
    """
    spark: SparkSession = manifest.sparkSession
    wanted = None if doc_ids is None else set(doc_ids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, start in zip(pdf["path"], pdf["start"]):
                files, name = _file_system(path)
                with files.open_input_file(name) as stream:
                    shard = ShardReader(stream, stream.size())
                    begin = int(start) + np.concatenate([[0], np.cumsum(shard.docs["ids"])]).astype(np.int64)
                    rows = None if wanted is None else shard.rows_of(wanted)
                    held: list[tuple] = []
                    size = 0
                    for row, doc, ids in shard.read(rows):
                        held.append((doc, int(begin[row]), len(ids) // 4, ids))
                        size += len(ids)
                        if size > 8 << 20:
                            yield _rows(held)
                            held, size = [], 0
                    if held:
                        yield _rows(held)

    kind = "doc_id long, start long, n_tokens long, ids binary"
    return manifest.select("path", "start").repartition(shuffle_partitions(spark), "path").mapInPandas(run, kind)


def _rows(held: list[tuple]) -> pd.DataFrame:
    df = pd.DataFrame(held, columns=["doc_id", "start", "n_tokens", "ids"])
    df["doc_id"] = df["doc_id"].astype("Int64")
    return df
