"""Packing examples into training sequences: vector bin packing.

A piece of an example has a demand for tokens, segments (one) and loss-bearing
tokens; a sequence has limits on all three.  Open sequences are filled by the
dot-product heuristic (Panigrahy et al., "Heuristics for Vector Bin Packing",
2011): of the pieces that fit, the one whose demand has the largest weighted
dot product with what is left of the sequence.  If none fits whole, one is cut
to fill it.  Sequences never span tasks, so packing needs no shuffle, and each
task holds a bounded pool of pieces.
"""
from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.common import table

CAPACITY = 1024
#: segments of a sequence: attention masks and position ids are kept by segment
MAX_SEGMENTS = 32
END_ID = 0
#: pieces held open in a task; beyond it sequences are filled until half are placed
POOL = 4096
#: distinct words whose ids a worker keeps twice over: new ones, and those kept before
CACHE_WORDS = 300_000
#: white space in a row from which a text goes to the tokenizer whole (the rank file's splitter recurses over it)
LONG_BLANK = 4096

TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordIds:
    """Token ids of whole texts, as little-endian unsigned 32-bit bytes.

    A byte-level BPE never merges across the blank before a word, so ids of a
    text are those of its blank-led words in a row, and words repeat.  Where a
    blank touches other white space this doesn't hold and the text is encoded
    whole.  Latin words go through the vocabulary's rank file (the same ids);
    all else, control strings and very long runs of white space, through the
    tokenizer itself."""

    def __init__(self, tokenizer=TOKENIZER, ranks=RANKS):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(public_tokenizers.path(tokenizer))
        with open(public_tokenizers.path(ranks), "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.latin = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        self.odd = re.compile("[^\u0000-ɏ]|<\\||\\s{%d}" % LONG_BLANK)
        self.first: dict[str, bytes] = {}
        self.rest: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        ids = self.exact.encode(text, add_special_tokens=False).ids if self.odd.search(text) else self.latin.encode_ordinary(text)
        return pack_ids(ids)

    def __call__(self, text: str) -> bytes:
        words = text.split(" ")
        head = words[0]
        if len(words) == 1:
            return self.encode(text)
        if not head or head[-1].isspace():
            return self.encode(text)
        found = list(map(self.rest.get, words))
        found[0] = b""
        if None in found:
            kept, older = self.rest, self.older
            for i, ids in enumerate(found):
                if ids is None:
                    w = words[i]
                    ids = kept.get(w) or older.get(w)
                    if ids is None:
                        if not w or w[0].isspace() or w[-1].isspace():
                            return self.encode(text)
                        ids = self.encode(" " + w)
                    found[i] = kept[w] = ids
            if len(kept) >= CACHE_WORDS:
                self.rest, self.older = {}, kept
        ids = self.first.get(head)
        if ids is None:
            if len(self.first) > CACHE_WORDS // 10:
                self.first.clear()
            ids = self.first[head] = self.encode(head)
        found[0] = ids
        return b"".join(found)


class _Packer:
    """Fills sequences from a bounded pool; ``out`` has (piece, sequence, offset)."""

    def __init__(self, limits: tuple[int, int, int]):
        self.limits = np.array(limits, float)
        self.pool: dict[tuple[int, int], list] = {}  # (tokens, loss tokens) -> pieces
        self.held, self.sequences, self.out = 0, 0, []
        self.bin: list = []
        self.left = self.limits.copy()

    def add(self, piece) -> None:
        self.pool.setdefault((piece[2], piece[3]), []).append(piece)
        self.held += 1
        if self.held >= POOL:
            self.fill(POOL // 2)

    def place(self, piece) -> None:
        self.bin.append(piece)
        self.left -= (piece[2], 1, piece[3])

    def take(self, kind):
        pieces = self.pool[kind]
        piece = pieces.pop()
        if not pieces:
            del self.pool[kind]
        self.held -= 1
        return piece

    def fill(self, until: int) -> None:
        while self.held > until:
            kinds = np.array(list(self.pool), float)
            demand = np.column_stack((kinds[:, 0], np.ones(len(kinds)), kinds[:, 1]))
            while len(demand) and self.held > until:
                fits = (demand <= self.left).all(1)
                if not fits.any():
                    break
                weight = self.left / self.limits**2
                best = int(np.where(fits, demand @ weight, -1).argmax())
                kind = (int(kinds[best, 0]), int(kinds[best, 1]))
                self.place(self.take(kind))
                if kind not in self.pool:
                    demand[best] = np.inf
            if self.held > until:
                self.cut()
                self.close()

    def cut(self) -> None:
        """Fill what is left with the front of a piece that is too long."""
        room, segments, loss = (int(x) for x in self.left)
        if not room or not segments or not self.pool:
            return
        piece = self.take(next(iter(self.pool)))
        length = min(room, piece[2], piece[2] - piece[3] + loss)
        if length > 0:
            front, back = piece[4].split(piece, length)
            self.place(front)
            piece = back
        if piece[2]:
            self.pool.setdefault((piece[2], piece[3]), []).append(piece)
            self.held += 1

    def close(self) -> None:
        """End the sequence.  A short one is cut into powers of two, which need no padding."""
        used = sum(p[2] for p in self.bin)
        sizes = [used] if used == self.limits[0] else [1 << b for b in range(used.bit_length() - 1, -1, -1) if used >> b & 1]
        pieces = self.bin[::-1]
        for size in sizes:
            offset = 0
            while offset < size:
                piece = pieces.pop()
                if piece[2] > size - offset:
                    piece, back = piece[4].split(piece, size - offset)
                    pieces.append(back)
                self.out.append((piece, self.sequences, offset))
                offset += piece[2]
            self.sequences += 1
        self.bin, self.left = [], self.limits.copy()

    def whole(self, piece) -> None:
        """A piece that fills a sequence by itself."""
        self.out.append((piece, self.sequences, 0))
        self.sequences += 1


class _Example:
    """A tokenized example; its tokens from ``loss_from`` on bear loss, but not its end id.
    A piece is (example, start, length, loss tokens, example again for splitting)."""

    __slots__ = ("key", "data", "n", "loss_from")

    def __init__(self, key, data: bytes, loss_from: int):
        self.key, self.data, self.n, self.loss_from = key, data, len(data) // 4, loss_from

    def piece(self, start: int, length: int):
        return (self, start, length, max(0, min(start + length, self.n - 1) - max(start, self.loss_from)), self)

    def split(self, piece, length: int):
        return self.piece(piece[1], length), self.piece(piece[1] + length, piece[2] - length)


def pack(examples: DataFrame, key="doc_id", text="text", prompt=None, capacity=CAPACITY, max_segments=MAX_SEGMENTS,
         max_loss=None, tokenizer=TOKENIZER, ranks=RANKS, with_ids=False) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, loss_tokens (and ids, if asked for).

    ``prompt`` names a column whose tokens precede the text's and bear no
    loss, nor does the end id; ``max_loss`` limits the loss-bearing tokens of a sequence (default:
    ``capacity``).  Null or empty text: the end id alone.  Long texts are cut
    freely; repeated rows and null keys are packed each on their own; other
    columns are left out.  An empty table gives an empty result."""
    max_loss = capacity if max_loss is None else max_loss
    if min(capacity, max_segments, max_loss) < 1:
        raise ValueError("capacity, max_segments and max_loss must be at least 1")
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    frame = examples.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"),
                            (F.col(prompt).cast("string") if prompt else F.lit(None).cast("string")).alias("prompt"))
    kind = frame.schema["key"].dataType.simpleString()
    schema = (f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
              "loss_tokens long" + (", ids array<long>" if with_ids else ""))

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        ids_of = _worker_ids(tokenizer, ranks)
        base = TaskContext.get().partitionId() << 33
        packer = _Packer((capacity, max_segments, max_loss))

        def rows():
            out, packer.out = packer.out, []
            made = []
            for (ex, start, length, loss, _), sequence, offset in out:
                data = ex.data[4 * start:4 * (start + length)]
                made.append((ex.key, start, length, zlib.crc32(data), ex.n, base + sequence, offset, loss)
                            + ((np.frombuffer(data, "<u4").astype(np.int64),) if with_ids else ()))
            frame = pd.DataFrame(made, columns=[c.split()[0] for c in schema.split(", ")])
            return frame.astype({"key": object}).where(frame.notna(), None) if frame["key"].isna().any() else frame

        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            # keys may be null: keep them as Python objects
            for k, t, p in zip(batch["key"].astype(object), batch["text"], batch["prompt"]):
                asked = ids_of(p) if p else b""
                ex = _Example(None if pd.isna(k) else k, asked + (ids_of(t) if t else b"") + end, len(asked) // 4)
                start = 0
                while start < ex.n:
                    stop = min(ex.n, start + capacity, max(start, ex.loss_from) + max_loss)
                    piece = ex.piece(start, stop - start)
                    packer.whole(piece) if piece[2] == capacity else packer.add(piece)
                    start = stop
                if len(packer.out) > 20_000:
                    yield rows()
        packer.fill(0)
        if packer.bin:
            packer.close()
        if packer.out:
            yield rows()

    return frame.mapInPandas(task, schema).withColumnRenamed("key", key)


_IDS: dict = {}


def _worker_ids(tokenizer: str, ranks: str) -> WordIds:
    """One per worker process: tasks that follow use its words again."""
    if (tokenizer, ranks) not in _IDS:
        _IDS[tokenizer, ranks] = WordIds(tokenizer, ranks)
    return _IDS[tokenizer, ranks]


def op4_packing(spark, sf_dir):
    """Pack all documents into sequences of at most 1024 tokens."""
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
