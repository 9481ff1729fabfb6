"""SentencePiece (merge type) encoding by backtracking, and decoding.

A merge-type encoding is the one sequence of pieces in which every two
neighbours are compatible: merging their joined characters anew gives the two
back.  So an encoder walks forward: an Aho-Corasick automaton over the pieces
tells the longest piece at every place of a chunk, the longest one compatible
with the piece before is taken, and where none is left the place is marked in
a bitfield as failed and the walk steps back to the next shorter piece before
it.  No priority queue of merges is needed, and the work is linear in practice
even for a text without a single blank.

A text is cut into chunks where no piece of the vocabulary can reach across:
before a run of blanks, between letters and signs that stand next to each other
in no piece, and around characters that no piece holds, which become byte
pieces.  Chunks repeat, so a worker keeps the ids of short ones.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.common import fresh, table

MODEL = "piece_bpe_32k.model"
BLANK = "▁"
#: short chunks that a worker keeps twice over (new ones, and those kept before), and pairs of pieces
KEPT_CHUNKS, KEPT_PAIRS, SHORT = 300_000, 500_000, 64
#: ids of an output batch
BATCH_IDS = 1 << 20


class Pieces:
    """Encoder and decoder of a merge-type model with byte pieces, the identity
    normalizer and a blank put before every text; other models are refused."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = " a  ａ "
        if self.model.normalize(probe) != BLANK + probe.replace(" ", BLANK):
            raise ValueError("only the identity normalizer with a leading blank is supported")
        n = self.model.get_piece_size()
        special = [i for i in range(n) if self.model.is_control(i) or self.model.is_unknown(i)]
        self.byte_ids = {int(self.model.id_to_piece(i)[1:-1], 16): i for i in range(n) if self.model.is_byte(i)}
        if len(self.byte_ids) < 256 or any(self.model.is_unused(i) for i in range(n)):
            raise ValueError("only models with byte pieces and without unused pieces are supported")
        self.end = self.model.eos_id()
        plain = [i for i in range(n) if i not in special and not self.model.is_byte(i)]
        self.ids = {self.model.id_to_piece(i): i for i in plain}
        self.score = {self.model.id_to_piece(i): self.model.get_score(i) for i in plain}
        if any(BLANK in p.lstrip(BLANK) for p in self.ids):
            raise ValueError("a piece reaches across a blank")
        # bytes of every id, for decoding; the unknown id has its own sign
        self.surface = [b""] * n
        for p, i in self.ids.items():
            self.surface[i] = p.replace(BLANK, " ").encode()
        for b, i in self.byte_ids.items():
            self.surface[i] = bytes([b])
        self.first = {i for p, i in self.ids.items() if p.startswith(BLANK)}
        self.strange = {i for i in special if not self.model.is_control(i)}

        self.pairs: dict[tuple[str, str], bool] = {}
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # a piece that its own merges don't lead to never comes up
        reached = [p for p in self.ids if self.merge(p) == [p]]
        known = set(reached)
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in known), None) for p in reached}
        self.trie = ahocorasick.Automaton()
        for p in reached:
            self.trie.add_word(p, p)
        self.trie.make_automaton()
        own = {i: np.array([i], "<i4").tobytes() for i in range(n)}
        self.packed = {p: own[i] for p, i in self.ids.items()}
        self.packed_bytes = {b: own[i] for b, i in self.byte_ids.items()}
        self.packed_end = own[self.end]
        # signs that stand next to a letter in some piece go with the letters
        held = {c for p in self.ids for c in p} - {BLANK}
        joined = {c for p in self.ids for a, b in zip(p, p[1:]) if BLANK not in (a, b) and a.isalpha() != b.isalpha() for c in (a, b)}
        letters, signs = ("".join(re.escape(c) for c in sorted(x)) for x in (
            {c for c in held if c.isalpha() or c in joined}, {c for c in held if not (c.isalpha() or c in joined)}))
        runs = [f"{BLANK}*[{x}]+" for x in (letters, signs) if x]
        self.cut = re.compile("|".join([*runs, f"[^{BLANK}{letters}{signs}]+", f"{BLANK}+"]), re.S)

    def merge(self, text: str) -> list[str]:
        """Plain merging of a short text: best score first, then leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best = max(range(len(parts) - 1), key=lambda i: (self.score.get(parts[i] + parts[i + 1], -np.inf), -i))
            joined = parts[best] + parts[best + 1]
            if joined not in self.score:
                break
            parts[best:best + 2] = [joined]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        """Whether two neighbours come back when their characters are merged anew."""
        good = self.pairs.get((a, b))
        if good is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            good = self.pairs[a, b] = self.merge(a + b) == [a, b]
        return good

    def walk(self, chunk: str) -> list[str]:
        """Pieces of a chunk; a character that is no piece stands alone."""
        n, shorter, pairs = len(chunk), self.shorter, self.pairs
        longest = list(chunk)
        for last, piece in self.trie.iter(chunk):
            longest[last + 1 - len(piece)] = piece  # longer ones end later
        failed = bytearray(n // 8 + 1)
        taken: list[str] = []
        at, piece, before = 0, longest[0], None
        while at < n:
            while piece is not None:
                to = at + len(piece)
                if not failed[to >> 3] >> (to & 7) & 1:
                    if before is None:
                        break
                    good = pairs.get((before, piece))
                    if self.compatible(before, piece) if good is None else good:
                        break
                piece = shorter.get(piece) or (chunk[at] if len(piece) > 1 else None)
            if piece is not None:
                taken.append(piece)
                at, before = to, piece
                piece = longest[at] if at < n else None
            elif before is not None:
                failed[at >> 3] |= 1 << (at & 7)
                piece = taken.pop()  # its end is marked now, so a shorter one is next
                at -= len(piece)
                before = taken[-1] if taken else None
            else:
                raise ValueError("no compatible sequence of pieces")
        return taken

    def _ids(self, pieces: list[str]) -> bytes:
        """Packed ids; a character that is no piece becomes its bytes' pieces."""
        packed = self.packed
        return b"".join([packed.get(p) or b"".join([self.packed_bytes[b] for b in p.encode()]) for p in pieces])

    def encode(self, text: str) -> bytes:
        """Ids of a text and the end id, as little-endian 32-bit numbers."""
        if not text:
            return self.packed_end
        chunks = self.cut.findall(BLANK + text.replace(" ", BLANK))
        found = list(map(self.chunks.get, chunks))
        if None in found:
            kept, older = self.chunks, self.older
            for k, ids in enumerate(found):
                if ids is None:
                    chunk = chunks[k]
                    ids = kept.get(chunk) or older.get(chunk) or self._ids(self.walk(chunk))
                    if len(chunk) <= SHORT:
                        kept[chunk] = ids
                    found[k] = ids
            if len(kept) >= KEPT_CHUNKS:
                self.chunks, self.older = {}, kept
        found.append(self.packed_end)
        return b"".join(found)

    def decode(self, ids: list[int]) -> str:
        """Text of a list of ids: control ids are left out, one leading blank goes."""
        data = b"".join(map(self.surface.__getitem__, ids))
        if self.strange.isdisjoint(ids):
            try:
                text = data.decode()
            except UnicodeDecodeError:
                return self.model.decode(ids)
            head = next((i for i in ids if self.surface[i]), None)
            return text[1:] if head in self.first else text
        return self.model.decode(ids)


_PIECES: dict[str, Pieces] = {}


def worker_pieces(model: str = MODEL) -> Pieces:
    """One per worker process: tasks that follow use its chunks again."""
    if model not in _PIECES:
        import public_tokenizers

        _PIECES[model] = Pieces(public_tokenizers.path(model))
    return _PIECES[model]


def encode_texts(docs: DataFrame, text="text", model=MODEL) -> DataFrame:
    """``docs`` with ids (array of int, the end id last) and decoded (string).

    Null or empty text: the end id alone, decoded as an empty string.  Texts
    of any length are encoded whole.  Repeated rows are encoded each on their
    own; all other columns are kept, and columns named ids or decoded are
    replaced.  An empty table gives an empty result."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("ids", "decoded")])
    whole, = fresh(docs, "piece_text")
    frame = docs.withColumn(whole, F.col(text).cast("string"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    schema = ", ".join(f"{n} {docs.schema[i].dataType.simpleString()}" for i, n in enumerate(names))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = worker_pieces(model)
        for batch in batches:
            columns, texts = batch.columns[:-1], batch.columns[-1]
            a, held, sizes, size = 0, [], [], 0

            def made(b):
                flat = np.frombuffer(b"".join(held), "<i4")
                bounds = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                numbers = flat.tolist()
                decoded = [pieces.decode(numbers[p:q]) for p, q in zip(bounds[:-1], bounds[1:])]
                ids = pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))
                return pa.RecordBatch.from_arrays(
                    [*(c.slice(a, b - a) for c in columns), ids, pa.array(decoded, pa.string())], names=[*names, "ids", "decoded"])

            for i in range(len(texts)):
                ids = pieces.encode(texts[i].as_py() or "")
                held.append(ids)
                sizes.append(len(ids) // 4)
                size += len(ids) // 4
                if size >= BATCH_IDS:
                    yield made(i + 1)
                    a, held, sizes, size = i + 1, [], [], 0
            if sizes:
                yield made(len(texts))

    found = frame.select(*[F.col(f"`{c}`") for c in docs.columns], whole).mapInArrow(
        task, f"{schema}, ids array<int>, decoded string")
    return found.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)], "ids", "decoded")


def op11_sentence_pieces(spark, sf_dir):
    """Encode and decode every document; digests of the ids and the text read back."""
    docs = table(spark, sf_dir, "documents")
    frame = docs.select("doc_id", F.col("text"))
    coded = encode_texts(frame)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
