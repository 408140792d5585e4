"""Token ids in files of directly addressable codes.

An id is cut into chunks of eight bits.  Level 0 holds the lowest chunk of every id;
a continuation bitmap says which ids have another chunk, and these follow, in order,
on level 1, and so on.  A rank directory (set bits before every 512th) turns a place
on one level into its place on the next, so any token is read with one access a level,
without decoding a block.

Documents are range-partitioned by id and written in ascending order.  Each task
writes files of its own into the shared folder and returns one manifest row per
file; only files of the manifest are read, so that a lost executor or a repeated
attempt leaves unread files at worst.  Start offsets are running sums over the
manifest, never over documents.
"""

from __future__ import annotations

import io
import itertools
import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .common import keep, lean, materialize, new_folder, open_fs, small_batches

MAGIC = b"DACTOK1\n"
BLOCK = 512
#: Id that ends every document.
END_ID = 2
#: Ids in one file, about: a task holds no more than one file's ids.
FILE_TOKENS = 4_000_000
TOKENIZER = "word_bpe_49k.json"
#: Tasks that read files at most.
READ_TASKS = 10_000
#: Words whose ids a worker remembers.
MEMO_WORDS = 900_000


class DacArray:
    """An array of unsigned integers in directly addressable codes."""

    def __init__(self, n: int, chunks: list[np.ndarray], bitmaps: list[np.ndarray], ranks: list[np.ndarray]):
        self.n, self.chunks, self.bitmaps, self.ranks = n, chunks, bitmaps, ranks

    @classmethod
    def encode(cls, values: np.ndarray) -> DacArray:
        rest = values if values.dtype == np.uint32 else values.astype(np.uint64)
        chunks, bitmaps, ranks = [], [], []
        while True:
            chunks.append((rest & rest.dtype.type(255)).astype(np.uint8))
            rest = rest >> rest.dtype.type(8)
            more = rest != 0
            bits = np.packbits(more, bitorder="little")
            bits = np.r_[bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)]
            per_block = np.bitwise_count(bits.reshape(-1, BLOCK // 8)).sum(axis=1, dtype=np.uint64)
            bitmaps.append(bits)
            ranks.append(np.r_[np.uint64(0), np.cumsum(per_block, dtype=np.uint64)])
            rest = rest[more]
            if not len(rest):
                return cls(len(values), chunks, bitmaps, ranks)

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        """One value, by one access a level."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, (chunks, bits, ranks) in enumerate(zip(self.chunks, self.bitmaps, self.ranks)):
            value |= int(chunks[i]) << 8 * level
            byte, bit = divmod(i, 8)
            if not bits[byte] >> bit & 1:
                break
            first = i // BLOCK * (BLOCK // 8)
            before = int(np.bitwise_count(bits[first:byte]).sum()) + int(bits[byte] & ((1 << bit) - 1)).bit_count()
            i = int(ranks[i // BLOCK]) + before
        return value

    def decode(self) -> np.ndarray:
        """All values as little-endian unsigned 32-bit integers."""
        value = np.zeros(0, "<u4")
        for chunks, bits in zip(self.chunks[::-1], self.bitmaps[::-1]):
            own = chunks.astype("<u4")
            more = np.unpackbits(bits, count=len(chunks), bitorder="little").view(bool)
            own[more] |= value << np.uint32(8)
            value = own
        return value

    def write(self, out) -> None:
        out.write(struct.pack("<QI", self.n, len(self.chunks)))
        for chunks, bits, ranks in zip(self.chunks, self.bitmaps, self.ranks):
            out.write(struct.pack("<QQQ", len(chunks), len(bits), len(ranks)))
            for x in (chunks, bits, ranks.astype("<u8")):
                out.write(x.tobytes())

    @classmethod
    def read(cls, data: memoryview, at: int) -> DacArray:
        n, levels = struct.unpack_from("<QI", data, at)
        at += 12
        parts: tuple[list, list, list] = ([], [], [])
        for _ in range(levels):
            sizes = struct.unpack_from("<QQQ", data, at)
            at += 24
            for part, kind, size in zip(parts, (np.uint8, np.uint8, np.dtype("<u8")), sizes):
                part.append(np.frombuffer(data, kind, size, at))
                at += size * np.dtype(kind).itemsize
        return cls(n, *parts)


class TokenFile:
    """One file: document ids, first token of each document, and the token codes."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        if view[:8] != MAGIC:
            raise ValueError("not a token file")
        n, = struct.unpack_from("<Q", view, 8)
        self.known = np.unpackbits(np.frombuffer(view, np.uint8, -(-n // 8), 16), count=n, bitorder="little").view(bool)
        at = 16 + -(-n // 8)
        self.doc_ids = np.frombuffer(view, "<i8", n, at)
        self.starts = np.frombuffer(view, "<u8", n + 1, at + 8 * n).astype(np.int64)
        self.codes = DacArray.read(view, at + 16 * n + 8)

    @staticmethod
    def dump(doc_ids: list[int | None], lengths: list[int], tokens: np.ndarray) -> bytes:
        out = io.BytesIO()
        out.write(MAGIC + struct.pack("<Q", len(doc_ids)))
        out.write(np.packbits([d is not None for d in doc_ids], bitorder="little").tobytes())
        out.write(np.array([d or 0 for d in doc_ids], "<i8").tobytes())
        out.write(np.r_[0, np.cumsum(lengths)].astype("<u8").tobytes())
        DacArray.encode(tokens).write(out)
        return out.getvalue()

    def token(self, doc: int, i: int) -> int:
        """Token ``i`` of the file's document number ``doc``."""
        if not 0 <= i < self.starts[doc + 1] - self.starts[doc]:
            raise IndexError(i)
        return self.codes[int(self.starts[doc]) + i]


class WordEncoder:
    """Encodes texts with a tokenizer whose pieces never cross white space, word by word with a memo.

    The ids equal those of the library on the whole text.  Texts are first brought to a form with fewer different
    words and the same ids: in lower case, a full stop or comma behind a word set apart.  Texts with added-token
    marks or control separators, which the word split could treat differently, go to the library whole.
    """

    #: A full stop or comma between a letter or number and white space is a piece of its own.
    _APART = re.compile(r"[.,](?=\s|\Z)(?<=[^\W_].)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.closing = np.zeros(max(vocabulary.values()) + 1, bool)  # ids of pieces that end a word
        for piece, i in vocabulary.items():
            self.closing[i] = piece.endswith("</w>")

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: set[str]) -> None:
        """Remember the ids of each word.  Words of letters alone are one piece sequence each, so that many are
        encoded as one text and cut behind the pieces that end a word."""
        plain = [w for w in words if w.isalpha() and w.lower().isalpha()]
        odd = list(words.difference(plain))
        groups = [plain[i:i + 128] for i in range(0, len(plain), 128)]
        for group, raw in zip(groups, self._ids([" ".join(g) for g in groups])):
            cuts = ((np.flatnonzero(self.closing[np.frombuffer(raw, "<u4")]) + 1) * 4).tolist()
            if len(cuts) != len(group) or cuts[-1] != len(raw):
                odd += group
                continue
            self.memo.update(zip(group, map(raw.__getitem__, map(slice, [0, *cuts], cuts))))
        self.memo.update(zip(odd, self._ids(odd)))

    def _plain(self, text: str) -> str:
        low = text.lower()
        if not low.isascii() and (len(low) != len(text) or "Σ" in text or not (
                unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low))):
            return text
        return self._APART.sub(r" \g<0>", low)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        words = [None if any(a in t for a in self.added) or any(c in t for c in "\x1c\x1d\x1e\x1f") else self._plain(t).split() for t in texts]
        unknown = set(itertools.chain.from_iterable(w for w in words if w)).difference(self.memo)
        if len(self.memo) + len(unknown) > MEMO_WORDS:
            self.memo.clear()
            unknown = set(itertools.chain.from_iterable(w for w in words if w))
        self._learn(unknown)
        get = self.memo.__getitem__
        return [self._ids([t])[0] if w is None else b"".join(map(get, w)) for t, w in zip(texts, words)]


def _encoder(path: str | None) -> WordEncoder:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return keep("token_codes", path, lambda: WordEncoder(path))


def write_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, folder: str | None = None,
                 tokenizer_path: str | None = None, end_id: int = END_ID, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write the token files of all rows and return the manifest: ``part, seq, path, n_docs, n_tokens, base``.

    Files are in ascending ``doc_id`` order (nulls first, rows with the same id next to each other in any
    order); ``base`` is the number of ids in all files before.  A null text counts as empty, i.e. it is the
    end id alone.  An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    small_batches(spark)
    target = folder or new_folder(spark, "tokens")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        encoder, part = _encoder(tokenizer_path), TaskContext.get().partitionId()
        fs, root = open_fs(target)
        fs.create_dir(root, recursive=True)
        end = np.array([end_id], "<u4").tobytes()
        ids: list[int | None] = []
        lengths: list[int] = []
        pieces: list[bytes] = []
        held = seq = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, seq
            path = f"{root}/{part:06d}-{seq:06d}-{uuid.uuid4().hex}.dac"
            tokens = np.frombuffer(b"".join(pieces), "<u4")
            pieces.clear()
            with fs.open_output_stream(path) as out:
                out.write(TokenFile.dump(ids, lengths, tokens))
            row = {"part": [part], "seq": [seq], "path": [path], "n_docs": [len(ids)], "n_tokens": [held]}
            ids.clear()
            lengths.clear()
            held, seq = 0, seq + 1
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([
                ("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

        for b in batches:
            for doc_id, codes in zip(b.column(0).to_pylist(), encoder.encode(b.column(1).to_pylist())):
                ids.append(doc_id)
                lengths.append(len(codes) // 4 + 1)
                pieces += (codes, end)
                held += lengths[-1]
                if held >= file_tokens:
                    yield flush()
        if ids:
            yield flush()

    files = materialize(rows.mapInArrow(lean("token_codes", run), "part int, seq int, path string, n_docs long, n_tokens long"), "manifest")
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    ahead = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("part_base"))
    inside = W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    return files.join(parts, "part").withColumn(
        "base", F.col("part_base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).drop("part_base")


def read_tokens(manifest: DataFrame, *, folder: str) -> DataFrame:
    """One row per document, read from the files: ``doc_id, start, n_tokens, ids_crc32``."""
    small_batches(manifest.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        fs, _ = open_fs(folder)
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with fs.open_input_stream(path) as src:
                    f = TokenFile(src.read())
                raw = memoryview(f.codes.decode()).cast("B")
                at = f.starts
                crc = [zlib.crc32(raw[4 * lo:4 * hi]) for lo, hi in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(f.doc_ids, mask=~f.known), pa.array(at[:-1] + base), pa.array(np.diff(at)), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = manifest.select("path", "base")
    files = files.repartition(max(1, min(files.count(), READ_TASKS)), "path")
    return files.mapInArrow(lean("token_codes", run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Write the token files of ``docs``, read them back, and return their documents.

    ``doc_id, start`` (ids of all documents before it), ``n_tokens`` (with the end id) and ``ids_crc32`` of
    the little-endian unsigned 32-bit ids.  Nulls, ties and empty tables as in :func:`write_tokens`; other
    columns are ignored; whole texts are encoded.
    """
    folder = options.pop("folder", None) or new_folder(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, id_col, text_col, folder=folder, **options), folder=folder)
