"""Benchmark decontamination by greedy string tiling.

Test items and documents are sequences of normalised words.  Seeds, runs of
``min_tile`` words that an item and a document share, are found by joining the
documents' rolling hashes with the items'.  For every pair with a seed, running
Karp-Rabin greedy string tiling marks the longest common runs that do not overlap,
again and again, down to ``min_tile`` words.  The marked part of the item is its
coverage; since tiles may lie in any order, reordered passages are caught.

The item index is broadcast in blocks of a bounded size (``BLOCK_WORDS`` words, about
100 bytes each); a larger benchmark takes several passes over the documents, which stay
where they are: there is no shuffle of texts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches, without_ids

#: Words in a tile at least, and the share of an item's words in tiles that makes a document contaminated.
MIN_TILE, COVERAGE = 5, 0.5
#: Words of test items whose index is broadcast at once.
BLOCK_WORDS = 500_000
#: Words of documents that a task remembers.
_MEMO_WORDS = 200_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_EDGE = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~«»“”„‘’‚…–—¡¿"


def normal_words(text: str | None) -> list[str]:
    """Lower-cased words without punctuation at their ends; bare punctuation is no word."""
    return [w for w in (x.strip(_EDGE) for x in (text or "").lower().split()) if w]


def window_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes (mod 2**64) of all windows of ``k`` word ids."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    x = ids.astype(np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * _BASE + (x[i:i + n] + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    return out


def greedy_tiles(item: np.ndarray, doc: np.ndarray, min_tile: int) -> list[tuple[int, int, int]]:
    """Tiles (place in item, place in doc, length) of running Karp-Rabin greedy string tiling.

    A negative id in ``doc`` is a gap that matches nothing.  Among equally long matches the one with the
    first place in the item, then in the document, is marked first.
    """
    used_i, used_d = np.zeros(len(item), bool), doc < 0
    tiles: list[tuple[int, int, int]] = []
    size = max(min_tile, min(len(item), 32))
    while True:
        by_hash: dict[int, list[int]] = defaultdict(list)
        h_i, h_d = window_hashes(item, size), window_hashes(doc, size)
        free_i = _free(used_i, size)
        for p in np.flatnonzero(free_i):
            by_hash[int(h_i[p])].append(int(p))
        matches: list[tuple[int, int, int]] = []
        longest = 0
        if by_hash and len(h_d):
            keys = np.fromiter(by_hash, np.uint64, len(by_hash))
            for q in np.flatnonzero(_free(used_d, size) & np.isin(h_d, keys)):
                for p in by_hash[int(h_d[q])]:
                    n = 0
                    while (p + n < len(item) and q + n < len(doc) and item[p + n] == doc[q + n]
                           and not used_i[p + n] and not used_d[q + n]):
                        n += 1
                    if n >= size:
                        matches.append((p, int(q), n))
                        longest = max(longest, n)
        if longest > 2 * size:
            size = longest
            continue
        for p, q, n in sorted(matches, key=lambda m: (-m[2], m[0], m[1])):
            if not used_i[p:p + n].any() and not used_d[q:q + n].any():
                used_i[p:p + n] = used_d[q:q + n] = True
                tiles.append((p, q, n))
        if matches:
            continue  # what is left of matches that others have cut is met again at this size
        if size > 2 * min_tile:
            size //= 2
        elif size > min_tile:
            size = min_tile
        else:
            return tiles


def _free(used: np.ndarray, size: int) -> np.ndarray:
    """Windows without a marked word."""
    n = len(used) - size + 1
    if n <= 0:
        return np.zeros(0, bool)
    c = np.r_[0, np.cumsum(used)]
    return c[size:] == c[:n]


class ItemIndex:
    """Word ids, seeds and sequences of one block of test items; this is what is broadcast."""

    def __init__(self, items: list[tuple[int, str | None]], min_tile: int):
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        for item_id, text in items:
            words = normal_words(text)
            if words and item_id is not None:
                ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
                self.items.append((item_id, np.array(ids, np.int64)))
        # items shorter than a tile must be found whole
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by_size: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, (_, ids) in enumerate(self.items):
            k = min(min_tile, len(ids))
            by_size[k] += [(int(h), i) for h in np.unique(window_hashes(ids, k))]
        for k, pairs in by_size.items():
            pairs.sort()
            self.seeds[k] = np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs], np.int64)

    def matches(self, words_of_doc: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(item id, tiled words, words of the item, tiles) of every item that shares a seed."""
        for k, (keys, owner) in self.seeds.items():
            h = window_hashes(words_of_doc, k)
            ok = np.flatnonzero(_free(words_of_doc < 0, k)) if len(h) else np.empty(0, np.int64)
            at = np.searchsorted(keys, h[ok])
            ok = ok[(at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == h[ok])]
            places: dict[int, list[int]] = defaultdict(list)
            for q in ok:
                lo, hi = np.searchsorted(keys, h[q], "left"), np.searchsorted(keys, h[q], "right")
                for o in owner[lo:hi]:
                    places[int(o)].append(int(q))
            for o, qs in places.items():
                item_id, ids = self.items[o]
                # only words in a shared seed can be in a tile: the rest becomes gaps
                parts, end = [], -1
                for q in qs:
                    if q >= end:
                        parts += [np.array([-1]), words_of_doc[q:q + k]]
                    else:
                        parts.append(words_of_doc[end:q + k])
                    end = q + k
                tiles = greedy_tiles(ids, np.concatenate(parts), k)
                if tiles:
                    yield item_id, sum(t[2] for t in tiles), len(ids), len(tiles)


class _Memo(dict):
    """Raw word -> id in the item vocabulary, -1 for words no item has, -2 for bare punctuation."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, raw: str) -> int:
        w = raw.strip(_EDGE)
        out = self.vocabulary.get(w, -1) if w else -2
        if len(self) < _MEMO_WORDS:
            self[raw] = out
        return out


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str | None]]]:
    """Test items in blocks of ``BLOCK_WORDS`` words; one block at a time is on the driver."""
    block, words = [], 0
    for row in benchmark.toLocalIterator():
        n = len((row["text"] or "").split())
        if block and words + n > BLOCK_WORDS:
            yield block
            block, words = [], 0
        block.append((row["item_id"], row["text"]))
        words += n
    if block:
        yield block


def contaminations(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                   min_tile: int = MIN_TILE, coverage: float = COVERAGE) -> DataFrame:
    """One row per document and test item whose coverage reaches the threshold:
    ``doc_id, item_id, tiled_words, item_words, n_tiles, coverage``.

    Null and empty texts and items match nothing, nor do items with a null id.  An item shorter than a
    tile must occur whole.  Repeated document rows give repeated result rows; repeated item rows are
    one item each.  An empty table on either side gives an empty result.  Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col("`item_id`").cast("long").alias("item_id"), F.col("`text`").cast("string").alias("text"))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = "doc_id long, item_id long, tiled_words long, item_words long, n_tiles long"
    found: DataFrame | None = None
    for block in _blocks(items):
        shared = spark.sparkContext.broadcast(ItemIndex(block, min_tile))

        def run(batches: Iterator, shared=shared) -> Iterator:
            import pyarrow as pa

            index = shared.value
            memo = _Memo(index.vocabulary)
            for b in batches:
                out: list[tuple] = []
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                    raw = (text.as_py() or "").lower().split()
                    ids = np.fromiter(map(memo.__getitem__, raw), np.int64, len(raw))
                    out += [(doc_id, *m) for m in index.matches(ids[ids != -2]) if m[1] >= coverage * m[2]]
                cols = list(zip(*out)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                                 names=["doc_id", "item_id", "tiled_words", "item_words", "n_tiles"])

        part = rows.mapInArrow(lean("decontaminate", run), schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = rows.where("false").selectExpr("doc_id", "0L item_id", "0L tiled_words", "0L item_words", "0L n_tiles")
    return found.withColumn("coverage", F.col("tiled_words") / F.col("item_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without contaminated documents, with all columns."""
    lost = contaminations(docs, benchmark, id_col, text_col, **options)
    return without_ids(docs, lost, id_col)
