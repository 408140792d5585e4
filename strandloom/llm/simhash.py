"""SimHash near-duplicates with BK-trees.

Distinct fingerprints (or distinct texts) are routed to shards, such that two that
may link share at least one shard.  Every shard holds a BK-tree, whose children are
keyed by their integer Hamming distance to the parent; a search follows only the
edges whose key is within the radius of the query's distance to the node.  Trees are
built and searched for many shards at once in numpy arrays, level by level.  A crowded
shard is cut into chunks, and each pair of chunks meets in a task of its own, so that no
task holds more than two chunks.  Shards return spanning links, never all pairs; star
contractions join them to components.

Two routings:

* :func:`fingerprint_groups` links fingerprints at ``radius`` or fewer differing bits.
  The 64 bits are cut into ``radius + 2`` blocks.  Two such fingerprints agree in at
  least two whole blocks, so each pair of blocks names a shard: no link is lost.
* :func:`near_duplicates` links texts whose word-shingle sets have a Jaccard similarity
  of at least ``similarity``.  Bands of minimum hashes name the shards, the BK-tree
  search with a wide radius proposes pairs and exact set comparison decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import heavy_lookup, lean, materialize, small_batches, with_lookup, without_ids
from .components import components

SEED = 42
#: Members of a shard's chunk.
CHUNK = 8192
#: Query-node pairs that a search looks at together.
FRONTIER = 1 << 18
#: Bands and minimum hashes a band of :func:`near_duplicates`: finds a pair of similarity 0.8 with 99.7 %.
BANDS, BAND_ROWS = 8, 3
#: Radius for proposals, between fingerprints of distinct shingles: at similarity 0.8 the expected distance is
#: 9.7 bits, its deviation 2.9; of 10,000 pairs with 5 to 1,000 common shingles none lay beyond 20 bits.
WIDE_RADIUS = 22


def words_of(text: str | None) -> list[bytes]:
    """Words of the text in UTF-8: A-Z lower-cased, separated by the six ASCII white-space characters."""
    return text.encode().lower().split() if text else []


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 (seed 42) of each k-word shingle, repeats included; of the whole sequence if it is shorter."""
    from xxhash import xxh64_intdigest

    if not words:
        return np.empty(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(k)))) if len(words) > k else [b" ".join(words)]
    return np.fromiter(map(partial(xxh64_intdigest, seed=SEED), shingles), np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """64-bit fingerprint: a bit is set if it is set in over half the hashes; 0 without hashes."""
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        part = np.ascontiguousarray(hashes[i:i + (1 << 16)]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def minhash_bands(hashes: np.ndarray, bands: int = BANDS, rows: int = BAND_ROWS) -> np.ndarray:
    """One 64-bit hash per band of the set's minimum hashes under ``bands * rows`` random functions."""
    rng = np.random.default_rng(SEED)
    n = bands * rows
    mul, add = rng.integers(1, 1 << 63, n, np.uint64) * 2 + 1, rng.integers(0, 1 << 63, n, np.uint64)
    mins = np.full(n, np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), 4096):
        x = hashes[i:i + 4096, None] * mul + add
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        mins = np.minimum(mins, x.min(axis=0))
    out = np.arange(bands, dtype=np.uint64)
    for row in mins.reshape(bands, rows).T:
        out = (out ^ row) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


class BKForest:
    """BK-trees of several shards in flat arrays.  Fingerprints are distinct within a shard or equal ones chain at edge 0."""

    def __init__(self, shard: np.ndarray, fp: np.ndarray):
        n = len(fp)
        self.fp, self.edge = fp, np.zeros(n, np.int64)
        self.root = np.zeros(n, np.int64)      # of each point: the root of its shard
        parent = np.full(n, -1, np.int64)
        at = np.arange(n)                      # points not yet placed
        group = shard.astype(np.int64)
        up = np.full(n, -1, np.int64)          # node below which a point goes
        dist = np.zeros(n, np.int64)
        first_level = True
        while len(at):
            order = np.argsort(group, kind="stable")
            at, group, up, dist = at[order], group[order], up[order], dist[order]
            head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            node = at[head]
            parent[node], self.edge[node] = up[head], dist[head]
            owner = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(at)]))
            if first_level:
                self.root[at] = node[owner]
                first_level = False
            rest = np.ones(len(at), bool)
            rest[head] = False
            at, up = at[rest], node[owner[rest]]
            dist = np.bitwise_count(self.fp[at] ^ self.fp[up]).astype(np.int64)
            group = up * 65 + dist
        kids = np.flatnonzero(parent >= 0)
        kids = kids[np.argsort(parent[kids], kind="stable")]
        self.kids = kids
        self.first = np.searchsorted(parent[kids], np.arange(n))
        self.count = np.bincount(parent[kids], minlength=n)

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query point, point of its shard) at ``radius`` or fewer bits, the query itself left out."""
        q, node = queries, self.root[queries]
        while len(q):
            d = np.bitwise_count(self.fp[q] ^ self.fp[node]).astype(np.int64)
            hit = (d <= radius) & (q != node)
            if hit.any():
                yield q[hit], node[hit]
            n = self.count[node]
            nq = np.repeat(q, n)
            base = np.repeat(self.first[node], n)
            kid = self.kids[base + np.arange(len(base)) - np.repeat(np.cumsum(n) - n, n)] if len(base) else base
            near = np.abs(self.edge[kid] - np.repeat(d, n)) <= radius
            q, node = nq[near], kid[near]


def _find(up: list[int], x: int) -> int:
    while up[x] != x:
        up[x] = up[up[x]]
        x = up[x]
    return x


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted arrays of distinct values."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def shard_links(shard: np.ndarray, node: np.ndarray, fp: np.ndarray, radius: int,
                sets: list[np.ndarray] | None = None, similarity: float = 0.0) -> list[tuple[int, int]]:
    """Spanning links (indices) of the linked points of each shard."""
    forest = BKForest(shard, fp)
    n = len(fp)
    _, index, size = np.unique(shard, return_inverse=True, return_counts=True)
    load = np.cumsum(size[index])
    up = list(range(n))
    links: list[tuple[int, int]] = []
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(load, (load[lo - 1] if lo else 0) + FRONTIER)))
        for q, m in forest.search(np.arange(lo, hi), radius):
            once = q < m  # every point is a query, so that each pair is met from its first point
            q, m = q[once], m[once]
            if len(q) > 1000:  # drop pairs that are joined already
                label = np.fromiter((_find(up, i) for i in range(n)), np.int64, n)
                apart = label[q] != label[m]
                q, m = q[apart], m[apart]
            for a, b in zip(q.tolist(), m.tolist()):
                ra, rb = _find(up, a), _find(up, b)
                if ra != rb and (sets is None or jaccard(sets[a], sets[b]) >= similarity):
                    up[max(ra, rb)] = min(ra, rb)
                    links.append((a, b))
        lo = hi
    return links


def _route_chunks(members: DataFrame, total: int, extra: list[str]) -> DataFrame:
    """Members of crowded shards with the name ``place`` of the task(s) where they meet the others."""
    crowd = materialize(members.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "crowded")
    own = heavy_lookup(members, crowd, "shard", "n", total)
    parts = F.ceil(F.col("n") / CHUNK).cast("int")
    chunk = F.pmod(F.xxhash64("node", "fp"), parts).cast("int")
    others = F.filter(F.sequence(F.lit(0), parts - 1), lambda j: j != F.col("chunk"))
    place = F.explode(F.when(F.col("parts") == 1, F.array(F.xxhash64(F.col("shard"), F.lit(-1)))).otherwise(
        F.transform(others, lambda j: F.xxhash64(F.col("shard"), F.least(j, F.col("chunk")), F.greatest(j, F.col("chunk"))))))
    return (own.withColumn("parts", parts).withColumn("chunk", chunk)
            .select(place.alias("place"), "node", "fp", *extra))


def _linker(radius: int, similarity: float, with_sets: bool):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def solve(table: pa.Table) -> pa.RecordBatch:
            place, node, fp = (table.column(c).to_numpy() for c in ("place", "node", "fp"))
            sets = [np.frombuffer(x.as_py(), np.uint32) for x in table.column("members")] if with_sets else None
            links = shard_links(place, node, fp.view(np.uint64), radius, sets, similarity)
            a, b = np.array(links, np.int64).reshape(-1, 2).T
            return pa.RecordBatch.from_pydict({"a": pa.array(node[a]), "b": pa.array(node[b])})

        held: list[pa.Table] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows >= 2 * CHUNK:
                table = pa.concat_tables(held).combine_chunks()
                place = table.column("place").to_numpy()
                cut = int(np.searchsorted(place, place[-1]))  # the last shard may go on
                if cut:
                    yield solve(table.slice(0, cut))
                held, rows = [table.slice(cut)], len(place) - cut
        if held:
            yield solve(pa.concat_tables(held).combine_chunks())
    return run


def _links(places: DataFrame, radius: int, similarity: float = 0.0, with_sets: bool = False) -> DataFrame:
    small_batches(places.sparkSession, 2048)
    return (places.repartition("place").sortWithinPartitions("place")
            .mapInArrow(lean("simhash", _linker(radius, similarity, with_sets)), "a long, b long").distinct())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 3) -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long) of each row's whole text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            fps = [simhash(shingle_hashes(words_of(t.as_py()), shingle)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")
                       ).mapInArrow(lean("simhash", run), "doc_id long, fp long")


def _block_masks(radius: int) -> list[int]:
    n = radius + 2
    cuts = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << b) - (1 << a)) for a, b in zip(cuts, cuts[1:])]
    masks = [x | y for x, y in combinations(blocks, 2)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def fingerprint_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 3,
                       radius: int = 2) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint`` (16 hex digits), ``component_id``.

    ``component_id`` is the smallest id reachable over links of ``radius`` or fewer bits.  Null and
    wordless texts have fingerprint zero and link like any other.  Repeated rows give repeated
    results.  Null ids never name a component unless all its ids are null.  An empty table gives an
    empty result; other columns are ignored.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, shingle=shingle), "fingerprints")
    total = rows.count()
    units = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n")), "units")
    masks = [F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(_block_masks(radius))]
    members = units.where("node is not null").select("node", "fp", F.explode(F.array(*masks)).alias("s")).select(
        F.xxhash64("s.t", "s.key").alias("shard"), "node", "fp")
    found = components(_links(_route_chunks(members, total * len(masks), []), radius))
    named = units.join(found, "node", "left").select("fp", "n", F.coalesce("component", "node").alias("component_id"))
    out = heavy_lookup(rows, materialize(named, "named"), "fp", "n", total)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5,
                    similarity: float = 0.8, radius: int = WIDE_RADIUS) -> DataFrame:
    """One row per input row: ``doc_id, component_id`` under links of at least ``similarity``.

    Texts with the same words are one unit (similarity 1, also those without words).  A unit has a number of its own, so
    that rows which repeat an id with different texts stay apart.  Nulls, repeated rows, null ids (whose units are not
    compared unless an id shares their words) and empty tables as in :func:`fingerprint_groups`.
    """
    spark = docs.sparkSession
    small_batches(spark)
    pairs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def describe(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            uid, fps, bands = [], [], []
            for t in b.column(1):
                words = words_of(t.as_py())
                h = np.unique(shingle_hashes(words, shingle))  # as the similarity, the fingerprint is of the set
                uid.append(_unit_id(words))
                fps.append(simhash(h))
                bands.append(minhash_bands(h).view(np.int64) if len(h) else [None] * BANDS)
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(uid, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64)),
                *[pa.array([x[i] for x in bands], pa.int64()) for i in range(BANDS)]], names=["doc_id", "uid", "fp", *(f"b{i}" for i in range(BANDS))])

    own = [f"b{i}" for i in range(BANDS)]
    rows = materialize(pairs.mapInArrow(lean("simhash", describe), "doc_id long, uid binary, fp long, " + ", ".join(f"{c} long" for c in own)), "described")
    total = rows.count()
    # rows of a unit are alike, so that its values come with the aggregate, combined before the shuffle
    units = rows.groupBy("uid").agg(F.min("doc_id").alias("name"), F.count(F.lit(1)).alias("n"), F.first("fp").alias("fp"), *[F.first(c).alias(c) for c in own])
    units = materialize(units.withColumn("node", F.monotonically_increasing_id()), "units")  # numbered once, as written
    live = units.where("name is not null and b0 is not null")
    members = live.select("node", "fp", F.explode(F.array(*[F.xxhash64(F.lit(i), F.col(c)) for i, c in enumerate(own)])).alias("shard"))
    members = materialize(members.select("shard", "node", "fp"), "members")
    crowd = members.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    wanted = members.join(crowd, "shard", "left_semi").select("node").distinct()
    wanted = materialize(live.join(wanted, "node", "left_semi").select(F.col("name").alias("doc_id"), "uid", "node"), "wanted")
    n_wanted = wanted.count()

    def sets_of(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            node, out = [], []
            for t, uid, n in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
                words = words_of(t.as_py())
                if _unit_id(words) == uid:  # another text may have the same id
                    node.append(n)
                    out.append(np.unique(shingle_hashes(words, shingle).astype(np.uint32)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(out, pa.binary())], names=["node", "members"])

    marked = with_lookup(pairs, wanted, "doc_id", n_wanted, 60).where("node is not null").select("text", "uid", "node")
    sets = materialize(marked.mapInArrow(lean("simhash", sets_of), "node long, members binary").dropDuplicates(["node"]), "sets")
    small_batches(spark)
    places = _route_chunks(members, total * BANDS, []).join(sets, "node")
    found = components(_links(places, radius, similarity, True))
    placed = units.join(found, "node", "left").select("uid", "n", "name", F.coalesce("component", "node").alias("component"))
    placed = materialize(placed, "placed")
    names = placed.groupBy("component").agg(F.min("name").alias("component_id"), F.count(F.lit(1)).alias("size"))
    named = heavy_lookup(placed, materialize(names, "names"), "component", "size", total).select("uid", "n", "component_id")
    return heavy_lookup(rows.select("doc_id", "uid"), materialize(named, "named"), "uid", "n", total).select("doc_id", "component_id")


def _unit_id(words: list[bytes]) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(b" ".join(words))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with all columns, that stay: of each group the one with the smallest id.

    An id goes if all its rows go; rows with a null id stay.
    """
    found = near_duplicates(docs, id_col, text_col, **options)
    lost = found.groupBy("doc_id").agg(F.bool_and(F.col("doc_id") != F.col("component_id")).alias("lost")).where("lost")
    return without_ids(docs, lost, id_col)
