"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

A document's set is its distinct word shingles. Its sketch has ``BANDS * ROWS``
coordinates, filled in rounds: in each of the first t rounds every shingle is
hashed to a coordinate and a value, in round t + i to coordinate i, so after 2t
rounds at the latest all are filled, after one or two for long texts. A
coordinate keeps the least value of the first round that reached it. Two
sketches agree in a coordinate with the sets' similarity, and the number of
agreements is concentrated like that of independent ones; so neither banding
nor the bound on agreements below depends on how long texts are.

Texts of equal words are one node. Nodes of which a band agrees share a list;
lists of one node go no further. Lists with the same least node make up that
node's group. The search has two passes over the groups:

1. each member is paired with the least node, so a large group of copies gives
   a star, not all its pairs;
2. where members of a group are still in different components, every member is
   compared with every other of another component. Components cannot grow by
   pairs within one, so no link is lost.

Pairs are retained if their sizes allow the similarity (exact) and their
sketches agree in ``AGREE`` coordinates, and all retained pairs are confirmed
on their full sets of shingles, as words, not hashes. In the second pass a task
does both for a tile: a block of the members outside the group's largest
component, and any other block. So no task holds a group, members of one
component never meet, and only links leave a task, one for a member and a
component.

At 85 of 100 a pair shares no band with odds of 7e-11, and agrees in fewer than
``AGREE`` coordinates with odds of 7e-11.

Rows: null and empty texts, and those of white space only, have an empty set
and are linked with nothing, so each is its own component; a text of fewer than
``WORDS`` words is one shingle; repeated rows and texts of equal words are one
node; null ids are the least; rows of one id with different texts are different
nodes. ``kept`` is true for rows whose id is the component's (all rows of that
id). Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import mix
from .components import connected_components
from .hashed import LOWER
from .tables import bounded_batches, keyed, table, written

WORDS, PERCENT = 3, 85
BANDS, ROWS = 40, 5
#: Of BANDS * ROWS coordinates, with one byte of each compared.
AGREE = 134
#: Shingles of a tile's side.
TILE = 200_000
#: Nodes (24 bytes each) that are broadcast at most.
SMALL = 500_000
_LOWER = LOWER.tobytes()
_NONE = np.uint64(2**64 - 1)


def shingles(text: bytes | None) -> set[tuple[bytes, ...]]:
    """Distinct shingles of a text; empty without words."""
    words = (text or b"").translate(_LOWER).split()
    return set(zip(*(words[k:] for k in range(WORDS)), strict=False)) if len(words) >= WORDS else {tuple(words)} if words else set()


def sketches(hashes: np.ndarray, counts: np.ndarray, t: int = BANDS * ROWS) -> np.ndarray:
    """Sketches of sets, a row each: ``hashes`` are 64-bit hashes of distinct elements, set after set; no set is empty."""
    out = np.full(len(counts) * t, _NONE, np.uint64)
    own = np.repeat(np.arange(len(counts)), counts)
    for i in range(2 * t):
        if not len(own):
            break
        mixed = mix(hashes + np.uint64(0x9E3779B97F4A7C15 * (i + 1) % 2**64))
        at = own * t + (((mixed >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else i - t)
        new = out[at] == _NONE
        np.minimum.at(out, at[new], np.uint64(i << 32) | (mixed[new] & np.uint64(0xFFFFFFFF)))
        if i < 8 or i % 8 == 0:  # sets whose coordinates are all filled are done
            unfilled = (out.reshape(-1, t) == _NONE).any(axis=1)[own]
            hashes, own = hashes[unfilled], own[unfilled]
    return out.reshape(-1, t)


def band_keys(sketch: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A key for each band of each sketch."""
    parts = sketch.reshape(len(sketch), bands, -1)
    keys = np.tile(mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(sketch), 1))
    for k in range(parts.shape[2]):
        keys = mix(keys * np.uint64(3) + parts[:, :, k])
    return keys


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["k", "h", "id", "digest", "n", "sketch", "keys"]
    for batch in batches:
        k, h, ids, texts = batch.columns
        texts = texts.cast(pa.binary())
        digests, counts, hashes, held, at = [], [], [], 0, 0

        def made(stop: int) -> pa.RecordBatch:
            n = np.array(counts, np.int64)
            full = sketches(np.concatenate([*hashes, np.zeros(0, np.uint64)]), n[n > 0])
            low = np.zeros((len(n), full.shape[1]), np.uint8)
            low[n > 0] = full & np.uint64(0xFF)
            ends = np.concatenate(([0], np.cumsum((n > 0) * BANDS)))
            keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(band_keys(full).view(np.int64).ravel()))
            sketch = pa.FixedSizeBinaryArray.from_buffers(pa.binary(low.shape[1]), len(n), [None, pa.py_buffer(low.tobytes())]).cast(pa.binary())
            own = [x.slice(at, stop - at) for x in (k, h, ids)]
            return pa.RecordBatch.from_arrays([*own, pa.array(digests, pa.binary()), pa.array(n), sketch, keys], names)

        for i, text in enumerate(texts.to_pylist()):
            own = shingles(text)
            digests.append(blake2b(b" ".join((text or b"").translate(_LOWER).split()), digest_size=16).digest() if own else None)
            counts.append(len(own))
            if own:
                hashes.append(np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, own)), np.uint64, len(own)))
            held += len(own)
            if held > 1 << 20:
                yield made(i + 1)
                digests, counts, hashes, held, at = [], [], [], 0, i + 1
        if counts:
            yield made(len(texts))


def sketched(docs: DataFrame) -> DataFrame:
    """Columns k, h, id, digest (of the words; null without), n (shingles), sketch (a byte a coordinate), keys (of bands) and row (a number); ``docs`` as ``keyed``."""
    bounded_batches(docs.sparkSession)
    made = docs.mapInArrow(_sketched, f"k long, h long, id {docs.schema['id'].dataType.simpleString()}, digest binary, n long, sketch binary, keys array<long>")
    return written(made.withColumn("row", F.monotonically_increasing_id()), "sketches")


def _retained(size_a: np.ndarray, size_b: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs may be similar, and how many coordinates agree: sizes of sets and rows of sketches, pair by pair."""
    agree = np.zeros(len(a), np.int64)
    near = np.flatnonzero(100 * np.minimum(size_a, size_b) >= PERCENT * np.maximum(size_a, size_b))
    for at in range(0, len(near), 1 << 14):
        part = near[at : at + (1 << 14)]
        agree[part] = (a[part] == b[part]).sum(axis=1)
    return agree >= AGREE, agree


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        u, v, n_u, n_v, a, b = batch.columns
        if len(u):
            keep = pa.array(_retained(n_u.to_numpy(), n_v.to_numpy(), _matrix(a), _matrix(b))[0])
            yield pa.RecordBatch.from_arrays([u.filter(keep), v.filter(keep)], ["u", "v"])


def numbered(texts: list[bytes]) -> list[np.ndarray]:
    """Sets of shingles as sorted numbers: equal ones, by their words, have equal numbers in all of the texts, each of which has words.

    Words get numbers, then pairs of words, then pairs of those with a third word; a place without a word counts as word 0.
    """
    known: dict[bytes, int] = {}
    ids, sizes = [], []
    for text in texts:
        words = text.translate(_LOWER).split()
        own = np.fromiter((known.setdefault(w, len(known) + 1) for w in words), np.int64, len(words))
        ids.append(np.pad(own, (0, max(0, WORDS - len(own)))))
        sizes.append(len(ids[-1]) - WORDS + 1)
    codes = np.concatenate([x[: len(x) - WORDS + 1] for x in ids])
    for k in range(1, WORDS):
        codes = np.unique(codes << np.int64(32) | np.concatenate([x[k : len(x) - WORDS + 1 + k] for x in ids]), return_inverse=True)[1]
    return [np.unique(x) for x in np.split(codes, np.cumsum(sizes)[:-1])]


def _tile_links(columns: list[np.ndarray], sketch: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Links of one tile between components, one for each member of the left side and component."""
    row, root, n, left, right = columns
    x, y = np.flatnonzero(left), np.flatnonzero(right)
    near: list[tuple[int, np.ndarray]] = []
    for i in x:
        others = y[(root[y] != root[i]) & (row[y] != row[i])]
        if len(others):
            keep, _ = _retained(np.broadcast_to(n[i], len(others)), n[others], np.broadcast_to(sketch[i], (len(others), sketch.shape[1])), sketch[others])
            if keep.any():
                near.append((i, others[keep]))
    if not near:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    asked = sorted({k for i, others in near for k in (i, *others.tolist())})
    sets = dict(zip(asked, numbered([texts[k] for k in asked]), strict=True))
    marked, u, v = np.zeros(1 + max(int(x[-1]) for x in sets.values()), bool), [], []
    for i, others in near:
        marked[sets[i]] = True
        sizes = n[others]
        for at in range(0, len(others), 256):
            part = others[at : at + 256]
            ends = np.cumsum(sizes[at : at + 256])
            both = np.add.reduceat(marked[np.concatenate([sets[k] for k in part])], np.concatenate(([0], ends[:-1])), dtype=np.int64)
            linked = part[100 * both >= PERCENT * (n[i] + n[part] - both)]
            u.append(np.full(len(linked), row[i])), v.append(linked)
        marked[sets[i]] = False
    u, v = np.concatenate(u), np.concatenate(v)
    once = np.unique(np.stack((u, root[v])), axis=1, return_index=True)[1] if len(u) else []
    return u[once], row[v[once]]


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of tiles; rows are sorted by tile, and a tile is held at a time."""
    held: list[pa.RecordBatch] = []
    key = None

    def closed() -> Iterator[pa.RecordBatch]:
        if held:
            whole = pa.Table.from_batches(held).combine_chunks()
            columns = [whole.column(c).to_numpy() for c in range(1, 6)]
            u, v = _tile_links(columns, _matrix(whole.column(6)), whole.column(7).cast(pa.binary()).to_pylist())
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])
            held.clear()

    for batch in batches:
        tile = batch.column(0).to_numpy()
        edges = np.flatnonzero(np.concatenate(([True], tile[1:] != tile[:-1], [True]))) if len(tile) else np.zeros(1, np.int64)
        for at, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if tile[at] != key:
                yield from closed()
                key = tile[at]
            held.append(batch.slice(at, end - at))
    yield from closed()


def unsettled_links(groups: DataFrame, infos: DataFrame, texts: DataFrame, roots: DataFrame, tile: int = TILE) -> DataFrame:
    """Columns u and v: links between nodes of different components that are in one group.

    ``groups`` has least and row, ``infos`` row, n and sketch, ``texts`` row and text, ``roots`` node and root. A group's
    members in its largest component and the others are dealt over blocks of about ``tile`` shingles; tiles hold one
    block of the others and any block.
    """
    member = groups.join(infos.select("row", "n"), "row").join(roots, F.col("row") == F.col("node"), "left").select("least", "row", "n", F.coalesce("root", "row").alias("root"))
    member = written(member, "group-members")
    sizes = member.groupBy("least", "root").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    sizes = sizes.groupBy("least").agg(F.max(F.struct("c", "root", "w")).alias("most"), F.sum("c").alias("c"), F.sum("w").alias("w"))
    # groups of two are settled by the first pass, whatever it found
    sizes = sizes.where((F.col("most.c") < F.col("c")) & (F.col("c") > 2)).select(
        "least", F.col("most.root").alias("main"), F.ceil(F.col("most.w") / tile).cast("int").alias("mains"), F.ceil((F.col("w") - F.col("most.w")) / tile).cast("int").alias("others"),
    )
    held = member.join(written(sizes, "unsettled-groups"), "least").withColumn("main", F.col("root") == F.col("main"))
    # blocks of the others come first: 0 to others - 1, then those of the main component
    block = F.when(F.col("main"), F.col("others") + F.pmod(F.xxhash64("row"), F.col("mains"))).otherwise(F.pmod(F.xxhash64("row"), F.col("others")))
    held = held.withColumn("block", block.cast("int")).withColumn(
        "meets", F.when(F.col("main"), F.sequence(F.lit(0), F.col("others") - 1)).otherwise(F.sequence(F.lit(0), F.col("others") + F.col("mains") - 1))
    )
    dealt = held.select("least", "row", "root", "n", "block", F.explode("meets").alias("other")).join(infos.select("row", "sketch"), "row").join(texts, "row")
    dealt = dealt.select(
        F.xxhash64("least", F.least("block", "other"), F.greatest("block", "other")).alias("tile"), "row", "root", "n",
        (F.col("block") <= F.col("other")).alias("left"), (F.col("block") >= F.col("other")).alias("right"), "sketch", "text",
    )
    return dealt.repartition("tile").sortWithinPartitions("tile").mapInArrow(_tiles, "u long, v long").distinct()


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache: OrderedDict[int, set] = OrderedDict()

    def of(row: int, text: pa.Scalar) -> set:
        found = cache.get(row)
        if found is None:
            found = cache[row] = shingles(text.as_buffer().to_pybytes())
            while len(cache) > 64 or len(cache) > 2 and sum(map(len, cache.values())) > 200_000:
                cache.popitem(last=False)
        else:
            cache.move_to_end(row)
        return found

    for batch in batches:
        u, v, first, second = batch.columns
        keep = []
        for i, (a, b) in enumerate(zip(u.to_pylist(), v.to_pylist(), strict=True)):
            x, y = of(a, first[i]), of(b, second[i])
            both = len(x & y)
            keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([u.filter(keep), v.filter(keep)], ["u", "v"])


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) that are similar enough, by the shingles of their whole texts (``texts`` has row and text)."""
    second = pairs.join(texts.select(F.col("row").alias("v"), F.col("text").alias("second")), "v")
    both = second.join(texts.select(F.col("row").alias("u"), F.col("text").alias("first")), "u")
    return both.select("u", "v", "first", "second").mapInArrow(_confirmed, "u long, v long")


def links(nodes: DataFrame, docs: DataFrame, tile: int = TILE) -> DataFrame:
    """Columns node and root of the components of similar nodes.

    ``nodes`` has row, k, h, n, sketch and keys; ``docs`` k, h and text.
    """
    posted = nodes.select(F.explode("keys").alias("key"), "row")
    shared = written(posted.groupBy("key").agg(F.min("row").alias("least"), F.max("row").alias("last")).where("least <> last").select("key", "least"), "shared-bands")
    groups = written(posted.join(shared, "key").select("least", "row").distinct(), "groups")
    infos = written(nodes.select("row", "n", "sketch", "k", "h").join(groups.select("row").distinct(), "row"), "group-sketches")
    members = infos.select("row", "k", "h")
    small = F.broadcast(members) if infos.count() <= SMALL else members
    texts = written(docs.select("k", "h", "text").join(small, ["k", "h"]).groupBy("row").agg(F.first("text").alias("text")), "group-texts")
    star = groups.where("row <> least").select(F.col("least").alias("u"), F.col("row").alias("v"))
    side = lambda c: infos.select(F.col("row").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    star = star.join(side("u"), "u").join(side("v"), "v").select("u", "v", "n_u", "n_v", "sketch_u", "sketch_v")
    pairs = written(star.mapInArrow(_stars, "u long, v long"), "pairs")
    found = written(confirmed(pairs, texts), "links")
    roots = written(connected_components(found, "minhash-links"), "roots")
    more = written(unsettled_links(groups, infos, texts, roots, tile), "links")
    return written(connected_components(found.unionByName(more), "minhash-links"), "roots")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """Columns id, n_shingles, component_id (the least id reachable over links) and kept, one row a row of ``df``."""
    docs = keyed(df, id_col, text_col)
    made = sketched(docs)
    worded = made.where("n > 0")
    least = F.min(F.struct("k", "id")).alias("least")
    distinct = written(worded.groupBy("digest").agg(F.min("row").alias("row"), least), "minhash-nodes")
    nodes = written(worded.drop("digest", "id").join(distinct.select("row"), "row"), "node-sketches")
    roots = links(nodes, docs, tile)
    member = written(distinct.join(roots, distinct.row == roots.node, "left").select("digest", "least", F.coalesce("root", "row").alias("root")), "minhash-members")
    component = written(member.groupBy("root").agg(F.min("least").alias("least")), "minhash-components")
    found = written(member.select("digest", "root").join(component, "root").select("digest", F.col("least.id").alias("component_id")), "minhash-found")
    # plain tables: the rows of a hot text can be split
    every = worded.join(found, "digest").select("id", "n", "component_id").unionByName(made.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return every.select("id", F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {"op13_minhash": op13_minhash}
ORACLES: dict[str, str] = {}
