"""SimHash near-duplicates through a byte-position index with count filtering.

Two 64-bit fingerprints that differ in at most ``BITS`` = 2 bits differ in at
most two of their eight bytes, so of eight positional bytes they share at least
six. The inverted index lists fingerprints by positional bytes: a posting holds
the four bytes of two of the four pairs of neighbouring positions, of which two
fingerprints within reach share at least one posting of their six. (A list by
one byte holds 1/256 of a corpus; by four it is short.) Pairs that meet in a
list are tallied by the positional bytes they share; pairs that reach the
guaranteed ``SHARED`` = 6 are retained and verified by their differing bits.

Lists of over ``HOT`` distinct fingerprints, found by a pre-aggregated count,
are split by two more positions (six choices again): a pair with six shared
bytes shares one of these as well. Under six bytes only two are free, so a list
holds at most 65,536 fingerprints however many copies a document has. Split
lists that are still large are not paired off: each member is probed with the
136 patterns of one or two flipped bits, which reach the tally by construction;
a list gives a spanning star of each group it finds, not all its pairs.
Postings are dealt over partitions sized by their number, sorted, and read as a
stream, so a task holds one list at a time.

Rows: a null or empty text, or one of white space only, has fingerprint zero
and is linked like any other. Repeated rows have equal fingerprints, hence one
component. A null id still gets a fingerprint and its component's least id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .tables import bounded_batches, id_key, parallelism, table, written

BITS, WORDS, SEED = 2, 3, 42
SHARED = 8 - BITS
_CHUNK = 1 << 15  # shingles whose bits are unpacked at once
_mask = lambda places: sum(0xFF << (8 * p) for p in places)
_NEIGHBOURS = ((0, 1), (2, 3), (4, 5), (6, 7))
#: Choices of positional bytes: first those of lists by four bytes, then those of lists by six.
FOURS = [_mask(a + b) for a, b in combinations(_NEIGHBOURS, 2)]
MASKS = np.array([*FOURS, *(_mask(x) for x in combinations(range(8), SHARED))], np.uint64)
HOT = 128  # lists by four bytes of more members are split; lists of up to so many are compared by pairs
PART = 2_000_000  # postings of a partition


def _majorities(texts: list[bytes | None]) -> np.ndarray:
    """Fingerprints of a run of documents."""
    out = np.zeros(len(texts), np.uint64)
    hashes: list[int] = []
    owners: list[int] = []
    counts: list[int] = []
    ones = np.zeros((len(texts), 64), np.int64)

    def flush() -> None:
        if hashes:
            bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
            np.add.at(ones, owners, np.add.reduceat(bits, starts, axis=0, dtype=np.int64))
            hashes.clear(), owners.clear(), counts.clear()

    totals = np.zeros(len(texts), np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for i, text in enumerate(texts):
        words = (text or b"").lower().split()
        if not words:
            continue
        n = totals[i] = max(1, len(words) - WORDS + 1)
        for at in range(0, n, _CHUNK):
            part = words[at : at + _CHUNK + WORDS - 1] if n > _CHUNK else words
            hashes += [digest(join(x), SEED) for x in zip(part, part[1:], part[2:])] if len(words) >= WORDS else [digest(join(words), SEED)]
            owners.append(i)
            counts.append(min(_CHUNK, n - at))
            if len(hashes) >= _CHUNK:
                flush()
    flush()
    out[:] = np.packbits(2 * ones > totals[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
        for at in range(0, len(texts), 512):
            part = _majorities(texts.slice(at, 512).to_pylist())
            yield pa.RecordBatch.from_arrays([ids.slice(at, 512), pa.array(part.view(np.int64))], ["id", "fp"])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id (as it came) and fp (the 64 bits as a long)."""
    bounded_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_fingerprints, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


_POP = np.array([bin(x).count("1") for x in range(1 << 16)], np.uint8)
_FLIPS = np.array([x for x in range(1, 1 << 16) if _POP[x] <= BITS], np.uint32)


def popcount(x: np.ndarray) -> np.ndarray:
    return _POP[np.ascontiguousarray(x).view(np.uint16).reshape(-1, 4)].sum(axis=1, dtype=np.int64)


def tally(x: np.ndarray) -> np.ndarray:
    """Equal positional bytes of pairs, from the exclusive or of each pair."""
    return (np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)


def _squeeze(values: np.ndarray, mask: int) -> np.ndarray:
    """The two bytes that ``mask`` leaves free, as numbers below 65,536."""
    low, high = (p for p in range(8) if not mask >> (8 * p) & 0xFF)
    byte = lambda p: (values >> np.uint64(8 * p)) & np.uint64(0xFF)
    return (byte(low) | byte(high) << np.uint64(8)).astype(np.uint32)


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs reach the tally and then hold to their bits."""
    both = a ^ b
    retained = np.flatnonzero(tally(both) >= SHARED)
    return retained[popcount(both[retained]) <= BITS]


def _star(members: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join each group of one list: members are distinct and sorted."""
    n = len(members)
    if n <= HOT:
        a, b = np.triu_indices(n, 1)
        near = _near(members[a], members[b])
        a, b = a[near], b[near]
    else:
        free = _squeeze(members, mask)
        where = np.full(1 << 16, -1, np.int64)
        where[free] = np.arange(n)
        found = [(i := np.flatnonzero(where[free ^ flip] >= 0), where[free[i] ^ flip]) for flip in _FLIPS]
        a, b = (np.concatenate([x[k] for x in found]) for k in (0, 1))
    root = np.arange(n)
    while len(a):
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    leaf = np.flatnonzero(root != np.arange(n))
    return members[root[leaf]], members[leaf]


def _listed(choice: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among whole lists, which come one after another with their members in order."""
    key = fp & MASKS[choice]
    same = (choice[1:] == choice[:-1]) & (key[1:] == key[:-1])
    once = np.concatenate(([True], ~same | (fp[1:] != fp[:-1])))  # a list that two splits lead to names its members twice
    choice, fp, key = choice[once], fp[once], key[once]
    edge = np.flatnonzero(np.concatenate(([True], (choice[1:] != choice[:-1]) | (key[1:] != key[:-1]), [True])))
    size = np.diff(edge)
    two = edge[:-1][size == 2]
    two = two[_near(fp[two], fp[two + 1])]
    u, v = [fp[two]], [fp[two + 1]]
    for at, n in zip(edge[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
        a, b = _star(fp[at : at + n], int(MASKS[choice[at]]))
        u.append(a), v.append(b)
    return np.concatenate(u), np.concatenate(v)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among fingerprints of one partition that share a list; rows are sorted by list and fingerprint."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0

    def settled(last: bool) -> Iterator[pa.RecordBatch]:
        choice, fp = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        if not last:  # the list that is open waits for its other members
            key = fp & MASKS[choice]
            done = int(np.flatnonzero((choice != choice[-1]) | (key != key[-1]))[-1]) + 1 if (choice[0] != choice[-1]) or (key[0] != key[-1]) else 0
            held.append((choice[done:], fp[done:]))
            choice, fp = choice[:done], fp[:done]
        if len(fp):
            u, v = _listed(choice, fp)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)))
        count += len(batch)
        if count >= 1 << 16:
            yield from settled(False)
            count = 0
    if held:
        yield from settled(True)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def postings(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """Columns choice, key and fp: one row for each list that a fingerprint stands in; ``distinct`` has fp."""
    fours = F.array(*[F.struct(F.lit(i).alias("choice"), F.lit(_signed(m)).alias("mask")) for i, m in enumerate(FOURS)])
    made = distinct.select(F.explode(fours).alias("x"), "fp").select("x.choice", F.col("fp").bitwiseAND(F.col("x.mask")).alias("key"), "fp")
    crowded = written(made.groupBy("choice", "key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("choice", "key"), "simhash-crowded")
    sixes = {int(m): i for i, m in enumerate(MASKS) if i >= len(FOURS)}
    more = lambda m: [m | _mask(x) for x in combinations([p for p in range(8) if not m >> (8 * p) & 0xFF], 2)]
    wider = F.array(*[F.array(*[F.struct(F.lit(sixes[x]).alias("choice"), F.lit(_signed(x)).alias("mask")) for x in more(m)]) for m in FOURS])
    split = made.join(crowded, ["choice", "key"]).select(F.explode(F.get(wider, F.col("choice"))).alias("x"), "fp")
    split = split.select("x.choice", F.col("fp").bitwiseAND(F.col("x.mask")).alias("key"), "fp")
    return made.join(crowded, ["choice", "key"], "left_anti").unionByName(split)


def links(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """Columns u and v: links that connect all fingerprints within BITS of each other; ``distinct`` has fp."""
    parts = max(parallelism(distinct.sparkSession), -(-len(FOURS) * distinct.count() // PART))
    dealt = postings(distinct, hot).repartition(parts, "choice", "key").sortWithinPartitions("choice", "key", "fp").select("choice", "fp")
    return dealt.mapInArrow(_links, "u long, v long")


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, fp and component_id, the least id whose fingerprint can be reached over links."""
    made = written(fingerprints(df, id_col, text_col), "fingerprints")
    distinct = written(made.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    roots = connected_components(links(distinct), "simhash-links")
    member = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    linked = written(member.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-linked")
    found = written(member.join(linked, "root").select("fp", "component_id"), "simhash-components")
    return made.join(found, "fp").select("id", "fp", "component_id")  # two plain tables: a hot fingerprint can be split


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, with its columns, one a component: that of least id (null ids last), then least text hash.

    Which row stays is a pre-aggregated minimum over (id, hash, position in the
    input); texts are not shuffled by component, so a large group is no hot key.
    """
    made = written(
        fingerprints(df.select(F.struct(F.col(id_col).isNull().alias("none"), id_key(id_col).alias("doc"), F.xxhash64(text_col).alias("h")).alias("key"), F.col(text_col).alias("text")), "key", "text"),
        "fingerprints",
    )
    distinct = written(made.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    roots = connected_components(links(distinct), "simhash-links")
    member = distinct.join(roots, distinct.fp == roots.node, "left").select("least", F.coalesce("root", "fp").alias("root"))
    best = member.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.*"))
    best = best.select(F.col("doc").alias("k"), "h")
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    own = df.select(row.alias("row"), id_key(id_col).alias("k"), F.xxhash64(text_col).alias("h"))
    kept = own.join(best, ["k", "h"], "left_semi")
    # repeated rows have one key: one of them stays, pre-aggregated
    return kept.groupBy("k", "h").agg(F.first("row").alias("row")).select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns])


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op8_simhash": op8_simhash}
ORACLES: dict[str, str] = {}
