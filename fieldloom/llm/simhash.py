"""SimHash near-deduplication with covering locality-sensitive hashing.

A fingerprint bit is set if it is set in over half of the hashes of a text's word shingles. Equal fingerprints
are one class. For radius r every bit position gets a non-zero vector of r + 1 bits, and table v (2**(r+1) - 1
of them) masks out the positions whose vector is orthogonal to v. The at most r positions in which two linked
fingerprints differ span less than the whole space, so some v is orthogonal to all of them, and the pair
agrees under that table's mask: no pair within the radius is missed.

Inside a bucket of one table, members are grouped by breadth-first search and linked to the least member of
their group, so that a bucket gives at most as many links as members. A bucket over ``SPLIT`` members is dealt
out again under the same construction over its free positions; for radius 3, what is left then agrees in all but
16 positions at most, which bounds the members of a second bucket by 2**16 whatever the data.

Components come from alternating large-star and small-star rounds, each a grouped minimum and a join, with a
checkpoint after every round, until every link leads to the least node of its component. Hot fingerprints, components and hubs are joined by broadcast.

Defined results: an empty table gives no rows; a null or empty text has the fingerprint zero and is linked like
any other; texts with fewer words than a shingle take their whole word sequence; a very long text is voted on in
parts of 4,096 shingles; a bit that is set in exactly half of the hashes is 0; repeated rows share a class; null
ids never name a component that has another id; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, documents, id_and_text, joined_by_key, record_batch, sliced

SHINGLE = 3
RADIUS = 3
SEED = 42
SPLIT = 4096
ROUNDS = 60
#: Links that a task of a round has at least, so that few links are not dealt out over every shuffle partition.
TASK_LINKS = 1 << 17
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: str, words: int) -> list[int]:
    tokens = text.encode().translate(_LOWER).split()  # bytes split at space and 9 to 13
    if not tokens:
        return []
    joined = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return [digest(joined, SEED)]
    ends, at = [], -1
    for t in tokens:
        at += len(t) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends]]
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :], strict=False)]


def fingerprints(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
        for batch in sliced(batches, 1 << 20):
            out = np.zeros(batch.num_rows, np.uint64)
            for k, text in enumerate(batch.column(1).to_pylist()):
                found = shingle_hashes(text, words)
                votes = np.zeros(64, np.int64)
                for start in range(0, len(found), 4096):
                    part = np.array(found[start : start + 4096], "<u8")
                    bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    votes += bits.sum(axis=0, dtype=np.int32)
                out[k] = np.packbits(votes * 2 > len(found), bitorder="little").view("<u8")[0]
            yield record_batch(schema, [batch.column(0), out.view(np.int64)])

    return id_and_text(docs).mapInArrow(run, "doc_id long, fp long")


@lru_cache(maxsize=4096)
def position_vectors(radius: int, n: int) -> tuple[int, ...]:
    """A non-zero vector of radius + 1 bits for each of n positions, such that no mask is nearly empty.

    Few vectors are dealt out in turn; where there are more vectors than positions, the best of some seeded
    random choices is taken, by the least number of positions in a mask.
    """
    top = 2 ** (radius + 1)
    if top - 1 <= n:
        return tuple(1 + k % (top - 1) for k in range(n))
    v = np.arange(1, top)
    best, least = None, -1
    for seed in range(64):
        chosen = np.random.default_rng(seed).choice(top - 1, n, replace=False) + 1
        sizes = (np.bitwise_count(chosen[None, :] & v[:, None]) & 1).sum(axis=1)
        if sizes.min() > least:
            best, least = chosen, sizes.min()
    return tuple(best.tolist())


def covering_masks(radius: int, positions: list[int] | None = None) -> list[int]:
    """Masks of the tables, for differences within some bit positions (all 64 if not given)."""
    positions = list(range(64)) if positions is None else positions
    vector = dict(zip(positions, position_vectors(radius, len(positions)), strict=True))
    return [sum(1 << p for p in positions if (vector[p] & v).bit_count() & 1) for v in range(1, 2 ** (radius + 1))]


def deep_masks(radius: int) -> dict[int, list[int]]:
    """For each table, the whole masks of its second deal."""
    out = {}
    for t, mask in enumerate(covering_masks(radius)):
        free = [p for p in range(64) if not mask >> p & 1]
        out[t] = [mask | m for m in covering_masks(radius, free)]
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bucket_links(members: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, least member of its group) for members that are not the least; groups: reachable within the radius."""
    order = np.sort(members)
    bits = order.view(np.uint64)
    root = np.full(len(order), -1, np.int64)
    rest = np.arange(len(order))
    while len(rest):
        seed, rest = rest[0], rest[1:]
        root[seed] = seed
        front = [seed]
        while front and len(rest):
            near = np.bitwise_count(bits[rest] ^ bits[front.pop()]) <= radius
            if near.any():
                found = rest[near]
                root[found] = seed
                front.extend(found.tolist())
                rest = rest[~near]
    linked = np.flatnonzero(root != np.arange(len(order)))
    return order[linked], order[root[linked]]


def _bucket_rows(radius: int, split: int | None):
    """Links within buckets, from rows (t, key, fp) in order of (t, key); rows of a bucket over ``split`` pass through."""
    schema = pa.schema([("t", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        held: list[np.ndarray] = []
        current, size, deep = None, 0, False

        def flush():
            nonlocal held, size, deep
            if not deep and size > 1:
                a, b = bucket_links(np.unique(np.concatenate(held)), radius)
                if len(a):
                    yield record_batch(schema, [np.full(len(a), -1, np.int32), a, b])
            held, size, deep = [], 0, False

        for batch in batches:
            if not batch.num_rows:
                continue
            t, key, fp = (batch.column(k).to_numpy() for k in range(3))
            border = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
            starts, stops = np.concatenate([[0], border]), np.concatenate([border, [len(t)]])
            # buckets of one member inside the batch need no look
            wanted = (stops - starts > 1) | (starts == 0) | (stops == len(t))
            for a, b in zip(starts[wanted].tolist(), stops[wanted].tolist(), strict=True):
                if current != (t[a], key[a]):
                    yield from flush()
                    current = (t[a], key[a])
                held.append(fp[a:b])
                size += b - a
                if split is not None and size > split:
                    deep = True
                if deep:
                    rows = np.concatenate(held)
                    yield record_batch(schema, [np.full(len(rows), t[a], np.int32), rows, rows])
                    held = []
        yield from flush()

    return run


def links(classes: DataFrame, radius: int = RADIUS, split: int = SPLIT) -> DataFrame:
    """a, b (a > b): links that join the same fingerprints as all pairs within the radius do. classes: distinct fp."""
    masks = np.array([signed(m) for m in covering_masks(radius)], np.int64)
    deeper = np.array([[signed(m) for m in ms] for ms in deep_masks(radius).values()], np.int64)

    def dealt(rows: DataFrame, again: bool) -> DataFrame:
        """t, key, fp: every fingerprint under every mask; in a second deal, under the masks of its table."""

        def run(batches):
            schema = pa.schema([("t", pa.int32()), ("key", pa.int64()), ("fp", pa.int64())])
            for whole in batches:
                for start in range(0, whole.num_rows, 1 << 12):
                    batch = whole.slice(start, 1 << 12)
                    fp = batch.column(0).to_numpy()
                    own = deeper[batch.column(1).to_numpy()] if again else np.broadcast_to(masks, (len(fp), len(masks)))
                    table = np.arange(len(masks)) + (batch.column(1).to_numpy()[:, None] * len(masks) if again else 0)
                    keys = (fp[:, None] & own).ravel()
                    yield record_batch(schema, [np.broadcast_to(table, own.shape).ravel().astype(np.int32), keys, np.repeat(fp, len(masks))])

        return rows.mapInArrow(run, "t int, key long, fp long")

    def grouped(rows: DataFrame, limit: int | None) -> DataFrame:
        return rows.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(_bucket_rows(radius, limit), "t int, a long, b long")

    found = checkpointed(grouped(dealt(classes.select("fp"), False), split))
    second = grouped(dealt(found.where("t >= 0").select(F.col("a").alias("fp"), "t"), True), None)
    return found.where("t < 0").select("a", "b").unionByName(second.select("a", "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (its least reachable node) of every node with a link that is no root itself, from rows (a, b)."""
    edges = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    least_tasks = edges.sparkSession.sparkContext.defaultParallelism

    def tasks(n: int) -> int:
        return max(least_tasks, -(-n // TASK_LINKS))

    def state(e: DataFrame) -> tuple[int, int]:
        """Links, and nodes that are not settled: those with two links down, or with links both down and up."""
        ends = e.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("down")), F.struct(F.col("b").alias("node"), F.lit(0).alias("down")))).alias("end")).select("end.*")
        nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.min("down").alias("least"))
        n, unsettled = nodes.agg(F.sum("down"), F.count_if((F.col("down") > 1) | (F.col("down") > 0) & (F.col("least") == 0))).first()
        return n or 0, unsettled

    # the number of links says how many tasks they are worth; a round makes no more links than there are
    edges = edges.coalesce(tasks(edges.count()))
    for _ in range(ROUNDS):
        n, unsettled = state(edges)
        if not unsettled:  # stars around the least node of each component
            break
        # large star: a node's larger neighbours move to its least neighbour (or to itself)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = joined_by_key(both, least, ["a"], "n", F.xxhash64("a", "b"), 2 * n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: a node and its smaller neighbours move to the least of them; links that repeat go at the end
        smallest = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        moved = joined_by_key(large, smallest, ["a"], "n", F.xxhash64("a", "b"), 2 * n).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = checkpointed(moved.unionByName(smallest.select("a", F.col("m").alias("b"))).distinct().coalesce(tasks(n)))
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def named_components(rows: DataFrame, classes: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """``rows`` with component_id, the least id of their component; null ids only name components without another.

    rows: (.., key); classes: (key, least_id, n) with n rows each; roots: (node, root) of the classes that have a link.
    """
    placed = checkpointed(classes.join(roots, F.col(key) == F.col("node"), "left").select(key, "least_id", "n", "root"))
    linked = placed.where(F.col("root").isNotNull())
    sizes = checkpointed(linked.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("members")))
    named = joined_by_key(linked.select("root", key, "n"), sizes, ["root"], "members", F.xxhash64(key)).select(key, "component_id", "n")
    named = checkpointed(named.unionByName(placed.where(F.col("root").isNull()).select(key, F.col("least_id").alias("component_id"), "n")))
    return joined_by_key(rows, named, [key], "n", F.xxhash64("doc_id")).drop("n")


def near_duplicates(docs: DataFrame, words: int = SHINGLE, radius: int = RADIUS, split: int = SPLIT) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every row."""
    rows = checkpointed(fingerprints(docs, words))
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n"))
    roots = components(links(classes.select("fp"), radius, split))
    # the least fingerprint of a component belongs to it too
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    found = named_components(rows, classes, roots, "fp")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
