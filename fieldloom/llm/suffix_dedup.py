"""Removal of long repeated byte strings by merging Burrows-Wheeler transforms of shards.

Candidates. Of the hashes of all ``GRAM``-byte strings inside a window of ``length`` bytes, the leftmost least
one is the window's anchor. Equal windows have equal anchors, so windows can be dealt out by their anchor's
hash, and an anchor hash that occurs once belongs to no repeated window. Consecutive windows with one anchor
form a run; the text under a run is a piece. Equal pieces of one map task leave it as one row with all places.

Merging. A task takes the pieces of whole anchor groups and deals every group's pieces out to ``SHARDS`` shards.
Each shard sorts its suffixes once and keeps their order, the Burrows-Wheeler transform (the symbol before each
suffix) and where the transform leads (the rank of the suffix that begins with that symbol). The shards are then
merged by refining their interleave, which never looks at the texts or sorts suffixes again: it is a sequence of
shards' entries in which the entries of one shard keep their order. A round reads the symbols before the entries and
deals the entries stably to their symbols' buckets, following the transforms, so that the interleave is sorted
by more symbols (two a round). Entries that were apart, or whose symbols differ, get a border: a border that first
appears when h symbols are sorted means a common prefix of fewer than h symbols. An interval between borders with entries of one shard alone is left out
from then on: what it repeats is known from the shard itself. What is in an interval of several shards after ``length``
symbols is a string that several shards have. With the common prefixes of neighbours within a shard, and pieces that
occur twice, these are all repeated strings.

Hot anchors. An anchor with more than ``HOT`` runs is no group of one task: each of its windows is dealt out by
its own hash, and counted under a 128-bit hash of its bytes; equal windows of a map task leave it as one row. Those
that also have one in ``HOT_ANCHORS`` of all runs, which are fewer than that, are found first and their runs never
meet; the others are counted where their runs meet.

Rows are named by an MD5 of id and text, so that a task that runs again gives the same names.

Defined results: an empty table gives no rows; a null or empty text has no bytes; texts shorter than ``length`` keep
everything; strings are judged on the input, and repeats inside one text and overlapping ones count; there are no
ties, every occurrence goes; equal rows repeat each other; very long texts are scanned in overlapping sections of
``SECTION`` bytes; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_and_text, record_batch, sliced

LENGTH = 200
GRAM = 32
SHARDS = 4
#: Bytes of distinct pieces that a task merges at a time (whole anchor groups).
CHUNK = 1 << 19
SCAN = 1 << 20
#: A longer text is scanned in sections, which overlap so that every window lies in one of them.
SECTION = 1 << 24
#: Runs of an anchor that may meet in one task.
HOT = 1 << 16
HOT_ANCHORS = 2000

MULTIPLY = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
#: Bits of the place in a packed (hash, place).
PLACE = 26


def _byte_values() -> np.ndarray:
    """A fixed 64-bit value for each byte, by the splitmix64 rule."""
    z = (np.arange(1, 257, dtype=np.uint64) * np.uint64(MULTIPLY)).astype(np.uint64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


BYTE_VALUES = _byte_values()


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit polynomial hash of every ``width`` bytes, built by doubling."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, size, done = BYTE_VALUES[data], 1, 0
    out = None
    factor = MULTIPLY
    while True:
        if width & size:
            part = power[done : done + n]
            out = part.copy() if out is None else out * np.uint64(pow(MULTIPLY, size, 1 << 64)) + part
            done += size
        if done == width:
            break
        power = power[: len(power) - size] * np.uint64(factor) + power[size:]
        factor = factor * factor & MASK
        size *= 2
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    n, size = len(values) - width + 1, 1
    out = values
    while size * 2 <= width:
        out = np.minimum(out[: len(out) - size], out[size:])
        size *= 2
    return np.minimum(out[:n], out[width - size : width - size + n]) if width > size else out[:n]


def anchor_runs(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first window, windows, anchor hash) of every run of windows with one anchor."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none
    if len(data) > 1 << PLACE:
        raise ValueError("too many bytes for one scan")
    grams = rolling(data, gram)
    packed = (grams & np.uint64(MASK - (1 << PLACE) + 1)) | np.arange(len(grams), dtype=np.uint64)
    at = (sliding_min(packed, length - gram + 1) & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    # a window is valid inside one text; runs break at texts' borders
    valid = np.zeros(len(at) + 1, np.int8)
    long = sizes >= length
    np.add.at(valid, (ends - sizes)[long], 1)
    np.add.at(valid, (ends - length + 1)[long], -1)
    inside = np.cumsum(valid[:-1]).astype(bool)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | ~inside[:-1]
    start = (ends - sizes)[sizes >= length]
    new[start] = True
    new &= inside
    first = np.flatnonzero(new)
    stop = np.append(first[1:], len(at))
    number = np.searchsorted(ends, first, "right")
    stop = np.minimum(stop, ends[number] - length + 1)
    return number, first - (ends - sizes)[number], stop - first, grams[at[first]].view(np.int64)


class Shard:
    """Pieces, their suffixes in order, and their Burrows-Wheeler transform; every piece ends in a terminator of its own."""

    def __init__(self, pieces: list[bytes], length: int):
        sizes = np.array([len(p) for p in pieces], np.int64)
        ends = np.cumsum(sizes + 1) - 1
        n = int(ends[-1]) + 1
        symbols = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends] = False
        symbols[inside] = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64) + 1
        self.piece = np.repeat(np.arange(len(pieces)), sizes + 1)
        self.start = ends - sizes
        left = ends[self.piece] - np.arange(n)
        rank, equal = self.sorted(symbols, left, length)
        self.order = np.empty(n, np.int64)
        self.order[rank] = np.arange(n)
        #: 0 to 255: the symbol before the suffix; 256: none, the suffix is a whole piece.
        before = np.full(n, 256, np.uint16)
        at = self.order
        some = left[at] < sizes[self.piece[at]]
        before[some] = symbols[at[some] - 1] - 1
        self.before = before
        #: How many symbols come before the suffix.
        self.behind = sizes[self.piece[at]] - left[at]
        #: Rank of the suffix that begins one symbol earlier: the entries of each symbol, in order, behind the terminators.
        self.leads = np.full(n, -1, np.int64)
        by_symbol = counting_deal(before)
        self.leads[by_symbol[: n - len(pieces)]] = np.arange(len(pieces), n)
        # neighbours in order whose common prefix has ``length`` symbols
        a, b = at[:-1], at[1:]
        both = np.flatnonzero((left[a] >= length) & (left[b] >= length))
        both = both[equal(a[both], b[both])]
        self.repeated = np.zeros(n, bool)
        self.repeated[both] = True
        self.repeated[both + 1] = True

    @staticmethod
    def sorted(symbols: np.ndarray, left: np.ndarray, length: int):
        """Ranks of all suffixes, by doubling the depth from 7 symbols on, and a test for common prefixes of ``length``."""
        n, depth = len(symbols), 7
        key = np.zeros(n, np.int64)
        for k in range(depth):
            key <<= 9
            key[: n - k] |= np.where(left[: n - k] > k, symbols[k:], 0)
        sub = np.argsort(key, kind="stable")
        new = np.ones(n, bool)
        # equal up to a terminator: the earlier piece first
        new[1:] = (key[sub[1:]] != key[sub[:-1]]) | (left[sub[1:]] < depth)
        rank = np.empty(n, np.int64)
        rank[sub] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        known, known_depth = None, 0
        while True:
            last = np.append(new[1:], True)
            sub = sub[~(new & last)]
            if depth <= length < 2 * depth:
                known, known_depth = rank.copy(), depth
            if not len(sub):
                break
            r = rank[sub]
            pair = r * n + rank[sub + depth]
            deal = np.argsort(pair)
            sub, r, pair = sub[deal], r[deal], pair[deal]
            here = np.arange(len(sub))
            head, new = np.ones(len(sub), bool), np.ones(len(sub), bool)
            head[1:], new[1:] = r[1:] != r[:-1], pair[1:] != pair[:-1]
            rank[sub] = r + np.maximum.accumulate(np.where(new, here, 0)) - np.maximum.accumulate(np.where(head, here, 0))
            depth *= 2

        def equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            if known is None:  # no two suffixes share so much
                return np.zeros(len(a), bool)
            shift = length - known_depth
            return (known[a] == known[b]) & (known[a + shift] == known[b + shift])

        return rank, equal


def counting_deal(symbols: np.ndarray) -> np.ndarray:
    """Places of the symbols, symbol by symbol, and in their order within each; numpy deals small integers by counting."""
    return np.argsort(symbols, kind="stable")


def merge(shards: list[Shard], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(entries, intervals) after ``length`` symbols: entries of all shards, numbered through, that share so long a prefix with another shard.

    A round deals by the two symbols before each entry, which are one small integer. Entries with fewer than
    ``length`` symbols before them never become windows and are not in the interleave.
    """
    sizes = np.array([len(s.before) for s in shards], np.int64)
    base = np.cumsum(sizes) - sizes
    before = np.concatenate([s.before for s in shards])
    leads = np.concatenate([s.leads + b for s, b in zip(shards, base.tolist(), strict=True)]).astype(np.int32)
    shard = np.repeat(np.arange(len(shards), dtype=np.uint8), sizes)
    entries = np.flatnonzero(np.concatenate([s.behind >= length for s in shards])).astype(np.int32)
    interval = np.zeros(len(entries), np.int32)
    two, twice = (before[leads] << 8 | before) if length > 1 else before, leads[leads]
    for left in range(length, 0, -2):
        symbol, lead = (two, twice) if left > 1 else (before, leads)
        symbol = symbol[entries]
        deal = counting_deal(symbol)
        symbol, interval, entries = symbol[deal], interval[deal], lead[entries[deal]]
        border = np.ones(len(entries), bool)
        border[1:] = (symbol[1:] != symbol[:-1]) | (interval[1:] != interval[:-1])
        number = np.cumsum(border, dtype=np.int32)
        # an interval of several shards has neighbours of different shards
        own = shard[entries]
        several = np.zeros(len(entries) + 1, bool)
        several[number[1:][(own[1:] != own[:-1]) & ~border[1:]]] = True
        keep = np.flatnonzero(several[number])
        entries, interval = entries[keep], number[keep]
        if not len(entries):
            break
    return entries, interval


def repeated_windows(pieces: list[bytes], counts: np.ndarray, length: int = LENGTH, shards: int = SHARDS) -> list[np.ndarray]:
    """For each of some distinct pieces, the window starts whose string starts elsewhere too; counts: places of each piece."""
    own = [list(range(k, len(pieces), shards)) for k in range(min(shards, len(pieces)))]
    made = [Shard([pieces[i] for i in ids], length) for ids in own]
    entries, _ = merge(made, length)
    found, base = [], 0
    for shard, ids in zip(made, own, strict=True):
        n = len(shard.before)
        mask = shard.repeated.copy()
        mask[entries[(entries >= base) & (entries < base + n)] - base] = True
        base += n
        at = shard.order[mask]
        at.sort()
        number = shard.piece[at]
        start = np.searchsorted(number, np.arange(len(ids) + 1))
        found += [(i, at[a:b] - s) for i, a, b, s in zip(ids, start[:-1].tolist(), start[1:].tolist(), shard.start.tolist(), strict=True)]
    out = [f for _, f in sorted(found, key=lambda f: f[0])]
    return [np.arange(max(0, len(p) - length + 1)) if c >= 2 else f for p, c, f in zip(pieces, counts, out, strict=True)]


def scanned(cut: list[bytes], length: int, gram: int):
    """:func:`anchor_runs` of texts that may be too many for one scan."""
    found, held, size = [], [], 0
    for k, text in enumerate(cut):
        held.append(text)
        size += len(text)
        if size > SECTION or k == len(cut) - 1:
            number, *rest = anchor_runs(held, length, gram)
            found.append((number + (k + 1 - len(held)), *rest))
            held, size = [], 0
    return [np.concatenate(c) for c in zip(*found, strict=True)]


def repeated_spans(plain: DataFrame, texts: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """row, start, stop: stretches of bytes covered by repeated windows, from (row, text, doc_id), as they are and dealt by row."""

    def runs_of(batches):
        """Names, first windows, numbers of windows and anchors of the runs in some rows."""
        for batch in sliced(batches, SCAN):
            cut, own, base = [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                raw = text.encode()
                for start in range(0, max(1, len(raw) - length + 1), SECTION):
                    cut.append(raw[start : start + SECTION + length - 1])
                    own.append(k)
                    base.append(start)
            if cut:
                number, first, windows, h = scanned(cut, length, gram)
                yield batch.column(0).take(pa.array(np.array(own, np.int64)[number])), first + np.array(base, np.int64)[number], windows, h

    def frequent(batches):
        """h and n of anchors with a large share of the task's runs, and the number of all its runs without an h."""
        schema = pa.schema([("h", pa.int64()), ("n", pa.int64())])
        counts: Counter = Counter()
        total = 0
        for _, _, _, h in runs_of(batches):
            names, n = np.unique(h, return_counts=True)
            some = n > 1
            counts.update(dict(zip(names[some].tolist(), n[some].tolist(), strict=True)))
            total += len(h)
            if len(counts) > 50 * HOT_ANCHORS:
                counts = Counter({k: v for k, v in counts.items() if v * HOT_ANCHORS * 2 >= total})
        kept = [(k, v) for k, v in counts.items() if v * HOT_ANCHORS >= total]
        yield record_batch(schema, [[None, *[k for k, _ in kept]], [total, *[v for _, v in kept]]])

    # before the deal, so that texts are not dealt out twice
    unnamed = plain.select(F.lit(b"").alias("row"), "text")
    found = {r["h"]: r["n"] for r in unnamed.mapInArrow(frequent, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("h").isNull() | (F.col("n") > hot)).orderBy(F.col("h").isNotNull(), F.col("n").desc()).limit(HOT_ANCHORS + 1).collect()}
    all_runs = found.pop(None, 0)
    hot_anchors = np.array(sorted(h for h, n in found.items() if n * HOT_ANCHORS >= all_runs), np.int64)

    def scan(batches):
        schema = pa.schema([("h", pa.int64()), ("salt", pa.int64()), ("row", pa.binary()), ("first", pa.int32()), ("windows", pa.int32())])
        for ids, first, windows, h in runs_of(batches):
            salt = np.where(np.isin(h, hot_anchors), 1 + first % 4096, 0)
            yield record_batch(schema, [h, salt, ids, first.astype(np.int32), windows.astype(np.int32)])

    def shared(batches):
        """Of rows in order of h, those whose h occurs again, and whether it occurs more than ``hot`` times; at most so many rows wait."""
        held: list[pa.RecordBatch] = []
        current, size = None, 0

        def out(rows, is_hot):
            for r in rows:
                yield pa.RecordBatch.from_arrays([*r.columns, pa.array(np.full(r.num_rows, is_hot))], names=[*r.schema.names, "hot"])

        for whole_batch in batches:
            salted = whole_batch.column(1).to_numpy() > 0
            batch = whole_batch.select(["h", "row", "first", "windows"])
            if salted.any():
                yield from out([batch.filter(pa.array(salted))], True)
                batch = batch.filter(pa.array(~salted))
            if not batch.num_rows:
                continue
            h = batch.column(0).to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1])
            stops = np.append(starts[1:], len(h))
            if h[0] == current:
                held.append(batch.slice(0, int(stops[0])))
                size += int(stops[0])
                starts, stops = starts[1:], stops[1:]
                if size > hot:
                    yield from out(held, True)
                    held = []
            if len(starts):
                if 1 < size <= hot:
                    yield from out(held, False)
                sizes = stops - starts
                whole = (sizes > 1) & (stops < len(h))
                for big, mask in ((False, whole & (sizes <= hot)), (True, whole & (sizes > hot))):
                    if mask.any():
                        yield from out([batch.filter(pa.array(np.repeat(mask, sizes))) if starts[0] == 0 else batch.slice(int(starts[0])).filter(pa.array(np.repeat(mask, sizes)))], big)
                current, size = h[-1], int(sizes[-1])
                held = [batch.slice(int(starts[-1]))]
                if size > hot:
                    yield from out(held, True)
                    held = []
        if 1 < size <= hot:
            yield from out(held, False)

    runs = texts.mapInArrow(scan, "h long, salt long, row binary, first int, windows int")
    common = runs.repartition("h", "salt").sortWithinPartitions("h", "salt").mapInArrow(shared, "h long, row binary, first int, windows int, hot boolean")
    wanted = common.groupBy(F.col("row").alias("run_row")).agg(F.collect_set(F.struct("h", "first", "windows", "hot")).alias("runs"))

    def cut(batches):
        schema = pa.schema([("h", pa.int64()), ("piece", pa.binary()), ("windows", pa.int32()), ("rows", pa.list_(pa.binary())), ("firsts", pa.list_(pa.int32()))])
        held: dict[tuple[int, bytes], tuple[int, list, list]] = {}
        size = 0

        def flush():
            names, found = list(held), list(held.values())
            for k in range(0, len(names), 5000):
                part, own = names[k : k + 5000], found[k : k + 5000]
                yield record_batch(schema, [[h for h, _ in part], [p for _, p in part], [w for w, _, _ in own], [r for _, r, _ in own], [f for _, _, f in own]])
            held.clear()

        def put(h, piece, windows, row, first):
            nonlocal size
            _, rows, firsts = held.setdefault((h, piece), (windows, [], []))
            rows.append(row)
            firsts.append(first)
            size += 100 + (len(piece) if len(rows) == 1 else 0)

        for batch in sliced(batches, SCAN):
            for row, text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not found:
                    continue
                raw = text.encode()
                for run in found:
                    first, windows = run["first"], run["windows"]
                    if not run["hot"]:
                        put(run["h"], raw[first : first + windows - 1 + length], windows, row, first)
                        continue
                    for at in range(first, first + windows):
                        name = xxhash.xxh3_128_digest(raw[at : at + length])
                        put(int.from_bytes(name[:8], "little", signed=True), name, 1, row, at)
                if size > 16 * SCAN:
                    yield from flush()
                    size = 0
        yield from flush()

    # all columns go along in all three reads of ``texts``, so that they are one exchange
    pieces = texts.join(wanted.hint("shuffle_hash"), texts["row"] == wanted["run_row"], "left").select("row", "text", "runs", "doc_id").mapInArrow(cut, "h long, piece binary, windows int, rows array<binary>, firsts array<int>")

    def solve(batches):
        schema = pa.schema([("row", pa.binary()), ("start", pa.int32()), ("stop", pa.int32())])
        ids, starts, stops = [], [], []
        #: Pieces of the anchors that wait: the one place of a piece, or None where it has several, which were passed on.
        alone: dict[bytes, tuple | None] = {}
        group: dict[bytes, tuple | None] = {}
        size, last = 0, None

        def put(rows, firsts, a, b):
            ids.extend(rows)
            starts.extend(f + a for f in firsts)
            stops.extend(f + b for f in firsts)

        def out():
            found = record_batch(schema, [ids[:], starts[:], stops[:]])
            for column in (ids, starts, stops):
                column.clear()
            return found

        def close():
            """The last anchor's pieces wait to be merged, unless it has only one."""
            nonlocal size
            if len(group) > 1 and last is not None:
                alone.update(group)
                size += sum(map(len, group))
            group.clear()

        def solved():
            texts = list(alone)
            counts = np.array([1 if p else 2 for p in alone.values()])
            for windows, place in zip(repeated_windows(texts, counts, length), alone.values(), strict=True):
                if place and len(windows):
                    for s in np.split(windows, np.flatnonzero(np.diff(windows) > length) + 1):
                        put([place[0]], [place[1]], int(s[0]), int(s[-1]) + length)
            alone.clear()

        for batch in batches:
            for h, piece, windows, rows, firsts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if h != last:
                    close()
                    if size > CHUNK:
                        solved()
                        size = 0
                    last = h
                span = windows - 1 + length
                if piece not in group and len(rows) == 1:
                    group[piece] = (rows[0], firsts[0])
                    continue
                before = group.get(piece)
                if before:
                    put([before[0]], [before[1]], 0, span)
                group[piece] = None
                put(rows, firsts, 0, span)
                if len(ids) > 50_000:
                    yield out()
        close()
        if alone:
            solved()
        yield out()

    return pieces.repartition("h").sortWithinPartitions("h").mapInArrow(solve, "row binary, start int, stop int")


def without_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes of every row.

    Whole texts are dealt out once, by a row's name; the scan, the cutting of pieces and the removal read that deal.
    """
    row = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text")).cast("binary")))
    plain = id_and_text(docs).select(row.alias("row"), "text", "doc_id")
    texts = plain.repartition("row")
    found = repeated_spans(plain, texts, length, hot=hot)
    by_doc = found.groupBy(F.col("row").alias("span_row")).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    fields = [pa.field("doc_id", pa.int64()), pa.field("n_bytes", pa.int64()), pa.field("n_removed", pa.int64()), pa.field("n_spans", pa.int64()), pa.field("kept_sha256", pa.string())]
    schema = pa.schema(fields + [pa.field("kept", pa.binary())] * with_text)

    def remove(batches):
        for batch in sliced(batches):
            rows = []
            for doc_id, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = text.encode()
                kept, at, n_spans, end = [], 0, 0, -1
                for span in sorted(spans or [], key=lambda s: (s["start"], s["stop"])):
                    if span["start"] > end:
                        n_spans += 1
                        kept.append(raw[at : span["start"]])
                    end = max(end, span["stop"])
                    at = end
                kept.append(raw[at:])
                rest = b"".join(kept)
                rows.append((doc_id, len(raw), len(raw) - len(rest), n_spans, hashlib.sha256(rest).hexdigest(), rest))
            yield record_batch(schema, [list(c) for c in list(zip(*rows, strict=True))[: len(schema)]] if rows else [[]] * len(schema))

    kinds = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return texts.join(by_doc.hint("shuffle_hash"), texts["row"] == by_doc["span_row"], "left").select("doc_id", "text", "spans").mapInArrow(remove, kinds)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir))
