"""The pipeline's stages, each on its own input, and the whole against plain versions."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import corpus_pipeline as pipeline
import numpy as np
import pyarrow as pa
import pytest
from fixtures import documents, no_documents
from pyspark.sql import functions as F
from test_operators import WORD

from fieldloom.llm import bpe, mixing, near_dedup, registry, toxicity


def test_registration():
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries()
    assert {int(name[2:].split("_")[0]) for name in registry.queries()} == set(range(1, 11))
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "mixing", "bpe_encoding"]


def shingles(text: str, n: int = 5) -> frozenset:
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1)) or frozenset([tuple(words)] if words else [])


def plain_groups(texts: list[str]) -> list[int]:
    """For each text, the first one that it is reachable from over pairs of similarity 0.8 or more."""
    sets = [shingles(t) for t in texts]
    out = [-1] * len(sets)
    for i in range(len(sets)):
        if out[i] >= 0:
            continue
        out[i], front = i, [i]
        while front:
            a = front.pop()
            for b in range(len(sets)):
                if out[b] < 0 and (sets[a] == sets[b] or 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])):
                    out[b] = i
                    front.append(b)
    return out


def least_id(rows):
    return min(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))


def plain_mix(rows) -> Counter:
    """doc_id -> how often the mix takes its row, for rows with ids of their own."""
    size = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in rows}
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s))
    total = {s: sum(size[r["doc_id"]] for r in rows if r["source"] == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    target, left, free = {}, 1.5 * sum(total.values()), list(sources)
    while True:
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 2 * total[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2 * total[s]
            left -= target[s]
            free.remove(s)
    times: Counter = Counter()
    for s in sources:
        budget, whole = int(target[s] + 1e-6), int((target[s] + 1e-6) / total[s]) if total[s] else 0
        rest = budget - whole * total[s]
        for r in sorted((r for r in rows if r["source"] == s), key=lambda r: hashlib.md5(str(r["doc_id"]).encode()).hexdigest()):
            taken = whole * size[r["doc_id"]] + max(0, min(size[r["doc_id"]], rest))
            rest -= size[r["doc_id"]]
            if size[r["doc_id"]]:
                times[r["doc_id"]] += -(-taken // size[r["doc_id"]])
    return +times


def test_run_against_a_plain_pipeline(spark, sf_dir):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    rows = [r for r in docs.collect() if model.score(r["text"] or "") < toxicity.THRESHOLD]
    unique = list({r["text"] or "": r for r in sorted(rows, key=lambda r: r["doc_id"])}.values())  # the largest id of a text
    groups = plain_groups([r["text"] or "" for r in unique])
    near = [least_id([r for r, g in zip(unique, groups) if g == first]) for first in dict.fromkeys(groups)]
    times = plain_mix(near)
    own = Tokenizer.from_file(bpe.default_path())
    got = pipeline.run(spark, sf_dir).collect()
    assert Counter(r["doc_id"] for r in got) == times
    text = {r["doc_id"]: r["text"] or "" for r in near}
    assert all(r["ids"] == own.encode(text[r["doc_id"]], add_special_tokens=False).ids for r in got)


def odd_documents(spark):
    """Null ids, repeated rows and ids, a long text, and columns named like those that operators use inside."""
    clash = ["h", "row", "ref", "class", "order", "taken", "times", "_times", "_copy", "key", "dealt", "size", "name", "range", "hot_n", "slot", "t", "fp"]
    texts = ["same", "other text", "same", "same", "uniq", "uniq", None, "", "a b c d e f g h", "a b c d e f g h", "long " * 60_000 + "end", "".join(f"w{i} " for i in range(40_000))]
    ids = [1, 1, 5, None, 7, 7, None, 10, None, None, 12, None]
    rows = [(i, t, "en", ["s", None][k % 2], 1, *[f"{c}{k % 3}" for c in clash]) for k, (i, t) in enumerate(zip(ids, texts))]
    rows += [rows[4], rows[8]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in clash)).repartition(3)


def test_stages_on_odd_rows(spark, sf_dir):
    docs = odd_documents(spark).persist()
    rows = docs.collect()
    assert Counter(pipeline.toxicity_stage(spark, docs, sf_dir).collect()) == Counter(rows)  # nothing toxic here
    for stage, expected in ((pipeline.exact_dedup_stage, 7), (pipeline.near_dedup_stage, 7)):
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == docs.columns
        found = kept.collect()
        assert len(found) == expected and not Counter(found) - Counter(rows)
        assert {r["text"] or "" for r in found} == {r["text"] or "" for r in rows}
    assert {r["doc_id"] for r in pipeline.exact_dedup_stage(spark, docs, sf_dir).where("text = 'same'").collect()} == {5}
    assert {r["doc_id"] for r in pipeline.near_dedup_stage(spark, docs, sf_dir).where("text = 'same'").collect()} == {1}
    mixed = pipeline.mixing_stage(spark, docs, sf_dir)
    assert mixed.columns == docs.columns
    found = Counter(mixed.collect())
    assert set(found) <= set(rows)
    words, size = Counter(), Counter()
    for r, n in found.items():
        words[r["source"]] += n * len(WORD.findall(r["text"] or ""))
    for r in rows:
        size[r["source"]] += len(WORD.findall(r["text"] or ""))
    assert all(n <= 2 * Counter(rows)[r] for r, n in found.items()) and all(words[s] <= 2 * size[s] for s in size)
    encoded = pipeline.encoding_stage(spark, docs, sf_dir)
    assert Counter(r["decoded_sha256"] for r in encoded.collect()) == Counter(hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in rows)


def test_row_counts_of_the_mix(spark):
    """A repeated row is taken by itself, and a row without an id as any other."""
    docs = spark.createDataFrame([(1, "a b c", "s"), (1, "a b c", "s"), (None, "d e f", "s")], "doc_id long, text string, source string")
    plan = mixing.mixture(docs).collect()
    assert sum(r["taken"] for r in plan) == 13
    assert sum(-(-r["taken"] // r["size"]) for r in plan) == mixing.mixed_rows(docs).count()


def test_stages(spark, sf_dir):
    docs = documents(spark).persist()
    columns = docs.columns
    rows = {r["doc_id"]: r for r in docs.collect()}
    clean = pipeline.toxicity_stage(spark, docs, sf_dir)
    assert clean.columns == columns and {r["doc_id"] for r in clean.collect()} <= set(rows)
    unique = pipeline.exact_dedup_stage(spark, docs, sf_dir).persist()
    texts = [r["text"] or "" for r in unique.collect()]
    assert unique.columns == columns and len(texts) == len(set(texts)) == len({r["text"] or "" for r in rows.values()})
    near = pipeline.near_dedup_stage(spark, unique, sf_dir).persist()
    left = unique.collect()
    groups = plain_groups([r["text"] or "" for r in left])
    expected = {least_id([r for r, g in zip(left, groups) if g == first])["doc_id"] for first in set(groups)}
    assert near.columns == columns and {r["doc_id"] for r in near.collect()} == expected
    mixed = pipeline.mixing_stage(spark, near, sf_dir)
    assert mixed.columns == columns and Counter(r["doc_id"] for r in mixed.collect()) == plain_mix(near.collect())
    encoded = pipeline.encoding_stage(spark, mixed, sf_dir)
    assert Counter(r["doc_id"] for r in encoded.collect()) == Counter(r["doc_id"] for r in mixed.collect())


@pytest.mark.parametrize("stage", [f for _, f in pipeline.STAGES], ids=[n for n, _ in pipeline.STAGES])
def test_stages_on_an_empty_table(spark, sf_dir, stage):
    assert stage(spark, no_documents(spark), sf_dir).count() == 0


def test_run_keeps_whole_documents(spark, sf_dir):
    out = pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    got = out.collect()
    source = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert got and all(r["decoded_sha256"] == hashlib.sha256((source[r["doc_id"]] or "").encode()).hexdigest() and len(r["ids"]) == r["n_tokens"] for r in got)


def test_near_copies_by_similarity(spark):
    """Nine in ten of all pairs of similarity 0.8 and more are linked, 98 % of 0.9 and more, and nothing under 0.8."""
    rng = random.Random(5)
    rows, similar = [], {}
    for k in range(400):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        near, far = list(words), list(words)
        for at in rng.sample(range(10, 190, 6), 1 + k % 4):
            near[at] = "changed"
        for at in range(10, 190, 18):
            far[at] = "other"
        rows += [(3 * k, " ".join(words)), (3 * k + 1, " ".join(near)), (3 * k + 2, " ".join(far))]
        a, b, c = (shingles(rows[3 * k + i][1]) for i in range(3))
        similar[k] = len(a & b) / len(a | b)
        assert len(a & c) < 0.8 * len(a | c) and len(b & c) < 0.8 * len(b | c)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs, 5).collect()}
    pairs = [k for k, s in similar.items() if s >= 0.8]
    linked = {k for k in similar if got[3 * k + 1] == 3 * k}
    assert len(pairs) >= 380 and linked <= set(pairs)
    assert len(linked) >= 0.9 * len(pairs)
    close = {k for k in pairs if similar[k] >= 0.9}
    assert len(linked & close) >= 0.98 * len(close) and len(close) >= 180
    assert all(got[3 * k + 2] == 3 * k + 2 for k in similar)


def test_large_buckets_are_dealt_again(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = [(i, " ".join([*words[: 40 + i], f"own{i}", *words[40 + i :]])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for split in (8, 1 << 16):
        classes = near_dedup.classed(docs, 5).select("class", "prints")
        roots = near_dedup.components(near_dedup.candidate_links(classes, split)).collect()
        assert len({r["root"] for r in roots}) == 1 and len(roots) == 59
    assert {r["component_id"] for r in near_dedup.near_duplicates(docs, 5).collect()} == {0}


def test_uneven_clusters_go_by_reachability(spark):
    """A chain of near copies whose ends are far apart, and two groups that only candidates join."""
    rng = random.Random(7)
    words = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows = []
    for i in range(8):
        rows.append((i, " ".join(words)))
        words = words[6:] + [f"x{rng.randrange(5000)}" for _ in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [shingles(t) for _, t in rows]
    assert len(sets[0] & sets[7]) < 0.8 * len(sets[0] | sets[7])
    names = near_dedup.classed(docs, 5).select("doc_id", "class").collect()
    first = min(r["class"] for r in names)
    clusters = spark.createDataFrame([(r["class"], first) for r in names], "node long, root long")
    found = {r["member"]: r["lead"] for r in near_dedup.leads(docs, clusters, 5).collect()}
    groups = plain_groups([t for _, t in rows])
    number = {r["class"]: r["doc_id"] for r in names}
    for r in names:
        lead = found.get(r["class"], r["class"])
        assert groups[number[lead]] == groups[r["doc_id"]]
    assert len({found.get(r["class"], r["class"]) for r in names}) == len(set(groups))


def test_members_of_buckets_travel_packed(spark):
    """Few rows for all members, not 150 for every class, and each member once in every table."""
    rng = np.random.default_rng(8)
    rows = [(0, i, int(own), int(guard), i % 10) for i, (own, guard) in enumerate(zip(rng.integers(0, 1 << 48, 500), rng.integers(0, 1 << 62, 500), strict=True))]
    frame = spark.createDataFrame(rows, "key long, class long, own long, guard long, k int").coalesce(1)
    found = near_dedup.dealt(frame, 4).collect()
    assert len(found) <= 40 and all(r["slice"] // 4 == r["k"] for r in found)
    members = np.concatenate([np.frombuffer(bytes(r["members"]), near_dedup.MEMBER) for r in found])
    assert len(members) == 500 * len(near_dedup.MASKS) and (np.bincount(members["class"]) == len(near_dedup.MASKS)).all()


def test_buckets_of_a_slice(monkeypatch):
    """Links join the pairs that plain comparison joins, whatever is held; every member of a large bucket comes out once."""
    rng = np.random.default_rng(9)
    members = np.zeros(3000, near_dedup.MEMBER)
    members["key"] = np.where(rng.random(3000) < 0.1, 7, rng.integers(10, 900, 3000))
    members["class"] = rng.permutation(3000)
    base = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    members["guard"] = base[rng.integers(0, 3, 3000)] ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64))
    expected = {}
    for key in set(members["key"].tolist()) - {7}:
        rows = members[members["key"] == key]
        a, b = near_dedup.guarded(rows["class"], rows["guard"].view(np.int64))
        expected |= {(int(x), int(y)): key for x, y in zip(a, b, strict=True)}
    batches = [pa.RecordBatch.from_arrays([pa.array([0]), pa.array([2], pa.int32()), pa.array([members[i : i + 100].tobytes()], pa.binary())], names=["slice", "k", "members"]) for i in range(0, 3000, 100)]
    for held in (near_dedup.HELD, 200):
        monkeypatch.setattr(near_dedup, "HELD", held)
        rows = [r for batch in near_dedup._bucket_rows(100)(iter(batches)) for r in batch.to_pylist()]
        assert {(r["a"], r["b"]) for r in rows if r["key"] is None} == set(expected) and all(r["k"] == 2 for r in rows)
        assert sorted(r["a"] for r in rows if r["key"] == 7) == sorted(members["class"][members["key"] == 7].tolist())
        assert all(r["key"] in (None, 7) for r in rows)


def test_only_texts_in_clusters_are_read_again(spark):
    """A text that shares its class with no other and has no near copy is not in the table of those to be looked at."""
    rows = [(i, f"text {i} of words that no other text has {i} {i + 1} {i + 2}") for i in range(200)] + [(500, "Text 3 of words that no other text has 3 4 5")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_dedup.classed(docs, 5)
    several = found.groupBy("class").count().where("count > 1").select("class")
    assert near_dedup.flagged(found, several).count() == 2
    assert sorted(r["doc_id"] for r in near_dedup.drop_near_copies(docs, 5).collect()) == list(range(200))
