import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from cohortspark.llm import simhash
from cohortspark.llm.simhash import MOST, SEGMENTS, WIDTHS, STARTS, fingerprint, forest_of_place, links_by_segment, near_duplicates, op12_simhash
from helpers import awkward_texts, clashing, documents
from pyspark.sql import functions as F

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    words = WORD.findall((text or "").encode().lower())
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def reached(fps):
    """The smallest place reachable by links of each."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= MOST:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(fps))]


def near(rng, fp, most):
    for bit in rng.sample(range(64), rng.randint(0, most)):
        fp ^= 1 << bit
    return fp


def crowd(seed, n=400):
    """Fingerprints in balls and chains, and some of few bits."""
    rng = random.Random(seed)
    out = [0, 1, 3, (1 << 64) - 1]
    while len(out) < n:
        fp = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 30])):
            out.append(near(rng, fp, 6))
            if rng.random() < 0.3:
                fp = out[-1]
    return list(dict.fromkeys(out))


def test_ring_has_a_start_for_every_link():
    rng = random.Random(1)
    for _ in range(3000):
        bits = rng.sample(range(64), rng.randint(0, MOST))
        each = [sum(STARTS[i] <= b < STARTS[i] + WIDTHS[i] for b in bits) for i in range(SEGMENTS)]
        chains = ([sum(each[(i + k) % SEGMENTS] for k in range(length)) for length in range(1, SEGMENTS + 1)] for i in range(SEGMENTS))
        assert any(all(SEGMENTS * d <= MOST * (k + 1) for k, d in enumerate(chain)) for chain in chains)


@pytest.mark.parametrize("pairs", [1 << 20, 50])
def test_places(monkeypatch, pairs):
    """All places together connect what links connect, and report no more links than a forest has."""
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    fps = crowd(4)
    links = []
    for i in range(SEGMENTS):
        order, found = forest_of_place(np.array(fps, np.uint64), i)
        assert len(found) < len(fps)
        links += [(int(order[a]), int(order[b])) for a, b in found]
    assert all((a ^ b).bit_count() <= MOST for a, b in links)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    want = reached(fps)
    assert len({(find(f), w) for f, w in zip(fps, want)}) == len(set(want)) == len({find(f) for f in fps})


@pytest.mark.parametrize("depth, crowded", [(0, 10**6), (4, 10**6), (12, 10**6), (0, 50), (3, 10), (12, 2)])
def test_links(spark, depth, crowded):
    """Also with limits so low that places are dealt anew."""
    fps = crowd(depth + crowded, 250)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    links = [(r.u % (1 << 64), r.v % (1 << 64)) for r in links_by_segment(df, depth, crowded).collect()]
    assert all((a ^ b).bit_count() <= MOST for a, b in links)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    want = reached(fps)
    assert len({(find(f), w) for f, w in zip(fps, want)}) == len(set(want)) == len({find(f) for f in fps})


def edited(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = awkward_texts() + ["A b  c", "a B c", "a b c d", "a b c d\n"]
    for _ in range(12):
        words = [word() for _ in range(rng.randint(80, 300))]
        for _ in range(rng.randint(1, 6)):
            copy = list(words)
            for _ in range(rng.choice([0, 1, 2])):
                copy[rng.randrange(len(copy))] = word()
            texts.append("\t".join(copy).upper())
    return texts


def test_documents(spark, tmp_path):
    texts = edited(7)
    path = str(tmp_path / "documents.parquet")
    clashing(documents(spark, texts)).write.parquet(path)
    fps = [plain_fingerprint(t) for t in texts]
    want = reached(fps)
    assert len(set(want)) < len(set(fps)) < len(texts)
    got = {r.doc_id: r for r in op12_simhash(spark, str(tmp_path)).collect()}
    assert [(got[i].fingerprint, got[i].component_id) for i in range(len(texts))] == [(f"{f:016x}", w) for f, w in zip(fps, want)]
    for settings in ({"group": 3}, {"group": 10**6, "crowded": 5}):
        rows = near_duplicates(spark.read.parquet(path), **settings).collect()
        assert sorted((r.id, r.component) for r in rows) == list(enumerate(want))


def test_pieces_make_no_difference(monkeypatch):
    texts = [(t or "").encode() for t in edited(8)]
    whole = [fingerprint(t) for t in texts]
    for size in (1, 30, 1000):
        monkeypatch.setattr(simhash, "PIECE", size)
        assert [fingerprint(t) for t in texts] == whole


def test_repeated_rows_missing_ids_and_no_rows(spark):
    docs = documents(spark, ["same text here", "other words in this one", None], first=5)
    twice = docs.union(docs.withColumn("doc_id", F.lit(None).cast("long")))
    rows = near_duplicates(twice).collect()
    assert sorted(((r.id or 0, r.component) for r in rows)) == [(0, 5), (0, 6), (0, 7), (5, 5), (6, 6), (7, 7)]
    assert near_duplicates(docs.limit(0)).count() == 0
