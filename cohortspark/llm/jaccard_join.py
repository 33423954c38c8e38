"""Documents that share three quarters of their word shingles, by T-occurrence search over inverted lists.

Only shingles that two different sets hold can be part of an overlap. So the shingles of all documents are dealt into
buckets, each bucket finds which occur more than once and how often (counted up to ``LONG``), and tells the documents.
A document of n shingles needs at least T = ceil(0.75 n) in common with a partner, so one with fewer shared shingles is
done. The others search:

* First round, to contract groups of near copies, whose pairs would grow with their square: in the ``FIRST`` lists with the
  smallest hashes of each document, every document meets the one with the fewest shingles of its own. Verified links
  make components.
* Second round, by DivideSkip: the lists of a document are put in order of length (the same order for all documents), and the
  T - t longest are left out of the merge. The others, of which a partner is in at least t, are merged: only lists with
  documents of different components, as pairs inside one are linked already. Short lists are merged by a heap, and
  whoever is in t of them is a candidate. Where a document's short lists are so few that a partner might be in none of them,
  its remaining lists are long; these are not merged, but the documents outside the list's main component meet the
  others in it.
* The lists that were left out are probed: a candidate's sorted shingles are looked up by bisection, all of them, so the
  overlap is exact.
* Pairs are left out when the shared shingles of either document are too few for the overlap that both sizes ask for.

Equal sets are one class throughout (a 64-bit digest of the set names it, shingles are 64-bit hashes of which at least
48 bits are compared), so copies are never expanded into pairs. Components come from links by minimum steps; each is
named by its smallest id. Sets travel packed, one row for a bucket and task, which keeps shuffles near six bytes a
shingle. A shingle that very many documents of one task hold goes straight to these documents; its bucket only gets one
note of it. Beyond ``PARTS`` buckets, each is dealt out once more by further bits of the hash, so none grows with the input.
For verification only documents that are in a pair are read, and their sets travel by themselves, not with stored pairs.

Defined results: null and empty texts and texts of white space have no shingles and are linked with nothing; repeated
rows are linked; rows without id take part and may have a null component; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.common import slices, table, text_of
from cohortspark.llm.components import connected_components
from cohortspark.llm.registry import query
from cohortspark.llm.shingles import set_key, shingle_sets
from cohortspark.sources.checkpoints import durable, release

#: Per cent of the union that linked documents share at least.
SIMILAR = 75

#: Shingles of a bucket, shingles that a task gathers before it sends them, documents of a task that make a shingle frequent.
BUCKET, GATHERED, FREQUENT = 3_000_000, 1_000_000, 64

#: List lengths are told apart up to here; longer lists are long ones.
LONG = 64

#: Lists of the first round, and lists that a candidate of the second round has to be in (t), for each document.
FIRST, OCCURRENCES = 16, 4

#: Buckets of the first shuffle at most (their number takes 16 bits of the hash).
PARTS = 1 << 16

#: Entries of merged lists that a task is given.
MERGED = 2_000_000

#: Parts of the hash in which the shared shingles of a document are counted.
BINS = 64

LOW = np.uint64((1 << 48) - 1)


def required(n: np.ndarray | int) -> np.ndarray | int:
    """Smallest overlap of a set of n with a similar one."""
    return -(-SIMILAR * n // 100)


def occurrences(n: int) -> int:
    """In how many of the lists that are merged (t) a partner of a set of n has to be."""
    return min(OCCURRENCES, int(required(n)))


def least_occurrences(n: int) -> int:
    """The smallest such number of both, as a similar set may be smaller."""
    return occurrences(int(required(n)))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, list[np.ndarray]]]:
    """Batches with an offset and the shingle sets of the rows from there."""
    for batch in batches:
        done = 0
        for part in slices(batch.column("text"), 1 << 20):
            yield batch, done, list(shingle_sets([t.encode() for t in part.to_pylist()]))
            done += len(part)


def keyed_documents(docs: DataFrame) -> DataFrame:
    """(id, key, n): the class of each document's set, null for an empty one, and the size of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, done, sets in _sets(batches):
            keys = pa.array([set_key(s) if len(s) else None for s in sets], pa.int64())
            sizes = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(done, len(sets)), keys, sizes], ["id", "key", "n"])

    return docs.select("id", "text").mapInArrow(run, "id long, key long, n long")


# --- packed shingles -------------------------------------------------------------------------------------------------

PACKED = "part long, keys binary, sizes binary, counts binary, hashes binary, lengths binary, notes binary"
PACKED_NAMES = [c.split()[0] for c in PACKED.split(", ")]


def _short(hashes: np.ndarray) -> bytes:
    """The low six bytes of each."""
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unshort(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(values)))


def _pack(part: int, owner: np.ndarray, keys: np.ndarray, sizes: np.ndarray, hashes: bytes, lengths: bytes = b"", notes: bytes = b"") -> tuple:
    """A row; ``owner`` has for each hash the place of its document in ``keys`` and ``sizes``, in groups.

    Hashes of a document cost eleven bytes besides their own: its key, its size in two bytes where all sizes of the row fit,
    and their number, up to 255 at a time.
    """
    starts, counts = _runs(owner)
    pieces = -(-counts // 255)
    at = np.repeat(owner[starts], pieces)
    numbers = np.full(len(at), 255, np.uint8)
    numbers[np.cumsum(pieces) - 1] = counts - 255 * (pieces - 1)
    held = sizes[at]
    kind = np.uint16 if held.max(initial=0) < 1 << 16 else np.uint32
    return (part, keys[at].tobytes(), held.astype(kind).tobytes(), numbers.tobytes(), hashes, lengths, notes)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), *[pa.binary()] * 6]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], PACKED_NAMES)


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def packed_shingles(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows of packed shingles for each bucket; parts from ``buckets`` on hold frequent shingles, for their documents only."""

    def emit(keys: list[int], sets: list[np.ndarray], turn: int) -> Iterator[pa.RecordBatch]:
        key, size = np.array(keys, np.int64), np.array([len(s) for s in sets])
        every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        crowded = np.bincount((every >> np.uint64(44)).astype(np.int64), minlength=1 << 20) >= FREQUENT
        some = np.flatnonzero(crowded[(every >> np.uint64(44)).astype(np.int64)])
        values, times = np.unique(every[some], return_counts=True)
        frequent = values[times >= FREQUENT]
        bucket = ((every >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        note = ((frequent >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        if len(frequent):
            direct = some[np.isin(every[some], frequent)]
            full = (bucket[direct] << np.uint64(48)) | (every[direct] & LOW)
            yield _rows([_pack(buckets + (int(key[0]) + turn) % buckets, owner[direct], key, size, full.tobytes(), bytes([LONG]) * len(full))])
            keep = np.ones(len(every), bool)
            keep[direct] = False
            every, owner, bucket = every[keep], owner[keep], bucket[keep]
        order = np.argsort(bucket.astype(np.uint16), kind="stable")  # at most PARTS buckets
        every, owner, bucket = every[order], owner[order], bucket[order]
        rows = []
        ends = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
        for b in range(buckets):
            part, noted = slice(ends[b], ends[b + 1]), frequent[note == b] if len(frequent) else frequent
            if ends[b] < ends[b + 1] or len(noted):
                rows.append(_pack(b, owner[part], key, size, _short(every[part]), notes=_short(noted)))
        yield _rows(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: dict[int, np.ndarray] = {}
        total = turn = 0
        for _, _, sets in _sets(batches):
            for s in sets:
                if len(s) and (key := set_key(s)) not in gathered:
                    gathered[key] = s
                    total += len(s)
            if total >= GATHERED:
                yield from emit(list(gathered), list(gathered.values()), turn)
                gathered, total, turn = {}, 0, turn + 1
        if gathered:
            yield from emit(list(gathered), list(gathered.values()), turn)

    return docs.select("text").mapInArrow(run, PACKED)


def split_buckets(packed: DataFrame, buckets: int, bits: int) -> DataFrame:
    """Packed rows whose bucket is split by so many further bits of the hash; one part after the other is gathered.

    A part's new number tells its bucket and the bits.
    """

    def cut(part: int, rows: list[dict]) -> pa.RecordBatch:
        found = pa.Table.from_pylist(rows, pa.schema([(n, pa.int64() if n == "part" else pa.binary()) for n in PACKED_NAMES]))
        if part >= buckets:  # frequent shingles, which are on their way to documents already
            return found.set_column(0, "part", pa.array([part << bits] * len(rows), pa.int64())).combine_chunks().to_batches()[0]
        keys, sizes = _unpacked(found)
        low = _unshort(b"".join(found["hashes"].to_pylist()))
        notes = np.unique(_unshort(b"".join(found["notes"].to_pylist())))
        shift = np.uint64(48 - bits)
        order = np.lexsort((keys, low >> shift))
        low, keys, sizes = low[order], keys[order], sizes[order]
        places = np.arange(1 << bits, dtype=np.uint64)
        starts, ends = (np.searchsorted(low >> shift, places, side) for side in ("left", "right"))
        firsts, lasts = (np.searchsorted(notes >> shift, places, side) for side in ("left", "right"))
        made = []
        for sub in range(1 << bits):
            at, noted = slice(starts[sub], ends[sub]), notes[firsts[sub] : lasts[sub]]
            if starts[sub] < ends[sub] or len(noted):
                first, counts = _runs(keys[at])
                owner = np.repeat(np.arange(len(first)), counts)
                made.append(_pack(part << bits | sub, owner, keys[at][first], sizes[at][first], _short(low[at]), notes=_short(noted)))
        return _rows(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size = None, [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["part"] != part or size >= 6 * GATHERED):
                    yield cut(part, held)
                    held, size = [], 0
                part = row["part"]
                held.append(row)
                size += len(row["hashes"])
        if held:
            yield cut(part, held)

    return packed.repartition("part").sortWithinPartitions("part").mapInArrow(run, PACKED)


def _unpacked(found: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Key and size for each hash."""
    counts = _joined(found["counts"], np.uint8)
    sizes = [
        np.frombuffer(size, np.uint16 if len(size) == 2 * len(count) else np.uint32).astype(np.uint32)
        for size, count in zip(found["sizes"].to_pylist(), found["counts"].to_pylist())
    ]
    return np.repeat(_joined(found["keys"], np.int64), counts), np.repeat(np.concatenate(sizes), counts)


def shared_shingles(packed: DataFrame, buckets: int, parts: int, bits: int = 0) -> DataFrame:
    """The shingles that several sets hold, with list lengths up to ``LONG``, packed for ``parts`` groups of documents.

    ``bits`` is by how many bits of the hash buckets have been split.
    """

    def run(found: pa.Table) -> pa.Table:
        part = found["part"][0].as_py() >> bits
        key, size = _unpacked(found)
        if part >= buckets:
            full, length = _joined(found["hashes"], np.uint64), _joined(found["lengths"], np.uint8)
        else:
            low = _unshort(b"".join(found["hashes"].to_pylist()))
            noted = np.unique(_unshort(b"".join(found["notes"].to_pylist())))
            order = np.argsort(low, kind="stable")
            starts, counts = _runs(low[order])
            often = np.repeat((counts > 1) | np.isin(low[order][starts], noted), counts)
            order = order[often]
            order = order[np.lexsort((key[order], low[order]))]
            low, key, size = low[order], key[order], size[order]
            first = np.ones(len(low), bool)  # copies in several tasks count once
            first[1:] = (low[1:] != low[:-1]) | (key[1:] != key[:-1])
            low, key, size = low[first], key[first], size[first]
            starts, counts = _runs(low)
            counts = np.where(np.isin(low[starts], noted), LONG, np.minimum(counts, LONG))
            length = np.repeat(counts, np.diff(np.append(starts, len(low)))).astype(np.uint8)
            keep = length > 1
            low, key, size, length = low[keep], key[keep], size[keep], length[keep]
            full = (np.uint64(part) << np.uint64(48)) | low
        group = (key.view(np.uint64) % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((key, group))
        full, key, size, length, group = full[order], key[order], size[order], length[order], group[order]
        rows = []
        for start, count in zip(*_runs(group)):
            s = slice(start, start + count)
            first, lengths_of = _runs(key[s])
            owner = np.repeat(np.arange(len(first)), lengths_of)
            rows.append(_pack(int(group[start]), owner, key[s][first], size[s][first], full[s].tobytes(), length[s].tobytes()))
        return pa.Table.from_batches([_rows(rows)])

    return packed.groupBy("part").applyInArrow(run, PACKED)


def searchers(shared: DataFrame) -> DataFrame:
    """(key, n, shared, first, lists, bins): documents with enough shared shingles, these sorted, the lists of the first
    round, and the lists to merge in the second.

    ``bins`` has how many of the shared ones fall into each of ``BINS`` parts of the hash; null if that is over a byte.
    """
    names = ["key", "n", "shared", "first", "lists", "bins"]

    def run(found: pa.Table) -> pa.Table:
        key, size = _unpacked(found)
        full, length = _joined(found["hashes"], np.uint64), _joined(found["lengths"], np.uint8)
        order = np.lexsort((full, key))
        full, key, size, length = full[order], key[order], size[order].astype(np.int64), length[order]
        first = np.ones(len(full), bool)
        first[1:] = (full[1:] != full[:-1]) | (key[1:] != key[:-1])
        full, key, size, length = full[first], key[first], size[first], length[first]
        starts, counts = _runs(key)
        made: list[list] = [[] for _ in names]
        for start, count in zip(starts.tolist(), counts.tolist()):
            n, spare = int(size[start]), count - required(int(size[start]))
            if spare >= 0:
                own = full[start : start + count]
                shortest = np.argsort(length[start : start + count], kind="stable")[: spare + occurrences(n)]
                bins = np.bincount((own % np.uint64(BINS)).astype(np.int64), minlength=BINS)
                held = bins.astype(np.int8) if bins.max() < 128 else None
                lists = (own[:FIRST].view(np.int64), own[shortest].view(np.int64))
                for column, value in zip(made, (int(key[start]), n, own.tobytes(), *lists, held)):
                    column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int8())]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(made, kinds)], names)

    return shared.groupBy("part").applyInArrow(run, "key long, n long, shared binary, first array<long>, lists array<long>, bins array<tinyint>")


# --- search ----------------------------------------------------------------------------------------------------------


def may_be_similar(n: Column, m: Column, other_n: Column, other_m: Column) -> Column:
    """Whether two documents of n shingles, m of them shared with any other, could have the overlap that they need."""
    return (100 + SIMILAR) * F.least(m, other_m) >= SIMILAR * (n + other_n)


def may_overlap_enough(n: Column, bins: Column, other_n: Column, other_bins: Column) -> Column:
    """The same by bins of the hash: two documents have at most the smaller of their numbers in each bin in common."""
    most = F.aggregate(F.zip_with(bins, other_bins, lambda a, b: F.least(a, b).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.coalesce((100 + SIMILAR) * most >= SIMILAR * (n + other_n), F.lit(True))


def t_occurrence(lists: list[list[int]], least: int) -> Iterator[int]:
    """The values that are in at least so many sorted lists, by merging the lists with a heap."""
    last, times = None, 0
    for value in heapq.merge(*lists):
        if value != last:
            if last is not None and times >= least:
                yield last
            last, times = value, 0
        times += 1
    if last is not None and times >= least:
        yield last


def probed_overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted sets: the smaller one's elements are looked up in the larger by bisection."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def verified(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """The pairs (u, v) that are similar, as (u, v). ``pairs`` is stored; it is small where ``documents`` are large.

    Only sets of documents in a pair are read. A set travels once for each pair it is ``u`` of, and once as ``v``.
    """

    def sets(name: str) -> DataFrame:
        wanted = pairs.select(F.col(name).alias("key")).distinct()
        held = documents.select("key", "n", "shared").join(wanted, "key", "left_semi")
        return held.select(F.col("key").alias(name), F.col("n").alias(f"n_{name}"), F.col("shared").alias(f"s_{name}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = zip(batch.column("n_u").to_pylist(), batch.column("n_v").to_pylist())
            held = zip(batch.column("s_u"), batch.column("s_v"))
            keep = []
            for (n, m), (a, b) in zip(sizes, held):
                common = probed_overlap(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64))
                keep.append(100 * common >= SIMILAR * (n + m - common))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    met = pairs.join(sets("u"), "u").join(sets("v"), "v").select("u", "v", "n_u", "n_v", "s_u", "s_v")
    return met.mapInArrow(run, "u long, v long")


def first_pairs(postings: DataFrame) -> DataFrame:
    """In each list, every document with the one that has the fewest shingles of its own, the smallest of several.

    That one is as close to the others as a member of the list can be: the original among its edited copies, or the
    document that is hardly more than the passage that all share. It comes second in its pairs.
    """
    hub = F.min(F.struct((F.col("n") - F.col("m")).alias("own"), "n", "key", "m"))
    hubs = durable(postings.groupBy("hash").agg(hub.alias("hub"), F.count("*").alias("docs")).where(F.col("docs") > 1))
    near = hubs.select("hash", F.col("hub.key").alias("v"), F.col("hub.n").alias("n_v"), F.col("hub.m").alias("m_v"))
    met = postings.join(near, "hash").where(F.col("key") != F.col("v"))
    could = may_be_similar(F.col("n"), F.col("m"), F.col("n_v"), F.col("m_v"))
    pairs = durable(met.where(could).select(F.col("key").alias("u"), "v").distinct())
    release(hubs)
    return pairs


def later_pairs(postings: DataFrame, components: DataFrame, documents: DataFrame) -> DataFrame:
    """Pairs of documents from different components that the lists suggest."""
    named = postings.join(components.select(F.col("u").alias("key"), F.col("v").alias("root")), "key", "left")
    named = durable(named.select("hash", "key", "n", "m", F.coalesce("root", "key").alias("root")))
    lists = named.groupBy("hash").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("docs"))
    lists = durable(lists.where(F.col("a") != F.col("b")).select("hash", "docs"))
    mixed = durable(named.join(lists, "hash"))
    release(named, lists)

    short = mixed.where(F.col("docs") < LONG)
    entries = short.agg(F.sum("docs")).first()[0] or 0  # of all lists, once for each of their documents
    held = short.groupBy("hash").agg(F.sort_array(F.collect_list(F.struct("key", "n", "m", "root"))).alias("held"))
    one = held.repartition(-(-entries // MERGED) or 1, "hash").select(F.explode("held").alias("own"), "held")
    own = F.col("own")
    partners = F.transform(
        F.filter("held", lambda x: (x.key < own.key) & (x.root != own.root) & may_be_similar(x.n, x.m, own.n, own.m)),
        lambda x: x.key,
    )
    merged = one.select(F.col("own.key").alias("u"), F.col("own.n").alias("n"), partners.alias("list")).where(F.size("list") > 0)
    merged = merged.groupBy("u", "n").agg(F.collect_list("list").alias("lists"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for u, n, lists in zip(*(batch.column(c).to_pylist() for c in ("u", "n", "lists"))):
                found = list(t_occurrence(lists, least_occurrences(n)))
                yield pa.RecordBatch.from_pydict({"u": pa.array([u] * len(found), pa.int64()), "v": pa.array(found, pa.int64())})

    pairs = merged.mapInArrow(search, "u long, v long")

    long = mixed.where(F.col("docs") >= LONG).select("hash", "key", "n", "m", "root")
    long = durable(long.join(documents.select("key", "bins"), "key"))
    sizes = long.groupBy("hash", "root").agg(F.count("*").alias("size"))
    main = durable(sizes.groupBy("hash").agg(F.max(F.struct("size", "root")).getField("root").alias("main")))
    outside = durable(long.join(main, "hash").where(F.col("root") != F.col("main")))
    other = long.select("hash", F.col("key").alias("v"), F.col("n").alias("n_v"), F.col("m").alias("m_v"), F.col("root").alias("root_v"), F.col("bins").alias("bins_v"))
    could = may_be_similar(F.col("n"), F.col("m"), F.col("n_v"), F.col("m_v"))
    could = could & may_overlap_enough(F.col("n"), F.col("bins"), F.col("n_v"), F.col("bins_v"))
    met = outside.join(other, "hash").where((F.col("root") != F.col("root_v")) & could)
    both = durable(pairs.unionByName(met.select(F.greatest("key", "v").alias("u"), F.least("key", "v").alias("v"))).distinct())
    release(mixed, long, main, outside)
    return both


def similar_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket: int = BUCKET, parts: int = PARTS
) -> DataFrame:
    """(id, n, component, key) for every row: size of its shingle set, the smallest id reachable by links, its class."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), text_of(f"`{text}`").alias("text"))
    keyed = durable(keyed_documents(rows))
    classes = durable(keyed.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("id").alias("least"), F.max("n").alias("n")))
    total = classes.agg(F.sum("n")).first()[0] or 0
    wanted = -(-total // bucket) or 1
    bits = max(0, (-(-wanted // parts) - 1).bit_length())
    buckets = parts if bits else wanted
    packed = packed_shingles(rows, buckets)
    if bits:
        packed = split_buckets(packed, buckets, bits)
    shared = shared_shingles(packed, buckets, parts=-(-wanted // 2), bits=bits)
    documents = durable(searchers(shared))
    sized = documents.withColumn("m", (F.octet_length("shared") / 8).cast("long"))
    first = durable(sized.select("key", "n", "m", F.explode("first").alias("hash")))
    pairs = first_pairs(first)
    links = durable(verified(pairs, documents))
    components = connected_components(links)
    release(first, pairs, links)
    postings = durable(sized.select("key", "n", "m", F.explode("lists").alias("hash")))
    pairs = later_pairs(postings, components, documents)
    more = durable(verified(pairs, documents))
    release(postings, pairs, documents)
    if not more.isEmpty():
        components = connected_components(components.unionByName(more))
    rooted = classes.join(components.select(F.col("u").alias("key"), F.col("v").alias("root")), "key", "left")
    rooted = durable(rooted.select("key", F.coalesce("root", "key").alias("root"), "least"))
    smallest = durable(rooted.groupBy("root").agg(F.min("least").alias("component")))
    named = durable(rooted.join(smallest, "root").select("key", "component"))
    release(rooted, smallest, classes)
    met = keyed.join(named, "key", "left")
    return met.select("id", "n", F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component")).alias("component"), "key")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The documents with all their columns, of each component only the one with the smallest id.

    Documents without shingles or without id stay; of several rows with the smallest id one stays. The documents that go
    are few, so these are taken out of the others, whose texts need not be shuffled then.
    """
    found = durable(similar_documents(docs))
    known = found.where(F.col("id").isNotNull())
    leads = F.col("key").isNotNull() & (F.col("id") == F.col("component"))
    ids = known.groupBy("id").agg(F.max(F.col("key").isNull() | leads).alias("stays"), F.count_if(leads).alias("leading"))
    special = durable(ids.where(~F.col("stays") | (F.col("leading") > 1)).select("id", "stays"))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_of().alias("text"))
    others = rows.join(special, "id", "left_anti")  # rows without id are among these
    repeated = rows.join(special.where("stays"), "id", "left_semi")
    repeated = repeated.groupBy("id").agg(F.min_by("row", "text").alias("row"))
    return others.select("row.*").unionByName(repeated.select("row.*"))


@query("op5_jaccard_join")
def op5_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    found = similar_documents(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
