"""Documents whose SimHash fingerprints differ in few bits, by pigeonring filtering.

A fingerprint has 64 bits; a bit is set when more than half of the document's word shingles (repeats count) have it set in
their hash. Equal fingerprints are one class, so copies are never paired.

The 64 bits are a ring of five segments, ``MOST`` the differing bits that a link allows. Two linked fingerprints have a
segment from which every chain of l consecutive segments differs in at most l * MOST / 5 bits: none in the first, one in
two, two in three, three in four. So each fingerprint is sent once for each segment it may start from, with others that
agree in leading bits of that segment. There the fingerprints are sorted by the first two segments of the ring, partners
are looked up with the second segment equal or one bit away, longer chains are held against their budgets one after the
other, and only what is left is compared whole.

The number of places grows with the number of fingerprints, so a place has about ``GROUP`` of them. A place with more than
``CROWDED`` (a third of the corpus may be edits of one text) is dealt anew by the first two segments, with visits from
fingerprints one bit away. A place reports a spanning forest of its links, not the links, found over pairs in blocks of
``PAIRS``; what it holds and returns is linear in its fingerprints. Components come from these by minimum steps.

Defined results: null and empty texts and texts of white space have fingerprint zero and are linked like any other; texts
with fewer words than a shingle hash the whole sequence; repeated rows are linked; rows without id take part and may have
a null component; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.common import slices, table, text_of
from cohortspark.llm.components import connected_components
from cohortspark.llm.registry import query
from cohortspark.sources.checkpoints import durable

WORDS_PER_SHINGLE, SEED = 4, 42

#: Differing bits that a link allows.
MOST = 4

#: Bits of the ring's segments, and where each begins.
WIDTHS = (13, 13, 13, 13, 12)
STARTS = (0, 13, 26, 39, 52)
SEGMENTS = len(WIDTHS)

#: Fingerprints of a place, fingerprints that make a place crowded, pairs that are compared at once.
GROUP, CROWDED, PAIRS = 20_000, 400_000, 1 << 20

#: Bytes of text that are split into words at once.
PIECE = 1 << 20

#: Most bits of a segment that a place may have in common.
DEEPEST = min(WIDTHS)


def _pieces(data: bytes) -> Iterator[bytes]:
    """Parts of a text that end at white space."""
    start = 0
    while len(data) - start > PIECE:
        stop = max(data.rfind(blank, start, start + PIECE) for blank in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if stop < 0:
            ends = [at for blank in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (at := data.find(blank, start + PIECE)) >= 0]
            if not ends:
                break
            stop = min(ends)
        yield data[start : stop + 1]
        start = stop + 1
    yield data[start:]


def shingle_hashes(data: bytes) -> Iterator[np.ndarray]:
    """Hashes of the text's shingles in order, piece by piece; of the whole sequence when it has fewer words."""
    k, last, any_yet = WORDS_PER_SHINGLE, [], False
    for piece in _pieces(data):
        words = last + piece.lower().split()
        if len(words) >= k:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = np.concatenate([[0], ends])[: len(words) - k + 1].tolist()
            hashes = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist())]
            any_yet = True
            yield np.array(hashes, np.uint64)
        last = words[-(k - 1) :]
    if last and not any_yet:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(last), SEED)], np.uint64)


def fingerprint(data: bytes) -> int:
    """The bits that are set in more than half of the hashes."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(data):
        for at in range(0, len(hashes), 1 << 16):
            block = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of each row as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_buffer().to_pybytes()) for part in slices(batch.column("text")) for t in part]
            made = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id"), made], ["id", "fp"])

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), text_of(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


# --- search ----------------------------------------------------------------------------------------------------------


def segment(i: int, fp: Column) -> Column:
    """One segment of a fingerprint as a number."""
    return F.shiftrightunsigned(fp, STARTS[i]).bitwiseAND(F.lit((1 << WIDTHS[i]) - 1).cast("long"))


def _segments(fp: np.ndarray, i: int) -> np.ndarray:
    return fp >> np.uint64(STARTS[i]) & np.uint64((1 << WIDTHS[i]) - 1)


def _budgets(i: int) -> list[tuple[np.uint64, int]]:
    """Bits of the chains of three, four and five segments from a segment on, with the bits that may differ in them."""
    out, mask = [], 0
    for length in range(1, SEGMENTS + 1):
        at = (i + length - 1) % SEGMENTS
        mask |= ((1 << WIDTHS[at]) - 1) << STARTS[at]
        if length > 2:
            out.append((np.uint64(mask), length * MOST // SEGMENTS))
    return out


class Forest:
    """A spanning forest of the links between some fingerprints."""

    def __init__(self, fp: np.ndarray):
        self.fp, self.label, self.links = fp, np.arange(len(fp)), []

    def add(self, a: np.ndarray, b: np.ndarray, i: int) -> None:
        """Compare pairs of places in ``fp`` whose first two segments from the ``i``-th on are within their budgets."""
        differing = self.fp[a] ^ self.fp[b]
        for mask, most in _budgets(i):
            near = np.bitwise_count(differing & mask) <= most
            a, b, differing = a[near], b[near], differing[near]
        x, y = self.label[a], self.label[b]
        apart = np.flatnonzero(x != y)
        if not len(apart):
            return
        pairs, first = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)])[:, apart], axis=1, return_index=True)
        up: dict[int, int] = {}

        def root(n: int) -> int:
            while n in up:
                n = up[n]
            return n

        for p, q, at in zip(*pairs.tolist(), apart[first].tolist()):
            p, q = sorted((root(p), root(q)))
            if p != q:
                up[q] = p
                self.links.append((int(a[at]), int(b[at])))
        roots = np.arange(len(self.fp))
        for n in up:
            roots[n] = root(n)
        self.label = roots[self.label]

    def add_runs(self, start_a: np.ndarray, n_a: np.ndarray, start_b: np.ndarray, n_b: np.ndarray, i: int, same: bool = False) -> None:
        """Compare all members of each run of places with all members of another, or of the same, run by run."""
        done = 0
        sizes = np.cumsum(n_a * n_b)
        while done < len(sizes):
            before = int(sizes[done - 1]) if done else 0
            if sizes[done] - before > PAIRS:  # a run that is too large by itself, in parts
                step = max(1, PAIRS // int(n_b[done]))
                for at in range(int(start_a[done]), int(start_a[done] + n_a[done]), step):
                    part = np.arange(at, min(at + step, int(start_a[done] + n_a[done])))
                    a, b = np.repeat(part, n_b[done]), np.tile(np.arange(start_b[done], start_b[done] + n_b[done]), len(part))
                    self.add(*((a[a < b], b[a < b]) if same else (a, b)), i)
                done += 1
                continue
            stop = max(done + 1, int(np.searchsorted(sizes, before + PAIRS, "right")))
            runs = np.arange(done, stop)
            total = n_a[runs] * n_b[runs]
            at = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
            width = np.repeat(n_b[runs], total)
            a, b = np.repeat(start_a[runs], total) + at // width, np.repeat(start_b[runs], total) + at % width
            self.add(*((a[a < b], b[a < b]) if same else (a, b)), i)
            done = stop


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(values)))


def forest_of_place(fp: np.ndarray, i: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The fingerprints in another order, and links between places of them, for chains from segment ``i`` on."""
    second = (i + 1) % SEGMENTS
    key = _segments(fp, i) << np.uint64(16) | _segments(fp, second)
    order = np.argsort(key, kind="stable")
    fp, key = fp[order], key[order]
    starts, counts = _runs(key)
    forest, keys = Forest(fp), key[starts]
    forest.add_runs(starts, counts, starts, counts, i, same=True)
    for bit in range(WIDTHS[second]):
        flip = np.uint64(1 << bit)
        low = np.flatnonzero(keys & flip == 0)
        at = np.searchsorted(keys, keys[low] | flip)
        at[at == len(keys)] = 0
        met = keys[at] == keys[low] | flip
        a, b = low[met], at[met]
        forest.add_runs(starts[a], counts[a], starts[b], counts[b], i)
    return fp, forest.links


def _found(fp: np.ndarray, links: list[tuple[int, int]]) -> pa.Table:
    signed = fp.view(np.int64)
    pairs = np.array(links, np.int64).reshape(-1, 2)
    return pa.table({"u": pa.array(signed[pairs[:, 0]]), "v": pa.array(signed[pairs[:, 1]])})


def links_by_segment(classes: DataFrame, depth: int, crowded: int = CROWDED) -> DataFrame:
    """(u, v): links that connect whatever linked fingerprints (column ``fp``, each once) are connected.

    A place is a segment and its ``depth`` leading bits.
    """
    fp = F.col("fp")
    places = F.array(*[F.shiftright(segment(i, fp), WIDTHS[i] - depth) + (i << depth) for i in range(SEGMENTS)])
    sent = classes.select("fp", F.explode(places).alias("place"))
    sizes = durable(sent.groupBy("place").agg(F.count("*").alias("n")).where(F.col("n") > crowded))
    full = {r.place: r.n for r in sizes.collect()}  # at most five times two to the power of ``depth`` places

    def search(found: pa.Table) -> pa.Table:
        return _found(*forest_of_place(found["fp"].to_numpy().view(np.uint64), found["place"][0].as_py() >> depth))

    some = sent.where(~F.col("place").isin(*full)) if full else sent
    links = some.groupBy("place").applyInArrow(search, "u long, v long")
    if not full:
        return links

    # crowded places: by both first segments, with visits from those that lack one bit of the second
    visits = None
    for i in range(SEGMENTS):
        if not any(place >> depth == i for place in full):
            continue
        second = (i + 1) % SEGMENTS
        own = F.struct(segment(second, fp).alias("at"), F.lit(True).alias("home"))
        other = [
            F.when(segment(second, fp).bitwiseAND(F.lit(1 << b).cast("long")) == 0, F.struct((segment(second, fp) + (1 << b)).alias("at"), F.lit(False).alias("home")))
            for b in range(WIDTHS[second])
        ]
        here = sent.where(F.col("place").isin(*[p for p in full if p >> depth == i]))
        here = here.select("fp", segment(i, fp).alias("first"), F.explode(F.filter(F.array(own, *other), lambda x: x.isNotNull())).alias("to"))
        here = here.select("fp", ((F.lit(i) * (1 << 13) + F.col("first")) * (1 << 13) + F.col("to.at")).alias("key"), "to.home")
        visits = here if visits is None else visits.unionByName(here)
    parts = -(-sum(full.values()) * 8 // crowded)
    visits = visits.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)))

    def search_again(found: pa.Table) -> pa.Table:
        values, key = found["fp"].to_numpy().view(np.uint64), found["key"].to_numpy()
        home = found["home"].to_numpy()
        order = np.lexsort((~home, key))
        values, key, home = values[order], key[order], home[order]
        out = []
        starts, counts = _runs(key)
        own = np.add.reduceat(home.astype(np.int64), starts) if len(starts) else counts
        for i in range(SEGMENTS):
            of = np.flatnonzero((key[starts] >> 26 == i) & (own > 0))
            forest = Forest(values)
            forest.add_runs(starts[of], own[of], starts[of], own[of], i, same=True)
            forest.add_runs(starts[of], own[of], starts[of] + own[of], counts[of] - own[of], i)
            out += forest.links
        return _found(values, out)

    return links.unionByName(visits.groupBy("part").applyInArrow(search_again, "u long, v long"))


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", group: int = GROUP, crowded: int = CROWDED
) -> DataFrame:
    """(id, fp, component) for every row: its fingerprint and the smallest id reachable by links."""
    found = durable(fingerprints(docs, doc_id, text))
    classes = durable(found.groupBy("fp").agg(F.min("id").alias("least")))
    depth = min(DEEPEST, max(0, math.ceil(math.log2(max(1, classes.count()) / group))))
    components = connected_components(durable(links_by_segment(classes, depth, crowded)))
    rooted = classes.join(components.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left")
    rooted = durable(rooted.select("fp", F.coalesce("root", "fp").alias("root"), "least"))
    smallest = durable(rooted.groupBy("root").agg(F.min("least").alias("component")))
    named = durable(rooted.join(smallest, "root").select("fp", "component"))
    return found.join(named, "fp").select("id", "fp", "component")


@query("op12_simhash")
def op12_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(table(spark, folder, "documents"))
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select(F.col("id").alias("doc_id"), shown.alias("fingerprint"), F.col("component").alias("component_id"))
