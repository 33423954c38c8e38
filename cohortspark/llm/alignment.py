"""Which tokens of two vocabularies cover the same bytes, and how often ids meet in the whole corpus.

Both vocabularies cut a space and the text into tokens that tile the same bytes. The tokens of both are intervals: sorted
by their starts (``lexsort``), with the running maximum of their ends, they coalesce into groups, and a group breaks where
a start reaches that maximum, which is where tokens of both sides end. Within a group every token of the one side meets
the tokens of the other that its bytes overlap: these are the links.

Texts longer than ``CHUNK_CHARS`` are cut at single spaces between other characters. Neither side has a token across such a
place (the loader checks that), so the parts align apart and a document of any length takes bounded memory beyond its ids.

How often an id pair is linked is counted over all documents. Each task takes its documents in batches of about ``BATCH``
bytes and numbers a batch's distinct pairs, so a pair is counted, joined and sent back once for a batch and not once for a
link. Counts are summed with partial aggregation; the highest count of each id of the second side is a table of at most as
many rows as that vocabulary has ids, which bounds its broadcast. A batch's documents wait in shared storage, their pairs
packed as numbers of the batch, until the batch's counts come back to them.

Defined results: null and empty texts, and texts that the second vocabulary does not give back byte for byte, have no
tokens, zeros in all numbers and an empty ``groups``; special strings inside texts are plain text; repeated rows count row
by row; an empty table gives an empty result; further columns are kept. Vocabularies are read on the driver and broadcast:
their size is that of the files.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from cohortspark.llm.byte_codec import byte_characters
from cohortspark.llm.common import once, table
from cohortspark.llm.registry import query
from cohortspark.sources.checkpoints import durable

VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.json", "piece_bpe_32k.model"

#: Characters after which a text is cut at the next place, bytes of text that are aligned at once, and bytes of a batch.
CHUNK_CHARS, BLOCK, BATCH = 8192, 1 << 20, 1 << 24

CUT = re.compile(r"(?<=\S) (?=\S)")

SPACE = "▁"


def read_vocabularies(path_a: str, path_b: str) -> dict:
    """The files' contents, with the bytes that each id stands for; refuses files that the method does not fit."""
    with open(path_a, encoding="utf-8") as file:
        text = file.read()
    read = json.loads(text)
    value = {c: b for b, c in enumerate(byte_characters())}
    special = {t["content"] for t in read["added_tokens"]}
    vocabulary = {token: i for token, i in read["model"]["vocab"].items() if token not in special}
    ranks = {bytes(value[c] for c in token): i for token, i in vocabulary.items()}
    made = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in read["model"]["merges"]]
    if made != sorted(made) or len({bytes([b]) for b in range(256)} & ranks.keys()) < 256:
        raise ValueError("ids of the first vocabulary have to follow its merges, and it has to know all bytes")
    with open(path_b, "rb") as file:
        model = file.read()
    pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
    held = []
    for i in range(len(pieces)):
        piece = pieces.id_to_piece(i)
        if re.search(f"[^{SPACE}]{SPACE}", piece):
            raise ValueError("a piece of the second vocabulary goes on after a word's end")
        held.append(bytes([int(piece[3:5], 16)]) if pieces.is_byte(i) else piece.replace(SPACE, " ").encode())
    return {"json": text, "ranks": ranks, "model": model, "pieces": held}


class Pair:
    """Both tokenizers, and what is looked up for their ids."""

    def __init__(self, read: dict):
        self.json = read["json"]
        self.first = tiktoken.Encoding("first", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read["ranks"], special_tokens={})
        self.second = sentencepiece.SentencePieceProcessor(model_proto=read["model"])
        self.pieces = read["pieces"]
        self.n_a, self.n_b = max(read["ranks"].values()) + 1, len(self.pieces)
        self.length_a = np.zeros(self.n_a, np.int64)
        for token, i in read["ranks"].items():
            self.length_a[i] = len(token)
        self.length_b = np.array([len(p) for p in self.pieces], np.int64)
        ids = [str(i) for i in range(max(self.n_a, self.n_b))]
        #: What stands before an id, times the number of ids, plus the id, gives the string to write.
        self.width, self.written = len(ids), [mark + i for mark in (",", ";", "|", "") for i in ids]
        self.whole: Tokenizer | None = None

    def first_ids(self, text: str) -> list[int]:
        if len(text) <= 2 * CHUNK_CHARS:
            return self.first.encode_ordinary(text)
        if self.whole is None:  # its time does not grow with the square of a pre-token's length
            self.whole = Tokenizer.from_str(self.json)
            self.whole.encode_special_tokens = True
        return self.whole.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[list[tuple[np.ndarray, np.ndarray]] | None]:
        """For each text the ids of both sides, part by part; None for a text without tokens."""
        parts = [chunks(text) for text in texts]
        flat = list(chain.from_iterable(parts))
        second = iter(self.second.encode(flat, num_threads=1) if flat else [])
        out: list[list[tuple[np.ndarray, np.ndarray]] | None] = []
        for held in parts:
            ids = [next(second) for _ in held]
            same = all(b"".join(map(self.pieces.__getitem__, b)) == b" " + p.encode() for p, b in zip(held, ids))
            out.append([(np.array(self.first_ids(" " + p)), np.array(b)) for p, b in zip(held, ids)] if same and held else None)
        return out


def chunks(text: str) -> list[str]:
    """The text's parts between single spaces, each of them of ``CHUNK_CHARS`` characters or a little more."""
    out, start = [], 0
    while len(text) - start > CHUNK_CHARS and (found := CUT.search(text, start + CHUNK_CHARS)):
        out.append(text[start : found.start()])
        start = found.end()
    return [*out, text[start:]] if text else []


def coalesce(a: np.ndarray, b: np.ndarray, pair: Pair) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group of each first token, group of each second one, links' first tokens, links' second tokens), by position.

    ``a`` and ``b`` are the ids of both sides over the same bytes.
    """
    ends_a, ends_b = np.cumsum(pair.length_a[a]), np.cumsum(pair.length_b[b])
    starts_a, starts_b = ends_a - pair.length_a[a], ends_b - pair.length_b[b]
    start = np.concatenate([starts_a, starts_b])
    order = np.lexsort((np.repeat([0, 1], [len(a), len(b)]), start))
    reached = np.maximum.accumulate(np.concatenate([ends_a, ends_b])[order])
    breaks = np.ones(len(order), bool)
    breaks[1:] = start[order][1:] >= reached[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks) - 1
    low, high = np.searchsorted(ends_b, starts_a, "right"), np.searchsorted(starts_b, ends_a, "left")
    met = high - low
    left = np.repeat(np.arange(len(a)), met)
    right = np.arange(len(left)) - np.repeat(np.cumsum(met) - met - low, met)
    return group[: len(a)], group[len(a) :], left, right


def _firsts(values: np.ndarray) -> np.ndarray:
    first = np.ones(len(values), bool)
    first[1:] = values[1:] != values[:-1]
    return first


class Aligned:
    """What is known of one document: numbers, the written groups' hash (and the groups, if they are kept), its pairs."""

    def __init__(self, keep: bool):
        self.n_a = self.n_b = self.n_groups = self.n_links = 0
        self.hash, self.kept, self.pairs = sha256(), [] if keep else None, []

    def write(self, text: str) -> None:
        self.hash.update(text.encode())
        if self.kept is not None:
            self.kept.append(text)


def align(parts: list[tuple[Aligned, np.ndarray, np.ndarray]], pair: Pair) -> None:
    """Align a block of documents' parts and add the outcome to the documents; a document's parts stand in a row."""
    a, b = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
    docs = list({id(p[0]): p[0] for p in parts}.values())
    place = {id(d): i for i, d in enumerate(docs)}
    owner = np.array([place[id(p[0])] for p in parts])
    of_a, of_b = (np.repeat(owner, [len(p[i]) for p in parts]) for i in (1, 2))
    group_a, group_b, left, right = coalesce(a, b, pair)
    n_a, n_b = np.bincount(group_a), np.bincount(group_b)
    # what is written: the groups one after the other, in each the first side's ids and then the second side's
    codes = np.empty(len(a) + len(b), np.int64)
    opens = _firsts(group_a)
    mark = np.where(opens, 1, 0)
    codes[np.arange(len(a)) + (np.cumsum(n_b) - n_b)[group_a]] = mark * pair.width + a
    codes[np.arange(len(b)) + np.cumsum(n_a)[group_b]] = np.where(_firsts(group_b), 2, 0) * pair.width + b
    count_a, count_b = np.bincount(of_a, minlength=len(docs)), np.bincount(of_b, minlength=len(docs))
    groups, links = np.bincount(of_a[opens], minlength=len(docs)), np.bincount(of_a[left], minlength=len(docs))
    ends = np.cumsum(count_a + count_b)
    pairs, times = np.unique((of_a[left] * pair.n_a + a[left]) * pair.n_b + b[right], return_counts=True)
    of_pair = pairs // (pair.n_a * pair.n_b)
    cut = np.searchsorted(of_pair, np.arange(len(docs) + 1))
    pairs = pairs % (pair.n_a * pair.n_b)
    for i, doc in enumerate(docs):
        start = ends[i] - count_a[i] - count_b[i]
        if not doc.n_groups:
            codes[start] += 2 * pair.width  # nothing stands before a document's first id
        doc.write("".join(map(pair.written.__getitem__, codes[start : ends[i]].tolist())))
        doc.n_a += int(count_a[i])
        doc.n_b += int(count_b[i])
        doc.n_groups += int(groups[i])
        doc.n_links += int(links[i])
        doc.pairs.append((pairs[cut[i] : cut[i + 1]], times[cut[i] : cut[i + 1]]))


def align_texts(texts: list[str | None], pair: Pair, keep: bool = False, block: int = BLOCK) -> list[Aligned]:
    out = [Aligned(keep) for _ in texts]
    waiting, size = [], 0
    for doc, parts in zip(out, pair.encode([t or "" for t in texts])):
        for a, b in parts or []:
            waiting.append((doc, a, b))
            size += int(pair.length_a[a].sum())
            if size >= block:
                align(waiting, pair)
                waiting, size = [], 0
    if waiting:
        align(waiting, pair)
    return out


def _texts(column: pa.Array) -> Iterator[list[str | None]]:
    """The texts of a column, about ``BLOCK`` characters at a time."""
    held: list[str | None] = []
    size = 0
    for text in column:
        held.append(text.as_py())
        size += len(held[-1] or "")
        if size >= BLOCK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _parted(docs: DataFrame, text: str, names: list[str], kept: list[str] | None = None) -> DataFrame:
    """(text, row): ``row`` has the columns to keep, all but ``names`` if none are named."""
    row = F.struct(*[F.col(f"`{c}`") for c in kept or docs.columns if c.lower() not in names])
    return docs.select(F.col(f"`{text}`").cast("string").alias("text"), row.alias("row"))


NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]


def token_groups(docs: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """The rows with ``n_a``, ``n_b``, ``n_groups``, ``n_links`` and ``groups`` (ids as `a1,a2|b1;a3|b2,b3`)."""
    rows = _parted(docs, text, [*NUMBERS, "groups"])
    sent = docs.sparkSession.sparkContext.broadcast(read_vocabularies(path_a, path_b))
    schema = T.StructType([rows.schema["row"], *[T.StructField(n, T.LongType()) for n in NUMBERS], T.StructField("groups", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = once(sent, Pair)
        for batch in batches:
            done = 0
            for texts in _texts(batch.column("text")):
                found = align_texts(texts, pair, keep=True)
                numbers = [pa.array([getattr(d, n) for d in found], pa.int64()) for n in NUMBERS]
                groups = pa.array(["".join(d.kept) for d in found], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(done, len(texts)), *numbers, groups], schema.names)
                done += len(texts)

    return rows.mapInArrow(run, schema).select("row.*", *NUMBERS, "groups")


# --- counts of the whole corpus --------------------------------------------------------------------------------------


def _packed(numbers: np.ndarray) -> bytes:
    """Whole numbers below 2**32 by bytes of equal weight, compressed."""
    return pa.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data, 4 * n, "zstd", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(raw.reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def aligned_batches(rows: DataFrame, sent: Broadcast, kind: T.DataType, most: int = BATCH, block: int = BLOCK) -> DataFrame:
    """A row for each batch: its documents with their numbers, its distinct pairs with counts, and who holds which.

    ``held`` has for the documents, one after the other, the steps between the places of their pairs in ``pairs``, and
    ``times`` how often; ``n_held`` of each document says how many.
    """
    document = T.StructType([T.StructField("row", kind), *[T.StructField(n, T.LongType()) for n in [*NUMBERS, "n_held"]], T.StructField("groups_sha256", T.StringType())])
    schema = (
        T.StructType()
        .add("batch", T.LongType())
        .add("docs", T.ArrayType(document))
        .add("held", T.BinaryType())
        .add("times", T.BinaryType())
        .add("pairs", T.ArrayType(T.LongType()))
        .add("counts", T.ArrayType(T.LongType()))
    )

    def emit(number: int, docs: list[tuple], row_parts: list[pa.Array]) -> pa.RecordBatch:
        every = [np.concatenate([p for p, _ in d.pairs]) if d.pairs else np.zeros(0, np.int64) for d in docs]
        each = [np.concatenate([t for _, t in d.pairs]) if d.pairs else np.zeros(0, np.int64) for d in docs]
        for i, d in enumerate(docs):
            if len(d.pairs) > 1:  # a long document's blocks hold some pairs again
                every[i], at = np.unique(every[i], return_inverse=True)
                each[i] = np.bincount(at, each[i]).astype(np.int64)
        n_held = np.array([len(p) for p in every], np.int64)
        flat, times = np.concatenate(every), np.concatenate(each)
        pairs, at = np.unique(flat, return_inverse=True)
        counts = np.bincount(at, times, minlength=len(pairs)).astype(np.int64)
        steps = np.diff(at, prepend=0)
        starts = (np.cumsum(n_held) - n_held)[n_held > 0]
        steps[starts] = at[starts]
        arrays = [pa.chunked_array(row_parts).combine_chunks()]
        arrays += [pa.array([getattr(d, n) for d in docs], pa.int64()) for n in NUMBERS]
        arrays += [pa.array(n_held), pa.array([d.hash.hexdigest() if d.n_a else "" for d in docs])]
        listed = pa.StructArray.from_arrays([a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays], document.names)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([TaskContext.get().partitionId() << 32 | number], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), listed),
                pa.array([_packed(steps)], pa.binary()),
                pa.array([_packed(times)], pa.binary()),
                pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pa.array(pairs)),
                pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pa.array(counts)),
            ],
            schema.names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = once(sent, Pair)
        docs, row_parts, size, number = [], [], 0, 0
        for batch in batches:
            done = 0
            for texts in _texts(batch.column("text")):
                docs += align_texts(texts, pair, block=block)
                row_parts.append(batch.column("row").slice(done, len(texts)))
                done += len(texts)
                size += sum(len(t) for t in texts if t) + 64 * len(texts)
                if size >= most:
                    yield emit(number, docs, row_parts)
                    docs, row_parts, size, number = [], [], 0, number + 1
        if docs:
            yield emit(number, docs, row_parts)

    return rows.mapInArrow(run, schema)


def align_tokens(
    docs: DataFrame,
    path_a: str,
    path_b: str,
    text: str = "text",
    kept: list[str] | None = None,
    most: int = BATCH,
    block: int = BLOCK,
) -> DataFrame:
    """The rows (of the ``kept`` columns) with the numbers of ``token_groups``, ``groups_sha256`` (hash of its groups, empty without tokens),
    ``n_best`` (links whose pair is the most frequent of its second id, ties included) and ``count_sum`` (sum of the
    pairs' counts in the whole corpus over the links).
    """
    spark = docs.sparkSession
    made = ["n_best", "count_sum", "groups_sha256"]
    rows = _parted(docs, text, [*NUMBERS, *made], kept)
    read = read_vocabularies(path_a, path_b)
    sent = spark.sparkContext.broadcast(read)
    kind, n_b = rows.schema["row"].dataType, len(read["pieces"])
    batches = durable(aligned_batches(rows, sent, kind, most, block))

    listed = batches.select("batch", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "met"))
    listed = listed.select("batch", "place", F.col("met.pairs").alias("pair"), F.col("met.counts").alias("n"))
    counts = durable(listed.groupBy("pair").agg(F.sum("n").alias("count")))
    second = (F.col("pair") % n_b).alias("second")
    highest = counts.groupBy(second).agg(F.max("count").alias("highest"))  # at most a row for each id
    scored = counts.join(F.broadcast(highest), second == F.col("second")).select(
        "pair", "count", (F.col("count") == F.col("highest")).alias("best")
    )
    back = listed.select("batch", "place", "pair").join(scored, "pair").select(
        F.col("batch").alias("of"), "place", "count", "best"
    )

    schema = T.StructType([T.StructField("row", kind), *[T.StructField(n, T.LongType()) for n in [*NUMBERS, "n_best", "count_sum"]], T.StructField("groups_sha256", T.StringType())])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        count, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, np.int64)
        place = right["place"].to_numpy()
        count[place], best[place] = right["count"].to_numpy(), right["best"].to_numpy()
        docs = left["docs"].combine_chunks().flatten()
        n_held = docs.field("n_held").to_numpy()
        total = int(n_held.sum())
        steps, times = (_unpacked(left[c][0].as_py(), total) for c in ("held", "times"))
        starts = np.cumsum(n_held) - n_held
        sums = np.cumsum(steps)
        before = np.concatenate([[0], sums])[starts]
        at = sums - np.repeat(before, n_held)
        parts = [np.concatenate([[0], np.cumsum(x[at] * times)]) for x in (best, count)]
        n_best, count_sum = (x[starts + n_held] - x[starts] for x in parts)
        columns = [docs.field("row"), *[docs.field(n) for n in NUMBERS], pa.array(n_best), pa.array(count_sum), docs.field("groups_sha256")]
        return pa.Table.from_arrays(columns, schema.names)

    waiting = batches.select("batch", "docs", "held", "times")
    done = waiting.groupBy("batch").cogroup(back.groupBy("of")).applyInArrow(finish, schema)
    return done.select("row.*", *NUMBERS, "n_best", "count_sum", "groups_sha256")


@query("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return align_tokens(docs, public_tokenizers.path(VOCABULARY_A), public_tokenizers.path(VOCABULARY_B), kept=["doc_id"])
