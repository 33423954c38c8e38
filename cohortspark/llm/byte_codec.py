"""Byte-level BPE encoding and decoding with a SentencePiece model that is written straight from a vocabulary.

Every byte is mapped to one printable character, so that each token of a rank file becomes a piece. The model holds
these pieces with the negative rank as score and changes no text, so its merges are those of the ranks: the pair whose
union has the lowest rank first, the leftmost of several. A pre-token that is a token as a whole is looked up first.
Ids are decoded by the inverse mapping.

The vocabulary file is read on the driver and sent along as a broadcast variable; its size is that of the file (about
a megabyte), whatever the input. Pre-tokens that repeat are encoded once; the table of them is emptied when it is full.

Defined results: a null text is an empty one and has no ids; strings that look like special tokens are ordinary text;
nulls among ids are an error of the caller; an empty table gives an empty result; further columns are kept.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.llm.common import slices, table, text_of
from cohortspark.llm.registry import query

VOCABULARY = "byte_bpe_multi_50k.tiktoken"

#: Pre-tokens whose ids a task keeps, and their longest length in characters.
KEPT, KEPT_CHARS = 200_000, 64


def byte_characters() -> list[str]:
    """The character of each byte: itself when printable, else the next free one from 256 on."""
    printable = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in order of rank."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in pairs)
    if [r for r, _ in ranked] != list(range(len(ranked))):
        raise ValueError("ranks have to be 0, 1, 2 and so on")
    return [token for _, token in ranked]


def _varint(n: int) -> bytes:
    n &= 2**64 - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A serialised BPE model: unknown piece at 0, then the piece of each rank, with the rank's negative as score.

    Field numbers are those of SentencePiece's public model format.
    """
    shown = byte_characters()
    normal, unknown, bpe = 1, 2, 2
    pieces = [_block(1, _block(1, b"<unk>") + _number(3, unknown))]
    for rank, token in enumerate(tokens):
        piece = "".join(shown[b] for b in token).encode()
        pieces.append(_block(1, _block(1, piece) + _varint(2 << 3 | 5) + struct.pack("<f", -rank) + _number(3, normal)))
    # kind 3, size 4; ids of unknown, begin, end and padding 40 to 43
    trainer = _number(3, bpe) + _number(4, len(tokens) + 1) + _number(40, 0) + b"".join(_number(k, -1) for k in (41, 42, 43))
    # no leading space (3), no removal (4) and no escape (5) of spaces
    normalizer = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _block(2, trainer) + _block(3, normalizer)


class Codec:
    """Encodes texts to ids and decodes ids to bytes."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.rank = {token: rank for rank, token in enumerate(tokens)}
        self.split = regex.compile(pattern).findall
        self.shown = str.maketrans({b: c for b, c in enumerate(byte_characters())})
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(tokens))
        self.kept: dict[str, list[int]] = {}

    def pretokens(self, found: list[str]) -> list[list[int]]:
        """The ids of each pre-token."""
        ids: list[list[int] | None] = [None] * len(found)
        rest = []
        for i, data in enumerate(map(str.encode, found)):
            rank = self.rank.get(data)
            if rank is None:
                rest.append((i, data.decode("latin-1").translate(self.shown)))
            else:
                ids[i] = [rank]
        for (i, _), out in zip(rest, self.model.encode([m for _, m in rest], num_threads=1) if rest else []):
            ids[i] = [k - 1 for k in out]
        return ids

    def encode(self, texts: list[str]) -> list[list[list[int]]]:
        """For each text, the ids of its pre-tokens."""
        split = [self.split(text) for text in texts]
        kept = self.kept
        if len(kept) > KEPT:
            kept.clear()
        new = list({p for found in split for p in found} - kept.keys())
        ids = dict(zip(new, self.pretokens(new)))
        get = ids.get
        out = [[x if (x := get(p)) is not None else kept[p] for p in found] for found in split]
        kept.update((p, x) for p, x in ids.items() if len(p) <= KEPT_CHARS)
        return out

    def decode(self, ids: Iterator[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def encode_decode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """The rows with ``ids`` (array of int) and ``decoded`` (binary, the bytes that the ids stand for)."""
    spark = docs.sparkSession
    tokens = spark.sparkContext.broadcast(read_ranks(path))
    names = [c for c in docs.columns if c.lower() not in ("ids", "decoded")]
    rows = docs.select(text_of(text).alias("text"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    schema = (
        T.StructType()
        .add("ids", T.ArrayType(T.IntegerType()))
        .add("decoded", T.BinaryType())
        .add("row", rows.schema["row"].dataType)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(tokens.value, pattern)
        for batch in batches:
            done = 0
            for part in slices(batch.column("text")):
                found = codec.encode(part.to_pylist())
                flat = [list(chain.from_iterable(x)) for x in found]
                ends = np.cumsum([0, *map(len, flat)]).astype(np.int32)
                values = np.fromiter(chain.from_iterable(flat), dtype=np.int32, count=int(ends[-1]))
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
                decoded = pa.array([codec.decode(x) for x in flat], pa.binary())
                row = batch.column("row").slice(done, len(part))
                yield pa.RecordBatch.from_arrays([ids, decoded, row], schema.names)
                done += len(part)

    return rows.mapInArrow(run, schema).select("row.*", "ids", "decoded")


def digests(coded: DataFrame) -> DataFrame:
    """Number of ids, hash of the decimal ids with commas between, hash of the decoded bytes."""
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.encode(F.array_join(F.col("ids").cast("array<string>"), ","), "UTF-8"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op9_byte_bpe_codec")
def op9_byte_bpe_codec(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return digests(encode_decode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN))
