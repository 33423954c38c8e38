"""Token counts of byte-level BPE by a finite-state transducer.

Reading a pre-token byte by byte, the last token of what has been read so far is unique: it is the one suffix token
that encodes as itself and does not merge with the token before it. So all that the future depends on is, for each
suffix that some token may still extend, its place in the trie of tokens, the token before it, and how many tokens
fewer the text had there. These are the states. Their number is finite because tokens are; each transition is compiled
the first time it is met and annotated with the change in the number of tokens, so the sum along a path is the count.
The table of transitions is thrown away and compiled anew when it is full.

Texts are cut into chunks at any character. What a chunk does to the state before it is a map of states to states and
counts. Wherever white space follows other characters, a letter's run of letters or a digit's run of digits ends, a
pre-token ends whatever came before, so from the first such place on the map is the same for all states. A map is
therefore kept as the characters before the first of these places, the tokens up to the last one, and the characters
behind it; a chunk without such a place (one run of letters, digits or marks only) is kept as it is. Places that may lie
inside a special string are not taken. Maps compose associatively. Chunks of long documents are dealt out over all tasks,
and their maps are composed pairwise in a tree (the up-sweep of a prefix scan, whose total is all that a count needs).
Long documents are stored once with a number of their own, so chunks and rows cannot be told apart wrongly, whatever the
rows come from.

Defined results: null and empty texts have 0 bytes and 0 tokens; the special tokens of the file count as one token
where their strings stand in a text; an empty table gives an empty result; repeated rows are counted row by row; further
columns are kept. The vocabulary is read on the driver and broadcast: its size is that of the file.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.llm.byte_codec import byte_characters
from cohortspark.llm.common import once, slices, table, text_of
from cohortspark.llm.registry import query
from cohortspark.sources.checkpoints import durable

VOCABULARY = "byte_bpe_50k.json"

#: Transitions and counted pre-tokens that a task keeps, and the longest pre-token kept, in characters.
MOST_TRANSITIONS, MOST_COUNTED, COUNTED_CHARS = 400_000, 200_000, 32

#: Characters of a chunk. Longer documents are dealt out chunk by chunk.
CHUNK_CHARS = 1 << 16

#: A token limit to compare with.
LIMIT = 1024

BLANKS_BEFORE_SPACE = regex.compile(r"\s ")

#: Where white space follows something else, and where a run of letters or digits ends: there a pre-token ends.
_PLACE = r"(?<=\S)(?=\s)|(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})"
SETTLED, LAST_SETTLED = regex.compile(_PLACE), regex.compile(f"(?r){_PLACE}")


def read_tokenizer(path: str) -> dict:
    """Merges as pairs of bytes in order, and special strings, of a byte-level BPE file."""
    with open(path, encoding="utf-8") as file:
        read = json.load(file)
    model, before = read["model"], read["pre_tokenizer"]
    if model["type"] != "BPE" or before["type"] != "ByteLevel" or before["add_prefix_space"] or read["normalizer"]:
        raise ValueError("only plain byte-level BPE is known here")
    value = {c: b for b, c in enumerate(byte_characters())}
    merges = []
    for pair in model["merges"]:
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        merges.append((bytes(value[c] for c in left), bytes(value[c] for c in right)))
    return {"merges": merges, "special": [t["content"] for t in read["added_tokens"]]}


class Transducer:
    """States, transitions and counts of one vocabulary; see the module's description."""

    def __init__(self, merges: list[tuple[bytes, bytes]]):
        self.bytes_of = [bytes([b]) for b in range(256)]
        number = {data: i for i, data in enumerate(self.bytes_of)}
        self.merge: dict[tuple[int, int], int] = {}
        self.halves: list[tuple[int, int]] = [(b, b) for b in range(256)]
        for left, right in merges:
            pair = number[left], number[right]
            if left + right in number:
                raise ValueError("two merges that give the same token are not known here")
            self.merge[pair] = number[left + right] = len(self.bytes_of)
            self.bytes_of.append(left + right)
            self.halves.append(pair)
        self.children: list[dict[int, int]] = [{}]
        self.token_at = [-1]
        for token, data in enumerate(self.bytes_of):
            if self.encode(data) != [token]:
                continue  # no text is ever encoded as this token
            node = 0
            for b in data:
                if b not in self.children[node]:
                    self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                node = self.children[node][b]
            self.token_at[node] = token
        self.beside: dict[tuple[int, int], bool] = {}
        self.restart()

    def restart(self) -> None:
        self.states = {((0, -1, 0),): 0}
        self.items = [((0, -1, 0),)]
        self.moves: dict[int, tuple[int, int]] = {}

    def encode(self, data: bytes) -> list[int]:
        """Merge by merge; used for single tokens only."""
        parts = list(data)
        while len(parts) > 1:
            merged, i = min((self.merge.get(pair, len(self.bytes_of)), i) for i, pair in enumerate(zip(parts, parts[1:])))
            if merged == len(self.bytes_of):
                break
            parts[i : i + 2] = [merged]
        return parts

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether two tokens in this order are how their bytes are encoded."""
        known = self.beside.get((left, right))
        if known is None:
            if len(self.beside) > MOST_TRANSITIONS:
                self.beside.clear()
            known = self.beside[left, right] = self._stay_apart(left, right)
        return known

    def _stay_apart(self, left: int, right: int) -> bool:
        """Undo the merges at the border, the latest first: none of the pairs there may have come before it.

        Tokens are numbered in the order of their merges, bytes first. Of equal merges the left one comes first.
        """
        before = len(self.bytes_of)
        while True:
            if self.merge.get((left, right), before) < before:
                return False
            if max(left, right) < 256:
                return True
            if left > right:
                before, left = left, self.halves[left][1]
            else:
                before, right = right + 1, self.halves[right][0]

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition of a state by a byte: the next state, and the change in the number of tokens."""
        last = change = None
        going = []
        for node, before, fewer in self.items[state]:  # the longest suffix first
            child = self.children[node].get(byte)
            if child is None:
                continue
            token = self.token_at[child]
            if last is None and token >= 0 and (before < 0 or self.stay_apart(before, token)):
                last, change = token, fewer + 1
            if self.children[child]:
                going.append((child, before, fewer))
        items = (*((node, before, fewer - change) for node, before, fewer in going), (0, last, 0))
        following = self.states.get(items)
        if following is None:
            following = self.states[items] = len(self.items)
            self.items.append(items)
        move = self.moves[state << 8 | byte] = following, change
        return move

    def count(self, data: bytes) -> int:
        """Number of tokens of one pre-token."""
        if len(self.moves) > MOST_TRANSITIONS:
            self.restart()
        state = total = 0
        moves = self.moves.get
        for byte in data:
            state, change = moves(state << 8 | byte) or self.compile(state, byte)
            total += change
        return total


class Remembered(dict):
    """Counts of strings by a function; short strings are kept until the table is full."""

    def __init__(self, count: Callable[[str], int]):
        super().__init__()
        self.count = count

    def __missing__(self, key: str) -> int:
        n = self.count(key)
        if len(key) <= COUNTED_CHARS:
            if len(self) >= MOST_COUNTED:
                self.clear()
            self[key] = n
        return n


class Counter:
    """Counts tokens of texts, and of chunks as maps that compose."""

    def __init__(self, tokenizer: dict, pattern: str):
        transducer = Transducer(tokenizer["merges"])
        self.split = regex.compile(pattern).findall
        special = sorted(tokenizer["special"], key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.longest = max(map(len, special), default=1)
        self.pretokens = Remembered(lambda pretoken: transducer.count(pretoken.encode()))
        self.words = Remembered(lambda word: self.part(" " + word))

    def part(self, text: str) -> int:
        """Tokens of a text by its pre-tokens."""
        return sum(map(self.pretokens.__getitem__, self.split(text)))

    def tokens(self, text: str) -> int:
        """Tokens of a text that starts and ends at a settled place."""
        if self.special is not None and (found := len(self.special.findall(text))):
            return found + sum(map(self.tokens, self.special.split(text)))
        if BLANKS_BEFORE_SPACE.search(text):
            return self.part(text)
        first, *words = text.split(" ")  # every space is a settled place here
        return self.part(first) + sum(map(self.words.__getitem__, words))

    def map_of(self, chunk: str) -> tuple[bool, str, int, str]:
        """What a chunk does: whether it has a settled place, the text before the first, tokens, text behind the last."""
        start = next((p for m in SETTLED.finditer(chunk) if self.outside_special(chunk, p := m.start())), None)
        if start is None:
            return False, chunk, 0, ""
        stop = next(p for m in LAST_SETTLED.finditer(chunk) if self.outside_special(chunk, p := m.start()))
        return True, chunk[:start], self.tokens(chunk[start:stop]), chunk[stop:]

    def outside_special(self, chunk: str, place: int) -> bool:
        """Whether no special string can go on across a place, whatever stands around the chunk."""
        if self.special is None or chunk[place].isspace():
            return True  # special strings are without white space
        reach = self.longest - 1
        if place < reach or place + reach > len(chunk):
            return False
        return all(m.end() <= reach or m.start() >= reach for m in self.special.finditer(chunk[place - reach : place + reach]))

    def compose(self, left: tuple, right: tuple) -> tuple[bool, str, int, str]:
        """The map of two neighbouring chunks."""
        if not left[0]:
            return right[0], left[1] + right[1], right[2], right[3]
        if not right[0]:
            return True, left[1], left[2], left[3] + right[1]
        return True, left[1], left[2] + self.tokens(left[3] + right[1]) + right[2], right[3]

    def total(self, maps: list[tuple]) -> int:
        """Tokens of the text whose chunks have these maps: neighbours are composed until one map is left."""
        while len(maps) > 1:
            odd = maps[len(maps) // 2 * 2 :]
            maps = [self.compose(a, b) for a, b in zip(maps[::2], maps[1::2])] + odd
        settled, head, n, tail = maps[0]
        return self.tokens(head) + (n + self.tokens(tail) if settled else 0)


def count_tokens(docs: DataFrame, path: str, pattern: str, text: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """The rows with ``n_tokens``, by the vocabulary file at ``path`` and the pattern of its pre-tokens."""
    tokenizer = docs.sparkSession.sparkContext.broadcast(read_tokenizer(path))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "n_tokens"])
    rows = docs.select(text_of(text).alias("text"), row.alias("row"))
    kind = rows.schema["row"].dataType
    long_text = F.char_length("text") > chunk_chars

    def make(read: dict) -> Counter:
        return Counter(read, pattern)

    counted = T.StructType().add("n_tokens", T.LongType()).add("row", kind)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = once(tokenizer, make)
        for batch in batches:
            n = [counter.tokens(t) for part in slices(batch.column("text")) for t in part.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), batch.column("row")], counted.names)

    cut = T.StructType().add("key", T.LongType()).add("part", T.LongType()).add("text", T.StringType())

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text")):
                text = text.as_py()
                parts = [text[i : i + chunk_chars] for i in range(0, len(text), chunk_chars)]
                yield pa.RecordBatch.from_pydict({"key": [key] * len(parts), "part": list(range(len(parts))), "text": parts})

    mapped = T.StructType([*cut.fields[:2], *T.StructType.fromDDL("settled boolean, head string, n long, tail string").fields])

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = once(tokenizer, make)
        for batch in batches:
            found = list(zip(*map(counter.map_of, batch.column("text").to_pylist())))
            made = [pa.array(x, k) for x, k in zip(found, (pa.bool_(), pa.string(), pa.int64(), pa.string()))]
            if found:
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("part"), *made], mapped.names)

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = once(tokenizer, make)
        for batch in batches:
            n = [counter.total([tuple(m.values())[1:] for m in maps]) for maps in batch.column("maps").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(n, pa.int64())], ["key", "n_tokens"])

    short = rows.where(~long_text).mapInArrow(whole, counted)
    long = durable(rows.where(long_text).withColumn("key", F.monotonically_increasing_id()))
    dealt = long.select("key", "text").mapInArrow(chunks, cut).repartition("key", "part")
    totals = dealt.mapInArrow(maps, mapped).groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("part", "settled", "head", "n", "tail"))).alias("maps")
    )
    totals = totals.mapInArrow(compose, "key long, n_tokens long")
    back = long.select("key", "row").join(totals, "key").select("n_tokens", "row")
    return short.unionByName(back).select("row.*", "n_tokens")


@query("op1_token_counts")
def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    sized = docs.select("doc_id", F.octet_length(text_of()).cast("long").alias("n_bytes"), "text")
    counted = count_tokens(sized, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
