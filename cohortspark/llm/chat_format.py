"""Raw chat transcripts to canonical turns, with roles recovered by a hidden Markov model.

A transcript is text whose lines may start with a speaker's marker ("User:", "AI:", "### Response:" and so on). The
states are the first line and the further lines of a turn, for each role. A line is observed as its mark (none, a role's
marker in the style that most of the transcript's markers have, a role's marker in another style, or a misspelt one), and by
whether it asks a question, is blank, and looks quoted. Viterbi's algorithm finds the most likely states of all lines
together; lines of a turn are joined, the marker is taken off, and the turn is rendered.

The shares of the model are counted in Spark on labelled turns: transcripts of them in which some markers are missing or
misspelt and some lines quote a marker (``DAMAGE``). Given shares (``GIVEN``) count like ``PRIOR`` observations, and are all
there is without labelled turns. At most ``SAMPLE`` conversations are counted, drawn by a hash.

Conversations of any length are cut into blocks of ``BLOCK`` turn numbers; every turn starts with a line of its own. A block
is reduced to the best scores from each role before it to each role at its end (a max-plus matrix); the blocks of a
conversation are chained by these, and each is decoded between the roles that the best chain gives it. So the states are
those of the whole conversation, and no task holds more than a block.

Defined results: roles other than system and assistant (null too) are users; null texts are empty turns; turns without
a number come last in their conversation; exactly repeated rows count once; rows without conversation belong to a
conversation of their own; a text's line that begins with a marker in the transcript's own style starts a turn; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortspark.llm.common import table
from cohortspark.llm.registry import query
from cohortspark.sources.checkpoints import durable

ROLES = ("system", "user", "assistant")

#: Turn numbers of a block.
BLOCK = 1024

#: Markers of each role, one for each style of transcript.
STYLES = (
    {"system": "System:", "user": "User:", "assistant": "Assistant:"},
    {"system": "[SYSTEM]", "user": "Human:", "assistant": "AI:"},
    {"system": "### System:", "user": "### Instruction:", "assistant": "### Response:"},
)
_EXACT = [re.compile("|".join(rf"\s*({re.escape(s[r])}) ?" for r in ROLES), re.IGNORECASE) for s in STYLES]
_NEARLY = re.compile(r"\s*(?:###\s*|\[)?([A-Za-z]{3,14})\s*[:;\]] ?")

#: Marks of a line: none, a role's marker in the transcript's style, in another style, and misspelt.
OTHER, MISSPELT, MARKS = 3, 6, 10

#: Shares that are given: lines that ask, are blank, or look quoted; who speaks first, and who speaks after whom.
GIVEN = {
    "first": (0.2, 0.7, 0.1),
    "next": ((0.02, 0.93, 0.05), (0.02, 0.1, 0.88), (0.02, 0.93, 0.05)),
    "goes_on": 0.6,
    "marked": 0.9,
    "asks": (0.02, 0.3, 0.1),
    "blank": 0.03,
    "quoted": 0.03,
}

#: Observations that a given share is worth, conversations that are counted at most.
PRIOR, SAMPLE = 20, 5000

#: Shares of turns whose marker is missing or misspelt, and that quote a marker, in labelled transcripts.
DAMAGE = {"missing": 0.02, "misspelt": 0.04, "quoted": 0.04}

#: For transcripts whose turns all carry their marker.
CLEAN = {"missing": 0.0, "misspelt": 0.0, "quoted": 0.0}


# --- lines -----------------------------------------------------------------------------------------------------------


def exact_marker(line: str, style: int) -> tuple[int, int] | None:
    """(role, length with the blanks around) of a marker of one style at a line's start."""
    found = _EXACT[style].match(line)
    return None if found is None else (found.lastindex - 1, found.end())


def style_of(lines: list[str]) -> int:
    """The style that most markers at the lines' starts have; of several the first."""
    counts = [sum(exact_marker(line, s) is not None for line in lines) for s in range(len(STYLES))]
    return counts.index(max(counts))


def _near(word: str, other: str) -> bool:
    """Whether one letter that is wrong, missing, too many or exchanged with the next makes one word the other."""
    if abs(len(word) - len(other)) > 1 or word == other:
        return False
    start = next((i for i, (a, b) in enumerate(zip(word, other)) if a != b), min(len(word), len(other)))
    a, b = word[start:], other[start:]
    return a[1:] == b[1:] or a[1:] == b or a == b[1:] or (a[:2] == b[1::-1] and a[2:] == b[2:])


def mark_of(line: str, style: int) -> tuple[int, int]:
    """(mark, length of the marker) of a line."""
    if (found := exact_marker(line, style)) is not None:
        return found[0] + 1, found[1]
    for other in range(len(STYLES)):
        if other != style and (found := exact_marker(line, other)) is not None:
            return found[0] + 1 + OTHER, found[1]
    nearly = _NEARLY.match(line)
    if nearly is not None:
        for number, role in enumerate(ROLES):
            word = re.sub("[^a-z]", "", STYLES[style][role].lower())
            if len(word) > 3 and (nearly[1].lower() == word or _near(nearly[1].lower(), word)):
                return number + 1 + MISSPELT, nearly.end()
    return 0, 0


def features(line: str, style: int) -> tuple[int, int, int, int]:
    """(mark, asks, blank, quoted)."""
    stripped = line.strip()
    quoted = line[:1] == ">" or stripped[:1] in ('"', "“", "'") or line[:2] == "  "
    return mark_of(line, style)[0], int(stripped.endswith("?")), int(not stripped), int(quoted)


# --- model -----------------------------------------------------------------------------------------------------------


class Model:
    """Log shares from counts of (kind, state or role, value); the given shares count as ``PRIOR`` observations."""

    def __init__(self, counts: Mapping[tuple[str, int, int], float] | None = None):
        counts = counts or {}

        def shares(kind: str, state: int, given: list[float]) -> np.ndarray:
            seen = np.array([counts.get((kind, state, v), 0) for v in range(len(given))]) + PRIOR * np.array(given)
            return np.log(seen / seen.sum())

        low = np.full((6, 6), -1e9)
        self.start = np.concatenate([shares("first", 0, list(GIVEN["first"])), low[0, :3]])
        self.move = low
        for state in range(6):
            role = state % 3
            following = shares("next", role, list(GIVEN["next"][role]))
            stops, goes = shares("goes_on", state, [1 - GIVEN["goes_on"], GIVEN["goes_on"]])
            self.move[state, :3] = stops + following
            self.move[state, 3 + role] = goes
        self.mark = np.empty((6, MARKS))
        self.flags = np.empty((3, 6, 2))
        for state in range(6):
            role = state % 3
            few = 0.001
            given = [few] * MARKS
            if state < 3:
                given[role + 1], given[0], given[role + 1 + MISSPELT] = GIVEN["marked"], 0.05, 0.04
            else:
                given[0] = 0.98
            self.mark[state] = shares("mark", state, given)
            asks = GIVEN["asks"][role]
            for i, (kind, share) in enumerate((("asks", asks), ("blank", GIVEN["blank"]), ("quoted", GIVEN["quoted"]))):
                self.flags[i, state] = shares(kind, state, [1 - share, share])

    def observed(self, line: str, style: int) -> np.ndarray:
        """Log-likelihood of a line in each state."""
        mark, *flags = features(line, style)
        return self.mark[:, mark] + sum(self.flags[i, :, v] for i, v in enumerate(flags))

    def seen(self, lines: list[str]) -> list[np.ndarray]:
        style = style_of(lines)
        return [self.observed(line, style) for line in lines]

    def entry(self, before: int | None) -> np.ndarray:
        """Scores of a block's first states after a role, or at the beginning; a block begins with a turn."""
        return self.start if before is None else np.concatenate([self.move[before, :3], np.full(3, -1e9)])


def viterbi(model: Model, seen: list[np.ndarray], before: int | None = None, last: int | None = None) -> list[int]:
    """The most likely states after a role, or at the beginning, that end with a role if one is asked for.

    Of equally likely ones the lowest.
    """
    score, back = model.entry(before) + seen[0], []
    for line in seen[1:]:
        ways = score[:, None] + model.move
        back.append(ways.argmax(0))
        score = ways.max(0) + line
    ends = score if last is None else np.where(np.arange(6) % 3 == last, score, -np.inf)
    states = [int(ends.argmax())]
    for came in reversed(back):
        states.append(int(came[states[-1]]))
    return states[::-1]


def block_scores(model: Model, seen: list[np.ndarray]) -> np.ndarray:
    """Best scores of a block, from each role before it (or the beginning, in the last row) to each role at its end."""
    score = np.stack([model.entry(b) for b in (0, 1, 2, None)]) + seen[0]
    for line in seen[1:]:
        score = (score[:, :, None] + model.move).max(1) + line
    return np.maximum(score[:, :3], score[:, 3:])


def chain(blocks: list[np.ndarray]) -> list[int]:
    """The role at the end of each block on the best way through all of them."""
    score, back = blocks[0][3], []
    for scores in blocks[1:]:
        ways = score[:, None] + scores[:3]
        back.append(ways.argmax(0))
        score = ways.max(0)
    ends = [int(score.argmax())]
    for came in reversed(back):
        ends.append(int(came[ends[-1]]))
    return ends[::-1]


GIVEN_MODEL = Model()


def parse(transcript: str, model: Model = GIVEN_MODEL, before: int | None = None, last: int | None = None) -> list[tuple[str, str]]:
    """(role, text) of each turn."""
    lines = transcript.split("\n")
    style = style_of(lines)
    turns: list[tuple[str, list[str]]] = []
    for line, state in zip(lines, viterbi(model, [model.observed(x, style) for x in lines], before, last)):
        if state < 3:
            turns.append((ROLES[state], [line[mark_of(line, style)[1] :]]))
        else:
            turns[-1][1].append(line)
    return [(role, "\n".join(held)) for role, held in turns]


def render(role: str, text: str) -> str:
    """One turn in the canonical form."""
    return f"<|im_start|>{role}\n{text}<|im_end|>\n"


# --- transcripts and shares ------------------------------------------------------------------------------------------


def damaged_transcript(turns: list[tuple[str, str]], style: int, seed: str, damage: Mapping[str, float] = DAMAGE) -> tuple[list[str], list[int]]:
    """(lines, states) of a transcript of (role, text) turns with missing, misspelt and quoted markers, drawn by a hash."""
    lines, states = [], []
    for i, (role, text) in enumerate(turns):
        number, marker = ROLES.index(role), STYLES[style][role]
        draw = [crc32(f"{seed}:{i}:{kind}".encode()) / 2**32 for kind in ("missing", "misspelt", "quoted", "place")]
        said = text.split("\n")
        if draw[2] < damage["quoted"]:
            other = (style + 1 + int(draw[3] * (len(STYLES) - 1))) % len(STYLES)
            said.insert(1 + int(draw[3] * len(said)), f"{STYLES[other][ROLES[int(draw[3] * 3)]]} as it was said")
        if draw[0] < damage["missing"]:
            first = said[0]
        elif draw[1] < damage["misspelt"]:
            at = next(k for k, c in enumerate(marker) if c.isalpha()) + 1 + int(draw[3] * 2)
            first = f"{marker[:at]}{marker[at + 1 :]} {said[0]}"
        else:
            first = f"{marker} {said[0]}"
        lines += [first, *said[1:]]
        states += [number] + [number + 3] * (len(said) - 1)
    return lines, states


def observations(lines: list[str], states: list[int]) -> Counter:
    """Counts of (kind, state or role, value) in one labelled transcript."""
    out: Counter = Counter()
    style = style_of(lines)
    for line, state, before in zip(lines, states, [None, *states]):
        for kind, value in zip(("mark", "asks", "blank", "quoted"), features(line, style)):
            out[kind, state, value] += 1
        if before is None:
            out["first", 0, state % 3] += 1
        else:
            out["goes_on", before, int(state >= 3)] += 1
            if state < 3:
                out["next", before % 3, state] += 1
    return out


def role_of(role: str = "role") -> Column:
    return F.when(F.col(role).isin("system", "assistant"), F.col(role)).otherwise("user")


def fit_model(turns: DataFrame, sample: int = SAMPLE, damage: Mapping[str, float] = DAMAGE) -> Model:
    """The model with shares counted on labelled turns (conv_id, turn, role, text); a few hundred counts reach the driver."""
    rows = turns.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", role_of().alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.select(F.approx_count_distinct("conv_id")).first()[0] or 0
    share = F.pmod(F.xxhash64("conv_id", F.lit("sample")), F.lit(max(1, -(-total // sample))))
    drawn = rows.where((share == 0) & F.col("turn").between(0, BLOCK - 1)).distinct()
    held = drawn.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for conv, said in zip(batch.column("conv_id").to_pylist(), batch.column("turns").to_pylist()):
                style = crc32(str(conv).encode()) % len(STYLES)
                counts += observations(*damaged_transcript([(t["role"], t["text"]) for t in said], style, str(conv), damage))
        keys = list(counts)
        columns = [[k[0] for k in keys], [k[1] for k in keys], [k[2] for k in keys], [counts[k] for k in keys]]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["kind", "state", "value", "n"])

    counted = held.select("conv_id", "turns").mapInArrow(run, "kind string, state long, value long, n long")
    found = counted.groupBy("kind", "state", "value").agg(F.sum("n").alias("n")).collect()
    return Model({(r["kind"], r["state"], r["value"]): r["n"] for r in found})


def transcripts(turns: DataFrame, style: Column | None = None) -> DataFrame:
    """(conv_id, block, transcript) of rows (conv_id, turn, role, text); the style depends on the conversation."""
    role = role_of()
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES))) if style is None else style
    marker = F.lit(None).cast("string")
    for number, markers in enumerate(STYLES):
        for name, mark in markers.items():
            marker = F.when((style == number) & (role == name), mark).otherwise(marker)
    turn = F.struct(F.col("turn").isNull().alias("last"), "turn", F.concat_ws(" ", marker, F.coalesce("text", F.lit(""))).alias("line"))
    rows = turns.select("conv_id", "turn", "role", "text").distinct()
    grouped = rows.groupBy("conv_id", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(2**62)).alias("block"))
    held = grouped.agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return held.select("conv_id", "block", F.array_join("turns.line", "\n").alias("transcript"))


# --- parsing ---------------------------------------------------------------------------------------------------------

PARSED = "known boolean, conv_id long, block long, position long, role string, text string, rendered string"


def _parsed(raw: DataFrame, model: Model, bounded: bool = False) -> DataFrame:
    """The turns of each block, by itself or between the roles in ``before`` and ``last``."""
    names = [c.split()[0] for c in PARSED.split(", ")]
    kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = []
                for known, conv, block, text, *ends in zip(*(c.to_pylist() for c in batch.slice(at, 512).columns)):
                    said = enumerate(parse(text, model, *ends))
                    rows += [(known, conv, block, i, role, held, render(role, held)) for i, (role, held) in said]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    columns = ["known", "conv_id", "block", "transcript", *(["before", "last"] if bounded else [])]
    return raw.select(*columns).mapInArrow(run, PARSED)


def canonical_turns(raw: DataFrame, model: Model = GIVEN_MODEL) -> DataFrame:
    """(conv_id, block, position, role, text, rendered) of each turn of (conv_id, block, transcript).

    Blocks of one conversation are decoded as one text; positions count on through them.
    """
    key = ["known", "conv_id"]
    stored = durable(
        raw.select(F.col("conv_id").isNotNull().alias("known"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0).cast("long")).alias("conv_id"), "block", "transcript")
    )
    several = durable(stored.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select(*key))
    single = _parsed(stored.join(several, key, "left_anti"), model)
    long = stored.join(several, key, "left_semi")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                scores = block_scores(model, model.seen(row["transcript"].split("\n"))).ravel()
                yield pa.RecordBatch.from_pydict({c: [row[c]] for c in (*key, "block")} | {"scores": pa.array([scores], pa.list_(pa.float64()))})

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                held = row["held"]
                ends = chain([np.array(b["scores"]).reshape(4, 3) for b in held])
                n = len(held)
                columns = {"known": [row["known"]] * n, "conv_id": [row["conv_id"]] * n, "block": [b["block"] for b in held]}
                ways = {"before": pa.array([None, *ends[:-1]], pa.int64()), "last": pa.array(ends, pa.int64())}
                yield pa.RecordBatch.from_pydict(columns | ways)

    scored = long.mapInArrow(score, "known boolean, conv_id long, block long, scores array<double>")
    linked = scored.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("block", "scores"))).alias("held"))
    ends = linked.mapInArrow(link, "known boolean, conv_id long, block long, before long, last long")
    decoded = durable(_parsed(long.join(durable(ends), [*key, "block"]), model, bounded=True))
    earlier = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    sizes = decoded.groupBy(*key, "block").agg(F.count(F.lit(1)).alias("n"))
    starts = durable(sizes.select(*key, "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start")))
    whole = decoded.join(starts, [*key, "block"]).withColumn("position", F.col("position") + F.col("start")).drop("start")
    turns = single.unionByName(whole)
    return turns.select(F.when(F.col("known"), F.col("conv_id")).alias("conv_id"), "block", "position", "role", "text", "rendered")


#: What has to come back from transcripts of the given table: its roles are the three, and no line starts like a marker.
SQL = """
SELECT conv_id, (turn // 1024)::BIGINT AS block,
  (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::BIGINT AS position, role, text,
  '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS rendered
FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)
"""


@query("op2_chat_format", SQL)
def op2_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """Each conversation as a raw transcript in one of several styles, parsed and rendered again.

    These transcripts are without damage, and so are those that the shares are counted on.
    """
    turns = table(spark, folder, "conversations")
    return canonical_turns(transcripts(turns), fit_model(turns, damage=CLEAN))
