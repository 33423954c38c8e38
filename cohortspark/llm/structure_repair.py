"""Cheapest repair of a conversation's turns by weighted CYK interval parsing.

A conversation is well formed when its roles spell ``(s?(ua)+)?``: an optional system turn, then user and assistant in
turn. Blank rows and rows seen earlier must go, others may be kept, given another role, or deleted, and empty turns may be
inserted anywhere; truncated rows cost more if they stay.

The repair grammar is in Chomsky normal form. It has a nonterminal for each pair of states (p, q) of the roles' automaton,
for what leads from p to q, with the rules (p, q) -> (p, r) (r, q); one row is a terminal by each edit that it allows, and
insertions are closed over: what they lead to from every state, at least cost, is part of each cell. A cell of a span holds
for each nonterminal the cheapest (cost, audit), where the audit names the edits in order. Spans are combined bottom-up by
length: 1, 2, 4 and so on. One way to split a span is enough, as the rules hold for all states r and so every way to split
gives the same cells (tested against all of them). Of equal costs the least audit wins; two audits of one cell with equal
cost are never one another's beginnings, so this holds for parts as for the whole.

Rows are put in order by a range partitioning of conversation and turn, so a conversation of any length is spread over
tasks and parsed in pieces of ``PIECE`` rows. A conversation that lies within one partition and one piece is done there.
Pieces of others are combined level by level, up to ``FAN`` at a time, and each piece gets its part of the audit back to
write its repaired turns. Copies of a row are counted before rows are ordered; rows seen earlier are found by the smallest
turn of their role and text.

Defined results: rows of a conversation are in order of turn, missing turns first, then role, then the text's first 64
characters, then its MD5; missing roles and texts are one space; an empty role is no initial; roles other than those that
begin with s, u or a have to be changed or deleted; rows without conversation belong to a conversation of their own;
exactly repeated rows repeat; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortspark.llm.common import BLANKS, table
from cohortspark.llm.registry import query
from cohortspark.sources.checkpoints import durable

#: Costs of the edits, and what a truncated row costs that stays.
CHANGE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

#: States: nothing yet, after system, after user, after assistant; what each initial leads to; where a conversation may end.
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)

#: An edit is one letter, in the order of the audit's letters D, I, K, R: inserted and changed rows tell user from assistant.
DROP, NEW, KEEP, TURN = "D", {"a": "H", "u": "I"}, "K", {"a": "Q", "u": "R"}
AUDIT = str.maketrans({"H": "I", "Q": "R"})
ROLE = {"a": "assistant", "u": "user"}
MADE = {NEW[c]: ROLE[c] for c in ROLE} | {TURN[c]: ROLE[c] for c in ROLE}

#: Rows of a piece, and pieces that are combined at once.
PIECE, FAN = 1024, 64

Cells = dict[tuple[int, int], tuple[int, str]]


def combine(left: Cells, right: Cells) -> Cells:
    """Cells of a span from those of its two parts, by all rules (p, q) -> (p, r) (r, q)."""
    out: Cells = {}
    for (p, r), (cost, edits) in left.items():
        for (s, q), (more, rest) in right.items():
            if r == s:
                found = cost + more, edits + rest
                if (p, q) not in out or found < out[p, q]:
                    out[p, q] = found
    return out


def _closure() -> Cells:
    """What insertions alone lead to."""
    steps: Cells = {(p, p): (0, "") for p in range(4)}
    for (p, c), q in MOVES.items():
        if c in NEW:
            steps[p, q] = INSERT, NEW[c]
    while (more := combine(steps, steps)) != steps:
        steps = more
    return steps


INSERTED = _closure()


@lru_cache(maxsize=1 << 14)
def cells(rows: str) -> Cells:
    """Cells of a span.

    A row is one letter: its initial, in upper case when truncated, '-' for another initial, '+' for another initial and
    truncated, '!' for a row that has to go.
    """
    if not rows:
        return INSERTED
    if len(rows) > 1:
        half = 1 << (len(rows) - 1).bit_length() - 1  # the longest span of the length before
        return combine(cells(rows[:half]), cells(rows[half:])) if len(rows) <= 64 else parse(rows)
    edits: Cells = {(p, p): (DELETE, DROP) for p in range(4)}
    if rows != "!":
        more = TRUNCATED if rows == "+" or rows.isupper() else 0
        for (p, c), q in MOVES.items():
            if c == rows.lower():
                edits[p, q] = more, KEEP
            elif c in TURN:
                edits[p, q] = more + CHANGE, TURN[c]
    return combine(combine(INSERTED, edits), INSERTED)


def parse(rows: str) -> Cells:
    """Cells of a longer span: those of all spans of 64 rows, then of twice as many, and so on."""
    spans = [cells(rows[i : i + 64]) for i in range(0, len(rows), 64)]
    return combined(spans)


def combined(spans: list[Cells]) -> Cells:
    """Cells of spans in a row, combined by pairs of neighbours until one is left."""
    while len(spans) > 1:
        odd = spans[len(spans) // 2 * 2 :]
        spans = [combine(a, b) for a, b in zip(spans[::2], spans[1::2])] + odd
    return spans[0] if spans else INSERTED


def cheapest(found: Cells) -> tuple[int, str]:
    """(cost, edits) of a whole conversation."""
    return min(found[0, q] for q in ENDS if (0, q) in found)


def repaired(rows: list[tuple[str, str]], edits: str) -> list[tuple[str, str]]:
    """(role, text) of the turns that the edits leave of these rows."""
    at, out = iter(rows), []
    for edit in edits:
        if edit in NEW.values():
            out.append((MADE[edit], ""))
            continue
        role, text = next(at)
        if edit != DROP:
            out.append((MADE.get(edit, role), text))
    return out


def cut_edits(edits: str, rows: list[int]) -> list[str]:
    """Parts of the edits for pieces of so many rows; insertions go with the row that follows, the last with the last."""
    out, at, places = [], 0, [i for i, e in enumerate(edits) if e not in NEW.values()]
    done = 0
    for n in rows:
        done += n
        stop = places[done - 1] + 1 if done else 0
        out.append(edits[at:stop])
        at = stop
    out[-1] += edits[at:]
    return out


# --- pieces ----------------------------------------------------------------------------------------------------------

NUMBERS = ("n_rows", "blank", "duplicate", "truncated", "illegal", "n_turns")

KEY = "known boolean, conv string"
FACTS = ", ".join(f"{n} long" for n in NUMBERS) + ", least_turn long, most_turn long, first string, last string"
STATES = sorted({(p, q) for p, q in INSERTED})
LEGAL = {"su", "ua", "au"}


class Piece:
    """Rows of one conversation that follow one another, and what is counted of them."""

    def __init__(self):
        self.kinds, self.rows = [], []
        self.facts = dict.fromkeys(NUMBERS, 0) | {"least_turn": None, "most_turn": None, "first": None, "last": None}

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        said = text.strip(BLANKS)
        fault = "blank" if not said else "duplicate" if seen else "truncated" if said[-1] not in ".!?" else None
        initial = role[:1]
        if fault in ("blank", "duplicate"):
            kind = "!"
        else:
            kind = initial if initial in ("s", "u", "a") else "-"
            if fault:
                kind = kind.upper() if kind != "-" else "+"
        one = {"n_rows": 1, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "n_turns": int(turn is not None)}
        if fault:
            one[fault] = 1
        self.facts = joined_facts(self.facts, one | {"least_turn": turn, "most_turn": turn, "first": initial, "last": initial})
        self.kinds.append(kind)
        self.rows.append((role, text))


def joined_facts(a: dict, b: dict) -> dict:
    """What is counted of two neighbouring parts together."""
    out = {n: a[n] + b[n] for n in NUMBERS}
    if a["last"] is not None and b["first"] is not None:
        out["illegal"] += a["last"] + b["first"] not in LEGAL
    if a["most_turn"] is not None and a["most_turn"] == b["least_turn"]:
        out["n_turns"] -= 1
    out["least_turn"] = b["least_turn"] if a["least_turn"] is None else a["least_turn"]
    out["most_turn"] = a["most_turn"] if b["most_turn"] is None else b["most_turn"]
    out["first"] = b["first"] if a["first"] is None else a["first"]
    out["last"] = a["last"] if b["last"] is None else b["last"]
    return out


def _gaps(facts: dict) -> int:
    return 0 if facts["least_turn"] is None else facts["most_turn"] - facts["least_turn"] + 1 - facts["n_turns"]


def ordered_rows(turns: DataFrame, conv: str, turn: str, role: str, text: str, copies: str) -> DataFrame:
    """(known, conv, turn, role, text, n, first_of): equal rows once with their number, and the smallest turn of their
    role and text when other turns have these, too. ``n`` is 0 for rows that only tell of a conversation."""
    plain = turns.select(
        F.col(conv).isNotNull().alias("known"),
        F.coalesce(F.col(conv).cast("string"), F.lit("")).alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"),
        F.col(copies).cast("long").alias("n"),
    )
    there = plain.where(F.col("n") > 0)
    digest = F.unhex(F.md5(F.concat(F.col("role"), F.lit("\0"), F.col("text"))))
    firsts = there.select("known", "conv", "turn", digest.alias("digest")).groupBy("known", "conv", "digest").agg(
        F.min("turn").alias("first_turn"), F.max(F.col("turn").isNull()).alias("unnumbered"), F.count("*").alias("rows")
    )
    firsts = durable(firsts.where(F.col("rows") > 1))
    met = there.withColumn("digest", digest).join(firsts, ["known", "conv", "digest"], "left")
    earlier = F.col("turn").isNotNull() & (F.col("unnumbered") | (F.col("first_turn") < F.col("turn")))
    columns = ["known", "conv", "turn", "role", "text"]
    rows = met.where(F.col("rows").isNull()).select(*columns, "n", F.lit(False).alias("seen"))
    again = met.where(F.col("rows").isNotNull()).groupBy(*columns).agg(F.sum("n").alias("n"), F.max(F.coalesce(earlier, F.lit(False))).alias("seen"))
    rows = rows.unionByName(again)
    nothing = plain.where(F.col("n") <= 0).select("known", "conv").distinct()
    missing = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"))]
    nothing = nothing.select("known", "conv", *missing, F.lit(0).cast("long").alias("n"), F.lit(False).alias("seen"))
    return rows.unionByName(nothing)


def pieces(rows: DataFrame, piece: int) -> DataFrame:
    """Pieces of all conversations; ``whole`` ones have the repaired turns, others the cells and rows."""
    order = ["known", "conv", "turn", F.substring("role", 1, 64), "role_end", F.substring("text", 1, 64), "digest"]
    keyed = rows.withColumn("role_end", F.md5("role")).withColumn("digest", F.md5("text"))
    sorted_rows = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("known", "conv", "turn", "role", "text", "n", "seen")
    pair = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    facts = [(n, pa.int64()) for n in (*NUMBERS, "least_turn", "most_turn")] + [("first", pa.string()), ("last", pa.string())]
    kinds = pa.schema(
        [("known", pa.bool_()), ("conv", pa.string()), ("part", pa.int64()), ("number", pa.int64()), ("whole", pa.bool_()), *facts]
        + [("cost", pa.int64()), ("edits", pa.string()), ("costs", pa.list_(pa.int64())), ("ways", pa.list_(pa.string())), ("turns", pair)]
    )
    ddl = f"{KEY}, part long, number long, whole boolean, {FACTS}, cost long, edits string, costs array<long>, ways array<string>, turns array<struct<role string, text string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        current, held, number, opened = None, Piece(), 0, True
        out: list[dict] = []
        size = 0

        def close(whole: bool) -> None:
            nonlocal held, number, size
            found = parse("".join(held.kinds))
            row = {"known": current[0], "conv": current[1], "part": part, "number": number, "whole": whole} | held.facts
            if whole:
                row["cost"], row["edits"] = cheapest(found)
                row["turns"] = [{"role": r, "text": t} for r, t in repaired(held.rows, row["edits"])]
            else:
                row["costs"], row["ways"] = ([found[s][i] for s in STATES] for i in (0, 1))
                row["turns"] = [{"role": r, "text": t} for r, t in held.rows]
            out.append(row)
            size += sum(len(t) for _, t in held.rows) + 200
            held, number = Piece(), number + 1

        def ready() -> pa.RecordBatch:
            nonlocal out, size
            made = pa.RecordBatch.from_pylist(out, kinds)
            out, size = [], 0
            return made

        for batch in batches:
            for known, conv, turn, role, text, n, seen in zip(*(c.to_pylist() for c in batch.columns)):
                if current != (known, conv):
                    if current is not None:
                        close(whole=not opened)
                        opened = False
                    current = known, conv
                elif len(held.rows) >= piece:
                    close(whole=False)
                    opened = True
                for copy in range(n):
                    if len(held.rows) >= piece:
                        close(whole=False)
                        opened = True
                        if size >= 1 << 22:
                            yield ready()
                    held.add(turn, role, text, seen or copy > 0)
                if size >= 1 << 22:
                    yield ready()
        if current is not None:
            close(whole=False)  # the conversation may go on in the next partition
        if out:
            yield ready()

    return sorted_rows.mapInArrow(run, ddl)


def _compose(rows: list[dict]) -> dict:
    """One row for pieces in a row."""
    facts = rows[0]
    for row in rows[1:]:
        facts = joined_facts(facts, row)
    whole = combined([{s: (c, w) for s, c, w in zip(STATES, r["costs"], r["ways"])} for r in rows])
    return {n: facts[n] for n in (*NUMBERS, "least_turn", "most_turn", "first", "last")} | {
        "costs": [whole[s][0] for s in STATES],
        "ways": [whole[s][1] for s in STATES],
    }


COMPOSED = f"{KEY}, number long, {FACTS}, costs array<long>, ways array<string>"


def composed(open_pieces: DataFrame, fan: int) -> DataFrame:
    """One row for each conversation of pieces (known, conv, number from 0, facts, cells), combined level by level."""
    names = [c.split()[0] for c in COMPOSED.split(", ")]
    level = open_pieces.select(*names)
    kinds = level.limit(0).toArrow().schema
    last = level.agg(F.max("number")).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                made = _compose(row["held"])
                yield pa.RecordBatch.from_pylist([{"known": row["known"], "conv": row["conv"], "number": row["number"]} | made], kinds)

    while True:
        held = F.sort_array(F.collect_list(F.struct(*names[2:]))).alias("held")
        grouped = level.groupBy("known", "conv", F.floor(F.col("number") / fan).alias("number")).agg(held)
        level = durable(grouped.mapInArrow(run, COMPOSED))
        if not last:
            return level
        last //= fan


def repair(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    copies: Column | None = None,
    piece: int = PIECE,
    fan: int = FAN,
) -> tuple[DataFrame, DataFrame]:
    """(reports, repaired): both with the conversation as (``known``, ``conv``: its id as text).

    Reports have a row for each conversation: gaps, blank, duplicate, truncated, illegal, cost, audit. Repaired turns come in
    pieces in order of ``part`` and ``number``: ``turns`` is an array of (role, text). ``copies`` says how often a row is
    there; a row with 0 copies still tells that there is such a conversation.
    """
    names = {"turn": turn, "role": role, "text": text, "conv": conv}
    rows = turns.select(*[F.col(f"`{c}`").alias(n) for n, c in names.items()], (F.lit(1) if copies is None else copies).alias("copies"))
    found = durable(pieces(ordered_rows(rows, "conv", "turn", "role", "text", "copies"), piece))
    done, rest = found.where("whole"), found.where(~F.col("whole"))

    order = Window.partitionBy("known", "conv").orderBy("part", "number")  # a row for each piece, not for each turn
    numbers = rest.select("known", "conv", "part", "number", "n_rows").withColumn("no", F.row_number().over(order) - 1)
    numbers = durable(numbers.withColumn("no", F.col("no").cast("long")))
    cells_of = rest.drop("turns", "n_rows").join(numbers, ["known", "conv", "part", "number"])
    roots = composed(durable(cells_of.drop("number").withColumnRenamed("no", "number")), fan)
    sizes = numbers.groupBy("known", "conv").agg(F.sort_array(F.collect_list(F.struct("no", "n_rows"))).alias("held"))
    cut = roots.select("known", "conv", "costs", "ways").join(sizes, ["known", "conv"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                cost, edits = cheapest({s: (c, w) for s, c, w in zip(STATES, row["costs"], row["ways"])})
                parts = cut_edits(edits, [p["n_rows"] for p in row["held"]])
                n = len(parts)
                columns = [[row["known"]] * n, [row["conv"]] * n, [p["no"] for p in row["held"]], [cost] * n, parts]
                kinds = (pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["known", "conv", "no", "cost", "edits"])

    chosen = durable(cut.mapInArrow(choose, f"{KEY}, no long, cost long, edits string"))
    located = numbers.drop("n_rows").join(chosen, ["known", "conv", "no"])
    met = rest.select("known", "conv", "part", "number", "turns").join(located, ["known", "conv", "part", "number"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            written = []
            for held, edits in zip(batch.column("turns").to_pylist(), batch.column("edits").to_pylist()):
                made = repaired([(t["role"], t["text"]) for t in held], edits)
                written.append([{"role": r, "text": t} for r, t in made])
            kept = [batch.column(c) for c in ("known", "conv", "part", "number")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(written, batch.column("turns").type)], ["known", "conv", "part", "number", "turns"])

    said = "turns array<struct<role string, text string>>"
    mended = met.select("known", "conv", "part", "number", "turns", "edits").mapInArrow(write, f"{KEY}, part long, number long, {said}")
    mended = done.select("known", "conv", "part", "number", "turns").unionByName(durable(mended))

    gaps = F.coalesce(F.col("most_turn") - F.col("least_turn") + 1 - F.col("n_turns"), F.lit(0)).alias("gaps")
    audit = F.translate("edits", "HQ", "IR").alias("audit")
    counted = [gaps, "blank", "duplicate", "truncated", "illegal"]
    audits = chosen.groupBy("known", "conv").agg(
        F.max("cost").alias("cost"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", "edits"))), lambda x: x.edits), "").alias("edits")
    )
    reports = done.select("known", "conv", *counted, "cost", audit)
    return reports.unionByName(roots.join(audits, ["known", "conv"]).select("known", "conv", *counted, "cost", audit)), mended


def digests(mended: DataFrame) -> DataFrame:
    """(known, conv, repaired_sha256): hash of the lines `role:text`, joined by line ends, of each conversation's pieces.

    A conversation's pieces pass one task in order, without being held together there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, hashed, empty = None, sha256(), True
        names = ["known", "conv", "repaired_sha256"]

        def ready() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*current, hashed.hexdigest())], names)

        for batch in batches:
            for known, conv, turns in zip(*(batch.column(c).to_pylist() for c in ("known", "conv", "turns"))):
                if current != (known, conv):
                    if current is not None:
                        yield ready()
                    current, hashed, empty = (known, conv), sha256(), True
                if turns:
                    hashed.update(("" if empty else "\n").encode() + "\n".join(f"{t['role']}:{t['text']}" for t in turns).encode())
                    empty = False
        if current is not None:
            yield ready()

    first = F.min(F.struct("part", "number")).alias("first")
    last = F.max(F.struct("part", "number")).alias("last")
    several = durable(mended.groupBy("known", "conv").agg(first, last).where(F.col("first") != F.col("last")).select("known", "conv"))
    line = F.transform("turns", lambda t: F.concat(t.role, F.lit(":"), t.text))
    single = mended.join(several, ["known", "conv"], "left_anti")
    single = single.select("known", "conv", F.sha2(F.encode(F.array_join(line, "\n"), "UTF-8"), 256).alias("repaired_sha256"))
    split = mended.join(several, ["known", "conv"], "left_semi")
    split = split.repartition("known", "conv").sortWithinPartitions("known", "conv", "part", "number")
    return single.unionByName(split.mapInArrow(run, f"{KEY}, repaired_sha256 string"))


def damaged(turns: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text) with planted faults, and ``copies``: how often the row is there then."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fault = F.crc32(F.encode(F.concat(shown[0], F.lit(":"), shown[1]), "UTF-8")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return turns.select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"),
    )


@query("op11_structure_repair")
def op11_structure_repair(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    reports, mended = repair(damaged(turns), copies=F.col("copies"))
    rows = reports.join(digests(mended), ["known", "conv"])
    conv_id = F.when(F.col("known"), F.col("conv")).cast(turns.schema["conv_id"].dataType).alias("conv_id")
    counted = [F.col(c).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return rows.select(conv_id, *counted, "audit", "repaired_sha256")
