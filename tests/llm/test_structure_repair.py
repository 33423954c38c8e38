import random
import re
from hashlib import sha256
from zlib import crc32

import pytest
from cohortspark.llm.structure_repair import (
    AUDIT, CHANGE, DELETE, INSERT, INSERTED, MOVES, TRUNCATED, cells, cheapest, combine, cut_edits, op11_structure_repair, parse, repair, repaired,
)
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string"
INITIAL = {"s": "system", "u": "user", "a": "assistant", "-": "tool"}
BLANK = "\x20\x09\x0a\x0b\x0c\x0d"


def plain_damage(rows):
    """{conv_id: rows after damage in order}"""
    out = {}
    for conv, turn, role, text in rows:
        held = out.setdefault(conv, [])
        fault = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault == 0:
            continue
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        held += [(turn, role, text)] * (2 if fault == 3 else 1)
    return {c: sorted(held, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, held in out.items()}


def plain(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, lines), row by row and state by state."""
    seen, kinds, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        said = text.strip(BLANK)
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        kinds.append(fault)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    states = {0: (0, "", ())}

    def inserted(states):
        for _ in range(3):
            for p, (cost, audit, lines) in list(states.items()):
                for (at, c), q in MOVES.items():
                    if at == p and c in "ua":
                        way = cost + 5, audit + "I", lines + (INITIAL[c] + ":",)
                        states[q] = min(states.get(q, way), way, key=lambda w: w[:2])
        return states

    for (_, role, text), fault in zip(rows, kinds):
        after = {}
        for p, (cost, audit, lines) in inserted(states).items():
            ways = [(p, (cost + 2, audit + "D", lines))]
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                for (at, c), q in MOVES.items():
                    if at == p and role[:1] == c:
                        ways.append((q, (cost + more, audit + "K", lines + (f"{role}:{text}",))))
                    if at == p and c in "ua":
                        ways.append((q, (cost + more + 1, audit + "R", lines + (f"{INITIAL[c]}:{text}",))))
            for q, way in ways:
                after[q] = min(after.get(q, way), way, key=lambda w: w[:2])
        states = after
    states = inserted(states)
    cost, audit, lines = min((states[q] for q in (0, 3) if q in states), key=lambda w: w[:2])
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, sha256("\n".join(lines).encode()).hexdigest()


def all_splits(rows):
    """Cells of the whole from every split of every span."""
    table = {}
    for i in range(len(rows)):
        table[i, i + 1] = cells(rows[i])
    for length in range(2, len(rows) + 1):
        for i in range(len(rows) - length + 1):
            ways = [combine(table[i, m], table[m, i + length]) for m in range(i + 1, i + length)]
            assert all(w == ways[0] for w in ways)
            table[i, i + length] = ways[0]
    return table[0, len(rows)]


def test_one_split_is_enough():
    rng = random.Random(1)
    for _ in range(60):
        rows = "".join(rng.choice("suaSUA-+!") for _ in range(rng.randint(1, 9)))
        assert cells(rows) == parse(rows) == all_splits(rows)
    long = "".join(rng.choice("suaSUA-+!") for _ in range(500))
    assert parse(long) == combine(parse(long[:123]), parse(long[123:]))


def test_insertions_are_closed_over():
    assert combine(INSERTED, INSERTED) == INSERTED
    assert cells("") == INSERTED and cheapest(INSERTED) == (0, "")
    assert (CHANGE, DELETE, INSERT, TRUNCATED) == (1, 2, 5, 5)
    assert cheapest(cells("ua")) == (0, "KK")
    assert [(c, e.translate(AUDIT)) for c, e in (cheapest(cells(k)) for k in ("s", "aa", "!u!a", "u"))] == [(2, "D"), (1, "RK"), (4, "DKDK"), (2, "D")]


def test_pieces_of_edits():
    parts = cut_edits("IKHDQKH", [0, 1, 2, 1])
    assert parts == ["", "IK", "HDQ", "KH"]
    rows = [("user", "1"), ("tool", "2"), ("user", "3"), ("user", "4")]
    whole = repaired(rows, "IKHDQKH")
    assert whole == repaired(rows[:1], parts[1]) + repaired(rows[1:3], parts[2]) + repaired(rows[3:], parts[3])


def conversations(seed, n=120):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t", None, "Yes.", "éß 🙂", "a.b", "x. "]
    roles = ["system", "user", "assistant", "tool", None, "User", "", "usher"]
    out = []
    for conv in [*range(n), None]:
        turns = rng.randint(0, 9) if conv is not None and conv != 3 else 60
        for i in range(max(1, turns)):
            role = rng.choice(roles) if rng.random() < 0.2 else ["user", "assistant"][i % 2]
            text = rng.choice(texts) if rng.random() < 0.3 else f"Said {rng.random()}."
            turn = rng.choice([None, 2, 2**40]) if rng.random() < 0.05 else i
            out.append((conv, turn, role, text))
    return out + out[:5]


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("seed", [1, 2])
def test_query(spark, tmp_path, seed):
    rows = conversations(seed)
    spark.createDataFrame(rows, SCHEMA).withColumn("part", F.lit("x")).withColumn("known", F.lit(1)).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r[n] for n in NAMES) for r in op11_structure_repair(spark, str(tmp_path)).collect()}
    assert got == {c: plain(held) for c, held in plain_damage(rows).items()}


@pytest.mark.parametrize("piece, fan", [(3, 2), (7, 64), (1024, 64)])
def test_pieces(spark, piece, fan):
    """Conversations over many pieces and partitions, and copies of rows, without damage."""
    from cohortspark.llm.structure_repair import digests

    rng = random.Random(piece)
    rows = [(7, i, rng.choice(["user", "assistant"]), f"n {i}" + rng.choice([".", ""])) for i in range(200)]
    rows += [(None, None, "user", "same."), (8, 5, "user", "said."), (8, 6, "assistant", "told.")] + [(9, 1, "system", "again.")] * 30
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    reports, mended = repair(df, piece=piece, fan=fan)
    found = reports.join(digests(mended), ["known", "conv"]).collect()
    held = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] or 0, r[1] or 0)):
        held.setdefault("" if conv is None else str(conv), []).append((turn, role, text))
    assert {r.conv: tuple(r[n] for n in NAMES) for r in found} == {c: plain(h) for c, h in held.items()}


def test_nothing_left_and_no_rows(spark, tmp_path):
    dropped = next(i for i in range(1000) if crc32(f"{i}:0".encode()) % 20 == 0)
    spark.createDataFrame([(dropped, 0, "user", "Gone.")], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert tuple(op11_structure_repair(spark, str(tmp_path)).first()) == (dropped, 0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())
    empty = tmp_path / "none"
    spark.createDataFrame([], SCHEMA).write.parquet(f"{empty}/conversations.parquet")
    assert op11_structure_repair(spark, str(empty)).count() == 0
