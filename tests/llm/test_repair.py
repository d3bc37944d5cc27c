"""Conversation repair against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from instructset.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_rows(rows):
    """Damaged rows of each conversation in order."""
    out = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        chance = zlib.crc32(name.encode()) % 20
        if chance == 0:
            continue
        text = "" if chance == 1 else re.sub("[.!?]", "", text) if chance == 2 else text
        role = "user" if chance == 4 else role
        out[conv] += [(turn, role, text)] * (2 if chance == 3 else 1)
    for conv in out:
        out[conv].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_parse(roles, found):
    """(cost, audit, emitted) by stepping through the rows, states being what was emitted so far."""
    step = repair.MOVES
    # state -> (cost, audit, emitted)
    best = {0: (0, "", ())}

    def spread(best):
        todo = list(best.items())
        while todo:
            state, (cost, audit, out) = todo.pop()
            for x, name in (("u", "user"), ("a", "assistant")):
                if (to := step.get((state, x))) is not None:
                    new = (cost + 3, audit + "I", (*out, (name, None)))
                    if to not in best or new[:2] < best[to][:2]:
                        best[to] = new
                        todo.append((to, new))
        return best

    best = spread(best)
    for i, (role, fault) in enumerate(zip(roles, found, strict=True)):
        nxt = {}

        def offer(state, new):
            if state not in nxt or new[:2] < nxt[state][:2]:
                nxt[state] = new

        for state, (cost, audit, out) in best.items():
            offer(state, (cost + 4, audit + "D", out))
            if fault in ("b", "d"):
                continue
            more = 3 if fault == "t" else 0
            if (to := step.get((state, role[:1]))) is not None:
                offer(to, (cost + more, audit + "K", (*out, (role, i))))
            for x, name in (("u", "user"), ("a", "assistant")):
                if (to := step.get((state, x))) is not None:
                    offer(to, (cost + 3 + more, audit + "R", (*out, (name, i))))
        best = spread(nxt)
    return min((best[q] for q in (0, 3) if q in best), key=lambda b: b[:2])


def plain_report(rows):
    out = {}
    for conv, own in plain_rows(rows).items():
        found = faults(own)
        n = Counter(found)
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, emitted = plain_parse([r[1] for r in own], found)
        assert re.fullmatch("(s?(ua)+)?", "".join(role[:1] for role, _ in emitted))
        body = "\n".join(f"{role}:{'' if i is None else own[i][2]}" for role, i in emitted)
        sha = hashlib.sha256(body.encode()).hexdigest()
        out[conv] = (gaps, n["b"], n["d"], n["t"], illegal, cost, audit, sha)
    return out


def random_rows(rng, convs, most):
    rows = []
    for conv in convs:
        for turn in range(rng.randrange(most)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "User", "", None, "admin"])
            text = rng.choice([None, "", " \n", "Yes.", "No!", "why? ", "cut off", "end.\x0b", f"text {rng.random()}.", f"{rng.random()}", "é。", "."])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role, text))
    return rows


def random_leaves(rng, n):
    return [(rng.choice("suua?a"), rng.choice(["", "", "", "d", "t"])) for _ in range(n)]


def test_blocks_and_pieces_give_the_cell_of_the_whole_chart(monkeypatch):
    rng = random.Random(1)
    for _ in range(60):
        rows = random_leaves(rng, rng.randrange(1, 14))
        chart = {(i, i + 1): repair.leaf(*r) for i, r in enumerate(rows)}
        for length in range(2, len(rows) + 1):
            for i in range(len(rows) - length + 1):
                splits = [repair.joined(chart[i, k], chart[k, i + length]) for k in range(i + 1, i + length)]
                # Every split of a span gives the same cell.
                assert len(set(splits)) == 1
                chart[i, i + length] = splits[0]
        for size in (1, 2, 3, 8):
            monkeypatch.setattr(repair, "BLOCK", size)
            assert repair.piece_cell(rows, [1] * len(rows)) == chart[0, len(rows)]


def test_insertions_are_closed_and_the_empty_span_is_neutral():
    rng = random.Random(2)
    assert repair.joined(repair.EMPTY, repair.EMPTY) == repair.EMPTY
    for _ in range(20):
        cell = repair.piece_cell(random_leaves(rng, 3), [1, 1, 1])
        assert repair.joined(cell, repair.EMPTY) == cell == repair.joined(repair.EMPTY, cell)
    assert len(repair.PAIRS) == 11
    assert repair.joined(repair.deletions(2), repair.deletions(3)) == repair.deletions(5)


def test_cells_are_the_cheapest_audits_by_enumeration():
    """Against all strings of edits of a few rows."""
    from itertools import product

    rng = random.Random(3)
    for _ in range(40):
        rows = random_leaves(rng, rng.randrange(0, 4))
        found = []
        for inserts in product(range(3), repeat=len(rows) + 1):
            for edits in product("KRD", repeat=len(rows)):
                ways = [""]
                cost = 3 * sum(inserts)
                audit = "I" * inserts[0]
                ways = [w + "".join(x) for w in ways for x in product("ua", repeat=inserts[0])]
                for (initial, fault), edit, after in zip(rows, edits, inserts[1:], strict=True):
                    if edit != "D" and fault == "d":
                        break
                    cost += {"K": 0, "R": 3, "D": 4}[edit] + (3 if fault == "t" and edit != "D" else 0)
                    audit += edit + "I" * after
                    kinds = {"K": [initial], "R": ["u", "a"], "D": [""]}[edit]
                    ways = [w + k + "".join(x) for w in ways for k in kinds for x in product("ua", repeat=after)]
                else:
                    if any(re.fullmatch("(s?(ua)+)?", w) for w in ways):
                        found.append((cost, audit))
        cell = repair.piece_cell(rows, [1] * len(rows)) if rows else repair.EMPTY
        assert min(cell[repair.PAIRS.index((0, q))] for q in (0, 3)) == min(found)


def report(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("repeated", [False, True])
def test_op13(spark, folder_of, repeated):
    rng = random.Random(4)
    rows = random_rows(rng, [*range(150), None], 9) + random_rows(rng, [900], 400) + [(901, 5, None, None)] * 7
    if repeated:
        rows = [r for r in rows if r[0] in (900, None)] * 2
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = queries.QUERIES["op13_conversations"](spark, folder_of(conversations=df))
    assert [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"] * 2
    assert got.count() == len({r[0] for r in rows})
    assert report(got) == plain_report(rows)


def test_a_conversation_in_many_pieces(spark):
    rng = random.Random(5)
    rows = random_rows(rng, range(4), 60)
    want = plain_report(rows)
    given = spark.createDataFrame(rows, SCHEMA)

    # Pieces of a few rows, as the tasks would cut them if PIECE_ROWS were small.
    def cut(batches):
        from instructset.llm import repair as own

        own.PIECE_ROWS = 3
        try:
            yield from own._cut(batches)
        finally:
            own.PIECE_ROWS = 2048

    whole = repair._cut
    repair._cut = cut
    try:
        pieces = repair.pieces_of(repair.damaged(given), given)
    finally:
        repair._cut = whole
    assert pieces.count() > 12
    assert report(repair.repair_report(pieces)) == want
    lines = defaultdict(list)
    for r in sorted(repair.repaired_rows(pieces).collect(), key=lambda r: (r.conv_id, r.place)):
        assert r.place == len(lines[r.conv_id]) and (r.turn is None or r.edit != "I")
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    for conv, found in want.items():
        assert hashlib.sha256("\n".join(lines[conv]).encode()).hexdigest() == found[-1]


def test_op13_over_given_conversations(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert report(queries.QUERIES["op13_conversations"](spark, folder)) == plain_report(rows)


def test_no_rows_extra_columns_and_a_conversation_that_loses_all(spark, folder_of, tmp_path):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Gone.", 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA + ", copies int, digest string")
    got = report(queries.QUERIES["op13_conversations"](spark, folder_of(conversations=df)))
    assert got == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert queries.QUERIES["op13_conversations"](spark, f"{tmp_path}/none").collect() == []


def test_long_texts(spark):
    rows = [(1, 1, "user", "word " * 400_000 + "."), (1, 2, "assistant", "a." * 900_000), (1, 3, "user", " " * 2_000_000)]
    given = spark.createDataFrame(rows, SCHEMA)
    report_ = repair.repair_report(repair.pieces_of(given)).collect()[0]
    assert (report_.cost, report_.audit, report_.blank) == (4, "KKD", 1)
