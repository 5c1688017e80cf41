import itertools
import random
import re
import zlib

from trackmill.llm import repair

SHAPE = re.compile(r"(s?(ua)+)?\Z")
SPACE = " \t\n\v\f\r"


def edits(rows):
    """Cheapest (cost, audit, lines) over every way to edit rows, with up to two inserts in a place."""
    marks, seen = [], set()
    for role, text in rows:
        blank = not text.strip(SPACE)
        marks.append("blank" if blank else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(SPACE)[-1] not in ".!?" else "")
        seen.add((role, text))
    choices = []
    for (role, text), mark in zip(rows, marks):
        more, own = 3 * (mark == "truncated"), [(4, "D", [])]
        if mark not in ("blank", "duplicate"):
            own += [(more, "K", [(role, text)])] if role else []
            own += [(3 + more, "R", [(r, text)]) for r in ("user", "assistant")]
        choices.append(own)
    gaps = [[(3 * n, "I" * n, [(r, "") for r in x]) for n in range(3) for x in itertools.product(("user", "assistant"), repeat=n)]] * (len(rows) + 1)
    woven = [x for pair in zip(gaps, choices) for x in pair] + gaps[-1:]
    best = None
    for pick in itertools.product(*woven):
        lines = [line for p in pick for line in p[2]]
        key = (sum(p[0] for p in pick), "".join(p[1] for p in pick))
        if (best is None or key < best[0]) and SHAPE.match("".join(r[0] for r, _ in lines)):
            best = key, lines
    return marks, best


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * {0: 0, 3: 2}.get(code, 1)
    return out


def expected(rows):
    by = {}
    for r in damage(rows):
        by.setdefault(r[0], []).append(r)
    for conv in {r[0] for r in rows}:
        own = sorted(by.get(conv, []), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns = {r[1] for r in own if r[1] is not None}
        marks, ((cost, audit), lines) = edits([r[2:] for r in own])
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(own, own[1:])]
        yield conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *map(marks.count, ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, "\n".join(f"{r}:{t}" for r, t in lines)


def got(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, n int")
    return sorted((tuple(r) for r in repair.repair(repair.damaged(df)).collect()), key=repr)


def test_against_all_edits(spark):
    pick, rows = random.Random(7), []
    for conv in range(80):
        for turn in range(pick.choice([1, 2, 2])):
            rows.append((conv, pick.choice([turn, turn, turn + 1, None]), pick.choice(["user", "assistant", "system", "user", "tool", None, "User"]), pick.choice(["Yes.", "No", "so? ", " \t\n", "", None, "a!\n\n", "I?J\nK.", "Yes."])))
    rows += [(None, 0, "user", "no id."), (None, 1, "assistant", "still none."), (10**15, None, None, None), (-7, 3, "", "no role.")]
    assert got(spark, rows) == sorted(expected(rows), key=repr)


def test_repeated_rows_and_long_texts(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", "x" * 200_000 + f" {t}.") for t in range(3)] * 2
    (row,) = got(spark, rows)
    left = damage(rows)
    assert row[3] == len(left) - len({r[2:] for r in left if r[3]}) - row[2]
    assert SHAPE.match("".join(x[0] for x in re.findall(r"(?m)^(user|assistant|system):", row[8])))


def test_long_conversation(spark):
    rows = [(5, t, "assistant" if t % 2 else "user", f"turn {t}.") for t in range(3000)]
    (row,) = got(spark, rows)
    assert row[1] > 0 and len(row[7].replace("I", "")) == len(damage(rows))
    assert SHAPE.match("".join(line[0] for line in row[8].split("\n")))


def test_empty(spark):
    assert got(spark, []) == []
