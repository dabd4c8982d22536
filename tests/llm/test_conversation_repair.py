"""Conversation repair against a search over all edits of each conversation."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from leakfree.llm import conversation_repair as repair
from leakfree.llm.queries import QUERIES

EMPTY = hashlib.sha256(b"").hexdigest()


def nil(x):
    return " " if x is None else str(x)


def planted(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{nil(conv)}:{nil(turn)}".encode()) % 20
        role, text = nil(role), nil(text)
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def fits(initials):
    return re.fullmatch("(s?(ua)+)?", initials) is not None


def cheapest(rows):
    """rows: (role, text, fault). Least (cost, audit, repaired) over all edits, by recursion over rows and the output so far."""
    @cache
    def rest(i, tail):  # tail: what the output so far allows next ("" nothing yet, else its last initial)
        best = []
        if i == len(rows) and tail in ("", "a"):
            best.append((0, "", ()))
        for x in "ua":
            if (tail, x) in {("", "u"), ("s", "u"), ("u", "a"), ("a", "u")} and depth[0] < 3:
                depth[0] += 1
                sub = search(i, x)
                depth[0] -= 1
                if sub:
                    best.append((sub[0] + 2, "I" + sub[1], ({"u": "user", "a": "assistant"}[x] + ":", *sub[2])))
        if i < len(rows):
            role, text, fault = rows[i]
            sub = search(i + 1, tail)
            if sub:
                best.append((sub[0] + 3, "D" + sub[1], sub[2]))
            if fault not in ("blank", "duplicate"):
                for letter, cost, to in [("K", 0, role), ("R", 2, "user"), ("R", 2, "assistant")]:
                    if (tail, to[:1]) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                        sub = search(i + 1, to[:1])
                        if sub:
                            best.append((sub[0] + cost + (fault == "truncated"), letter + sub[1], (f"{to}:{text}", *sub[2])))
        return min(best, default=None)

    def search(i, tail):
        return rest.__wrapped__(i, tail) if depth[0] else rest(i, tail)

    depth = [0]
    return rest(0, "")


def expected(conv, rows):
    rows = sorted((r for r in planted(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    if not rows:
        return (conv, 0, 0, 0, 0, 0, 0, "", EMPTY)
    seen, marked = set(), []
    for _, _, role, text in rows:
        solid = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else None if solid[-1] in ".!?" else "truncated"
        seen.add((role, text))
        marked.append((role, text, fault))
    turns = {r[1] for r in rows} - {None}
    count = lambda k: sum(m[2] == k for m in marked)
    cost, audit, out = cheapest(tuple(marked))
    assert fits("".join(o[0] for o in out))
    return (conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, count("blank"), count("duplicate"), count("truncated"),
            sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:])), cost, audit,
            hashlib.sha256("\n".join(out).encode()).hexdigest())


def made(seed, conversations=150, most=9):
    r = random.Random(seed)
    out = []
    for conv in [*range(conversations), None]:
        for turn in range(r.randint(1, most)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "User", "", None])
            text = r.choice(["a.", "b!", "c", "", " \n", None, "é?", "long text\nof lines. ", f"t{r.random()}.", "x!y", "x."])
            out.append((conv, r.choice([turn, turn, turn, None, turn + 3, turn // 2]), role, text))
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


def run(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as copy", "2 as conv", "3 as pos").repartition(3) \
        .write.parquet(f"{path}/conversations.parquet")
    got = QUERIES["op13_conversation_repair"](spark, str(path))
    assert got.columns[:9] == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted(map(tuple, got.collect()), key=lambda t: (t[0] is None, t[0] or 0))


@pytest.mark.parametrize("rows_a_chart, spans, per_task", [(16, 4, 100_000), (2, 2, 100_000), (3, 4, 4)])
def test_query_equals_all_edits(spark, tmp_path, monkeypatch, rows_a_chart, spans, per_task):
    for name, value in (("ROWS", rows_a_chart), ("SPANS", spans), ("ROWS_PER_TASK", per_task)):
        monkeypatch.setattr(repair, name, value)
    rows = made(per_task)
    got = run(spark, tmp_path, rows)
    assert got == [expected(c, rows) for c in [*range(150), None]]


def test_charts_of_any_size_give_the_same_edits(spark, tmp_path, monkeypatch):
    """A long conversation: one chart over all spans against charts of charts."""
    rows = [(1, i, "user" if i % 3 else "assistant", f"t{i % 50}{'.' if i % 7 else ''}") for i in range(120)]
    d = repair.faults(repair.damaged(spark.createDataFrame(rows, SCHEMA))).orderBy("pos").collect()
    want = repair.cheapest(repair.chart([repair.leaf(x["initial"], x["fault"]) for x in d]))
    got = run(spark, tmp_path, rows)[0]
    assert (got[6], got[7]) == want


def test_repaired_rows(spark):
    rows = made(2, 40)
    d = repair.faults(repair.damaged(spark.createDataFrame(rows, SCHEMA)))
    found = repair.parsed(d)
    out = {}
    for x in repair.repaired(d, found).orderBy("conv", "at").collect():
        out.setdefault(x["conv"], []).append(x)
    for r in found.collect():
        mine = out.get(r["conv"], [])
        assert fits("".join(x["role"][0] for x in mine))
        assert [x["at"] for x in mine] == list(range(len(mine)))
        assert "".join(x["edit"] for x in mine) == r["audit"].replace("D", "")


def test_nothing_and_all_dropped(spark, tmp_path):
    assert run(spark, f"{tmp_path}/a", []) == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert run(spark, f"{tmp_path}/b", [(gone, 0, "user", "x.")]) == [(gone, 0, 0, 0, 0, 0, 0, "", EMPTY)]
