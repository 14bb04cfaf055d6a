"""Conversation repair against a plain dynamic program over whole conversations."""
import hashlib
import random
import re
import zlib
from functools import lru_cache
from itertools import product

import pytest

from heatline.llm import conversations

GOOD = re.compile(r"(s?(ua)+)?\Z")
MOVES = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
NAMES = {"u": "user", "a": "assistant"}


def visible(text):
    return re.findall("[^\x20\x09-\x0d]", text)


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        shown = visible(text)
        if not shown:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def best(rows):
    """(cost, audit, repaired) of the cheapest edits, by (cost, audit) over all choices."""
    kinds = faults(rows)
    result = {"": (0, "", ()), "a": (0, "", ())}
    for at in range(len(rows), -1, -1):
        fresh = {}
        if at == len(rows):
            fresh = dict(result)
        else:
            role, text = rows[at]
            for state in ("", "s", "u", "a"):
                options = []
                if state in result:
                    cost, audit, rest = result[state]
                    options.append((cost + 4, "D" + audit, rest))
                if kinds[at] in ("", "truncated"):
                    extra = 3 * (kinds[at] == "truncated")
                    to = MOVES.get((state, role[:1]))
                    if to in result and to is not None:
                        cost, audit, rest = result[to]
                        options.append((cost + extra, "K" + audit, (f"{role}:{text}", *rest)))
                    for new in "ua":
                        to = MOVES.get((state, new))
                        if to is not None and to in result:
                            cost, audit, rest = result[to]
                            options.append((cost + 3 + extra, "R" + audit, (f"{NAMES[new]}:{text}", *rest)))
                if options:
                    fresh[state] = min(options)
        for _ in range(3):  # inserted rows, until nothing gets better
            for state, new in product(("", "s", "u", "a"), "ua"):
                to = MOVES.get((state, new))
                if to is not None and to in fresh:
                    cost, audit, rest = fresh[to]
                    option = (cost + 3, "I" + audit, (f"{NAMES[new]}:", *rest))
                    fresh[state] = min(fresh.get(state, option), option)
        result = fresh
    return result[""]


def plain(rows):
    """conv_id -> the contract's columns, from (conv_id, turn, role, text) rows."""
    groups = {}
    for conv_id, turn, role, text in rows:
        groups.setdefault(conv_id, []).append((turn, role, text))
    out = {}
    for conv_id, members in groups.items():
        members.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [t for t, _, _ in members if t is not None]
        kinds = faults([r[1:] for r in members])
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(members, members[1:])]
        cost, audit, repaired = best([r[1:] for r in members])
        out[conv_id] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *[kinds.count(k) for k in ("blank", "duplicate", "truncated")],
            sum(p not in ("su", "ua", "au") for p in pairs),
            cost,
            audit,
            hashlib.sha256("\n".join(repaired).encode()).hexdigest(),
        )
    return out


def found(parts):
    return {
        r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)
        for r in conversations.summaries(parts).collect()
    }


def made(seed, n, most, nulls=True):
    pick = random.Random(seed)
    rows = []
    for conv_id in range(n):
        roles = pick.choice([["user", "assistant"], ["user"], ["system", "user", "assistant", "tool", "uncle"]])
        for k in range(pick.randint(1, most)):
            text = pick.choice(["Fine.", "And so", "", " \t", "Ö!", f"row {k}.", f"cut {k}", "Why? \n"])
            role = roles[k % 2] if len(roles) == 2 and pick.random() < 0.8 else pick.choice(roles)
            turn = pick.choice([k, k, k, k // 2, None if nulls else k])
            rows.append((conv_id if conv_id or not nulls else None, turn, role, text))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("most_rows, passes", [(4096, 4), (3, 4), (2, 0), (1, 1)])
def test_repairs(spark, most_rows, passes):
    rows = made(most_rows, 60, 14) + [(1000, k, "user", f"only users {k}.") for k in range(41)]
    rows += [(1001, k, "user", f"cut users {k}") for k in range(40)] + [(1002, 5, "user", "same.")] * 9
    rows += [(1003, k, "assistant" if k % 2 else "user", "same.") for k in range(50)]
    rows += [(1004, None, "", "x."), (1005, 1 << 40, "user", "long. " * 20_000)]
    parts = conversations.repair(spark.createDataFrame(rows, SCHEMA), passes=passes, part_rows=most_rows)
    assert (parts.groupBy("conv_id").count().agg({"count": "max"}).head()[0] > 9) == (most_rows < 9)
    assert found(parts) == plain(rows)
    for r in parts.filter("whole").collect():
        assert GOOD.match("".join(x.role[0] for x in r.repaired))


def test_every_short_conversation(spark):
    rows, names = [], {"s": "system", "u": "user", "a": "assistant", "t": "tool"}
    for at, roles in enumerate(w for n in range(1, 5) for w in product("suat", repeat=n)):
        rows += [(at, k, names[r], f"{k}." if (at + k) % 3 else f"{k}") for k, r in enumerate(roles)]
    assert found(conversations.repair(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


@lru_cache
def damage(conv_id, turn):
    key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
    return zlib.crc32(key.encode()) % 20


def test_damage(spark):
    rows = made(5, 80, 9) + [(k, None, None, None) for k in range(90, 110)] + [(None, None, None, "x")]
    kept = []
    for conv_id, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = damage(conv_id, turn)
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        kept += [(conv_id, turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    wanted = dict.fromkeys({r[0] for r in rows}, (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()))
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", part int, kinds string")
    assert found(conversations.repair(conversations.damaged(frame), copies="copies")) == wanted | plain(kept)


def test_no_rows(spark):
    assert found(conversations.repair(spark.createDataFrame([], SCHEMA))) == {}


def test_matrices_and_reruns_agree():
    pick = random.Random(3)
    for _ in range(300):
        kinds = bytes(pick.choices(range(10), k=pick.randint(0, 12)))
        after = tuple(pick.choice([0, 3, 4, 6]) for _ in range(4))
        true = conversations.backwards(kinds, conversations._level(after)[0])[1]
        assert conversations.through(conversations.matrix(kinds), after) == true or not kinds
        guess = conversations.backwards(kinds, (0, 0, 0, 0))[1]
        level = conversations._level(after)[0]
        assert conversations.rerun(kinds, (0, 0, 0, 0), guess, level) == true
