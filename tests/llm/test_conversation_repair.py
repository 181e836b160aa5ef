import hashlib
import itertools
import random
import re
import zlib

import pytest

pytest.importorskip("cladeframe.llm")
from cladeframe.llm import conversation_repair as repair  # noqa: E402


def plain(signature, most):
    """All edit sequences up to a cost, the best one by cost and then by its letters."""
    best = None
    stack = [("", "", 0, 0)]
    while stack:
        edits, roles, i, cost = stack.pop()
        if cost > most or (best and cost > best[0]):
            continue
        if i == len(signature) and re.fullmatch("(s?(ua)+)?", roles):
            best = min(x for x in (best, (cost, edits)) if x)
        for role in "ua":
            stack.append((edits + "I", roles + role, i, cost + 3))
        if i < len(signature):
            letter = signature[i]
            stack.append((edits + "D", roles, i + 1, cost + 4))
            if letter not in "1234":
                extra = 3 if letter.isupper() else 0
                stack.append((edits + "K", roles + letter.lower(), i + 1, cost + extra))
                for role in "ua":
                    stack.append((edits + "R", roles + role, i + 1, cost + 3 + extra))
    return best


def test_solutions_equal_all_edits_tried():
    short = ["".join(x) for n in range(3) for x in itertools.product("suaxSUAX1234", repeat=n)]
    rng = random.Random(3)
    short += ["".join(rng.choices("suaxSUA12", k=3)) for _ in range(60)] + ["".join(rng.choices("suaU3", k=4)) for _ in range(20)]
    for signature in short:
        cost, audit, steps = repair.solved(signature)
        assert (cost, audit) == plain(signature, 4 * len(signature)), signature
        assert len(steps) == sum(x != "D" for x in audit)


def test_a_long_signature_is_solved_without_deep_calls():
    cost, audit, steps = repair.solved("ua" * 3000 + "u")
    assert cost == 3 and audit == "K" * 6001 + "I" and steps[-1] == (0, "assistant")
    assert repair.solved("1" * 2500)[:2] == (10_000, "D" * 2500)


def by_rule(rows):
    """Faults and repaired text of one conversation's rows, by the definition."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    seen, letters, faults = set(), "", []
    for _, role, text in rows:
        solid = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
        seen.add((role, text))
        faults.append(fault)
        k = "sua".find(role[:1]) if role[:1] else 3
        k = 3 if k < 0 else k
        letters += ("SUAX" if fault == "truncated" else "1234" if fault else "suax")[k]
    turns = {t for t, _, _ in rows if t is not None}
    cost, audit = plain(letters, 4 * len(letters))
    out, i, roles = [], 0, ""
    for edit in audit:
        role, text = (rows[i][1], rows[i][2]) if edit != "I" else ("", "")
        i += edit != "I"
        if edit != "D":
            role = role if edit == "K" else "assistant" if roles.endswith("u") else "user"
            roles += role[:1]
            out.append(f"{role}:{text}")
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


ODD = [
    (1, 0, "user", "Hello."), (1, 1, "assistant", "Hi!"), (1, 4, "user", "cut off"), (2, 0, "system", "Be kind."), (2, 1, "user", "A?"), (2, 2, "user", "A?"), (2, 2, "user", "A?"),
    (3, None, None, "No role."), (3, None, "user", None), (4, 5, "tool", "x. \n"), (4, 5, "", "é"), (5, 0, "user", " \x0b\n"), (5, 1, "assistant", "\x85."), (6, None, "user", "One."),
    (7, 0, "assistant", "long " * 40_000), (7, 1, "user", "y."), (None, 0, "user", "Null."), (None, 1, "assistant", "ok"),
]


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, place int, letter string, audit string").repartition(3)


def test_repaired_conversations_equal_the_rule(spark):
    found = repair.repaired(conversations(spark, ODD))
    shas = {r.conv_id: r.sha256 for r in repair.digests(found.rows).collect()}
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, shas.get(r.conv_id, hashlib.sha256().hexdigest())) for r in found.audits.collect()}
    assert got == {c: by_rule([x[1:] for x in ODD if x[0] == c]) for c in {x[0] for x in ODD}}
    nothing = repair.repaired(conversations(spark, []))
    assert nothing.audits.count() == 0 and nothing.rows.count() == 0


def test_damage_by_checksum(spark):
    rows = [(c, t, "assistant", f"Say {c} {t}! Yes?") for c in range(30) for t in range(3)] + [(None, 4, None, None), (40, None, "user", "x.")]
    want = []
    for c, t, role, text in rows:
        role, text = role or " ", text or " "
        dice = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if dice == 1 else re.sub("[.!?]", "", text) if dice == 2 else text
        want += [(c, t, "user" if dice == 4 else role, text)] * (0 if dice == 0 else 2 if dice == 3 else 1)
    got = [tuple(r) for r in repair.damaged(conversations(spark, rows)).select("conv_id", "turn", "role", "text").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
