"""Conversation repair against a search over all edits."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from tertulia.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string, part int, again boolean, digest string, rows string"
FIT = re.compile(r"(s?(ua)+)?")
BLANK = " \t\n\x0b\x0c\r"


def build(spark, rows):
    return spark.createDataFrame([(*r, 0, None, "", "") for r in rows], SCHEMA)


def cheapest(rows: list[tuple[str, str, str]]) -> tuple[int, str, tuple]:
    """Least (cost, audit) and its repaired rows; a row is (role, text, fault)."""

    @lru_cache(maxsize=None)
    def ways(i: int, out: str, inserted: int) -> tuple | None:
        # `out` is as much of the role initials as matters: the last one, and whether a system row came
        best = []
        if i == len(rows):
            if out in ("", "a", "sa"):
                best.append((0, "", ()))
        else:
            role, text, fault = rows[i]
            later = ways(i + 1, out, 0)
            if later:
                best.append((4 + later[0], "D" + later[1], later[2]))
            if fault not in ("blank", "duplicate"):
                for edit, cost, new in (("K", 0, role), ("R", 3, "user"), ("R", 3, "assistant")):
                    after = step(out, new[:1])
                    later = ways(i + 1, after, 0) if after else None
                    if later:
                        extra = 3 if fault == "truncated" else 0
                        best.append((cost + extra + later[0], edit + later[1], ((new, text), *later[2])))
        if inserted < 3:
            for new in ("user", "assistant"):
                after = step(out, new[0])
                later = ways(i, after, inserted + 1) if after else None
                if later:
                    best.append((3 + later[0], "I" + later[1], ((new, ""), *later[2])))
        return min(best, key=lambda w: w[:2]) if best else None

    def step(out: str, initial: str) -> str | None:
        """What `out` becomes: whether and what initials it may be the beginning of."""
        if initial == "s":
            return "s" if out == "" else None
        if initial == "u":
            return "su" if out in ("s", "sa") else "u" if out in ("", "a") else None
        if initial == "a":
            return {"su": "sa", "u": "a"}.get(out)
        return None

    return ways(0, "", 0)


def plain(rows: list[tuple]) -> tuple:
    """What the operator finds of one conversation's rows (turn, role, text)."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faulty = set(), []
    for _, role, text in rows:
        held = text.strip(BLANK)
        fault = "blank" if not held else "duplicate" if (role, text) in seen else "truncated" if held[-1] not in ".!?" else ""
        seen.add((role, text))
        faulty.append((role, text, fault))
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, out = cheapest(faulty)
    assert FIT.fullmatch("".join(r[:1] for r, _ in out))
    initials = [r[:1] for _, r, _ in rows]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *[sum(f == k for _, _, f in faulty) for k in ("blank", "duplicate", "truncated")],
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
        cost,
        audit,
        hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(),
    )


def by_conversation(rows):
    found = {}
    for conv_id, turn, role, text in rows:
        found.setdefault(conv_id, []).append((turn, role, text))
    return found


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def found_by(spark, rows):
    got = repair.summary(repair.repair(build(spark, rows))).collect()
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in got}


def random_rows(seed, conversations, longest, gap=1):
    draw = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]
    texts = ["Yes.", "No!", "why?", "well", "a. b", " ", "", None, "\t\x0b\r\n", " ", "ok.  ", "\U0001f600", "end. "]
    rows = []
    for conv_id in range(conversations):
        for turn in range(draw.randint(1, longest)):
            when = None if draw.random() < 0.05 else turn * gap if draw.random() < 0.9 else draw.randint(0, longest) * gap
            said = draw.choice(texts) if draw.random() < 0.4 else f"{draw.randint(0, 10**6)}" + draw.choice([".", "!", ""])
            role = draw.choice(roles) if draw.random() < 0.3 else ("user", "assistant")[turn % 2]
            rows.append((conv_id or None, when, role, said))
    return rows


def test_short_ones(spark):
    rows = random_rows(1, 300, 9)
    assert found_by(spark, rows) == {c: plain(r) for c, r in by_conversation(rows).items()}


@pytest.mark.parametrize("turns", [1, 2, 5])
def test_any_cut_gives_the_same(spark, monkeypatch, turns):
    """Parts of few turns: what is put together is what one parser would find."""
    monkeypatch.setattr(repair, "TURNS", turns)
    rows = random_rows(turns + 7, 60, 14)
    assert found_by(spark, rows) == {c: plain(r) for c, r in by_conversation(rows).items()}


def test_a_long_one_is_cut(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(5000) if t % 50] + [(1, 9000, "user", "1.")]
    parts = repair.repair(build(spark, rows))
    assert parts.count() == 6 and parts.agg(F.max(F.size("rows"))).first()[0] <= 2 * repair.TURNS
    got = repair.summary(parts).first()
    # Every fiftieth row, a user's, is gone: an empty one is put in there, and an answer at the end.
    assert (got["gaps"], got["duplicate"], got["audit"].count("I"), got["audit"][-2:]) == (9000 - 4901, 0, 101, "KI")


def test_examples(spark):
    said = {
        1: [("system", "Be kind."), ("user", "Hi."), ("assistant", "Hello.")],
        2: [("user", "Hi."), ("user", "You?"), ("assistant", "Hello.")],
        3: [("assistant", "Hello."), ("user", "Hi.")],
        4: [("user", "Hi."), ("assistant", "Hel")],
        5: [("user", " "), ("assistant", "")],
        6: [("system", "Be kind.")],
        7: [("user", "A."), ("assistant", "B."), ("user", "A."), ("assistant", "C.")],
    }
    rows = [(c, i, role, text) for c, r in said.items() for i, (role, text) in enumerate(r)]
    got = {c: (g[5], g[6]) for c, g in found_by(spark, rows).items()}
    assert {c: got[c] for c in (1, 4, 5, 6)} == {1: (0, "KKK"), 4: (3, "KK"), 5: (8, "DD"), 6: (4, "D")}
    assert got == {c: plain([(i, *x) for i, x in enumerate(r)])[5:7] for c, r in said.items()}


def test_repaired_rows_fit(spark):
    rows = random_rows(3, 100, 12)
    parts = repair.repair(build(spark, rows))
    out = {}
    for r in sorted(repair.repaired_rows(parts).collect(), key=lambda r: (r["conv_id"] or 0, r["part"], r["place"])):
        out.setdefault(r["conv_id"], []).append((r["role"], r["text"], r["edit"]))
    for held in out.values():
        assert FIT.fullmatch("".join(role[:1] for role, _, _ in held))
        assert all(text == "" for _, text, edit in held if edit == "I")


def test_no_rows(spark):
    assert found_by(spark, []) == {}


def damage(rows):
    out = []
    for conv_id, turn, role, text in rows:
        fill = lambda v: " " if v is None else str(v)
        which = zlib.crc32(f"{fill(conv_id)}:{fill(turn)}".encode()) % 20
        role, text = fill(role), fill(text)
        if which == 0:
            continue
        text = "" if which == 1 else re.sub("[.!?]", "", text) if which == 2 else text
        out += [(conv_id, turn, "user" if which == 4 else role, text)] * (2 if which == 3 else 1)
    return out


def test_query(spark, tmp_path):
    rows = random_rows(5, 200, 12) + [(10**6, t, "user", "x" * 50_000) for t in range(3)]
    gone = next(c for c in range(2000, 4000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "Hi."))
    build(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in queries.op13_repair(spark, str(tmp_path)).collect()}
    left = by_conversation(damage(rows))
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {c: plain(left[c]) if c in left else nothing for c in {r[0] for r in rows}}
    assert got[gone] == nothing
