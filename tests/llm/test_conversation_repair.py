import hashlib
import itertools
import random
import zlib

import pytest

from driftwood.llm import conversation_repair as module
from driftwood.llm.conversation_repair import CODES, damage, fold_blocks, parse_block, repair, text_digests
from driftwood.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, id string, place int, cost string, lost_ string"


def fits(initials):
    body = initials[1:] if initials[:1] == "s" else initials
    return initials == "" or (len(body) >= 2 and len(body) % 2 == 0 and body == "ua" * (len(body) // 2))


def by_force(codes):
    """The least (cost, audit) by trying all edits of a few rows, with up to two inserts before each and at the end."""
    fault_of = {c: (i, f) for (i, f), c in CODES.items()}
    best = None

    def go(i, initials, cost, audit):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        ends = [("", 0)] + [("".join(p), 5 * n) for n in (1, 2) for p in itertools.product("ua", repeat=n)]
        for extra, more in ends:
            if i == len(codes):
                if fits(initials + extra):
                    way = (cost + more, audit + "I" * len(extra))
                    best = way if best is None else min(best, way)
                continue
            initial, fault = fault_of[codes[i]]
            stay = 5 if fault == "truncated" else 0
            then = audit + "I" * len(extra)
            go(i + 1, initials + extra, cost + more + 2, then + "D")
            if fault in ("fine", "truncated"):
                go(i + 1, initials + extra + initial, cost + more + stay, then + "K")
                for c in "ua":
                    go(i + 1, initials + extra + c, cost + more + stay + 1, then + "R")

    go(0, "", 0, "")
    return best


def whole(codes, size):
    blocks = [codes[i:i + size] for i in range(0, len(codes), size)] or [""]
    tables = [{start: {to: way[:2] for to, way in parse_block(b, start).items()} for start in module.PLACES} for b in blocks]
    cost, ways, inserts = fold_blocks(tables)
    return cost, "".join(parse_block(b, enter)[leave][2] for b, (enter, leave) in zip(blocks, ways)) + "I" * inserts


def test_parser_finds_the_cheapest_and_least_repair():
    g = random.Random(11)
    for n in (0, 1, 2, 3, 3, 4, 4, 4) * 12:
        codes = "".join(g.choice(sorted(CODES.values())) for _ in range(n))
        assert whole(codes, 4096) == by_force(codes), codes


def test_blocks_of_any_size_give_the_same_repair():
    g = random.Random(12)
    for _ in range(150):
        codes = "".join(g.choice(sorted(CODES.values())) for _ in range(g.randint(1, 60)))
        expected = whole(codes, 4096)
        assert all(whole(codes, size) == expected for size in (1, 2, 7, 16))


def rows():
    g = random.Random(4)
    texts = ["Hello there.", "", None, " \t\n", "What?", "cut off", "Well!  ", "x" * 3000 + ".", "é.", "\x1c"]
    made = []
    for conversation in [*range(60), None]:
        for turn in range(g.randint(1, 6)):
            made.append((conversation, g.choice([turn, turn, None]), g.choice(["user", "assistant", "system", "tool", "", None]), g.choice(texts), "c", 1, "z", None))
    return made


def expected_by_force(made):
    """Damage, faults, repair and digests of ``made`` in plain Python; ties of a turn are taken by role and text."""
    groups = {}
    for conversation, turn, role, text, *_ in made:
        found = groups.setdefault(conversation, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conversation is None else conversation}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
        found.extend([(turn is not None, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1))
    expected = {}
    for conversation, found in groups.items():
        found.sort(key=lambda r: (r[0], r[1] or 0, r[2], r[3]))
        seen, codes, faults = set(), "", dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, _, role, text in found:
            solid = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "fine"
            seen.add((role, text))
            if fault in faults:
                faults[fault] += 1
            codes += CODES[role[:1] if role[:1] in ("s", "u", "a") else "?", fault]
        cost, audit = whole(codes, 4096)
        turns = [t for _, t, _, _ in found if t is not None]
        initials = [r[2][:1] for r in found]
        lines, i, place, size = [], 0, 0, len(audit) - audit.count("D")
        for letter in audit:
            if letter != "D":
                due = "user" if (place - size % 2) % 2 == 0 else "assistant"
                lines.append(f"{found[i][2] if letter == 'K' else due}:{'' if letter == 'I' else found[i][3]}")
                place += 1
            i += letter != "I"
        expected[conversation] = {
            "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **faults, "cost": cost, "audit": audit,
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}
    return expected


@pytest.mark.parametrize("bits", [12, 1])
def test_odd_rows_equal_plain_python(spark, bits, monkeypatch):
    monkeypatch.setattr(module, "BLOCK_BITS", bits)
    made = rows()
    mended, summary = repair(damage(spark.createDataFrame(made, SCHEMA)))
    digest = {r["conversation"]: r["repaired_sha256"] for r in text_digests(mended).collect()}
    got = {r["conversation"]: r.asDict() for r in summary.collect()}
    expected = expected_by_force(made)
    assert got.keys() == expected.keys()
    for conversation, wanted in expected.items():
        found = got[conversation] | {"repaired_sha256": digest.get(conversation, hashlib.sha256(b"").hexdigest())}
        assert {k: found[k] for k in wanted} == wanted, conversation


def test_repaired_rows_are_a_legal_conversation(spark):
    made = [(1, t, "user", f"Question {t}.", None, None, None, None) for t in range(5)] + [(2, 0, "assistant", "No.", None, None, None, None)]
    mended, _ = repair(spark.createDataFrame(made, SCHEMA))
    got = {}
    for r in mended.collect():
        got.setdefault(r["conversation"], []).append((r["place"], r["edit"], r["role"], r["text"]))
    assert [r[2] for r in sorted(got[1])] == ["user", "assistant"] * 2
    assert sorted(r[3] for r in got[1]) == [f"Question {t}." for t in range(1, 5)]
    assert 2 not in got


def test_a_long_conversation_is_parsed_in_blocks(spark):
    made = [(7, i, ("user", "assistant")[i % 2], f"Text {i}.") for i in range(20_000)]
    mended, summary = repair(spark.createDataFrame(made, "conv_id long, turn long, role string, text string").repartition(5))
    r = summary.first()
    assert (r["cost"], r["audit"], r["illegal"], r["gaps"]) == (0, "K" * 20_000, 0, 0)
    assert mended.count() == 20_000


def test_empty_table(spark):
    mended, summary = repair(damage(spark.createDataFrame([], SCHEMA)))
    assert summary.count() == mended.count() == text_digests(mended).count() == 0


def test_query_keeps_every_conversation(spark):
    sf = "/root/testdata/sf0.001"
    got = QUERIES["op11_conversation_repair"](spark, sf).collect()
    ids = {r["conv_id"] for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").distinct().collect()}
    assert len(got) == len(ids) and {r["conv_id"] for r in got} == ids
