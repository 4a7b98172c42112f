"""Structure repair against all edits of short conversations."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from postlens.llm import structure

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, segment string, audit int"
LEGAL = re.compile(r"(s?(ua)+)?")


def damage(rows):
    out = []
    for c, n, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if n is None else n}".encode()) % 20
        if fate:
            row = (c, n, "user" if fate == 4 else role, "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text)
            out += [row] * (2 if fate == 3 else 1)
    return out


def brute(rows):
    """Counts and the best edits of one conversation's rows, by trying all: a dict over what came out so far."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    faults, seen = [], set()
    for _, _, role, text in rows:
        body = text.strip(SPACE)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [role[:1] or " " for _, _, role, _ in rows]
    turns = [r[1] for r in rows if r[1] is not None]
    # (initials, lines) -> (cost, audit); up to three inserts between rows
    states = {"": [(0, "", ())]}
    add = lambda into, key, entry: into.setdefault(key, []).append(entry)

    def slim(found):
        """Of entries that end alike the best goes on: what follows depends on the last initials alone."""
        best = {}
        for key, entries in found.items():
            short = key if len(key) < 2 else ("" if key[:1] != "s" else "s") + key[-1:] + ("+" if len(key) > 2 else "")
            for e in entries:
                best.setdefault(short, []).append((e[0], e[1], e[2], key))
        return [min(v)[:3] + (min(v)[3],) for v in best.values()]

    def inserted(found):
        out = {k: list(v) for k, v in found.items()}
        last = found
        for _ in range(3):
            new = {}
            for key, entries in last.items():
                for cost, audit, lines in entries:
                    for role in ("user", "assistant"):
                        if structure_prefix(key + role[0]):
                            add(new, key + role[0], (cost + 3, audit + "I", (*lines, f"{role}:")))
            for k, v in new.items():
                out.setdefault(k, []).extend(v)
            last = new
        return out

    for (_, _, role, text), fault, initial in zip(rows, faults, initials, strict=True):
        found = {}
        for key, entries in inserted(states).items():
            for cost, audit, lines in entries:
                add(found, key, (cost + 4, audit + "D", lines))
                if fault in ("blank", "duplicate"):
                    continue
                more = 3 if fault == "truncated" else 0
                if structure_prefix(key + initial):
                    add(found, key + initial, (cost + more, audit + "K", (*lines, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if structure_prefix(key + new[0]):
                        add(found, key + new[0], (cost + 3 + more, audit + "R", (*lines, f"{new}:{text}")))
        states = {}
        for cost, audit, lines, key in slim(found):
            add(states, key, (cost, audit, lines))
    cost, audit, lines = min(e for key, entries in inserted(states).items() if LEGAL.fullmatch(key) for e in entries)
    pairs = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    counts = [faults.count(x) for x in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, pairs, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def structure_prefix(initials):
    return re.fullmatch(r"s?(ua)*u?", initials) is not None


def conversations(rnd, n):
    rows = []
    for c in range(n):
        for t in range(rnd.randrange(1, 9)):
            turn = rnd.choice([t, t, t, t, t + 1, None])
            role = rnd.choice(["user", "assistant", "system", "tool", "", None, "U"]) if rnd.random() < 0.25 else ["user", "assistant"][t % 2]
            rows.append((c, turn, role, rnd.choice(["ok.", "hi", "yes! \n", "", " \t", None, "what?\x0b", f"é{t}.", f"n{rnd.randrange(9)}"]), "clash", 1))
    return rows


@pytest.mark.parametrize("partitions", [1, 13])
def test_repair(spark, partitions):
    rnd = random.Random(5)
    rows = conversations(rnd, 120)
    rows += [(500, 0, "user", "x" * 100_000 + ".", "", 0), (None, 0, "user", "a.", "", 0), (None, None, "assistant", "b.", "", 0), (501, 5, None, None, "", 0)] + [(502, 1, "user", "same.", "", 0)] * 40
    rows += [(503, t, ["user", "assistant"][t % 2], f"t{t // 3}.", "", 0) for t in range(400)]
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # conversations are cut into many segments
    try:
        df = spark.createDataFrame(rows, SCHEMA).repartition(3)
        got = {r.conv_id: tuple(r)[1:] for r in structure.summary(df, *structure.repair(structure.damaged(df))).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    by = {c: [] for c in {r[0] for r in rows}}
    for r in damage(rows):
        by[r[0]].append(r)
    want = {c: brute(v) if v else (0,) * 6 + ("", hashlib.sha256().hexdigest()) for c, v in by.items()}
    assert {c: (got[c], want[c]) for c in want if got.get(c) != want[c]} == {} and len(got) == len(want)


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert structure.summary(none, *structure.repair(none)).count() == 0
    ids = spark.createDataFrame([(4,)], "conv_id long")
    r = structure.summary(ids, *structure.repair(none)).first()
    assert tuple(r) == (4, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_a_walk_by_checkpoints_is_the_walk_by_all_vectors():
    rnd = random.Random(8)
    for n in (0, 1, 2, 3, 10, 101):
        kinds = [((rnd.choice("suax "), rnd.choice(["", "", "truncated", "blank", "duplicate"])), rnd.choice([0, 0, 2])) for _ in range(n)]
        vectors = [structure.END]
        for kind, copies in reversed(kinds):
            vectors.append(structure.vector_before([(kind, copies)], vectors[-1]))
        state, audit = structure.START, ""
        for (kind, copies), vector in zip(kinds, reversed(vectors[:-1]), strict=True):
            letters, state = structure._walked(kind, vector, state)
            audit += letters + "D" * copies
        assert structure.walk(kinds, structure.END, (structure.START,))[structure.START] == (state, audit)
