"""The filter audit against filters applied one after the other."""

import itertools
import random

from postlens.llm import filter_audit

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, lang string, part string, mask int, digest string"
LABELS = "doc_id long, quality int, toxic int, good int"


def failed(rows):
    """Letters that each row fails, by plain rules."""
    firsts = {}
    for i, t, _ in rows:
        if i is not None:
            firsts[t or ""] = min(i, firsts.get(t or "", i))
    for i, t, _ in rows:
        t = t or ""
        words = t.translate({ord(c): " " for c in SPACE}).split(" ")
        words = [w for w in words if w]
        capitals = sum("A" <= c <= "Z" for c in t)
        yield "".join(
            x for x, bad in zip("ABCDE", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * capitals > 3 * len(t), any(c in "#$%&*|" for c in t), i is not None and i > firsts[t]), strict=True) if bad
        )


def brute(rows, labels):
    out, masks = {}, list(failed(rows))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    for part in {r[2] or "" for r in rows}:
        mine = [(i, m) for (i, _, lang), m in zip(rows, masks, strict=True) if (lang or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                shapley[x] += len(gone)
                fails = sum(x in m for _, m in mine)
                alone = sum(m == x for _, m in mine)
                out[part, "".join(order), step] = (x, len(left), len(gone), fails - len(gone), alone, sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))
        for key in [k for k in out if k[0] == part]:
            out[key] += (shapley[out[key][0]],) if len(out[key]) == 7 else ()
    return out


def audit(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "clash", 7, "clash") for r in rows], SCHEMA).repartition(3)
    return filter_audit.audit(*filter_audit.failure_masks(docs, spark.createDataFrame([(*r, 5) for r in labels], LABELS)))


def test_audit(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(160):
        words = [rnd.choice(["ab", "Cd", "x y", "é"]) if i % 3 else f"w{rnd.randrange(10**6)}" for _ in range(rnd.choice([3, 199, 200, 260]))]
        rows.append((i, rnd.choice(["", "# ", "EF "]) + rnd.choice([" ", "\n", "\x0b\t"]).join(words), rnd.choice(["en", "en", "de", None])))
    rows += [(1000 + i, rows[i % 5][1], "fr") for i in range(40)]
    rows += [(200, None, "en"), (201, "", "de"), (201, "", "de"), (202, " \n", ""), (None, rows[0][1], "en"), (None, "", None), (203, "Zé" * 60_000, "en"), (3, rows[3][1], "zz")]
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(0, 220, 2)] + [(4, 1, 1), (None, 1, 1), (6, None, None), (6, 1, None)]
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in audit(spark, rows, labels).collect()}
    want = brute(rows, labels)
    assert len(got) == 600 * 5 and got == want


def test_audit_of_nothing(spark):
    assert audit(spark, [], []).count() == 0
    rows = audit(spark, [(1, "x", None)], []).collect()
    assert len(rows) == 600 and {r.part for r in rows} == {""} and sum(r.removed for r in rows) == 120


def test_swaps_pass_through_all_orders():
    for n in range(1, 6):
        order = list(range(n))
        seen = {tuple(order)}
        for at in filter_audit.swaps(n):
            order[at], order[at + 1] = order[at + 1], order[at]
            seen.add(tuple(order))
        assert len(seen) == len(list(itertools.permutations(range(n)))) == 1 + sum(1 for _ in filter_audit.swaps(n))


def test_a_hot_part_is_a_few_counts(spark):
    rows = spark.range(60_000).selectExpr("'en' as part", "cast(id % 32 as int) as mask", "id % 5 = 0 as good", "false as toxic")
    got = filter_audit.audit("ABCDE", rows).collect()
    assert len(got) == 600 and {r.kept for r in got if r.step == 5} == {1875} and {r.shapley for r in got if r.filter == "C"} == {120 * (60_000 - 1875) // 5}
