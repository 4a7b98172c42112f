"""The pipeline's stages against brute force on a small table; they feed each other."""

import importlib
import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
pipeline = importlib.import_module("corpus_pipeline")

SPACE = " \t\n\x0b\x0c\r"


def shingles(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or {" ".join(words)}


def edited(rnd, text, times):
    words = text.split()
    for _ in range(times):
        words[rnd.randrange(len(words))] = f"x{rnd.randrange(9999)}"
    return " ".join(words)


def test_stages(spark, tmp_path):
    rnd = random.Random(11)
    base = [" ".join(f"w{rnd.randrange(500)}" for _ in range(rnd.randrange(20, 200))) for _ in range(150)]
    texts = [t + (" vile" if i % 6 == 0 else "") for i, t in enumerate(base)] * 2
    texts += [edited(rnd, t, 1 + len(t.split()) // 60) for t in base if len(t.split()) > 60]
    texts += [base[3] + "\n", base[4].replace("w", "W", 1), None, "", "a b"]
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int("vile" in t)) for i, t in enumerate(texts) if t]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    names = [n for n, _ in pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "simhash_near_dedup", "source_mixing", "best_fit_packing"]
    now, seen = docs, {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if k < len(names) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = now.collect()
    clean = [r.doc_id for r in seen["toxicity"]]
    assert len(clean) == len(set(clean)) and sum("vile" in (r.text or "") for r in seen["toxicity"]) <= 3
    assert {i for i, t in enumerate(texts) if "vile" not in (t or "")} <= set(clean)

    groups = {}
    for r in seen["toxicity"]:
        groups.setdefault("".join(c for c in r.text or "" if c not in SPACE), []).append((-len(r.text or ""), r.doc_id))
    kept = {min(g)[1] for g in groups.values()}
    assert {r.doc_id for r in seen["exact_dedup"]} == kept

    sets = {r.doc_id: shingles(r.text or "") for r in seen["exact_dedup"]}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sorted(sets):
            for b in sets:
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
        if all(root[root[i]] == root[i] for i in sets):
            break
    assert {r.doc_id for r in seen["simhash_near_dedup"]} == set(root.values())
    assert len(set(root.values())) < len(sets) - 20

    once = {r.doc_id: tuple(r) for r in seen["simhash_near_dedup"]}
    assert seen["source_mixing"] and all(once[r.doc_id] == tuple(r) for r in seen["source_mixing"])
    drawn = {}
    for r in seen["source_mixing"]:
        drawn[r.doc_id] = drawn.get(r.doc_id, 0) + 1
    packed = {}
    for r in seen["best_fit_packing"]:
        packed[r.doc_id] = packed.get(r.doc_id, 0) + (r.piece == 0)
    assert packed == drawn
    assert sorted(map(tuple, pipeline.run(spark, str(tmp_path)).drop("sequence_id", "offset").collect())) == sorted(map(tuple, now.drop("sequence_id", "offset").collect()))
