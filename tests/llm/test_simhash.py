import random

import numpy as np
import xxhash

from convspark.llm.simhash import drop_near_duplicates, fingerprint, links, near_dedup, near_pairs

from .helpers import LONG, components, doc, docs_of


def slow_fingerprint(text, k=4):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
             .replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    sh = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


TEXTS = ["", "one", "Ä B c d E f", "a b c\td\ne f\x1cg h i", " ".join(LONG), " ".join(LONG).upper(), "w " * 9000, "a b c d", "A  B\r\nC d e"]


def test_fingerprint():
    for t in TEXTS:
        assert fingerprint(t) == slow_fingerprint(t)


def test_spark_hash_agrees(spark):
    (row,) = spark.sql("select xxhash64('a b c d') h").collect()
    assert row["h"] % (1 << 64) == fingerprint("A b c  d")


def test_near_pairs_all_radii():
    rng = np.random.default_rng(0)
    for radius in (0, 1, 4, 7):
        fps = []
        for b in rng.integers(0, 2**63, 60):
            for _ in range(rng.integers(1, 20)):
                v = int(b)
                for k in rng.integers(0, 64, rng.integers(0, radius + 3)):
                    v ^= 1 << int(k)
                fps.append(v)
        fps = np.unique(np.array(fps, np.uint64))
        bucket = np.sort(rng.integers(0, 9, len(fps)))
        near = [(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps))
                if bucket[i] == bucket[j] and bin(int(fps[i] ^ fps[j])).count("1") <= radius]
        got = near_pairs(bucket, fps, radius)
        assert set(got) <= set(near)
        assert components(len(fps), got) == components(len(fps), near)


def test_links_are_complete_even_for_hot_buckets(spark):
    rng = random.Random(1)
    fps = set()
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(12):
            v = base
            for _ in range(rng.randint(0, 4)):
                v ^= 1 << rng.randrange(64)
            fps.add(v)
    fps = sorted(np.array(sorted(fps), np.uint64).view(np.int64).tolist())
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    near = [(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if bin((fps[i] ^ fps[j]) % (1 << 64)).count("1") <= 4]
    at = {f: i for i, f in enumerate(fps)}
    for cell in (2048, 5):
        got = [(at[r["a"]], at[r["b"]]) for r in links(df, cell=cell).collect()]
        assert components(len(fps), got) == components(len(fps), near)


def test_components_equal_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", "   ", "one", "one"]
    for _ in range(12):
        words = [rng.choice(LONG) for _ in range(300)]
        for _ in range(rng.randint(1, 6)):
            w = list(words)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    rows = [doc(100 - i, t) for i, t in enumerate(texts)] + [doc(100, None)]
    fps = [slow_fingerprint(r[1] or "") for r in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4]
    root = components(len(rows), near)
    want = sorted((rows[i][0], fps[i], min(rows[j][0] for j in range(len(rows)) if root[j] == root[i])) for i in range(len(rows)))
    df = docs_of(spark, rows)
    got = sorted((r["id"], r["fp"] % (1 << 64), r["component_id"]) for r in near_dedup(df).collect())
    assert got == want
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted({r["doc_id"] for r in kept.collect()}) == sorted({c for _, _, c in want})


def test_null_ids_and_empty(spark):
    df = docs_of(spark, [doc(None, "a b c d e"), doc(None, "a b c d e"), doc(3, "a b c d e")])
    assert sorted(str((r["id"], r["component_id"])) for r in near_dedup(df).collect()) == ["(3, 3)", "(None, 3)", "(None, 3)"]
    assert drop_near_duplicates(df).count() == 3
    assert near_dedup(docs_of(spark, [])).collect() == []


def test_repeated_id_with_different_texts(spark):
    """Id 5 goes as a copy of 3 and names the group of its other text: that row stays."""
    a, b = " ".join(LONG), " ".join(reversed(LONG))
    rows = [doc(3, a), doc(5, a), doc(5, b), doc(9, b), doc(7, "x y z w v u"), doc(None, a)]
    df = docs_of(spark, rows)
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert got == sorted([(3, a), (5, b), (7, "x y z w v u"), (None, a)], key=str)
