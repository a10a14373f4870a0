import random

import numpy as np
import xxhash

from convspark.llm import substrings
from convspark.llm.substrings import HASHES, _among_themselves, _mix, compact_windows, shared_passages, shingle_lists, shingles, window_minima

from .helpers import LONG, components, doc, docs_of


def text(rng, n):
    return [rng.choice(LONG) + str(rng.randrange(50)) for _ in range(n)]


def test_window_minima():
    rng = np.random.default_rng(0)
    for n, width in ((1, 1), (46, 46), (300, 46), (90, 7)):
        v = rng.integers(0, 30, n).astype(np.uint64)
        want = [i + int(np.argmin(v[i:i + width])) for i in range(n - width + 1)]
        assert window_minima(v, width).tolist() == want


def test_shingles_of_many_texts_are_xxh64(monkeypatch):
    """Hashed together, not one by one: the library is asked for shingles beyond the array's bytes only."""
    rng = random.Random(2)
    texts = [" ".join("\u00e9" * rng.randrange(2) + "X" * rng.choice((1, 2, 3, 5, 8, 13, 40)) for _ in range(rng.randrange(60))) for _ in range(200)]
    texts += ["", "a b", "y" * 3000 + " b c d E f"]
    want = []
    for t in texts:
        w = t.encode().lower().split()
        want.append([xxhash.xxh64_intdigest(b" ".join(w[i:i + 5]), 42) for i in range(len(w) - 4)])
    asked = []
    digest = xxhash.xxh64_intdigest
    monkeypatch.setattr(substrings.xxhash, "xxh64_intdigest", lambda *a: asked.append(a) or digest(*a))
    assert [h.tolist() for h in shingle_lists(texts)] == want
    assert len(asked) < 10 and [h.tolist() for h in map(shingles, texts)] == want


def test_windows_tile_every_text():
    rng = random.Random(1)
    hs = [shingles(" ".join(text(rng, n))) for n in (3, 50, 51, 49, 400, 0)] + [shingles("same line of words " * 100)]
    ends = np.cumsum([len(h) for h in hs])
    starts = np.r_[0, ends[:-1]]
    h = np.concatenate(hs)
    for band, (key, of, anchor, first, last) in enumerate(compact_windows(h, ends, 46)):
        covered = sorted(x for a, b in zip(first, last) for x in range(a, b + 1))
        assert covered == [x for a, b in zip(starts, ends) for x in range(a, b - 45)]
        v = _mix(h, HASHES[2 * band])
        for a, f, z, t in zip(anchor, first, last, of):
            assert f <= a < f + 46 and starts[t] <= f and z + 46 <= ends[t]
            assert all(v[s:s + 46].min() == v[a] for s in range(f, z + 1))


def jaccard(a, b, k=5):
    x, y = ({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} for w in (a, b))
    return len(x & y) / len(x | y)


def test_planted_passages(spark):
    rng = random.Random(7)
    passage, near = text(rng, 60), text(rng, 120)
    rows, body = [], {}
    for i in range(40):
        w = text(rng, rng.randint(60, 200))
        if i in (3, 11, 30):
            w = w[:20] + passage + w[20:]
        if i in (5, 6):
            n = list(near)
            n[60] = f"changed{i}"
            w = n + w
        body[i] = w
    rows = [doc(i, " ".join(w)) for i, w in body.items()]
    rows += [doc(50, " ".join(body[9])), doc(51, None), doc(52, ""), doc(53, "too short"), doc(54, "too short"), doc(None, " ".join(passage)),
             rows[12], doc(60, "one line again and " * 80), doc(61, "one line again and " * 90)]
    got = shared_passages(docs_of(spark, rows)).collect()
    words = {r[0]: (r[1] or "").split() for r in rows if r[0] is not None}
    pairs = {(r["doc"], r["rep_doc"]) for r in got}
    assert pairs - {(30, 11)} == {(11, 3), (30, 3), (6, 5), (50, 9), (61, 60)}
    for r in got:
        a, b = words[r["doc"]][r["start_word"]:r["end_word"]], words[r["rep_doc"]][r["rep_start_word"]:r["rep_end_word"]]
        assert len(a) == len(b) >= 50
        assert jaccard(a, b) >= 0.8 or max(jaccard(a[i:i + 50], b[i:i + 50]) for i in range(len(a) - 49)) >= 0.8
    for d in (11, 30):
        mine = [r for r in got if r["doc"] == d]
        assert min(r["start_word"] for r in mine) <= 20 and max(r["end_word"] for r in mine) >= 80


def test_members_that_miss_the_first_document_meet(spark):
    """Two keys' first document shares a signature but not enough text with the rest: the rest is paired."""
    rng = random.Random(9)
    core, tails = text(rng, 30), [text(rng, 40) for _ in range(4)]
    rows = [doc(i, " ".join(core + tails[min(i, 2)])) for i in range(4)]
    rows[0] = doc(0, " ".join(core + tails[0]))
    got = {(r["doc"], r["rep_doc"]) for r in shared_passages(docs_of(spark, rows)).collect()}
    assert got == {(2, 3)} or got == {(3, 2)}


def test_hot_key_as_a_grid_of_cells(spark):
    """Windows of one key, in cells of three rows: the links connect what all pairs would connect."""
    rng = random.Random(4)
    cores = [text(rng, 60) for _ in range(3)]
    rows, regions = [], []
    for d in range(24):
        h = shingles(" ".join(cores[d % 3])).astype(np.uint32).view(np.int32)
        h = np.r_[np.int32(d), h[:40], h[40:]][:56]
        h[20] = 7
        rows.append((1, d, 1, 20, 0, 56))
        regions.append((d, 1, 0, h.tolist()))
    r = spark.createDataFrame(rows, "key long, doc long, region long, anchor long, first long, stop long")
    g = spark.createDataFrame(regions, "doc long, region long, at long, hashes array<int>")
    for cell in (1024, 3):
        got = _among_themselves(r, g, 46, 0.8, cell).collect()
        assert all(x["doc"] % 3 == x["rdoc"] % 3 and x["doc"] > x["rdoc"] and x["similarity"] >= 0.8 for x in got)
        assert components(24, [(x["doc"], x["rdoc"]) for x in got]) == [d % 3 for d in range(24)]


def test_empty(spark):
    assert shared_passages(docs_of(spark, [])).collect() == []
    assert shared_passages(docs_of(spark, [doc(1, None)])).collect() == []


def test_inserted_and_deleted_words(spark):
    """Passages that differ by one word put in or left out in the middle, inside unrelated documents."""
    rng = random.Random(21)
    rows, kinds = [], {}
    for n in range(60):
        p = text(rng, 50 + 10 * (n % 3))
        q = p[:len(p) // 2] + (["put"] if n % 2 else []) + p[len(p) // 2 + (1 - n % 2):]
        for d, w in ((2 * n, p), (2 * n + 1, q)):
            rows.append(doc(d, " ".join(text(rng, 70) + w + text(rng, 70))))
        kinds[(2 * n + 1, 2 * n)] = n % 2
    words = {r[0]: r[1].split() for r in rows}
    got = shared_passages(docs_of(spark, rows)).collect()
    assert {(r["doc"], r["rep_doc"]) for r in got} <= set(kinds)
    for r in got:
        a, b = words[r["doc"]][r["start_word"]:r["end_word"]], words[r["rep_doc"]][r["rep_start_word"]:r["rep_end_word"]]
        assert len(a) == len(b) and max(jaccard(a[i:i + 50], b[i:i + 50]) for i in range(len(a) - 49)) >= 0.8
    for kind in (0, 1):
        found = {(r["doc"], r["rep_doc"]) for r in got if kinds[(r["doc"], r["rep_doc"])] == kind}
        assert len(found) >= 24


def test_failing_windows_meet_verified_ones_and_the_first_documents_variants(spark):
    """Chains of edits A-B-C, and first documents with two variants of a passage whose second is copied: whatever
    shares a signature and has slices that are near is linked."""
    rng = random.Random(5)
    rows = []
    for n in range(60):
        a = text(rng, 50)
        b, c, second = [*a], [*a], [*a]
        b[25] = c[25] = f"once{n}"
        c[45] = f"twice{n}"
        second[12] = second[37] = f"variant{n}"
        for w in (a + text(rng, 60) + second, b, c, second):
            rows.append(" ".join(text(rng, 60) + w + text(rng, 60)))
    hs = [shingles(x) for x in rows]
    ends = np.cumsum([len(h) for h in hs])
    starts, by_key, want = np.r_[0, ends[:-1]], {}, set()
    for key, of, _, first, last in compact_windows(np.concatenate(hs), ends, 46):
        for k, t, f, z in zip(key.tolist(), of.tolist(), first, last):
            by_key.setdefault(k, []).append((t, [set(hs[t][x:x + 46].tolist()) for x in range(f - starts[t], z - starts[t] + 1)]))
    for group in by_key.values():
        for i, (t, x) in enumerate(group):
            want |= {(t, u) for u, y in group[:i] if t != u and any(len(p & q) >= 0.8 * len(p | q) for p in x for q in y)}
    got = {(r["doc"], r["rep_doc"]) for r in shared_passages(docs_of(spark, [doc(i, x) for i, x in enumerate(rows)])).collect()}
    roots = components(len(rows), got)
    assert len(want) > 100 and sorted(p for p in want if roots[p[0]] != roots[p[1]]) == []


def test_recall_at_the_similarity_bound(spark):
    """Pairs of 50-word passages with one word substituted (similarity 0.80), in unrelated documents."""
    rng = random.Random(13)
    rows = []
    for n in range(150):
        a = text(rng, 50)
        b = a[:25] + [f"other{n}"] + a[26:]
        assert 0.8 <= jaccard(a, b) < 0.81
        rows += [doc(2 * n + i, " ".join(text(rng, 60) + w + text(rng, 60))) for i, w in enumerate((a, b))]
    got = {(r["doc"], r["rep_doc"]) for r in shared_passages(docs_of(spark, rows)).collect()}
    assert got <= {(2 * n + 1, 2 * n) for n in range(150)} and len(got) >= 0.95 * 150, len(got)


def test_keys_of_a_batch_are_compared_in_step(spark, monkeypatch):
    """Many small keys whose rows have words put in, repeats or nothing in common: the links connect what all slices of
    all pairs connect, and the number of array steps does not grow with the number of keys."""
    rng = random.Random(3)
    width, n = 12, 150
    rows, regions, want = [], [], {}
    for key in range(n):
        base = [rng.randrange(1000, 9000) for _ in range(width)]
        if key % 3 == 1:
            base[8] = base[9] = base[3]
        lists = []
        for d in range(5):
            if d == 4 or key % 3 == 2:
                h = [rng.randrange(10000, 99999) for _ in range(2 * width - 1)]
            else:
                h = [rng.randrange(10000, 99999) for _ in range(d % 3)] + base[:6 + d] + ([d] if d % 2 else []) + base[6 + d:]
                h += [rng.randrange(10000, 99999) for _ in range(4)]
            for _ in range(rng.randrange(4)):
                h[rng.randrange(len(h))] = rng.randrange(10000, 99999)
            anchor = len(h) // 2
            h[anchor] = 7
            lo, hi = max(0, anchor - width + 1), min(len(h), anchor + width)
            rows.append((key, 10 * key + d, 0, anchor, 0, len(h)))
            regions.append((10 * key + d, 0, 0, h))
            lists.append([set(h[a:a + width]) for a in range(lo, hi - width + 1)])
        near = [(i, j) for i in range(5) for j in range(i)
                if any(len(p & q) >= 0.7 * len(p | q) for p in lists[i] for q in lists[j])]
        want[key] = components(5, near)
    assert len({tuple(v) for v in want.values()}) > 3
    r = spark.createDataFrame(rows, "key long, doc long, region long, anchor long, first long, stop long")
    g = spark.createDataFrame(regions, "doc long, region long, at long, hashes array<int>")
    held = []
    monkeypatch.setattr(type(r), "mapInArrow", lambda df, f, schema: held.append((f, df.coalesce(1).toArrow())) or r)
    _among_themselves(r, g, width, 0.7)
    (run, cells), = held
    cells = cells.combine_chunks().sort_by([(c, "ascending") for c in ("key", "i", "j", "doc", "anchor")])

    class Counted:
        calls = 0

        def __getattr__(self, name):
            Counted.calls += 1
            return getattr(np, name)

    monkeypatch.setattr(substrings, "np", Counted())
    got = [x for b in run(iter(cells.to_batches())) for x in b.to_pylist()]
    assert all(x["doc"] // 10 == x["rdoc"] // 10 and x["doc"] > x["rdoc"] and x["similarity"] >= 0.7 for x in got)
    for key, roots in want.items():
        assert components(5, [(x["doc"] % 10, x["rdoc"] % 10) for x in got if x["doc"] // 10 == key]) == roots
    assert Counted.calls < 20 * n  # 1,794; where each key is compared by itself 7,933
