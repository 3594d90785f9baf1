"""The comparison over rows against plain code for one pair at a time."""

import random
import tracemalloc

import pytest

from folioforge.operators import alignment, diff, pairing


def plain_edits(a, b, limit):
    reach, trail = {1: 0}, []
    for d in range(min(len(a) + len(b), limit) + 1):
        trail.append(dict(reach))
        for k in range(-d, d + 1, 2):
            x = reach[k + 1] if k == -d or (k != d and reach[k - 1] < reach[k + 1]) else reach[k - 1] + 1
            while x < len(a) and x - k < len(b) and a[x] == b[x - k]:
                x += 1
            reach[k] = x
            if x >= len(a) and x - k >= len(b):
                break
        else:
            continue
        break
    else:
        return None
    out, x, y = [], len(a), len(b)
    for step in range(d, -1, -1):
        seen, k = trail[step], x - y
        down = k == -step or (k != step and seen[k - 1] < seen[k + 1])
        fx = seen[k + 1 if down else k - 1] if step else 0
        fy = fx - (k + 1 if down else k - 1) if step else 0
        while x > fx and y > fy:
            x, y = x - 1, y - 1
            out.append(("equal", x, y))
        if step:
            out.append(("insert", -1, fy) if down else ("delete", fx, -1))
            x, y = fx, fy
    return out[::-1]


def plain_matches(a, b, limit):
    """The equal places, range by range."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while n > i and m > j and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            out.append((n, m))
        if i == n or j == m:
            continue
        x, y = a[i:n], b[j:m]
        met = [(p, y.index(v)) for p, v in enumerate(x) if x.count(v) == 1 and y.count(v) == 1] if len(x) + len(y) > alignment.ANCHOR_LEAST else []
        if met:
            at_i, at_j = i, j
            for k in alignment.increasing([q for _, q in met]):
                p, q = met[k]
                todo += [(at_i, i + p, at_j, j + q), (i + p, i + p + 1, j + q, j + q + 1)]
                at_i, at_j = i + p + 1, j + q + 1
            todo.append((at_i, n, at_j, m))
        else:
            out += [(p + i, q + j) for kind, p, q in plain_edits(x, y, limit) or [] if kind == "equal"]
    return sorted(out)


def plain_pairs(deleted, inserted):
    out, used = {}, set()
    for i, text in enumerate(deleted):
        best, score = -1, pairing.PAIR_ABOVE
        for j in range(max(0, i - pairing.PAIR_WINDOW), min(len(inserted), i + pairing.PAIR_WINDOW + 1)):
            if j not in used and (s := diff.dice(text, inserted[j])) > score:
                best, score = j, s
        if best >= 0:
            used.add(best)
            out[i] = (best, score)
    return out


def plain_rows(a, b, max_inline=diff.MAX_INLINE, limit=alignment.EDIT_LIMIT):
    rows, at_i, at_j = [], 0, 0
    for p, q in [*plain_matches(a, b, limit), (len(a), len(b))]:
        pairs = plain_pairs(a[at_i:p], b[at_j:q])
        taken, cursor = {j for j, _ in pairs.values()}, 0
        for k in range(p - at_i):
            if k in pairs:
                j, score = pairs[k]
                rows += [("insert", None, at_j + c, None, None) for c in range(cursor, j) if c not in taken]
                cursor = max(cursor, j)
                left, right = a[at_i + k], b[at_j + j]
                short = max(len(x.encode("utf-16-le")) // 2 for x in (left, right)) <= max_inline
                rows.append(("modify", at_i + k, at_j + j, int(score * 100 + 0.5) / 100, diff.inline(left, right) if short else None))
            else:
                rows.append(("delete", at_i + k, None, None, None))
        rows += [("insert", None, at_j + c, None, None) for c in range(cursor, q - at_j) if c not in taken]
        if p < len(a):
            rows.append(("equal", p, q, None, None))
        at_i, at_j = p + 1, q + 1
    return rows


def tables(spark, pairs):
    """The blocks of both sides, dealt out in any order, with a column more; the places have gaps."""
    sides = []
    for side in (0, 1):
        rows = [(k, 3 * i + 5, text, "x") for k, pair in pairs.items() for i, text in enumerate(pair[side])]
        random.Random(1).shuffle(rows)
        sides.append(spark.createDataFrame(rows, "pair_id long, block_ix int, text string, kind string").repartition(3))
    return sides


def told(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["pair_id"], r["row_ix"])):
        assert r["row_ix"] == len(out.setdefault(r["pair_id"], []))
        out[r["pair_id"]].append((r["kind"], r["left_ix"], r["right_ix"], r["similarity"], None if r["spans"] is None else [(s["kind"], s["text"]) for s in r["spans"]]))
    return out


def revised(rng, words, n):
    """A side of few different blocks, so that many are alike and others similar, and what became of it."""
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 5)))
    left = [text() for _ in range(n)]
    right = []
    for x in left:
        chance = rng.random()
        if chance < 0.15:
            continue
        if chance < 0.35:
            x = x + rng.choice(words)
        right.append(x)
        if chance > 0.85:
            right.append(text())
    return left, right


def test_rows_against_plain_code(spark):
    rng = random.Random(7)
    pairs = {k: revised(rng, "alpha beta gamma delta eps zeta".split(), rng.randrange(0, 30)) for k in range(1000)}
    pairs |= {2000: ([], ["a", "b"]), 2001: (["a"], []), 2002: (["", ""], [""]), 2003: (["x 😀 y" * 9], ["x 😀 z" * 9])}
    got = told(diff.diff_rows(*tables(spark, pairs), max_inline=60).collect())
    assert got == {k: rows for k, (a, b) in pairs.items() if (rows := plain_rows(a, b, 60))}


@pytest.mark.parametrize("bucket", [8, 128])
def test_long_pairs_against_plain_code(spark, monkeypatch, bucket):
    """Ranges with anchors, moved blocks, ranges without anchors, and runs longer than a bucket."""
    monkeypatch.setattr(pairing.pairs, "__defaults__", (bucket,))
    rng = random.Random(11)
    unlike = [f"block {i} {rng.random()}" for i in range(1200)]
    moved = unlike[:200] + unlike[500:700] + ["new"] + unlike[200:500] + unlike[720:]
    shuffled = unlike[:]
    rng.shuffle(shuffled)
    few = [rng.choice("abcdef") * 3 for _ in range(300)]
    same = [f"a line that all share, {i % 3}" for i in range(260)]
    pairs = {
        1: (unlike, moved), 2: (unlike, shuffled), 3: (few, [rng.choice("abcdef") * 3 for _ in range(300)]), 4: revised(rng, "alpha beta gamma delta".split(), 900),
        5: (unlike[:500], [f"other {i}" for i in range(450)]), 6: (same, [f"a line that all share: {i % 4}" for i in range(300)]), 7: (unlike[:30], unlike[:30]), 8: (unlike[:700], unlike[:700]),
        9: ([], unlike[:900]), 10: (unlike[:300] + few + unlike[300:600], unlike[:290] + few[::-1] + unlike[310:600]),
    }
    got = told(diff.diff_rows(*tables(spark, pairs), edit_limit=None).collect())
    for k, (a, b) in pairs.items():
        assert got[k] == plain_rows(a, b, limit=10**9), k
    limited = told(diff.diff_rows(*tables(spark, {3: pairs[3]}), edit_limit=50).collect())
    assert limited[3] == plain_rows(*pairs[3], limit=50)


def test_scripts_are_the_same_and_small(monkeypatch):
    rng = random.Random(3)
    for stride in (1, 7, 256):
        monkeypatch.setattr(alignment, "STRIDE", stride)
        for _ in range(150):
            a, b = ([rng.randrange(5) for _ in range(rng.randrange(60))] for _ in range(2))
            assert alignment.shortest_edits(a, b, None) == plain_edits(a, b, 10**9)
            assert alignment.shortest_edits(a, b, 9) == plain_edits(a, b, 9)
    monkeypatch.undo()
    a, b = ([f"{side}{i}" if i % 6 < 5 else i for i in range(3000)] for side in "ab")
    tracemalloc.start()
    script = alignment.shortest_edits(a, b, None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(kind != "equal" for kind, _, _ in script) == 5000 and peak < 100 << 20


def test_pairs_of_runs_against_plain_code(spark):
    rng = random.Random(5)
    words = "one two three four".split()
    runs = {(k, 10 * r): ([" ".join(rng.choices(words, k=3)) for _ in range(rng.randrange(1, 40))], [" ".join(rng.choices(words, k=3)) for _ in range(rng.randrange(0, 40))]) for k in range(40) for r in range(2)}
    rows = [(*key, side, i, text) for key, run in runs.items() for side in (0, 1) for i, text in enumerate(run[side])]
    changed = spark.createDataFrame(rows, "pair_id long, run long, side int, place int, text string").repartition(4)
    for bucket in (8, 128):
        got = {}
        for r in pairing.pairs(changed, bucket).collect():
            got.setdefault((r["pair_id"], r["run"]), {})[r["i"]] = (r["j"], r["score"])
        assert got == {key: found for key, run in runs.items() if (found := plain_pairs(*run))}


def test_refused_pairs_and_no_rows(spark):
    pairs = {1: (["a"] * 6, ["b"] * 5), 2: (["a"], ["a"])}
    got = told(diff.diff_rows(*tables(spark, pairs), max_blocks=10).collect())
    assert got == {1: [("OUT_OF_MEMORY", None, None, None, None)], 2: [("equal", 0, 0, None, None)]}
    assert diff.diff_rows(*tables(spark, {})).count() == 0
    long = {1: (["a" * 30 + "x"], ["a" * 30 + "y"])}
    assert told(diff.diff_rows(*tables(spark, long), max_inline=10).collect())[1][0][4] is None
    assert told(diff.diff_rows(*tables(spark, long), max_inline=None).collect())[1][0][4] is not None
