import hashlib
import math

import numpy as np
import pytest
from llm.test_centroids import make
from sparkfill.llm import codes


def brute(rows, parts, entries, dims, scale=256, rounds=2):
    kept = [(i, label, [math.floor(scale * float(np.float32(c))) for c in v]) for i, v, label in rows
            if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    w = dims // parts
    first = [v for _, v in sorted((i, v) for i, _, v in kept if i is not None)[:entries]]
    books = [[v[p * w : p * w + w] for v in first] for p in range(parts)]

    def nearest(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            cells = [[] for _ in books[p]]
            for _, _, v in kept:
                cells[nearest(books[p], v[p * w : p * w + w])[1]].append(v[p * w : p * w + w])
            books[p] = [[sum(x) // len(x) for x in zip(*m)] if m else b for m, b in zip(cells, books[p])]
    out = []
    for i, label, v in kept:
        found = [nearest(books[p], v[p * w : p * w + w]) for p in range(parts)]
        out.append((str(i), label, "".join(f"{n:02x}" for _, n in found), sum(d for d, _ in found)))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def check(spark, rows, **options):
    want, sha = brute(rows, **options)
    options.pop("dims")
    got = codes.digest(make(spark, rows), **options).collect()
    assert sorted((str(r.vec_id), r.code, r.error) for r in got) == sorted((i, c, e) for i, _, c, e in want)
    per = {}
    for _, label, _, e in want:
        per[label] = per.get(label, 0) + e
    assert sorted((r.code, r.label_error) for r in got) == sorted((c, per[label]) for _, label, c, _ in want)
    assert {r.codebooks_sha256 for r in got} == {sha}


def test_odd_vectors_ties_and_repeats(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(0, 0.1, 8).tolist(), i % 4 or None) for i in range(300)]
    rows += [(3, rows[3][1], 2)] * 70 + [(None, rows[4][1], 5), (900, None, 1), (901, [], 1), (902, [0.5] * 7, 1), (903, [0.5] * 12, 1)]
    rows += [(904, [math.nan] * 8, 1), (905, [-math.inf] + [0.0] * 7, 1), (906, [None] + [0.0] * 7, 1), (907, [1e5] * 8, 1)]
    check(spark, rows, parts=4, entries=16, dims=8)
    coarse = [(i, [float(v) for v in rng.integers(-1, 2, 4)], 0) for i in range(200)]  # many ties
    check(spark, coarse, parts=2, entries=32, dims=4, scale=1)


def test_few_equal_or_no_vectors(spark):
    check(spark, [(2, [0.5, 0.25], 0), (1, [0.5, 0.25], 0)], parts=2, entries=64, dims=2)
    assert codes.digest(make(spark, [(1, None, 0)])).collect() == []
    assert codes.digest(make(spark, [(None, [0.0] * 16, 0)])).collect() == []
    assert codes.digest(make(spark, []).limit(0)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


@pytest.mark.parametrize("width", [1, 2, 4, 40])
def test_blocks_against_all_distances(width):
    rng = np.random.default_rng(width)
    for size, spread in ((1, 5), (16, 5), (1000, 30), (3000, 1 << 22)):
        points = rng.integers(-spread, spread, (size, width))
        points[: size // 3] = points[0]  # a third of all are equal
        book = np.concatenate([points[rng.integers(0, size, 20)], rng.integers(-spread, spread, (44, width))])
        true = ((points[:, None] - book[None]) ** 2).sum(-1)
        blocks = codes.Blocks.of(points)
        entry, error = blocks.coded(book)
        assert (entry == true.argmin(1)).all() and (error == true.min(1)).all()
        sums, counts, want = np.zeros_like(book), np.zeros(64, np.int64), np.zeros_like(book)
        blocks.add_to(sums, counts, book)
        np.add.at(want, entry, points)
        assert (sums == want).all() and (counts == np.bincount(entry, minlength=64)).all()


def test_shortlists_prune_and_sums_stand_for_blocks():
    rng = np.random.default_rng(5)
    centres = rng.integers(-1000, 1000, (64, 4))
    points = centres[rng.integers(0, 64, 16384)] + rng.integers(-9, 9, (16384, 4))
    sums, counts = np.zeros_like(centres), np.zeros(64, np.int64)
    computed = codes.Blocks.of(points).add_to(sums, counts, centres)
    assert counts.sum() == len(points) and (sums.sum(0) == points.sum(0)).all()
    assert computed < 0.05 * 64 * len(points)


def test_hilbert_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        walk = grid[codes.hilbert_order(grid, bits)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()
