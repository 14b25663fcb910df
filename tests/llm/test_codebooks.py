"""Weighted codebooks against plain rounds over all vectors."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from walkspark.llm import codebooks

SCHEMA = "vec_id long, embedding array<double>, label int"


def _plain(rows, parts=4, entries=256, rounds=4, scale=1024):
    """Lloyd's rounds over every row, in Python's whole numbers."""
    kept = [(i, [math.floor(scale * x) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    most = min(Counter(len(v) for _, v, _ in kept if v and len(v) % parts == 0).items(), key=lambda x: (-x[1], x[0]))[0]
    kept = [(i, [max(-codebooks.LIMIT, min(codebooks.LIMIT, x)) for x in v], y) for i, v, y in kept if len(v) == most]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = most // parts
    cut = lambda v, p: tuple(v[p * w : (p + 1) * w])
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, p: min((far(cut(v, p), c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        sums = defaultdict(list)
        for _, v, _ in kept:
            for p in range(parts):
                sums[p, near(v, p)[1]].append(cut(v, p))
        for (p, e), found in sums.items():
            books[p][e] = tuple(sum(x) // len(found) for x in zip(*found))
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    made = [(i, y, [near(v, p) for p in range(parts)]) for i, v, y in kept]
    total = Counter()
    for _, y, found in made:
        total[y] += sum(d for d, _ in found)
    return Counter((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), total[y], digest) for i, y, found in made)


def _rows():
    rng = random.Random(31)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(8)], i % 3 or None) for i in range(700)]
    rows += [(1000 + i, rows[5][1], 1) for i in range(300)]  # a third of all rows hold one vector
    rows += [(2000 + i, rows[i][1][:4] + rows[0][1][4:], 2) for i in range(50)]
    odd = [None, [], [None] * 8, [float("nan")] + [0.0] * 7, [float("inf")] + [0.0] * 7, [1.0] * 12, [0.5] * 7, [0.0] * 8, [1e300] * 8, [-1e300] + [0.25] * 7]
    return rows + [(3000 + i, v, None) for i, v in enumerate(odd)] + [(7, [0.1] * 8, 1), (7, [0.1] * 8, 1), (None, [0.3] * 8, 1)]


def test_codes_equal_plain_rounds(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("uid", "v", "pos", "part", "n", "code", "error", "id")})
    for given in ({}, {"entries": 16, "rounds": 2}, {"parts": 2}):
        got = codebooks.compress(df, **given)
        assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
        assert Counter(tuple(r) for r in got.collect()) == _plain(rows, **given)


def test_codes_of_nothing(spark):
    df = spark.createDataFrame(_rows(), SCHEMA)
    for some in (df.limit(0), df.filter("embedding IS NULL"), df.filter("size(embedding) = 7")):
        got = codebooks.compress(some)
        assert got.count() == 0 and got.dtypes == codebooks.compress(df).dtypes


def test_equal_parts_are_kept_once(spark):
    rows = codebooks.whole_numbers(spark.createDataFrame(_rows(), SCHEMA).filter("size(embedding) = 8"), "vec_id", "embedding", "label", 1024)
    found = codebooks.distinct_parts(rows, 4, 2)
    assert found.groupBy("pos").agg(F.sum("n").alias("n")).filter(F.col("n") != rows.count()).count() == 0
    assert found.count() == found.select("pos", "part").distinct().count() and found.agg(F.max("n")).first()[0] >= 300


def test_nearest_ties_and_large_numbers():
    book = np.array([[0, 0], [2, 0], [2, 0]])
    index, error = codebooks.nearest(np.array([[1, 0], [2, 0], [9, 9]]), book)
    assert index.tolist() == [0, 1, 1] and error.tolist() == [1, 0, 130]
    far = codebooks.LIMIT
    index, error = codebooks.nearest(np.array([[far, -far]]), np.array([[-far, far], [far, far - 1]]))
    assert index.tolist() == [1] and error.tolist() == [(2 * far - 1) ** 2]
