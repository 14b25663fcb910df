"""Katz back-off language model of word pairs: trained into tables, applied by recursion over the orders.

p(w | h) = d(c) c / c(h) for a pair seen c times in training, else alpha(h) p(w), and p(w) = d(c) c / N for a
word seen c times, else what is left over, the one class of unknown words. The discounts d are Good-Turing's for
counts up to five and 1 above; alpha(h) is what the seen pairs leave over, divided by what p leaves over for the
words not seen after h, so that p(. | h) sums to one exactly. A history whose pairs leave nothing over (all of
them were seen more than five times) gets one more count in its denominator; no other history does.

Training counts words, then pairs; both are combined before they are shuffled. The tables: words (w, n);
pairs, one row of packed columns for each bucket; histories (h, log_total, log_alpha). A pair lies in the bucket of its
rare word (the second if rare, else the first), or of the pair itself when both are among the most frequent
words; so no frequent word gathers in a bucket, and a rare word's count is known where its pairs are.

Scoring goes over the texts once. Pairs among the `cached` most frequent ones are looked up where the text
lies, so hot pairs are never shuffled; the others go to their bucket, packed, and meet its table there one
packed row at a time. Unseen pairs go on to the order below, histories of rare words to the table of histories.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from walkspark.llm.common import discard, lean, stored
from walkspark.llm.words import END, START, mixed, word_hashes

FREQUENT = 1 << 17
CACHED = 1 << 19
LIMIT = 5  # counts above it aren't discounted
BUCKET_TOKENS = 6_000_000
FLUSH_TOKENS = 1_000_000
ROWS = 256
BATCH_BYTES = 1 << 22  # of an Arrow batch: with packed rows, Spark's 64 MB would be held twice by each side of a task
RARE = np.uint64(1 << 63)
CLASSES = 64  # of pair counts, two for each power of two


def in_training(doc_id: Column) -> Column:
    """Documents to learn from: the crc32 of their id as text, modulo 7, isn't 2. A null id trains."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 != 2, F.lit(True))


def with_ends(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The texts' words, each text followed by its end."""
    out = np.full(len(hashes) + len(lengths), END, np.uint64)
    out[np.arange(len(hashes)) + np.repeat(np.arange(len(lengths)), lengths)] = hashes
    return out


def _flushes(batches: Iterator[pa.RecordBatch], tokens: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    """(words and ends, tokens of each row, the rows without text) of about `tokens` tokens; text is the last column."""
    held, size = [], 0

    def joined():
        words, lengths, rows = zip(*held)
        held.clear()  # what was joined isn't kept as well
        return np.concatenate(words), np.concatenate(lengths), pa.Table.from_batches(rows).combine_chunks().to_batches()[0]

    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            hashes, lengths = word_hashes(part.column(part.num_columns - 1))
            held.append((with_ends(hashes, lengths), lengths + 1, part.select(part.schema.names[:-1])))
            size += len(held[-1][0])
            if size > tokens:
                yield joined()
                size = 0
    if held:
        yield joined()


def word_counts(documents: DataFrame) -> DataFrame:
    """(w, n): the training count of every word hash, ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, _, _ in _flushes(batches, 3 * FLUSH_TOKENS):
            w, n = np.unique(words, return_counts=True)
            yield pa.RecordBatch.from_pydict({"w": w.astype(np.int64), "n": n.astype(np.int64)})

    texts = documents.filter(in_training(F.col("doc_id"))).select("doc_id", "text")
    return texts.mapInArrow(lean(run), "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))


def discounts(counted: dict[int, int]) -> list[float]:
    """Good-Turing discounts of counts 1 to LIMIT from the numbers of types with each count up to LIMIT + 1.

    Where the numbers give no discount between 0 and 1 (few or odd data), half a count is taken off.
    """
    n = [counted.get(r, 0) for r in range(LIMIT + 2)]
    common = (LIMIT + 1) * n[LIMIT + 1] / n[1] if n[1] else 1.0
    out = []
    for r in range(1, LIMIT + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


def _discounted(n: np.ndarray, d: list[float]) -> np.ndarray:
    return n * np.r_[0.0, d, 1.0][np.minimum(n, LIMIT + 1)]


def _pack(*columns: np.ndarray) -> bytes:
    """Columns by byte plane, compressed."""
    planes = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _unpack(data: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    out = []
    with zstandard.ZstdDecompressor().stream_reader(data) as planes:  # one column's at a time
        for kind in kinds:
            width = np.dtype(kind).itemsize
            raw = np.frombuffer(planes.read(n * width), np.uint8)
            out.append(raw.reshape(width, n).T.copy().view(kind).ravel())
    return out


def _pack_pairs(h: np.ndarray, w: np.ndarray, *more: np.ndarray) -> bytes:
    """Pairs sorted by history: the steps between histories are small."""
    return _pack(np.diff(h, prepend=np.uint64(0)), w, *more)


def _unpack_pairs(data: bytes, n: int, *more: str) -> list[np.ndarray]:
    h, *rest = _unpack(data, n, "u8", "u8", *more)
    return [np.cumsum(h, out=h), *rest]


def _codes(words: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The place of a word among the frequent ones, or its hash with the top bit set."""
    at = np.searchsorted(frequent, words)
    at[at == len(frequent)] = 0
    return np.where(frequent[at] == words, at.astype(np.uint64), words | RARE)


def _pairs(words: np.ndarray, lengths: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(histories, words) as codes, a pair for each token."""
    w = _codes(words, frequent)
    h = np.empty_like(w)
    h[1:] = w[:-1]
    h[np.cumsum(lengths) - lengths] = np.searchsorted(frequent, np.uint64(START))
    return h, w


def _bucket(h: np.ndarray, w: np.ndarray, buckets: int) -> np.ndarray:
    key = np.where(w >= RARE, w, np.where(h >= RARE, h, (h << np.uint64(32)) | w))
    return (mixed(key) % np.uint64(buckets)).astype(np.int32)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows start."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def pair_table(documents: DataFrame, frequent: Column, buckets: int) -> DataFrame:
    """(bucket, n, pairs, types, classes) of the training pairs, one row a bucket.

    pairs: packed histories, words and counts, sorted by history and word. types: the numbers of pairs seen once to LIMIT + 1
    times; classes: of pairs of frequent words by count, two classes for each power of two.
    """

    def part(words: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
        h, w = _pairs(words, lengths, frequent.value[0])
        bucket = _bucket(h, w, buckets)
        order = np.lexsort((w, h, bucket))
        h, w, bucket = h[order], w[order], bucket[order]
        del order
        first = _starts(bucket, h, w)
        n = np.diff(np.r_[first, len(h)]).astype(np.uint32)
        h, w, bucket = h[first], w[first], bucket[first]
        cuts = np.r_[_starts(bucket), len(bucket)]
        each = [(int(bucket[lo]), int(hi - lo), _pack_pairs(h[lo:hi], w[lo:hi], n[lo:hi])) for lo, hi in zip(cuts[:-1], cuts[1:])]
        return pa.RecordBatch.from_pydict({"bucket": pa.array([x[0] for x in each], pa.int32()), "n": pa.array([x[1] for x in each], pa.int64()), "pairs": pa.array([x[2] for x in each], pa.binary())})

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, lengths, _ in _flushes(batches, 3 * FLUSH_TOKENS):
            yield part(words, lengths)  # its arrays are gone when the next texts are read
            del words, lengths

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        h, w, n = (np.concatenate(x) for x in zip(*[_unpack_pairs(d, k, "u4") for d, k in zip(pdf["pairs"], pdf["n"])]))
        order = np.lexsort((w, h))
        h, w, n = h[order], w[order], n[order].astype(np.uint64)
        del order
        first = _starts(h, w)
        h, w, n = h[first], w[first], np.add.reduceat(n, first)
        types = np.bincount(np.minimum(n, LIMIT + 2).astype(np.int64), minlength=LIMIT + 3)[1 : LIMIT + 2]
        classes = np.bincount(_class(n[(h < RARE) & (w < RARE)]), minlength=CLASSES * 2)
        return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "n": [len(h)], "pairs": [_pack_pairs(h, w, n)], "types": [types.tolist()], "classes": [classes.tolist()]})

    texts = documents.filter(in_training(F.col("doc_id"))).select("doc_id", "text")
    made = texts.mapInArrow(lean(parts), "bucket int, n long, pairs binary")
    return made.groupBy("bucket").applyInPandas(whole, "bucket int, n long, pairs binary, types array<long>, classes array<long>")


def _class(n: np.ndarray) -> np.ndarray:
    return np.floor(2 * np.log2(n.astype(np.float64))).astype(np.int64)


@dataclass
class Model:
    """A trained model: its tables, and what every worker holds (bounded by FREQUENT and CACHED)."""

    words: DataFrame  # w, n
    pairs: DataFrame  # bucket, n, pairs, ...
    histories: DataFrame  # h, log_total, log_alpha
    buckets: int
    total: int
    vocabulary: int
    d1: list[float]
    d2: list[float]
    unit: float  # the denominator of word probabilities
    unknown: float  # the probability of the class of unknown words
    known: object  # broadcast: frequent words, their counts, their totals and alphas as histories; cached pairs and their counts


def _history_parts(known, p1: Callable, d2: list[float]):
    """(h, n, kept, mass) of each history in a bucket: tokens after it, what discounting keeps, p(w) of the seen words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h, w, n = _unpack_pairs(data, size, "u8")
                first = _starts(h)
                sums = {"n": n.astype(np.int64), "kept": _discounted(n, d2), "mass": p1(_word_n(w, *_rare(w, n.astype(np.int64)), known.value[1]))}
                yield pa.RecordBatch.from_pydict({"h": h[first].view(np.int64)} | {c: np.add.reduceat(x, first) for c, x in sums.items()})

    return run


def _rare(w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rare words and their training counts; w, n: all pairs of a bucket, so all of each rare word in it."""
    is_rare = w >= RARE
    w = w[is_rare]
    order = np.argsort(w)
    n = n[is_rare][order]
    w = w[order]
    del order
    first = _starts(w)
    return w[first], np.add.reduceat(n, first) if len(first) else n


def _word_n(asked: np.ndarray, rare: np.ndarray, rare_n: np.ndarray, frequent_n: np.ndarray) -> np.ndarray:
    """Training counts of the words `asked`."""
    out = np.zeros(len(asked), np.int64)
    is_rare = asked >= RARE
    out[~is_rare] = frequent_n[asked[~is_rare].astype(np.int64)]
    if len(rare):
        at = np.minimum(np.searchsorted(rare, asked[is_rare]), len(rare) - 1)
        out[is_rare] = np.where(rare[at] == asked[is_rare], rare_n[at], 0)
    return out


def train(documents: DataFrame, frequent_words: int = FREQUENT, bucket_tokens: int = BUCKET_TOKENS, cached: int = CACHED) -> Model:
    """A model of the training documents (see in_training) among documents (doc_id, text)."""
    spark = documents.sparkSession
    words = stored(word_counts(documents), "katz-words", BATCH_BYTES)
    types = {r["n"]: r["types"] for r in words.filter(F.col("n") <= LIMIT + 1).groupBy("n").agg(F.count("*").alias("types")).collect()}
    total, vocabulary, docs = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("w") == END, F.col("n"))), F.lit(0))).first()
    d1 = discounts(types)
    left = sum(r * types.get(r, 0) * (1 - d1[r - 1]) for r in range(1, LIMIT + 1))
    unit, left = (total, left) if left > 0 else (total + 1, 1.0)
    unknown = left / unit

    def p1(n):
        return np.where(n > 0, _discounted(n, d1) / unit, unknown)

    top = words.orderBy(F.desc("n"), "w").limit(frequent_words).toPandas()  # at most frequent_words short rows
    frequent = np.r_[top["w"].to_numpy(np.uint64), np.uint64(START)]
    order = np.argsort(frequent)
    frequent, frequent_n = frequent[order], np.r_[top["n"].to_numpy(np.int64), 0][order]
    first = spark.sparkContext.broadcast((frequent, frequent_n))
    buckets = max(6, math.ceil(total / bucket_tokens))
    pairs = stored(pair_table(documents, first, buckets), "katz-pairs", BATCH_BYTES)
    sums = lambda c, n: pairs.agg(*[F.coalesce(F.sum(F.get(c, F.lit(k))), F.lit(0)) for k in range(n)]).first()
    d2 = discounts(dict(enumerate(sums("types", LIMIT + 1), 1)))
    parts = pairs.select("pairs", "n").mapInArrow(lean(_history_parts(first, p1, d2)), "h long, n long, kept double, mass double")
    each = parts.groupBy("h").agg(F.sum("n").alias("n"), F.sum("kept").alias("kept"), F.sum("mass").alias("mass"))
    nothing = F.col("n") - F.col("kept") < 1e-9 * F.col("n")
    over = F.when(nothing, 1.0).otherwise(F.col("n") - F.col("kept"))
    whole = F.when(nothing, F.col("n") + 1.0).otherwise(F.col("n").cast("double"))
    histories = stored(each.select("h", F.log10(whole).alias("log_total"), F.log10(over / whole / F.greatest(1.0 - F.col("mass"), F.lit(unknown))).alias("log_alpha")), "katz-histories", BATCH_BYTES)
    ours = histories.filter((F.col("h") >= 0) & (F.col("h") < len(frequent))).toPandas()  # at most frequent_words + 1 rows
    log_total, log_alpha = np.zeros(len(frequent)), np.zeros(len(frequent))
    log_total[ours["h"]], log_alpha[ours["h"]] = ours["log_total"], ours["log_alpha"]
    sizes = np.array(sums("classes", 2 * CLASSES), np.int64)
    above = np.cumsum(sizes[::-1])[::-1]
    least = int(np.flatnonzero(np.r_[above <= cached, True])[0])  # the lowest class from which on all pairs fit

    def hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h, w, n = _unpack_pairs(data, size, "u8")
                chosen = (h < RARE) & (w < RARE)
                chosen[chosen] = _class(n[chosen]) >= least
                yield pa.RecordBatch.from_pydict({"found": pa.array([np.r_[(h[chosen] << np.uint64(32)) | w[chosen], n[chosen]].tobytes()], pa.binary())})

    found = [np.frombuffer(r["found"], np.uint64).reshape(2, -1) for r in pairs.select("pairs", "n").mapInArrow(hot, "found binary").collect()]  # at most `cached` pairs
    keys, counts = np.concatenate([*found, np.zeros((2, 0), np.uint64)], axis=1)
    order = np.argsort(keys)
    known = spark.sparkContext.broadcast((frequent, frequent_n, log_total, log_alpha, keys[order], counts[order]))
    return Model(words, pairs, histories, buckets, total, vocabulary, d1, d2, unit, unknown, known)


#: A row of the input goes by two hashes, 96 bits in all, so that no two of any corpus meet: one of its id and text, one of its id and words.
ROW = ["doc", "doc2"]
KEY = np.dtype([("doc", "<i8"), ("doc2", "<i4")])
SUMS = "kind byte, doc long, doc2 int, doc_id long, rows long, tokens long, known long, base double, part double, h long, seen long, unseen long"
SENT = "kind byte, bucket int, n long, data binary, doc long, doc2 int, doc_id long, rows long, tokens long, known long, base double, part double"


def _columns(schema: str, size: int, /, **given) -> pa.RecordBatch:
    """A batch of `size` rows with the given columns (arrays, or one value for all rows) and nulls."""
    kinds = {"byte": pa.int8(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}

    def column(x, kind):
        if x is None:
            return pa.nulls(size, kind)
        return x if isinstance(x, pa.Array) else pa.array([x] * size if np.isscalar(x) else x, kind)

    return pa.RecordBatch.from_pydict({name: column(given.get(name), kinds[kind]) for name, kind in (c.strip().split(" ") for c in schema.split(","))})


def _second(words: np.ndarray, lengths: np.ndarray, doc_id: pa.Array) -> np.ndarray:
    """A 32-bit hash of each text's words in their order and of its id. Rows alike in these have equal scores."""
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(words), dtype=np.uint64) - np.repeat(starts, lengths).astype(np.uint64)
    texts = np.add.reduceat(mixed(words + place * np.uint64(0x9E3779B97F4A7C15)), starts)  # no text is without its end
    ids = doc_id.fill_null(0).to_numpy().view(np.uint64) + np.asarray(doc_id.is_null()).astype(np.uint64) * RARE
    return (mixed(texts + mixed(ids)) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _send(model: Model):
    """For each text its sums over what is known where it lies (kind 2), and packed requests for the rest (kind 1)."""
    known, buckets, d2, unit = model.known, model.buckets, model.d2, model.total + model.vocabulary + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, frequent_n, _, _, _, counts = known.value
        log_kept = np.log10(_discounted(counts, d2)) if len(counts) else np.zeros(0)
        log_base = np.log10((frequent_n + 1) / unit)
        for flush in _flushes(batches, FLUSH_TOKENS):
            yield from sent(*flush, log_kept, log_base)  # its arrays are gone when the next texts are read
            del flush

    def sent(words: np.ndarray, lengths: np.ndarray, rows: pa.RecordBatch, log_kept: np.ndarray, log_base: np.ndarray) -> Iterator[pa.RecordBatch]:
        frequent, frequent_n, log_total, _, keys, counts = known.value
        h, w = _pairs(words, lengths, frequent)
        doc = np.repeat(np.arange(len(lengths), dtype=np.uint32), lengths)
        by_doc = lambda at, x=None: np.bincount(doc[at], x, len(lengths))
        common = w < RARE
        place = w[common].astype(np.int64)
        here = np.flatnonzero(common & (h < RARE))
        key = (h[here] << np.uint64(32)) | w[here]
        at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
        hit = keys[at] == key if len(keys) else np.zeros(len(key), bool)
        cached, at = here[hit], at[hit]
        part = by_doc(cached, log_kept[at] - log_total[h[cached].astype(np.int64)])
        made = {"tokens": lengths, "known": by_doc(common, (frequent_n[place] > 0).astype(np.float64)).astype(np.int64), "base": by_doc(common, log_base[place]), "part": part}
        spread = pa.array(np.arange(len(lengths)) % buckets, pa.int32())
        ids = np.zeros(len(lengths), KEY)
        ids["doc"], ids["doc2"] = np.asarray(rows.column("doc")), _second(words, lengths, rows.column("doc_id"))
        yield _columns(SENT, len(lengths), kind=2, bucket=spread, **{c: np.ascontiguousarray(ids[c]) for c in ROW}, doc_id=rows.column("doc_id"), rows=1, **made)
        rest = np.ones(len(w), bool)
        rest[cached] = False
        h, w, doc = h[rest], w[rest], doc[rest]
        bucket = _bucket(h, w, buckets)
        order = np.lexsort((doc, w, h, bucket))
        h, w, doc, bucket = h[order], w[order], doc[order], bucket[order]
        first = _starts(bucket, h, w, doc)
        n = np.diff(np.r_[first, len(h)]).astype(np.uint32)
        h, w, doc, bucket = h[first], w[first], doc[first], bucket[first]
        cuts = np.r_[_starts(bucket), len(bucket)]
        out = []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            mine, local = np.unique(doc[lo:hi], return_inverse=True)  # ids of the documents in this part alone
            head = np.array([len(mine)], np.uint32).tobytes()
            out.append((int(bucket[lo]), int(hi - lo), head + ids[mine].tobytes() + _pack_pairs(h[lo:hi], w[lo:hi], n[lo:hi], local.astype(np.uint32))))
        yield _columns(SENT, len(out), kind=1, bucket=[x[0] for x in out], n=[x[1] for x in out], data=[x[2] for x in out])

    return run


class _Bucket:
    """The pairs of one bucket, sorted by history and word, and its rare words."""

    def __init__(self, data: bytes, size: int, frequent_n: np.ndarray):
        self.h, self.w, n = _unpack_pairs(data, size, "u8")
        self.n, self.frequent_n = n.view(np.int64), frequent_n
        self.rare, self.rare_n = _rare(self.w, self.n)

    def pair_n(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        lo, end = np.searchsorted(self.h, h), np.searchsorted(self.h, h, "right")
        left, hi = np.flatnonzero(lo < end), end.copy()
        while len(left):  # the word's place among those of the history, by halves
            mid = (lo[left] + hi[left]) // 2
            less = self.w[mid] < w[left]
            lo[left[less]], hi[left[~less]] = mid[less] + 1, mid[~less]
            left = left[lo[left] < hi[left]]
        out, at = np.zeros(len(h), np.int64), np.flatnonzero(lo < end)
        at = at[self.w[lo[at]] == w[at]]
        out[at] = self.n[lo[at]]
        return out

    def word_n(self, w: np.ndarray) -> np.ndarray:
        return _word_n(w, self.rare, self.rare_n, self.frequent_n)


def _answer(model: Model):
    """Sums of documents (kind 0) and their uses of rare histories (kind 1) from rows sorted by bucket and kind."""
    known, d1, d2, unit, unknown, places = model.known, model.d1, model.d2, model.unit, model.unknown, model.total + model.vocabulary + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, frequent_n, log_total, log_alpha, _, _ = known.value
        empty = _pack_pairs(*[np.zeros(0, np.uint64)] * 3)
        at, table = None, None
        for batch in batches:
            kinds = np.asarray(batch.column(0))
            passed = batch.filter(pa.array(kinds == 2))
            if passed.num_rows:
                yield _columns(SUMS, passed.num_rows, kind=0, **{c: passed.column(c) for c in (*ROW, "doc_id", "rows", "tokens", "known", "base", "part")})
            buckets, sizes, packed = np.asarray(batch.column("bucket")), batch.column("n"), batch.column("data")
            for i in np.flatnonzero(kinds < 2).tolist():
                size, data = sizes[i].as_py(), memoryview(packed[i].as_buffer())  # read where it lies
                if buckets[i] != at:
                    table = None  # before the next one is unpacked
                    at, table = buckets[i], _Bucket(data, size, frequent_n) if kinds[i] == 0 else _Bucket(empty, 0, frequent_n)
                if kinds[i] == 1:
                    yield from answers(table, data, size)

    def answers(table: _Bucket, data: bytes, size: int) -> Iterator[pa.RecordBatch]:
        _, frequent_n, log_total, log_alpha, _, _ = known.value
        docs = int(np.frombuffer(data, np.uint32, 1)[0])
        ids = np.frombuffer(data, KEY, docs, 4)
        ids = {c: np.ascontiguousarray(ids[c]) for c in ROW}
        h, w, n, doc = _unpack_pairs(data[4 + KEY.itemsize * docs :], size, "u4", "u4")
        pair_n, word_n = table.pair_n(h, w), table.word_n(w)
        seen, rare_w, rare_h = pair_n > 0, w >= RARE, h >= RARE
        below = np.log10(np.where(word_n > 0, _discounted(word_n, d1) / unit, unknown))
        with np.errstate(divide="ignore"):
            part = np.where(seen, np.log10(_discounted(pair_n, d2)), below)
        of = h[~rare_h].astype(np.int64)
        part[~rare_h] += np.where(seen[~rare_h], -log_total[of], log_alpha[of])
        base = np.where(rare_w, np.log10((word_n + 1) / places), 0.0)
        sums = [np.bincount(doc, n * x, docs) for x in (rare_w & (word_n > 0), base, part)]
        yield _columns(SUMS, docs, kind=0, **ids, known=sums[0].astype(np.int64), base=sums[1], part=sums[2])
        if rare_h.any():
            doc, h, n, seen = doc[rare_h], h[rare_h], n[rare_h].astype(np.int64), seen[rare_h]
            order = np.lexsort((h, doc))
            doc, h, n, seen = doc[order], h[order], n[order], seen[order]
            first = _starts(doc, h)
            yield _columns(SUMS, len(first), kind=1, **{c: x[doc[first]] for c, x in ids.items()}, h=h[first].view(np.int64), seen=np.add.reduceat(n * seen, first), unseen=np.add.reduceat(n * ~seen, first))

    return run


def apply(model: Model, documents: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of documents (doc_id, text)."""
    said = F.coalesce("text", F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", said).alias("doc"), "text")
    sent = rows.mapInArrow(lean(_send(model)), SENT)
    tables = model.pairs.select(F.lit(0).cast("byte").alias("kind"), "bucket", "n", F.col("pairs").alias("data"))
    both = tables.unionByName(sent, allowMissingColumns=True).repartitionById(model.buckets, "bucket").sortWithinPartitions("bucket", "kind")  # no task has two buckets
    made = stored(both.mapInArrow(lean(_answer(model)), SUMS), "katz-sums", BATCH_BYTES)
    sums = made.filter("kind = 0").groupBy(*ROW).agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("rows", "tokens", "known", "base", "part")])
    used = made.filter("kind = 1").select(*ROW, "h", "seen", "unseen").join(model.histories, "h", "left")
    backed = used.groupBy(*ROW).agg(F.sum(F.coalesce(F.col("unseen") * F.col("log_alpha") - F.col("seen") * F.col("log_total"), F.lit(0.0))).alias("backed"))
    joined = sums.join(backed, ROW, "left").withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))  # rows equal in id and text
    each = lambda c: (F.col(c) / F.col("rows"))
    score = (F.col("part") + F.coalesce("backed", F.lit(0.0))) / F.col("rows")
    return joined.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), each("tokens").cast("long").alias("n_tokens"), each("known").cast("long").alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), each("base").alias("base_score"), score.alias("score"))


def score(documents: DataFrame, frequent_words: int = FREQUENT, bucket_tokens: int = BUCKET_TOKENS, cached: int = CACHED) -> DataFrame:
    """One row for each row of documents (doc_id, text): train() on its training documents, apply() to all.

    base_score: add-one unigrams; score: log10 probability under the Katz model, end of text included. Null and
    empty texts are one end. Rows that repeat an id are scored each by itself; rows equal in id and text get equal
    scores. A null id trains. Texts of any length; ties don't matter. Other columns are ignored. Without any
    training text all words are unknown and unseen. An empty table gives no rows.
    """
    model = train(documents, frequent_words, bucket_tokens, cached)
    discard(model.words)
    scores = apply(model, documents)  # its sums are written: only they and the histories are read from here on
    discard(model.pairs)
    return scores
