"""The pipeline against a plain version of its stages, and every operator and stage on odd tables."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from tests.llm.test_operators import WORD, _links, _prose, _quality, _spans
from walkspark.llm import ann, bpe, katz, langid, licenses, mixing, neardup, pii, quality, sharding

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])
#: Columns of the caller with the names of columns that the operators add or use.
EXTRA = ["kept", "slot", "_found", "_words", "_h", "clean_text", "spans", "ids", "component", "_id"]


def plain_quality(text):
    """(kept, clean text): the line rules, plainly."""
    t = text or ""
    n_words, _, _, _, repeats = _quality(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]

    def fails(x):
        k, low = len(WORD.findall(x)), x.lower()
        marks, bars = len(re.findall(quality.MARKS, x)), len(re.findall(quality.SEPARATORS, x))
        doubled = len(re.findall(r"[!?*#$%&]{2,}(?=[ \t\n\x0b\f\r]|$)", x))
        without = re.sub("|".join(quality.STOCK), "", low)
        phrases = len(low) - len(without)
        unclosed = x.rstrip(" \t\n\x0b\f\r")[-1:] not in quality.CLOSING and k < (0 if len(lines) == 1 else 4)
        return 10 * marks > len(x) or 5 * doubled > k or (bars >= 2 and 4 * bars >= k) or unclosed or (phrases > 0 and (k <= quality.STOCK_WORDS or 5 * phrases > len(x)))

    kept = [x for x in dict.fromkeys(lines) if not fails(x)]
    whole = sum(map(len, lines))
    lost = 1 - sum(map(len, kept)) / whole if whole else 1.0
    return n_words >= 50 and 100 * repeats <= 50 * n_words and lost <= 0.5, "\n".join(kept)


def _texts():
    rng = random.Random(21)
    texts = [None, "", " \t\n", "short one", "x" * 60_000]
    for i in range(30):
        base = _prose(rng, 150, 900)
        texts += [base, base + "\nHome | About | Contact\nAll rights reserved."] if i % 3 else [base]
        if i % 5 == 0:
            texts.append(" ".join(w if rng.random() > 0.01 else "zz" for w in base.split(" ")))
    texts += ["\n".join(" | ".join(f"item{i}n{j}" for j in range(8)) for i in range(12)), _prose(rng, 100, 3), _prose(rng, 90, 800) + f"\nWrite to a.{1}b@mail.example.com or call +44 20 7946 0958 today."]
    texts += [_prose(rng, 20_000, 40_000)]
    return texts


def _docs(spark, extra=False):
    sources = ["hot", "hot", "b", None]
    rows = [(i, t, "en", sources[i % 4], len(t or "")) for i, t in enumerate(_texts())]
    if extra:
        rows += [(None, _texts()[5], None, None, None), *rows[5:8]]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.concat(F.lit(c), F.coalesce("doc_id", F.lit(-1))) for c in EXTRA}) if extra else df


def test_pipeline_equals_its_plain_version(spark, tmp_path):
    import public_tokenizers
    import tiktoken

    docs = _docs(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    clean = {i: c for i, t in enumerate(_texts()) for kept, c in [plain_quality(t)] if kept}
    linked = _links(clean, 5, 80)
    left = {i: t for i, t in clean.items() if linked[i][1] == i}
    assert set(rows) == set(left) and 10 < len(left) < len(clean) < len(_texts())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.default_ranks_path()), special_tokens={})
    places = {r["doc_id"]: (r["slot"], r["row_in_block"]) for r in mixing.mix(docs.filter(F.col("doc_id").isin(list(left)))).collect()}
    for i, t in left.items():
        parts, at = [], 0
        for lo, hi, kind in sorted(_spans(t), key=lambda s: (s[0], -s[1])):
            if lo >= at:
                parts += [t[at:lo], f"<{pii.KINDS[kind].upper()}>"]
            at = max(at, hi)
        masked = "".join(parts) + t[at:]
        assert rows[i]["n_tokens"] == len(library.encode_ordinary(masked)) and (rows[i]["slot"], rows[i]["row_in_block"]) == places[i]
        assert rows[i]["decoded_sha256"] == hashlib.sha256(masked.encode()).hexdigest()


def test_quality_verdicts_equal_the_plain_rules(spark):
    rng = random.Random(22)
    pieces = ["privacy policy", "Home |", "»", "!!", "##", "end.", "word", "All Rights Reserved", "\n", "\n", "\n", " ", "a b c d e.", "Ünï", "***", "x y z w v u t s r q p o n m l k j i h g"]
    texts = ["".join(rng.choice(pieces) + rng.choice([" ", "", "\n"]) for _ in range(rng.randrange(1, 80))) for _ in range(300)] + _texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.clean_lines(df).collect():
        kept, clean = plain_quality(texts[r["doc_id"]])
        assert (r["kept"], r["clean_text"]) == (kept, clean), texts[r["doc_id"]]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_tables(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = _docs(spark, extra=True)
    rows = stage(spark, docs, "").collect()
    ids = Counter(r["doc_id"] for r in rows)
    given = Counter(r["doc_id"] for r in docs.select("doc_id").collect())
    if name == "quality_rules":
        kept = Counter(r["doc_id"] for r in docs.collect() if plain_quality(r["text"])[0])
        assert ids == kept and ids[None] == 1
    elif name == "near_dedup":
        want = _links(dict(enumerate(_texts())), 5, 80)
        assert ids == Counter([None, *[i for i, (_, c) in want.items() if i == c]])
    else:
        assert ids == given
    if name != "tokens":
        assert list(rows[0].asDict()) == docs.columns
        assert all(r[c] == f"{c}{-1 if r['doc_id'] is None else r['doc_id']}" for r in rows for c in EXTRA)
        empty = stage(spark, docs.limit(0), "")
        assert empty.count() == 0 and empty.columns == docs.columns
    else:
        assert stage(spark, docs.limit(0), "").count() == 0 and next(r for r in rows if r["doc_id"] == 0)["n_tokens"] == 0
    assert stage(spark, docs.select("doc_id", "text", "source").withColumn("n_chars", F.lit(1)), "").count() == len(rows)


def _pages(df):
    return df.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://h.example/"), "doc_id").alias("url"), F.col("text").alias("html"), *EXTRA)


OPERATORS = {
    "op1": lambda df: ann.nearest(df.select(F.col("doc_id").alias("vec_id"), F.when(F.col("doc_id") != 1, F.array(F.col("doc_id").cast("double"), F.lit(1.0))).alias("embedding"), *EXTRA), df.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0), F.lit(0.0)).alias("embedding")), shards=2),
    "op2": quality.clean_lines,
    "op3": neardup.near_duplicates,
    "op4": lambda df: sharding.assign_shards(df, n_shards=3),
    "op5": lambda df: licenses.scan(df, {"labels": ["mit", licenses.UNKNOWN, licenses.NONE], "bias": [0.0, 0.0, 1.0], "weights": {"mit": [3.0, 0.0, 0.0]}, "temperature": 1.0, "sure": 0.5, "cues": ["mit"]}),
    "op6": mixing.mix,
    "op7": bpe.encode,
    "op8": lambda df: pii.find_pii(df),
    "op9": katz.score,
    "op10": lambda df: langid.identify(_pages(df), df),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_operators_on_odd_tables(spark, name):
    """Null ids, texts and sources, empty and long texts, repeated rows, clashing columns, and no rows at all."""
    docs = _docs(spark, extra=True)
    n = docs.count()
    found = OPERATORS[name](docs)
    rows = found.count()
    assert rows == n or name == "op1" and rows > 0
    assert OPERATORS[name](docs.limit(0)).count() == 0
    if name in ("op2", "op4", "op6"):
        own = {"op2": {"kept", "clean_text"}, "op4": {"slot"}, "op6": {"slot"}}[name]
        assert all(r[c] == f"{c}{-1 if r['doc_id'] is None else r['doc_id']}" for r in found.collect() for c in EXTRA if c not in own)


def test_moving_to_more_shards_moves_few_rows(spark):
    """Of a ring of virtual nodes, another shard takes about its share; bounded loads move the overflow besides."""
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"))
    eight, nine = ({r["doc_id"]: r["home_shard"] for r in sharding.assign_shards(rows, n_shards=k).collect()} for k in (8, 9))
    moved = [i for i in eight if eight[i] != nine[i]]
    assert all(nine[i] == 8 for i in moved) and len(moved) < 0.2 * len(eight)  # the ring alone: rows go to the new shard only
    eight, nine = ({r["doc_id"]: r["shard"] for r in sharding.assign_shards(rows, n_shards=k).collect()} for k in (8, 9))
    assert sum(eight[i] != nine[i] for i in eight) < 0.5 * len(eight)
