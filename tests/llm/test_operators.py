"""Each operator against a brute-force version, and on odd tables: nulls, empty and long texts, repeated rows,
no rows, columns whose names clash."""

from __future__ import annotations

import ast
import gc
import math
import random
import re
import time
import tracemalloc
import uuid
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from walkspark.llm import ann, bpe, common, katz, langid, licenses, mixing, neardup, pii, quality, sharding

DOC = "doc_id long, text string, source string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _docs(spark, texts, sources=("a",)):
    return spark.createDataFrame([(i, t, sources[i % len(sources)]) for i, t in enumerate(texts)], DOC)


def _prose(rng, n, vocabulary=400):
    words = [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
    lines = [" ".join(words[i : i + 12]) + "." for i in range(0, n, 12)]
    return "\n".join(lines)


ODD = [None, "", " \t\n\x0b", "one", "A b", "x" * 50_000, "é ü ß z", "a.b@c.de " * 30, "same text here", "same text here"]


# quality

def _quality(t):
    w = WORD.findall(t or "")
    windows = list(zip(w, w[1:], w[2:]))
    counts, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if counts[x] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    rng = random.Random(1)
    texts = ODD + [_prose(rng, rng.randrange(1, 300), rng.choice([3, 40, 2000])) for _ in range(60)] + ["a b c d e f a b c d e f g", "a a a a"]
    df = _docs(spark, texts).withColumn("kept", F.lit("x")).withColumn("n_words", F.lit(1))
    rows = quality.clean_lines(df).collect()
    assert len(rows) == len(texts)
    for r in rows:
        e = _quality(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == e
        assert r["base_failed"] == (e[0] < 50 or 100 * e[4] > 50 * e[0])
        assert not (r["kept"] and r["base_failed"])
    assert quality.clean_lines(df.limit(0)).count() == 0


def test_quality_verdicts(spark):
    good = "\n".join(f"This is clean line number {i} with words {i * 7} and {i * 13} here." for i in range(12))
    symbols = "\n".join(" ".join(f"w{i}x{j}###" for j in range(8)) for i in range(12))
    menu = "\n".join(" | ".join(f"item{i}n{j}" for j in range(8)) for i in range(12))
    got = {r["doc_id"]: r for r in quality.clean_lines(_docs(spark, [good, symbols, menu, good + "\nAll rights reserved, see our privacy policy.", good + "\n" + "Home | About | Contact"])).collect()}
    assert [got[i]["kept"] for i in range(5)] == [True, False, False, True, True]
    assert got[3]["clean_text"] == good and got[4]["clean_text"] == good


def test_a_long_line_may_mention_a_stock_phrase(spark):
    words = " ".join(f"word{i}" for i in range(80))
    one = f"The court held that the privacy policy was part of the contract, {words} and lorem ipsum too."
    lines = "\n".join(f"This is clean line number {i} with words {i * 7} and {i * 13} here." for i in range(12))
    furniture = "\n".join(f"Terms of use, a{i} b{i} privacy policy c{i} cookie policy d{i}." for i in range(12))
    spam = f"{' '.join(f'{i} privacy policy terms of use cookie policy' for i in range(20))}."
    got = {r["doc_id"]: r for r in quality.clean_lines(_docs(spark, [one, f"{lines}\n{one}", furniture, f"{lines}\n{spam}"])).collect()}
    assert got[0]["kept"] and got[0]["lost_share"] == 0.0 and got[0]["clean_text"] == one
    assert got[1]["clean_text"] == f"{lines}\n{one}"
    assert not got[2]["kept"] and not got[2]["base_failed"] and got[2]["clean_text"] == ""
    assert got[3]["clean_text"] == lines


def test_lines_end_and_words_part_at_any_white_space(spark):
    plain = "\n".join(f"This is clean line number {i} with words {i * 7} and {i * 13} here." for i in range(12))
    short = "\n".join(f"No {i}." for i in range(60))
    loose = "\n".join(f"a{i} b{i} c{i} d{i} e{i}" for i in range(30))
    pairs = [(x, x.replace("\n", "\r\n")) for x in (plain, short, loose)] + [(x, x.replace(" ", "\t")) for x in (plain, short, loose)] + [(loose, loose.replace("a", "  a"))]
    rows = quality.clean_lines(_docs(spark, [t for pair in pairs for t in pair])).orderBy("doc_id").collect()
    assert all(r["kept"] and r["lost_share"] == 0.0 for r in rows)
    few = quality.clean_lines(_docs(spark, ["\n".join(f"   a{i}  b{i}" for i in range(60))])).first()
    assert few["lost_share"] == 1.0 and not few["kept"]


# sharding

def test_sharding(spark):
    df = _docs(spark, [f"text {i % 50}" for i in range(1003)] + ODD)
    rows = sharding.shard_documents(df).collect()
    sizes = Counter(r["shard"] for r in rows)
    assert sorted(sizes) == list(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1 and len(rows) == df.count()
    slots = defaultdict(set)
    for r in rows:
        slots[r["shard"]].add(r["slot"])
    assert all(slots[s] == set(range(sizes[s])) for s in sizes)
    texts = dict(df.select("doc_id", "text").collect())
    assert all(r["size"] == len((texts[r["doc_id"]] or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode()) for r in rows)
    # rows that aren't at home fled a full shard, and no shard with room is passed on the way
    assert sum(r["shard"] != r["home_shard"] for r in rows) < 0.5 * len(rows)
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard_documents(df.repartition(7)).collect()}
    assert again == {r["doc_id"]: (r["shard"], r["slot"]) for r in rows}
    clash = spark.createDataFrame([(None, 1, "a"), (None, 2, "b"), (3, 3, None)], "doc_id long, shard int, slot string")
    assert sharding.assign_shards(clash, n_shards=2).count() == 3 and sharding.assign_shards(clash.limit(0)).count() == 0


def test_overflow_goes_clockwise():
    nodes = sharding.ring(3, 4, 6)
    segments = sharding.placement({5: 30}, 3, 4, 6)
    order = list(dict.fromkeys(s for c, s in [n for n in nodes if n[0] >= 5] + [n for n in nodes if n[0] < 5]))
    assert [s[3] for s in segments] == order and [s[2] - s[1] for s in segments] == [10, 10, 10]


# mixing

def test_schedule_meets_every_deadline():
    for weights in ({"a": 5, "b": 3, "c": 1}, {f"s{i}": 1 / (i + 1) for i in range(20)}, {"only": 2}):
        per = mixing.shares(weights, 512)
        rows = mixing.schedule(per)
        assert sum(per.values()) == 512 and sorted(r[4] for r in rows) == list(range(512))
        assert all(release <= slot < deadline for _, _, release, deadline, slot in rows)
        done = Counter()
        for s, _, _, _, slot in sorted(rows, key=lambda r: r[4]):
            done[s] += 1
            assert all(abs(done[x] - (slot + 1) * per[x] / 512) < 1 for x in per)


def test_mix(spark):
    df = spark.createDataFrame([(i, ["a", "b", None][min(2, i % 7 // 3)], 9) for i in range(3000)], "doc_id long, source string, slot int")
    rows = mixing.mix(df, {"a": 1, "b": 2, "": 1}, block_rows=4, period=64).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(3000)) and len({(r["slot"], r["row_in_block"]) for r in rows}) == 3000
    blocks = defaultdict(set)
    for r in rows:
        assert r["release"] <= r["slot"] < r["deadline"]
        blocks[r["slot"]].add((r["source"], r["block"]))
    assert all(len(b) == 1 for b in blocks.values())
    laid = [r["slot"] for r in mixing.in_mix_order(mixing.mix(df)).collect()]
    assert laid == sorted(laid)
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mix(df.union(df)).count() == 6000
    with pytest.raises(ValueError):
        mixing.mix(df, {"a": 1})


def test_shares_follow_the_weights_of_many_sources(spark):
    weights = {f"s{i}": 0.67 / 2999 for i in range(2999)} | {"hot": 0.33}
    period = mixing.period_for(weights)
    per = mixing.shares(weights, period)
    assert sum(per.values()) == period and min(per.values()) >= 1
    assert all(abs(per[s] - period * w) < 1 for s, w in weights.items())
    assert mixing.period_for({"a": 1.0, "b": 2.0}) == mixing.PERIOD and mixing.period_for({}) == mixing.PERIOD
    few = mixing.shares({"a": 1000, **{f"s{i}": 1 for i in range(6)}}, 8)
    assert few == {"a": 2, **{f"s{i}": 1 for i in range(6)}}


def test_mix_of_more_sources_than_slots(spark):
    df = spark.range(9000).select(F.col("id").alias("doc_id"), F.concat(F.lit("h"), F.least("id", F.lit(5000))).alias("source"))
    rows = mixing.mix(df).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(9000)) and len({(r["slot"], r["row_in_block"]) for r in rows}) == 9000
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in rows)


def test_tokens_carry_the_place_in_the_mix(spark):
    import corpus_pipeline

    texts = [None, "", *[f"text number {i}" for i in range(400)]]
    df = _docs(spark, texts, ("hot", "hot", "hot", "b", "c"))
    want = {r["doc_id"]: (r["slot"], r["row_in_block"]) for r in mixing.mix(df).collect()}
    rows = corpus_pipeline.tokens(spark, corpus_pipeline.mix_sources(spark, df, "").repartition(5), "").collect()
    places = [(r["slot"], r["row_in_block"]) for r in rows]
    assert {r["doc_id"]: p for r, p in zip(rows, places)} == want and len(rows) == len(texts)
    assert places == sorted(places)


# columns of our own never meet the caller's

CLASH = ["_h", "_tie", "_at", "_rank", "_cell", "_lo", "_hi", "_first", "_source", "_n", "_per", "_k", "_cycle", "_release", "_deadline", "_slot", "_words", "_lines", "_WORDS2"]


@pytest.mark.parametrize("run", [lambda df: mixing.mix(df), lambda df: sharding.assign_shards(df, n_shards=3), lambda df: quality.clean_lines(df), lambda df: mixing.in_mix_order(mixing.mix(df))])
def test_clashing_names_stay(spark, run):
    df = _docs(spark, [f"text number {i}" for i in range(50)], ("a", "b")).withColumns({c: F.concat(F.lit(c), "doc_id") for c in CLASH})
    rows = run(df).collect()
    assert len(rows) == 50 and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in CLASH)


# near duplicates

def _links(texts, words, threshold):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(zip(*[w[k:] for k in range(words)])) if len(w) >= words else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= threshold * (len(sets[i]) + len(sets[j]) - common):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("words, threshold", [(3, 85), (5, 80)])
def test_near_duplicates(spark, words, threshold):
    rng = random.Random(5)
    texts = list(ODD)
    for _ in range(8):
        base = _prose(rng, 120).split(" ")
        texts += [" ".join(w if rng.random() > p else "zz" for w in base) for p in (0, 0, 0.01, 0.02, 0.03, 0.05, 0.3)]
    base = _prose(rng, 150).split(" ")
    texts += [" ".join(w if rng.random() > 0.025 else f"q{rng.randrange(9)}" for w in base) for _ in range(150)]  # a crowded bucket
    df = _docs(spark, texts).withColumn("id", F.lit(0)).withColumn("component", F.lit(""))
    want = _links(dict(enumerate(texts)), words, threshold)
    rows = neardup.near_duplicates(df, words=words, threshold=threshold).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    kept = neardup.drop_near_duplicates(df, words=words, threshold=threshold)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in want.items() if i == c} and kept.columns == df.columns


def test_near_duplicates_of_nothing(spark):
    empty = _docs(spark, ["x"]).limit(0)
    assert neardup.near_duplicates(empty).count() == 0
    nulls = spark.createDataFrame([(None, "a b c d e f", "s"), (None, "a b c d e f", "s"), (1, "a b c d e f", "s"), (1, "a b c d e f", "s")], DOC)
    rows = neardup.near_duplicates(nulls).collect()
    assert sorted((r["doc_id"] or 0, r["kept"]) for r in rows) == [(0, True), (0, True), (1, True), (1, True)]


def test_repeated_rows_leave_one(spark):
    text, other = "one two three four five six seven", "a b c d e f g h i"
    rows = [(4, text, "s"), (4, text, "s"), (4, text, "s"), (6, text, "s"), (7, other, "s"), (7, "", "s"), (None, text, "s"), (9, None, "s"), (9, None, "s")]
    kept = neardup.drop_near_duplicates(spark.createDataFrame(rows, DOC))
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 4, 7, 9]
    again = neardup.drop_near_duplicates(spark.createDataFrame(rows[::-1], DOC).repartition(3))
    assert sorted(map(str, again.collect())) == sorted(map(str, kept.collect()))


def test_an_id_with_two_texts_is_one_document(spark):
    text, other = "one two three four five six seven", "a b c d e f g h i"
    rows = [(2, text, "s"), (5, text, "s"), (5, other, "s"), (8, other, "s"), (9, "x y z", "s")]
    got = {(r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, DOC)).collect()}
    assert got == {(2, 2), (5, 2), (8, 2), (9, 9)}


def test_blocks_hold_few_shingles(spark, monkeypatch):
    rng = random.Random(12)
    base = _prose(rng, 150).split(" ")
    texts = [" ".join(w if rng.random() > 0.03 else f"q{rng.randrange(9)}" for w in base) for _ in range(120)]
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 1000)
    want = _links(dict(enumerate(texts)), 3, 85)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(_docs(spark, texts), words=3, threshold=85).collect()} == want


def test_every_close_signature_shares_a_bucket(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 16, neardup.WIDTH, dtype=np.uint16)
    rows = [(0, bytearray(a.tobytes()))]
    for i in range(1, 60):
        b = a.copy()
        b[rng.choice(neardup.WIDTH, 17, replace=False)] ^= 1
        rows.append((i, bytearray(b.tobytes())))
    keys = {r["id"]: set(r["k"]) for r in spark.createDataFrame(rows, "id int, sig binary").select("id", neardup._deletions().alias("k")).collect()}
    assert all(keys[0] & keys[i] for i in keys)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    assert {r["id"]: r["component"] for r in neardup.components(edges).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# byte-level BPE

def test_bpe_equals_library(spark):
    import public_tokenizers
    import tiktoken

    ranks = bpe.read_ranks(bpe.default_ranks_path())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    texts = [*ODD, "<|endoftext|> don't  stop\n\n  now ", "ab" * 20_000, *["".join(rng.choice("abé \n\t\x1c\x85'sre12À漢🙂.,!?") for _ in range(60)) for _ in range(400)]]
    df = _docs(spark, texts).withColumn("ids", F.lit(1))
    rows = bpe.decode(bpe.encode(df)).collect()
    for r in rows:
        t = texts[r["doc_id"]] or ""
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert ids == library.encode_ordinary(t) and r["n_tokens"] == len(ids) and bytes(r["decoded"]) == t.encode()
    assert len(rows) == len(texts) and bpe.encode(df.limit(0)).count() == 0


def test_lower_ranks_that_come_up_late_go_first():
    ranks = {bytes([c]): i for i, c in enumerate(b"abcd")} | {b"bc": 9, b"abc": 5, b"cd": 7, b"ab": 8, b"dd": 6}
    encoder = bpe.Encoder(ranks, r"\w+|\s+")

    def plain(piece):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            best = min(((ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks), default=None)
            if best is None:
                return [ranks[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    rng = random.Random(4)
    pieces = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 12))).encode() for _ in range(500)]
    assert encoder.merges(pieces) == [plain(p) for p in pieces]


# personal data

def _spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m)
    out = [(m.start(), m.end(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), m.end(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), m.end(), 2) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [(m.start(), m.end(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


def test_base_spans():
    rng = random.Random(6)
    for _ in range(5000):
        t = "".join(rng.choice("ab1.@ +-(56%é\n") for _ in range(30))
        assert pii.base_spans(t) == _spans(t)
    assert pii.base_spans("a@b@c.de 4111 1111 1111 1111, 10.0.0.256 and +44 (20) 7946-0958") == _spans("a@b@c.de 4111 1111 1111 1111, 10.0.0.256 and +44 (20) 7946-0958")
    assert pii.base_spans("9" * 200_000) == [] and pii.base_spans("@" * 100_000) == []


def test_base_spans_that_start_together_are_ordered_by_kind(spark):
    texts = ["10.0.0.1@host.com", "4111111111111111@x.com", "see 10.0.0.1@host.com"]
    assert [pii.base_spans(t) for t in texts] == [[(0, 17, 0), (0, 8, 1)], [(0, 22, 0), (0, 16, 2)], [(4, 21, 0), (4, 12, 1)]]
    rows = pii.find_pii(_docs(spark, texts), patterns=["in none:"]).orderBy("doc_id").collect()
    assert [[s["kind"] for s in r["spans"]] for r in rows] == [["email", "ip"], ["email", "card"], ["email", "ip"]]
    assert [r["text"] for r in pii.redact(_docs(spark, texts), patterns=[]).orderBy("doc_id").collect()] == ["<EMAIL>", "<EMAIL>", "see <EMAIL>"]


def test_patterns_are_learnt(spark):
    texts = [f"Hello there my staff id: {i * 7919 % 99991 + 100000}@x.com ok, the year 20{i:02d}5 went" for i in range(30)]
    df = _docs(spark, [*texts, "My staff id: QX-77812-B ok then", "In the year 20245 it rained", None, ""]).withColumn("spans", F.lit(1))
    rows = {r["doc_id"]: r for r in pii.find_pii(df).collect()}
    assert [(s["kind"], s["start"], s["end"]) for s in rows[30]["spans"]] == [("id", 13, 23)] and rows[30]["base"] == []
    assert rows[31]["spans"] == [] and rows[32]["spans"] == [] and rows[33]["spans"] == [] and len(rows[0]["base"]) == 1
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df.drop("spans")).collect()}
    assert clean[30] == "My staff id: <ID> ok then" and clean[32] is None and clean[0].startswith("Hello there my staff id: <EMAIL> ok")
    assert pii.find_pii(df.limit(0)).count() == 0


def test_found_identifiers_induce_patterns_and_none_is_cut_by_rank(spark):
    # "staff id:" has mail seeds and QX codes behind it, "badge=" only QX codes; the pair "in the" has most seeds but isn't reliable
    texts = [f"Hello my staff id: u{i}@x.com ok" for i in range(30)] + [f"My staff id: QX-{i}77-B ok" for i in range(5)] + [f"entry badge=QX-{i}77-B" for i in range(5)]
    texts += [f"lives in the m{i}@x.com or in the big town near in the old mill and in the wood" for i in range(60)]
    df = _docs(spark, [*texts, "entry badge=ZZ-90909 ok"])
    known = pii.learn_patterns(df)
    names = [r["pattern"] for r in known.collect()]
    assert {"label id:", "in badge="} <= set(names) and "words in the" not in names
    assert sorted(p for part in pii._pieces(known, 1) for p in part) == sorted(names) and list(pii._pieces(known, 10_000)) == [sorted(names)]
    assert all(len(part) == 1 for part in pii._pieces(known, 1))
    one = {r["doc_id"]: r["spans"] for r in pii.find_pii(df, patterns=known, max_patterns=1).collect()}
    assert one == {r["doc_id"]: r["spans"] for r in pii.find_pii(df).collect()} and [s["kind"] for s in one[len(texts)]] == ["id"]
    assert pii.redact(df, patterns=known, max_patterns=1).filter(F.col("doc_id") == len(texts)).first()["text"] == "entry badge=<ID> ok"


def test_followers_counts_all_tokens_behind_patterns():
    import pyarrow as pa

    texts = ["Staff id: 7 id: 8 xy=1 XY=2", "id: id:", None, ""]
    marks = np.full(1 << (pii.MARK_BITS - 3), 255, np.uint8)
    out = Counter()
    for b in pii._followers(marks)([pa.RecordBatch.from_pydict({"text": texts})]):
        out.update(dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist())))
    assert out["label id:"] == 4 and out["in xy="] == 2 and out["words staff id:"] == 1 and out["words id: 8"] == 1


# language model

@pytest.mark.parametrize("frequent, cached", [(20, 1 << 19), (20, 0), (2, 10), (1000, 50)])
def test_katz(spark, frequent, cached):
    rng = random.Random(8)
    texts = [*ODD, *[_prose(rng, rng.randrange(1, 200), 60) for _ in range(80)], *["always follows always follows"] * 30]
    df = _docs(spark, texts)
    rows = {r["doc_id"]: r for r in katz.score(df, frequent_words=frequent, bucket_tokens=900, cached=cached).collect()}
    tokens = {i: (t or "").encode().lower().split() + [None] for i, t in enumerate(texts)}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    uni = Counter(w for i in train for w in tokens[i])
    after = defaultdict(Counter)
    for i in train:
        for h, w in zip(["start", *tokens[i]], tokens[i]):
            after[h][w] += 1
    n, v = sum(uni.values()), len(uni)
    d1, d2 = katz.discounts(Counter(uni.values())), katz.discounts(Counter(c for x in after.values() for c in x.values()))
    of = lambda d, c: (d[c - 1] if c <= katz.LIMIT else 1.0) * c
    p1 = {w: of(d1, c) / n for w, c in uni.items()}
    unknown = 1 - sum(p1.values())
    total, alpha, widened = {}, {}, 0
    for h, x in after.items():
        kept, c = sum(of(d2, c) for c in x.values()), sum(x.values())
        total[h] = c if c - kept > 1e-9 * c else c + 1
        widened += total[h] > c
        alpha[h] = (1 - kept / total[h]) / (1 - sum(p1[w] for w in x))
        assert kept / total[h] + alpha[h] * (unknown + sum(p for w, p in p1.items() if w not in x)) == pytest.approx(1)
    assert 0 < widened < len(after) / 2
    for i, t in tokens.items():
        want = base = 0.0
        for h, w in zip(["start", *t], t):
            c = after[h][w] if h in after else 0
            want += math.log10(of(d2, c) / total[h] if c else alpha.get(h, 1.0) * p1.get(w, unknown))
            base += math.log10((uni[w] + 1) / (n + v + 1))
        r = rows[i]
        assert r["score"] == pytest.approx(want) and r["base_score"] == pytest.approx(base)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(t), sum(w in uni for w in t), n, i not in train)


def test_katz_of_odd_tables(spark):
    df = _docs(spark, ["a b c", None, "a b"]).withColumn("h", F.lit(1)).withColumn("bucket", F.lit("x"))
    assert katz.score(df.limit(0)).count() == 0
    other = spark.createDataFrame([(0, "other text here", "a"), (None, "a b c", "a"), (None, None, "a")], DOC).withColumn("h", F.lit(1)).withColumn("bucket", F.lit("x"))
    rows = katz.score(df.union(df).union(other)).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in rows) == {(0, 4): 3, (1, 1): 2, (2, 3): 2, (None, 4): 1, (None, 1): 1}
    assert len({round(r["score"], 9) for r in rows if r["doc_id"] == 2}) == 1


def test_requests_carry_the_ids_of_their_own_documents(spark):
    rng = random.Random(3)
    df = _docs(spark, [_prose(rng, 60, 5000) for _ in range(300)])

    def sent(bucket_tokens):
        model = katz.train(df, frequent_words=50, bucket_tokens=bucket_tokens, cached=0)
        rows = df.select("doc_id", F.xxhash64("doc_id").alias("doc"), "text").mapInArrow(katz._send(model), katz.SENT).filter("kind = 1").select("n", "data").collect()
        return [(r["n"], int(np.frombuffer(r["data"], np.uint32, 1)[0])) for r in rows]

    for parts in (sent(6000), sent(300)):
        assert all(docs <= n for n, docs in parts)


def test_a_bucket_answers_in_little_memory():
    rng = np.random.default_rng(4)
    n = 400_000
    h, w = rng.integers(0, 5000, n).astype(np.uint64), rng.integers(0, 50_000, n).astype(np.uint64) | katz.RARE
    order = np.lexsort((w, h))
    h, w = h[order], w[order]
    first = katz._starts(h, w)
    h, w = h[first], w[first]
    counts = rng.integers(1, 9, len(h)).astype(np.uint64)
    data = katz._pack_pairs(h, w, counts)
    tracemalloc.start()
    table = katz._Bucket(data, len(h), np.zeros(1, np.int64))
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.reset_peak()
    got_n, got_w = table.pair_n(h[:100], w[:100]), table.word_n(w[:100])
    more = tracemalloc.get_traced_memory()[1] - kept
    tracemalloc.stop()
    assert kept < 30 * len(h) and more < 1 << 20  # a request costs nothing that grows with the bucket
    assert got_n.tolist() == counts[:100].tolist() and got_w.tolist() == [int(counts[w == x].sum()) for x in w[:100]]
    want = dict(zip(zip(h.tolist(), w.tolist()), counts.tolist()))
    ask_h, ask_w = rng.integers(0, 5100, 20_000).astype(np.uint64), rng.integers(0, 50_000, 20_000).astype(np.uint64) | katz.RARE
    ask_h[:9000], ask_w[:9000] = h[::44][:9000], w[::44][:9000]
    assert table.pair_n(ask_h, ask_w).tolist() == [want.get(x, 0) for x in zip(ask_h.tolist(), ask_w.tolist())]
    assert katz._Bucket(katz._pack_pairs(*[np.zeros(0, np.uint64)] * 3), 0, np.zeros(1, np.int64)).pair_n(ask_h, ask_w).sum() == 0


def test_requests_come_to_one_bucket_in_small_batches(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(katz, "BATCH_BYTES", 4000, raising=False)
    monkeypatch.setattr(katz, "FLUSH_TOKENS", 300)
    answer = katz._answer

    def noting(model):
        def noted(batches):
            seen = []

            def each():
                for batch in batches:
                    rows = [len(x or b"") for x in batch.column("data").to_pylist()]
                    seen.append((sum(rows), max(rows), *set(batch.column("bucket").to_pylist())))
                    yield batch

            yield from run(each())
            (tmp_path / uuid.uuid4().hex).write_text(repr(seen))

        run = answer(model)
        return noted

    monkeypatch.setattr(katz, "_answer", noting)
    rng = random.Random(5)
    df = _docs(spark, [_prose(rng, 60, 300) for _ in range(120)])
    assert katz.score(df, frequent_words=20, bucket_tokens=1000, cached=0).count() == 120
    tasks = [ast.literal_eval(f.read_text()) for f in tmp_path.iterdir()]
    assert max(len({b for x in task for b in x[2:]}) for task in tasks) == 1
    batches = [x for task in tasks for x in task]
    assert len(batches) > 3 * len(tasks)
    assert all(size <= 4000 + most for size, most, *_ in batches)  # the row that fills a batch may be long


def test_a_worker_gives_arrow_memory_back_and_takes_small_pieces(monkeypatch):
    class Pool:
        released = 0

        def release_unused(self):
            Pool.released += 1

    monkeypatch.setattr(common.pa, "default_memory_pool", Pool)
    batch = pa.RecordBatch.from_pydict({"text": ["a b"] * 1000})
    same = lambda batches: iter(batches)
    pieces = list(common.lean(same, common.PIECE_ROWS)([batch, batch.slice(0, 0), batch]))
    assert max(b.num_rows for b in pieces) == common.PIECE_ROWS and sum(b.num_rows for b in pieces) == 2000 and Pool.released == 1
    assert [b.num_rows for b in common.lean(same)([batch])] == [1000] and Pool.released == 2


def test_redaction_runs_in_small_pieces(spark):
    df = spark.range(1000).coalesce(1).select(F.concat(F.lit("mail a@b.org "), "id").alias("text"))
    made = None

    class Frame:
        schema, columns = df.schema, df.columns

        def mapInArrow(self, run, schema):
            nonlocal made
            made = run

    found = Frame()
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(pii, "_passes", lambda documents, *a: (found, [], "found"))
        pii.redact(found, patterns=[])
    rows = df.toPandas()["text"].tolist()
    out = list(made([pa.RecordBatch.from_pydict({"text": rows, "found": pa.nulls(1000, pa.list_(pa.int32()))})]))
    sizes = [b.num_rows for b in out]
    assert max(sizes) == common.PIECE_ROWS and [t for b in out for t in b.column("text").to_pylist()] == [f"mail <EMAIL> {i}" for i in range(1000)]


def test_the_plan_of_a_mix_needs_no_python_workers(spark):
    for rows in ([("a", 0, 3), ("b", 1, None)], []):
        made = mixing._frame(spark, rows, "s string, k long, n long")
        assert [tuple(r) for r in made.collect()] == rows and made.schema.simpleString() == "struct<s:string,k:bigint,n:bigint>"
        assert "ExistingRDD" not in made._jdf.queryExecution().toString()


def test_shuffle_files_go_with_the_table_that_they_made(spark):
    def files():
        return sum("shuffle_" in f for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(",").split(","))

    gc.collect()
    spark._jvm.System.gc()
    time.sleep(1)
    before, kept = files(), spark.conf.get(common.CLEANUP, None)
    table = common.stored(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).agg(F.count("*").alias("n")).repartition(3, "n"), "test")
    assert files() <= before and spark.conf.get(common.CLEANUP, None) == kept
    assert sorted(tuple(r) for r in table.collect()) == [(k, 100) for k in range(10)]


def test_a_scoring_leaves_only_tables_that_are_read(spark):
    rng, folder = random.Random(5), Path(common.shared_dir(spark).replace("file://", ""))
    before = set(folder.iterdir())
    scores = katz.score(_docs(spark, [_prose(rng, 20, 300) for _ in range(40)]))
    assert {p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before} == {"katz-sums", "katz-histories"}
    assert scores.count() == 40


def test_an_idle_encoder_is_small(spark):
    import public_tokenizers

    plain = bpe._encoder(bpe.default_ranks_path(), public_tokenizers.PATTERN)
    texts = [" ".join(f"word{i}x" for i in range(k, k + 2000)) for k in range(0, 2 * bpe.KEPT, 2000)] + ["", "the word1x the"]
    ids = plain.encode(texts)
    plain.settle()
    assert len(plain.known) + len(plain.older) <= bpe.KEPT
    assert plain.encode(texts[::-1]) == ids[::-1]
    df = _docs(spark, ["a b", None, "", "caf\u00e9 \U0001f600"]).withColumn("decoded", F.lit(1))
    once = bpe.encode(df, decoding=True)
    assert once._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(once.collect()) == sorted(bpe.decode(bpe.encode(df)).select(*once.columns).collect())


# nearest neighbours

def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16)).astype("f4")
    x[100:400] = x[7]  # a third of a shard are copies
    rows = [(i, [float(v) for v in x[i]]) for i in range(3000)] + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [None] * 16), (5004, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1))
    got = defaultdict(list)
    for r in sorted(ann.nearest(df, df.filter("vec_id % 20 = 0"), shards=3).collect(), key=lambda r: r["rank"]):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    exact, hits = x.astype("f8") @ x.astype("f8").T, 0
    for q in range(0, 3000, 20):
        order = [i for i in np.lexsort((np.arange(3000), -exact[q])) if i != q][:20]
        hits += len(set(order) & {i for i, _ in got[q]})
        assert len(got[q]) == 20 and [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True)
        assert all(s == pytest.approx(exact[q][i]) for i, s in got[q])
    assert hits >= 0.95 * 20 * 150 and set(got) == set(range(0, 3000, 20))
    assert [i for i, _ in got[100]] == [7, *range(101, 120)]
    assert ann.nearest(df.limit(0), df).count() == 0


def test_nearest_with_repeated_rows_and_ties(spark):
    # 199 distinct vectors that all have the inner product 1 with the query, in three dimensions
    rows = [(i, [1.0, i / 10, 1.0 - i / 10]) for i in range(1, 200)] + [(0, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in ann.nearest(df, df.filter("vec_id = 0"), beam=120, shards=2).orderBy("rank").collect()]
    assert got == [(i, 1.0) for i in range(1, 21)]
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 8))
    rows = [(i, [float(v) for v in x[i]]) for i in range(300)]
    once, twice = (spark.createDataFrame(r, "vec_id long, embedding array<double>") for r in (rows, rows + rows))
    ask = lambda df: sorted(map(tuple, ann.nearest(df, df.filter("vec_id % 50 = 0"), shards=2).collect()))
    assert ask(once) == ask(twice)
    several = spark.createDataFrame([*rows, (0, rows[7][1]), (250, rows[9][1])], "vec_id long, embedding array<double>")
    per = defaultdict(list)
    for r in ann.nearest(several, several.filter("vec_id = 0"), shards=2).orderBy("rank").collect():
        per[r["query_id"]].append((r["vec_id"], r["score"]))
    mine = {}
    for v in (x[0], x[7]):
        for i, row in [*rows[1:], (250, rows[9][1])]:
            mine[i] = max(mine.get(i, -1e9), float(np.dot(v, row)))
    want = sorted(((-s, i) for i, s in mine.items()))[:20]
    assert [i for i, _ in per[0]] == [i for _, i in want] and len(per) == 1


@pytest.mark.parametrize("rows, mb", [(1500, 128), (6000, 1)])
def test_recall_holds_as_shards_are_added(spark, rows, mb):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(rows, 24)) * rng.uniform(0.5, 1.5, size=(rows, 1))
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(rows)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in ann.nearest(df, df.filter("vec_id % 100 = 0"), shards=2, shard_mb=mb).collect():
        got[r["query_id"]].add(r["vec_id"])
    exact, hits = x @ x.T, 0
    for q in range(0, rows, 100):
        order = [i for i in np.argsort(-exact[q]) if i != q][:20]
        hits += len(got[q] & set(order))
    assert hits >= 0.9 * 20 * len(got) and len(got) == rows // 100


def _mean_recall(got, x, queries):
    """Against numpy at the precision of long doubles."""
    x = x.astype(np.longdouble)
    hits = 0
    for q in queries:
        exact = x @ x[q]
        hits += len(got[q] & set([i for i in np.lexsort((np.arange(len(x)), -exact)) if i != q][:20]))
    return hits / (20 * len(queries))


@pytest.mark.parametrize("large", [1e3, 1e4, 1e8, 1e20, 1e155])
def test_a_few_large_vectors_neither_crash_nor_hide_the_others(spark, large):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1200, 16))
    x[[3, 700]] *= large
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(len(x))], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in ann.nearest(df, df.filter("vec_id % 40 = 0"), shards=2).collect():
        got[r["query_id"]].add(r["vec_id"])
    assert _mean_recall(got, x, range(0, len(x), 40)) >= 0.95


@pytest.mark.parametrize("scale", [1e-200, 1e20, 1e155])
def test_vectors_of_any_finite_size(spark, scale):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 12)) * scale
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(len(x))], "vec_id long, embedding array<double>")
    rows = ann.nearest(df, df.filter("vec_id % 50 = 0"), shards=2).collect()
    assert len(rows) == 200 and not any(math.isnan(r["score"]) for r in rows)
    if scale == 1e20:
        got = defaultdict(set)
        for r in rows:
            got[r["query_id"]].add(r["vec_id"])
            assert r["score"] == pytest.approx(float(x[r["query_id"]] @ x[r["vec_id"]]))
        assert _mean_recall(got, x, range(0, 500, 50)) >= 0.95


def test_products_beyond_doubles_have_their_sign():
    assert ann._products(np.array([[1e200, 1e200], [1e200, -1e201], [3.0, 4.0]]), np.array([1e200, 1e200])).tolist() == [np.inf, -np.inf, 7e200]


# licences

@pytest.fixture(scope="module")
def licence_model(spark):
    rng = random.Random(9)
    return licenses.train(spark, _docs(spark, [_prose(rng, 80) for _ in range(60)] + ["Public transport is free of charge, to any person at the station.\nThe software was use of the source of the work.\n\n", None, ""]))


def _judged(model, line, agreement=0.5):
    """scan() of one line, plainly."""
    w = licenses.plain_words(line)
    if not set(w) & set(model["cues"]):
        return None
    p, label = licenses.probability(model, w)
    if label == licenses.NONE:
        return None
    confirmed = False
    if label != licenses.UNKNOWN:
        pairs = {f"{a} {b}" for a, b in zip(w, w[1:])}
        named = any(f" {' '.join(licenses.plain_words(n))} " in f" {' '.join(w)} " for n in licenses.FAMILIES[label])
        confirmed = named or bool(pairs) and len(pairs & set(licenses.template_pairs()[label])) >= agreement * len(pairs)
    return label if confirmed and p >= model["sure"] else licenses.UNKNOWN, round(p, 9), confirmed


def test_licences_equal_a_plain_scan(spark, licence_model):
    rng = random.Random(10)
    words = sorted({w for _, _, s in licenses.positives() for w in s.split()}) + [f"w{i}" for i in range(30)]
    said = [s for _, _, s in licenses.positives()]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 25))) for _ in range(300)] + [rng.choice(said) + " " + _prose(rng, 5) for _ in range(200)] + said[::7]
    texts = ["\n".join(lines[i : i + 5]) for i in range(0, len(lines), 5)] + ODD + [" \n\n a\n \t\nb"]
    df = _docs(spark, texts).withColumns({"licences": F.lit(0), "n_paragraphs": F.lit("x"), "h": F.lit(1)})
    for r in licenses.scan(df, licence_model).collect():
        text = texts[r["doc_id"]] or ""
        want = [(i, *x) for i, line in enumerate(text.split("\n")) if (x := _judged(licence_model, line))]
        assert [(x["paragraph"], x["family"], round(x["probability"], 9), x["confirmed"]) for x in r["licences"]] == want
        assert r["n_paragraphs"] == sum(1 for x in text.split("\n") if WORD.search(x)) and r["h"] == 1
    assert licenses.scan(df.limit(0), licence_model).count() == 0
    bare = licenses.train(spark, df.limit(0), iterations=5)
    assert licenses.scan(df, bare).count() == len(texts)


def test_licences_are_found_without_any_cue_word(spark, licence_model):
    labels = ["mit", "gpl", licenses.UNKNOWN, licenses.NONE]
    weights = {"permission": [0.6, 0.1, 0.0, 0.0], "is hereby granted": [0.9, 0.0, 0.5, 0.1], "to": [0.0, 0.0, 0.0, 0.4], "hereby": [0.1, 0.0, 0.3, 0.0], "free copyleft": [-0.5, 2.0, 0.0, -0.1]}
    model = {"labels": labels, "bias": [0.0, -0.2, 0.1, 1.0], "weights": weights, "temperature": 1.0, "sure": 0.0, "cues": ["license"]}
    texts = ["a\nPermission is hereby granted.\nto permission is hereby granted", "permission hereby\nhereby granted", "(free, copyleft)", "free permission", None, ""]
    got = {r["doc_id"]: [x["paragraph"] for x in r["licences"]] for r in licenses.scan(_docs(spark, texts), model).collect()}
    assert got == {0: [1, 2], 1: [], 2: [0], 3: [], 4: [], 5: []}
    words = sorted({w for _, _, s in licenses.positives() for w in s.split()} - {"license", "licence", "under"})
    rng = random.Random(11)
    lines = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(400)]
    for model in (licence_model, {**licence_model, "bias": [*licence_model["bias"][:-1], min(licence_model["bias"]) - 1.0]}):  # "none" may be unlikely
        for r in licenses.scan(_docs(spark, lines + [" ", "zzz"]), model).collect():
            line = (lines + [" ", "zzz"])[r["doc_id"]]
            p, label = licenses.probability(model, licenses.plain_words(line))
            assert [round(x["probability"], 9) for x in r["licences"]] == ([round(p, 9)] if label != licenses.NONE and line.strip() else [])


def test_licences_of_texts_and_statements(spark, licence_model):
    rng = random.Random(9)
    said = {
        "Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache", "This work is licensed under the GNU General Public License, version 3.": "gpl", "Licensed under CC BY-NC 4.0.": "cc-by-nc",
        "Use of this source code is governed by the BSD 3-Clause License": "bsd", "distributed under the terms of the GNU Lesser General Public License": "lgpl",
        # bodies that don't name their licence, as wrapped lines
        "Permission is hereby granted, free of charge, to any person obtaining a copy": "mit", "Redistribution and use in source and binary forms, with or without": "bsd",
        "Unless required by applicable law or agreed to in writing, software distributed": "apache", "Redistributions in binary form must reproduce the above copyright notice, this": "bsd",
    }
    ordinary = [_prose(rng, 80) for _ in range(40)]
    rows = licenses.scan(_docs(spark, [f"{_prose(rng, 30)}\n{s}" for s in said] + ordinary), licence_model).orderBy("doc_id").collect()
    assert [[x["family"] for x in r["licences"]] for r in rows[: len(said)]] == [[f] for f in said.values()]
    assert all(r["licences"][0]["paragraph"] == 3 for r in rows[: len(said)]) and all(r["licences"] == [] for r in rows[len(said) :])


def test_licences_of_unseen_families_are_unknown(spark, licence_model):
    names = [*licenses.UNSEEN, "q public license", "sleepycat license"]  # the last two calibrate nothing either
    texts = [s.format(n) for n in names for s in licenses.STATEMENTS]
    found = [x["family"] for r in licenses.scan(_docs(spark, texts), licence_model).collect() for x in r["licences"]]
    assert sum(f in licenses.FAMILIES for f in found) <= 0.05 * len(texts) and sum(f == "unknown" for f in found) >= 0.5 * len(texts)
    held = [(label, s) for label, out, s in licenses.positives() if out and label in licenses.FAMILIES]
    rows = licenses.scan(_docs(spark, [s for _, s in held]), licence_model).orderBy("doc_id").collect()
    got = [r["licences"][0]["family"] if r["licences"] else None for r in rows]
    right, wrong = sum(g == f for g, (f, _) in zip(got, held)), sum(g in licenses.FAMILIES and g != f for g, (f, _) in zip(got, held))
    print(f"licences held out: recall {right / len(held):.3f}, precision {right / (right + wrong):.3f}")
    assert right >= 0.85 * len(held) and right >= 0.95 * (right + wrong)


# language identification

def test_language(spark):
    rng = random.Random(10)
    words = {"en": ["the", "and", "with", "house", "river"], "fr": ["le", "et", "avec", "maison", "fleuve"], "de": ["der", "und", "mit", "haus", "fluss"]}
    docs = spark.createDataFrame([(x, " ".join(rng.choices(words[x], k=40))) for x in words for _ in range(20)] + [("en", None), (None, "the")], "lang string, text string")
    page = lambda x, lang=None: f'<html{f" lang={chr(34)}{lang}{chr(34)}" if lang else ""}><body><script>der und</script><p>{" ".join(rng.choices(words[x], k=30))}</p></body></html>'
    rows = [(i, f"http://h{i % 3}.example.org/p{i}", page(x, x)) for i, x in enumerate(["en", "fr", "de"] * 10)]
    rows += [(100, "http://h0.example.org/en/x", page("fr", "en")), (101, "http://h1.example.org/", ""), (102, None, None), (103, "http://a.example.de/", "<html><p>12</p></html>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("lang", F.lit("zz"))
    got = {r["page_id"]: r for r in langid.identify(df, docs).collect()}
    assert [got[i]["lang"] for i in range(30)] == ["en", "fr", "de"] * 10 and len(got) == 34
    assert got[100]["text_lang"] == "fr" and got[101]["lang"] == "fr" and got[103]["lang"] == "de" and got[102]["host"] == ""
    assert all(0 < r["probability"] <= 1 for r in got.values())
    assert langid.identify(df.limit(0), docs).count() == 0 and langid.identify(df, docs.limit(0)).filter("lang IS NULL").count() == 34


def _fused(pages, labels, model, strength=5.0):
    """identify() page by page, plainly."""
    def of(url):
        m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", url or "")
        host = m[1].lower() if m else ""
        parts = host.split(".")
        below = 3 if len(parts) > 1 and len(parts[-1]) == 2 and parts[-2] in langid.SECOND else 2
        seg = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([A-Za-z]{2})(?:[/?#-]|$)", url or "")
        suffix = seg[1].lower() if seg and seg[1].lower() in labels else langid.COUNTRIES.get(parts[-1])
        return host, ".".join(parts[-below:]), parts[-1], suffix

    facts = []
    for _, url, html in pages:
        found = langid.trigram_bins(langid.visible_text(html or ""), langid.BINS)
        z = 0.05 * model[:, found].sum(axis=1) if len(found) else np.zeros(len(labels))
        z = z - z.max()
        z -= np.log(np.exp(z).sum())
        m = re.search(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", html or "", re.I)
        facts.append((*of(url), m[1].lower() if m else None, z))
    out = []
    for i, (host, domain, tld, suffix, declared, z) in enumerate(facts):
        others = [f for k, f in enumerate(facts) if k != i]
        count = lambda keep: (sum((np.exp(f[5]) for f in others if keep(f)), np.zeros(len(labels))), sum(1 for f in others if keep(f)))
        c, n = count(lambda f: True)
        prior = (c + 1) / (n + len(labels))
        for keep in (lambda f: f[2] == tld, lambda f: f[1:3] == (domain, tld), lambda f: f[0] == host):
            c, n = count(keep)
            prior = (c + strength * prior) / (n + strength)
        says = lambda said, right: np.array([0.0 if said not in labels else np.log(right) if x == said else np.log((1 - right) / (len(labels) - 1)) for x in labels])
        total = z + says(declared, 0.85) + says(suffix, 0.8) + np.log(prior)
        p = np.exp(total - total.max())
        out.append((labels[int(np.argmax(total))], 1 / p.sum()))
    return out


def test_language_equals_a_plain_fusion(spark):
    rng = random.Random(14)
    words = {"en": ["the", "and", "with", "house"], "fr": ["le", "et", "avec", "maison"], "de": ["der", "und", "mit", "haus"]}
    docs = spark.createDataFrame([(x, " ".join(rng.choices(words[x], k=40))) for x in words for _ in range(10)], "lang string, text string")
    page = lambda x: f"<html{rng.choice(['', ' lang=fr', ' lang=zz', ' LANG=en-GB'])}><p>{' '.join(rng.choices(words[x], k=rng.randrange(0, 6)))}<script>und</script></p>"
    urls = ["https://a.b.co.uk/x", "https://b.co.uk:80/", "http://c.example.de/fr/y", "http://d.example.de/", "http://u@e.example.com/de", None, "", "nonsense"]
    rows = [(i, rng.choice(urls), rng.choice([page("en"), page("fr"), page("de"), None, ""])) for i in range(60)]
    rows += rows[:3]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("host", "prior", "own", "text_scores", "z", "best")})
    labels, model = langid.train(docs)
    want = Counter((r[0], lang, round(p, 6)) for r, (lang, p) in zip(rows, _fused(rows, labels, model)))
    assert Counter((r["page_id"], r["lang"], round(r["probability"], 6)) for r in langid.identify(df, docs).collect()) == want
    with pytest.raises(ValueError):
        langid.train(docs, max_languages=2)


def test_declared_language_is_one_pass():
    import time

    said = langid.declared_language
    assert said('<!doctype html><HTML class="a" lang="DE-at"><p>') == "de" and said("<html lang = fr") == "fr"
    assert said("<html><p lang=es>") is None and said("<html x><html lang=it>") == "it" and said("") is None
    began = time.monotonic()
    for opener in ("<html", "<html ", "<html lang ", "<html x>", "<html lang="):
        assert said(opener * (1_000_000 // len(opener))) in (None, "htm")
    assert time.monotonic() - began < 5


def test_visible_text_is_one_pass():
    import time

    see = langid.visible_text
    assert see("a<p>b</p><script>x<b></SCRIPT >c<!-- <p> d -->e &amp; f<nav>g<nav>h</nav>i") == "a b c e & f i"
    assert see("a<script>b") == "a b" and see("a<!-- b") == "a<!-- b" and see("a<!-- b > c") == "a c" and see("a < b") == "a < b" and see('x<div class="ad">y</div>z<div class=advice>w</div>') == "x z w"
    for piece in ("<script>", "<!--", "<", "<nav", "</div>", '<div class="ad">', "<!-- a -->"):
        began = time.perf_counter()
        see(piece * 40_000)
        assert time.perf_counter() - began < 2
