"""Personal data by bootstrapped contextual extraction.

Base finders for e-mail addresses, IPv4 addresses, payment cards and phone numbers give the seeds.
The words in front of a seed (a label such as "tel:", or the two words before) induce lexical
patterns. Patterns and the identifiers they stand before form a bipartite graph, which Spark scores
in rounds: a pattern is as reliable as the identifiers it finds among all tokens it precedes in the
corpus, an identifier as the patterns that find it. Identifiers of high score count as seeds in the next round
and so induce patterns of their own. Patterns that end highly reliable then mark
identifiers of unseen shapes (kind "id") in all texts.

Only tables of identifiers and patterns are shuffled; patterns are scored as tables, however many. Texts are read three times where they lie:
for seeds and sites, for the number of all tokens behind each pattern, and for the spans.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from walkspark.llm.common import PIECE_ROWS, discard, lean, stored, unused

KINDS = ["email", "ip", "card", "phone", "id"]
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++").finditer
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+").finditer
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").finditer
DIGIT = re.compile(r"[0-9]").search
#: A token with the blanks before it left out; the six ASCII white-space characters part tokens.
TOKEN = re.compile(r"[^\x20\x09-\x0D]+").finditer
#: What may open an identifier inside a token, behind a label: letters, then : or = or #.
LABELLED = re.compile(r"([^\W\d_][\w-]{1,30}[:=#]+)(.+)\Z", re.S).match
#: Patterns that may count are looked up in 2 ** MARK_BITS bits, and HELD counts are held in a worker at once.
MARK_BITS = 26
HELD = 200_000
#: Patterns that go to the workers in one pass over the texts.
MAX_PATTERNS = 10_000
EDGES = "\"'`()[]{}<>.,;:!?"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base finders, ordered by start, then kind; ends exclusive, in code points."""
    found = []
    at, end = text.find("@"), 0
    while at >= 0:
        # the longest run of local characters up to the @ is where a leftmost match would start
        lo = at
        while lo > end and (text[lo - 1].isascii() and (text[lo - 1].isalnum() or text[lo - 1] in "._%+-")):
            lo -= 1
        if lo < at and (m := DOMAIN(text, at + 1)):
            found.append((lo, m.end(), 0))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    if DIGIT(text):
        for m in IP(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((m.start(), m.end(), 1))
        for m in CARD(text):
            if 12 <= len(digits := _digits(m[0])) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), 2))
        for m in PHONE(text):
            if 9 <= len(_digits(m[0])) <= 15:
                found.append((m.start(), m.end(), 3))
    return sorted(found, key=_order)


def _order(span: tuple[int, int, int]) -> tuple[int, int, int]:
    start, end, kind = span
    return start, kind, end


def sites(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, str | None, list[str]]]:
    """(start, end, seed's kind or None, patterns) of each seed and each other token with a digit of five characters or more."""
    if not spans and not DIGIT(text):
        return
    before, k = ["", ""], 0
    for m in TOKEN(text):
        start, end, token = m.start(), m.end(), m[0]
        while k < len(spans) and spans[k][1] <= start:
            k += 1
        seed = spans[k] if k < len(spans) and spans[k][0] < end else None
        if seed is not None and seed[0] >= start:
            yield seed[0], seed[1], KINDS[seed[2]], _patterns(before, token[: seed[0] - start])
        elif seed is None and end - start >= 5 and DIGIT(token):
            lo, hi, label = _core(token)
            if hi - lo >= 5 and DIGIT(token[lo:hi]):
                yield start + lo, start + hi, None, _patterns(before, label)
        before = [before[1], token]


def _core(token: str) -> tuple[int, int, str]:
    """Where the identifier in a token starts and ends, and the label inside the token before it."""
    lo, label = 0, ""
    if m := LABELLED(token):
        lo, label = m.start(2), m[1]
    hi = len(token)
    while lo < hi and token[lo] in EDGES:
        lo += 1
    while hi > lo and token[hi - 1] in EDGES:
        hi -= 1
    return lo, hi, label


def _patterns(before: list[str], label: str) -> list[str]:
    """A label inside the token ("id="), a label before it ("tel:"), the two words before it; lower case."""
    label = label.strip("\"'`([{<").lower()
    out = []
    if label[-1:] in (":", "=", "#") and len(label) > 1:
        out.append(f"in {label}")
    elif before[1][-1:] in (":", "=", "#") and len(before[1]) > 1:
        out.append(f"label {before[1].lower()}")
    if before[0] and not label:
        out.append(f"words {before[0].lower()} {before[1].lower()}")
    return out


def _each(run, *names):
    """An Arrow function over batches from one that yields rows (tuples) for a text."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row for text in batch.column(0).to_pylist() if text for row in run(text)]
            yield pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(names)}, schema=pa.schema([(n, pa.string() if n != "seed" else pa.bool_()) for n in names]))

    return apply


def learn_patterns(documents: DataFrame, text: str = "text", rounds: int = 3, support: int = 3, confidence: float = 0.8) -> DataFrame:
    """A written table (pattern) of reliable patterns: at least `confidence` after the last round, found before `support` or more distinct trusted identifiers.

    Trusted are the seeds and, from the second round on, identifiers with a score of `confidence` or more, so
    what a pattern finds induces further patterns. All patterns that stand before `support` or more distinct
    identifiers are scored; nothing is left out by rank. Works on all rows; empty tables and tables without
    seeds give no patterns.
    """
    slim = documents.select(text)

    def occurrences(t):
        spans = base_spans(t)
        for start, end, kind, patterns in sites(t, spans):
            for p in patterns:
                yield p, t[start:end], kind is not None

    seen = slim.mapInArrow(lean(_each(occurrences, "pattern", "instance", "seed"), PIECE_ROWS), "pattern string, instance string, seed boolean")
    graph = stored(seen.groupBy("pattern", "instance").agg(F.count("*").alias("n"), F.max("seed").alias("seed")), "pii-graph")
    # a pattern before fewer identifiers can't reach the support in any round
    able = stored(graph.groupBy("pattern").agg(F.count("*").alias("instances")).filter(F.col("instances") >= support).select("pattern"), "pii-able")
    totals = slim.mapInArrow(lean(_followers(_marks(able)), PIECE_ROWS), "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("total"))
    totals = stored(totals.join(able, "pattern", "left_semi"), "pii-totals")
    edges = stored(graph.join(able, "pattern", "left_semi"), "pii-edges")
    scores = edges.groupBy("instance").agg(F.max(F.when(F.col("seed"), 1.0).otherwise(0.0)).alias("score"))
    patterns = documents.sparkSession.createDataFrame([], "pattern string, reliable double")
    for k in range(rounds):
        sums = edges.join(scores, "instance").groupBy("pattern").agg(F.sum(F.col("score") * F.col("n")).alias("found"), F.count(F.when(F.col("seed") | (F.col("score") >= confidence), 1)).alias("trusted"))
        patterns = stored(sums.filter(F.col("trusted") >= support).join(totals, "pattern").select("pattern", (F.col("found") / F.col("total")).alias("reliable")), "pii-patterns")
        if k + 1 < rounds:
            miss = F.when(F.max("seed"), F.lit(0.0)).otherwise(F.exp(F.sum(F.log(F.greatest(1.0 - F.coalesce("reliable", F.lit(0.0)), F.lit(1e-9))))))
            scores = stored(edges.join(patterns, "pattern", "left").groupBy("instance").agg((1.0 - miss).alias("score")), "pii-scores")
    return patterns.filter(F.col("reliable") >= confidence).select("pattern")


def _marks(patterns: DataFrame) -> np.ndarray:
    """A table of 2 ** MARK_BITS bits in which each pattern's bit is set: the same size for any number of patterns."""
    at = F.crc32(F.col("pattern").cast("binary")) % (1 << MARK_BITS)
    bits = patterns.select(F.shiftright(at, 3).cast("int").alias("byte"), F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), (at % 8 + 1).cast("int")).alias("bit"))
    found = bits.groupBy("byte").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(1 << (MARK_BITS - 3), np.uint8)
    out[found["byte"].to_numpy()] = found["bits"].to_numpy().astype(np.uint8)
    return out


def _followers(marks: np.ndarray):
    """Counts of all tokens of the texts that stand where a pattern would find an identifier, for every pattern whose
    bit in `marks` is set (so for a few others too)."""
    marks = marks.tobytes()
    mask = (1 << MARK_BITS) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: Counter = Counter()
        inner: Counter = Counter()
        counts: Counter = Counter()

        def marked(p, n):
            at = zlib.crc32(p.encode()) & mask
            if marks[at >> 3] >> (at & 7) & 1:
                counts[p] += n

        def settle():
            for (a, b), n in pairs.items():
                if a:
                    marked(f"words {a} {b}", n)
                if b[-1] in ":=#":
                    marked(f"label {b}", n)
            for label, n in inner.items():
                marked(f"in {label}", n)
            pairs.clear()
            inner.clear()

        def rows():
            out = pa.RecordBatch.from_pydict({"pattern": list(counts), "n": list(counts.values())}, schema=pa.schema([("pattern", pa.string()), ("n", pa.int64())]))
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = [m[0] for m in TOKEN(text)] if text else []
                low = [w.lower() for w in words]
                pairs.update(zip(["", *low], low))
                for w in words:
                    if (":" in w or "=" in w or "#" in w) and (m := LABELLED(w)):
                        inner[m[1].lower()] += 1
                if len(pairs) > HELD or len(inner) > HELD:
                    settle()
                    if len(counts) > HELD:
                        yield rows()
        settle()
        yield rows()

    return run


def all_spans(text: str, patterns: set[str], earlier: list | None = None) -> tuple[list, list]:
    """(base spans, base spans and those that reliable patterns find). earlier: starts and ends that other patterns found."""
    base = base_spans(text)
    more = {(lo, hi, 4) for lo, hi in zip(earlier[::2], earlier[1::2])} if earlier else set()
    if patterns:
        more |= {(lo, hi, 4) for lo, hi, kind, found in sites(text, base) if kind is None and not patterns.isdisjoint(found)}
    return base, sorted([*base, *more], key=_order)


def _pieces(patterns: DataFrame | list[str], max_patterns: int) -> Iterator[list[str]]:
    """The patterns in lists of at most max_patterns. Of a table the driver reads one hash class at a time, half a list on average."""
    if isinstance(patterns, DataFrame):
        classes = -(-patterns.count() // max_patterns)
        if classes > 1:
            classes *= 2
            patterns = stored(patterns.withColumn("class", F.pmod(F.xxhash64("pattern"), F.lit(classes)).cast("int")).repartitionByRange("class"), "pii-classes")
        read = lambda k: patterns.filter(F.col("class") == k) if classes > 1 else patterns
        parts = (sorted(r["pattern"] for r in read(k).collect()) for k in range(classes))
    else:
        parts = iter([list(patterns)])
    for part in parts:
        for at in range(0, len(part), max_patterns):
            yield part[at : at + max_patterns]


def _passes(documents: DataFrame, text: str, patterns: DataFrame | list[str], max_patterns: int) -> tuple[DataFrame, list[str], str]:
    """documents with a new column, the starts and ends that all patterns but those of the last pass find, and these last ones, and the column's name.

    Each pass but the last takes at most max_patterns patterns and writes the table, so neither the driver nor a worker
    ever holds all of them.
    """
    (name,) = unused(documents, "found")
    df = documents.withColumn(name, F.lit(None).cast("array<int>"))
    schema, written, part = df.schema, None, []
    for following in _pieces(patterns, max_patterns):
        part, before = following, part
        if not before:
            continue

        def run(batches: Iterator[pa.RecordBatch], these=before) -> Iterator[pa.RecordBatch]:
            chosen = set(these)
            for batch in batches:
                found = [[x for lo, hi, k in all_spans(t, chosen, e)[1] if k == 4 for x in (lo, hi)] if t else None for t, e in zip(batch.column(text).to_pylist(), batch.column(name).to_pylist())]
                yield pa.RecordBatch.from_pydict({n: pa.array(found, pa.list_(pa.int32())) if n == name else batch.column(n) for n in batch.schema.names})

        last, written = written, stored(df.mapInArrow(lean(run, PIECE_ROWS), schema), "pii-found")
        if last is not None:
            discard(last)
        df = written
    return df, part, name


def find_pii(documents: DataFrame, text: str = "text", patterns: DataFrame | list[str] | None = None, max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """documents without their text, with `base` and `spans`: arrays of struct<kind, start, end> ordered by start, then kind.

    Positions are code points, ends exclusive. patterns: a table (pattern) from learn_patterns (default: learnt here), or a list.
    More than max_patterns take several passes over the texts.
    Null and empty texts have no spans; texts of any length are searched whole. Each row is judged alone, so repeated rows
    get equal spans; spans that start together (ties) stand by kind. Columns named base or spans are replaced, others stay.
    An empty table gives no rows.
    """
    known = learn_patterns(documents, text) if patterns is None else patterns
    df = documents.drop("base", "spans")
    fields = [f for f in df.schema.fields if f.name != text]
    df, known, name = _passes(df, text, known, max_patterns)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"{n} array<struct<kind:string,start:int,end:int>>" for n in ("base", "spans")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = set(known)
        for batch in batches:
            both = [all_spans(t, chosen, e) if t else ([], []) for t, e in zip(batch.column(text).to_pylist(), batch.column(name).to_pylist())]
            arrays = [pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, b, k in x[i]] for x in both], kind) for i in (0, 1)]
            yield pa.RecordBatch.from_pydict({f.name: batch.column(f.name) for f in fields} | {"base": arrays[0], "spans": arrays[1]})

    return df.mapInArrow(lean(run, PIECE_ROWS), schema)


def redact(documents: DataFrame, text: str = "text", patterns: DataFrame | list[str] | None = None, max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """documents with every span of `text` replaced by <KIND>; the longest wins where spans overlap. Null stays null."""
    known = learn_patterns(documents, text) if patterns is None else patterns
    df, known, name = _passes(documents, text, known, max_patterns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = set(known)
        for batch in batches:
            out = []
            for t, e in zip(batch.column(text).to_pylist(), batch.column(name).to_pylist()):
                spans = all_spans(t, chosen, e)[1] if t else []
                if spans:
                    parts, at = [], 0
                    for lo, hi, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
                        if hi <= at:
                            continue
                        if lo >= at:
                            parts += [t[at:lo], f"<{KINDS[kind].upper()}>"]
                        at = hi
                    t = "".join(parts) + t[at:]
                out.append(t)
            yield pa.RecordBatch.from_pydict({n: pa.array(out, pa.string()) if n == text else batch.column(n) for n in batch.schema.names if n != name})

    return df.mapInArrow(lean(run, PIECE_ROWS), documents.schema)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
