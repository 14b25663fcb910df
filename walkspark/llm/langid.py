"""Language identification of web pages by Bayesian evidence fusion.

Four kinds of evidence meet in log space: the likelihood of the page's visible text under byte-trigram models trained
on all labelled documents; the language that the markup declares; the languages that the address
suffix (country-code domain or path segment) stands for; and a prior of the host. Host priors are
smoothed along the hierarchy host, domain, top-level domain, all pages: each level's counts are pulled towards
its parent's estimate. The counts come from grouped aggregation of the pages' own text evidence.

Trigram tables have 2**bins counts for each language at any size of the input, and they alone go to all workers.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from walkspark.llm.common import stored

BINS = 16
#: Elements without words for readers, and page furniture.
DROPPED = frozenset(["script", "style", "noscript", "template", "nav", "footer", "header", "aside", "form", "button"])
NAME = re.compile(r"[A-Za-z][A-Za-z0-9]*").match
CLOSES = re.compile(rf"</({'|'.join(sorted(DROPPED))}|div)\b", re.I).finditer
ADVERT = re.compile(r"<div class=\"?ad\b", re.I).match
ROOT = re.compile(r"<html\b", re.I).search
LANG = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z]{2,3})", re.I).search
#: Country-code domains and the language most pages under them use.
COUNTRIES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "nz": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "ru": "ru", "se": "sv", "jp": "ja"}

#: Labels that stand under a country's code where others have their own name.
SECOND = ["ac", "co", "com", "edu", "gov", "net", "org"]


def visible_text(page: str) -> str:
    """Text outside tags, comments and dropped elements (up to their next closing tag; an element that is never closed
    loses its tag alone). One pass: no part of the page is looked at more than a fixed number of times."""
    closes: dict[str, list[int]] = {}
    for m in CLOSES(page):
        closes.setdefault(m[1].lower(), []).append(m.start())
    out, at, comments = [], 0, True
    i = page.find("<")
    while i >= 0:
        end = -1
        if comments and page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            comments = end >= 0
            end += 2 if comments else 0
        if end < 0:
            end = page.find(">", i + 1)
            if end < 0:
                break
            name = m[0].lower() if (m := NAME(page, i + 1)) else ""
            if name in DROPPED or name == "div" and ADVERT(page, i):
                later = closes.get(name, [])
                k = bisect_left(later, end)
                if k < len(later) and (close := page.find(">", later[k])) >= 0:
                    end = close
        out.append(page[at:i])
        at = end + 1
        i = page.find("<", at)
    out.append(page[at:])
    return " ".join(entities.unescape(" ".join(out)).split())


def declared_language(page: str) -> str | None:
    """The language of the first html tag that names one, in one pass: each tag is read up to its end and no further."""
    at = 0
    while m := ROOT(page, at):
        end = page.find(">", m.end())
        at = end if end >= 0 else len(page)
        if found := LANG(page, m.end(), at):
            return found[1].lower()
    return None


def trigram_bins(text: str, bins: int) -> np.ndarray:
    """A bin for each byte trigram of the lower-case text."""
    raw = np.frombuffer(f" {text.lower()} ".encode(), np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.empty(0, np.uint32)
    code = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - bins)


def train(documents: DataFrame, text: str = "text", lang: str = "lang", bins: int = BINS, max_languages: int = 200) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities [language, bin]) from all labelled documents, add-one smoothed.

    Rows without text or label take no part; repeated rows count each. Counts of every document are summed on Spark; the
    table for the driver has 2**bins rows a language, so more than max_languages labels raise ValueError.
    """
    if len(found := documents.filter(F.col(lang) != "").select(lang).distinct().limit(max_languages + 1).collect()) > max_languages:
        raise ValueError(f"over {max_languages} languages, such as {found[0][0]}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for label, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if label and t:
                    mine = counts.setdefault(label, np.zeros(1 << bins, np.int64))
                    mine += np.bincount(trigram_bins(t, bins), minlength=1 << bins)
        for label, mine in counts.items():
            at = np.flatnonzero(mine)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([label] * len(at), pa.string()), "bin": pa.array(at, pa.int32()), "n": pa.array(mine[at], pa.int64())})

    rows = documents.select(lang, text).mapInArrow(run, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    labels = sorted(rows["lang"].unique())
    table = np.ones((len(labels), 1 << bins))
    for k, label in enumerate(labels):
        mine = rows[rows["lang"] == label]
        table[k, mine["bin"].to_numpy()] += mine["n"].to_numpy()
    return labels, np.log(table / table.sum(axis=1, keepdims=True))


def evidence(pages: DataFrame, labels: list[str], model: np.ndarray, id: str = "page_id", url: str = "url", html: str = "html", bins: int = BINS, trust: float = 0.05) -> DataFrame:
    """(id, host, domain, tld, declared, suffix, text_scores) per page; scores are normalised log posteriors of the text alone.

    trust: weight of one trigram. Neighbouring trigrams share bytes and a page has one topic, so
    each counts as that much of an independent observation. Pages without text have equal scores.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            declared, scores = [], []
            for page in batch.column(2).to_pylist():
                page = page or ""
                declared.append(declared_language(page))
                found = trigram_bins(visible_text(page), bins)
                s = trust * (model[:, found].sum(axis=1) if len(found) else np.zeros(len(labels)))
                s -= s.max() if len(s) else 0
                scores.append((s - np.log(np.exp(s).sum())).tolist() if len(s) else [])
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "url": batch.column(1), "declared": pa.array(declared, pa.string()), "text_scores": pa.array(scores, pa.list_(pa.float64()))})

    kind = pages.schema[id].dataType.simpleString()
    made = pages.select(F.col(id).alias("id"), F.col(url).alias("url"), html).mapInArrow(run, f"id {kind}, url string, declared string, text_scores array<double>")
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    made = made.withColumn("host", F.coalesce(host, F.lit("")))
    parts = F.split("host", r"\.")
    below = F.when((F.length(F.element_at(parts, -1)) == 2) & F.coalesce(F.get(parts, F.size(parts) - 2).isin(SECOND), F.lit(False)), 2).otherwise(1)  # labels under the domain's own
    segment = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([A-Za-z]{2})(?:[/?#-]|$)", 1))
    country = F.coalesce(*[F.when(F.element_at(parts, -1) == c, F.lit(v)) for c, v in COUNTRIES.items()])
    named = F.when(segment.isin(labels), segment) if labels else F.lit(None).cast("string")
    return made.select("id", "host", F.array_join(F.slice(parts, F.greatest(F.size(parts) - below, F.lit(1)), 3), ".").alias("domain"), F.element_at(parts, -1).alias("tld"), "declared", F.coalesce(named, country).alias("suffix"), "text_scores")


def identify(pages: DataFrame, documents: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", strength: float = 5.0, declared_right: float = 0.85, suffix_right: float = 0.8) -> DataFrame:
    """One row per page: id, lang, probability, declared, suffix, host, text_lang.

    declared_right, suffix_right: how often a declaration or suffix names the page's language; what
    is left is spread over the other languages; a declaration outside the model's languages says nothing. The prior of a
    page's host is made of the host's other pages. Null or empty pages and addresses give no evidence, so the prior
    decides; addresses without a host share one. Of equally likely languages (ties) the first by name counts. Repeated
    pages are pages each; pages of any length are read whole, in one pass. Without labelled documents lang is null. Other columns
    of pages are ignored. An empty table gives no rows.
    """
    labels, model = train(documents)
    n = len(labels)
    made = stored(evidence(pages, labels, model, id, url, html), "langid-evidence")
    if not n:
        return made.select(F.col("id").alias(id), *[F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("probability", "double"))], "declared", "suffix", "host", F.lit(None).cast("string").alias("text_lang"))
    own = F.transform("text_scores", F.exp)
    sums = F.array(*[F.sum(F.exp(F.get("text_scores", F.lit(k)))) for k in range(n)])
    hosts = made.groupBy("host", "domain", "tld").agg(sums.alias("host_c"), F.count("*").cast("double").alias("host_n"))
    up = lambda level, *keys: hosts.groupBy(*keys).agg(F.array(*[F.sum(F.get("host_c", F.lit(k))) for k in range(n)]).alias(f"{level}_c"), F.sum("host_n").alias(f"{level}_n"))
    levels = hosts.join(up("domain", "domain", "tld"), ["domain", "tld"]).join(up("tld", "tld"), "tld").crossJoin(F.broadcast(up("all")))  # one row
    levels = stored(levels.drop("domain", "tld"), "langid-hosts")  # from a table, the join below can split a hot host

    def says(column: str, right: float) -> Column:
        known = F.col(column).isin(labels)
        return F.array(*[F.when(~known | F.col(column).isNull(), 0.0).when(F.col(column) == x, float(np.log(right))).otherwise(float(np.log((1 - right) / max(n - 1, 1)))) for x in labels])

    # each level's counts without the page itself, pulled towards the level above
    above = F.transform(F.arrays_zip("all_c", own.alias("own")), lambda x: (x["all_c"] - x["own"] + 1.0) / (F.col("all_n") - 1.0 + n))
    joined = made.join(levels, "host").withColumn("prior", above)
    for level in ("tld", "domain", "host"):
        whole = F.col(f"{level}_n") - 1.0 + strength
        zipped = F.arrays_zip(F.col(f"{level}_c").alias("c"), own.alias("own"), "prior")
        joined = joined.withColumn("prior", F.transform(zipped, lambda x: (F.greatest(x["c"] - x["own"], F.lit(0.0)) + strength * x["prior"]) / whole))  # noqa: B023
    fused = joined.select("*", says("declared", declared_right).alias("d"), says("suffix", suffix_right).alias("s"))
    logs = F.array(*[F.get("text_scores", F.lit(k)) + F.get("d", F.lit(k)) + F.get("s", F.lit(k)) + F.log(F.get("prior", F.lit(k))) for k in range(n)])
    scored = fused.withColumn("z", logs).withColumn("best", F.array_max("z"))
    names = F.array(*[F.lit(x) for x in labels])
    total = F.aggregate("z", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("best")))
    return scored.select(F.col("id").alias(id), F.element_at(names, F.array_position("z", F.col("best")).cast("int")).alias("lang"), (1.0 / total).alias("probability"), "declared", "suffix", "host", F.element_at(names, F.array_position("text_scores", F.array_max("text_scores")).cast("int")).alias("text_lang"))
