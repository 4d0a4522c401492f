"""Language of web pages by Bayesian fusion of evidence.

Four kinds of evidence are combined: how likely each language makes the text (character trigrams counted
over all labelled documents), the language the markup declares, the address suffix, and the host. The
last two come as a prior with hierarchical smoothing: counts of a host lean on those of its domain, these
on those of the suffix, these on those of all pages. Counts are sums of the posteriors that the text
alone gives, made by grouped aggregation; a page's own share is taken out of its prior. How far a
declaration can be trusted is counted in the same way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskpanel.llm.common import lower_ascii
from riskpanel.llm.html_extract import main_text
from riskpanel.session import materialize

BUCKET_BITS = 15
MAX_LANGUAGES = 256
#: Weight of a text's log-likelihood: overlapping trigrams repeat what they say.
TEMPER = 0.3
#: Pages' worth of trust in the level above, and in a declaration seen nowhere.
KAPPA = 4.0
PART = 1 << 20
DECLARED = re.compile(r"""<html[^>]*?\s(?:xml:)?lang\s*=\s*["']?\s*([A-Za-z]{2,3})""", re.I)
META = re.compile(r"""<meta[^>]*content-language[^>]*content\s*=\s*["']?\s*([A-Za-z]{2,3})""", re.I)


def trigrams(text: str | None, bits: int = BUCKET_BITS) -> np.ndarray:
    """How often each hashed trigram of bytes occurs in the whole text, in lower case and without signs and digits."""
    counts = np.zeros(1 << bits, np.int64)
    whole = b" " + " ".join(re.findall(r"[^\W\d_]+", (text or "").lower())).encode("utf-8", "replace") + b" "
    for at in range(0, max(len(whole) - 2, 0), PART):
        codes = np.frombuffer(whole, np.uint8)[at : at + PART + 2].astype(np.uint32)
        keys = (codes[:-2] << np.uint32(16)) | (codes[1:-1] << np.uint32(8)) | codes[2:]
        with np.errstate(over="ignore"):
            counts += np.bincount((keys * np.uint32(2654435761)) >> np.uint32(32 - bits), minlength=1 << bits)
    return counts


def learn(docs: DataFrame, bits: int = BUCKET_BITS) -> tuple[list[str], np.ndarray]:
    """Languages of the documents and log-probabilities of trigrams in each, from all rows with a language."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                if lang not in sums:
                    sums[lang] = np.zeros(1 << bits, np.int64)
                sums[lang] += trigrams(text, bits)
        for lang, counts in sums.items():
            used = np.flatnonzero(counts)
            yield pd.DataFrame({"lang": lang, "bucket": used.astype(np.int32), "n": counts[used]})

    rows = docs.where("lang is not null and text is not null").select("lang", "text").mapInPandas(
        counted, "lang string, bucket int, n long"
    )
    found = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).groupBy("lang").agg(
        F.collect_list(F.struct("bucket", "n")).alias("counts")
    ).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    table = np.full((len(found), 1 << bits), 0.5)
    for i, row in enumerate(found):
        table[i, [c["bucket"] for c in row["counts"]]] += [c["n"] for c in row["counts"]]
    return [row["lang"] for row in found], np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def declared_language(page: str | None) -> str | None:
    head = page or ""
    m = DECLARED.search(head) or META.search(head)
    return m[1].lower() if m else None


def host_of(url: Column) -> Column:
    """Host of an address in lower case; null if it has none."""
    host = F.regexp_extract(lower_ascii(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(host != "", host)


def text_evidence(pages: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """``page_id, url, declared, host, domain, suffix, likely``: ``likely`` are log-likelihoods by language."""
    shared = pages.sparkSession.sparkContext.broadcast(model[1])

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        bits = int(table.shape[1]).bit_length() - 1
        for batch in batches:
            out = batch[["page_id", "url"]].copy()
            out["declared"] = [declared_language(page) for page in batch["html"]]
            likely = []
            for page in batch["html"]:
                counts = trigrams(main_text(page), bits)
                used = np.flatnonzero(counts)
                likely.append((TEMPER * (table[:, used].astype(np.float64) @ counts[used])).tolist())
            out["likely"] = likely
            yield out

    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", "url", "html").mapInPandas(
        made, f"page_id {kind}, url string, declared string, likely array<double>"
    )
    host = host_of(F.col("url"))
    suffix = F.substring_index(host, ".", -1)
    return rows.select(
        "*", host.alias("host"), F.substring_index(host, ".", -2).alias("domain"), suffix.alias("suffix")
    )


def normalised(logs: Column) -> Column:
    """Probabilities out of log-weights."""
    shifted = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(shifted, lambda x: x / F.aggregate(shifted, F.lit(0.0), lambda a, b: a + b))


def sums_of(name: str, size: int) -> Column:
    return F.array(*[F.sum(F.col("belief")[i]) for i in range(size)]).alias(name)


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """``page_id, url, host, declared, lang, probability`` for each row of ``pages``.

    A null or empty page has no text evidence and goes by its other evidence; a null or odd address has
    a null host, which is a host of its own. Without labelled documents language and probability are
    null. Of equally probable languages the first in code-point order is taken. Repeated rows stay;
    an empty table gives no rows. Columns other than those named in the text are not read.
    """
    model = learn(docs)
    langs = model[0]
    if not langs:
        return pages.select(
            "page_id", "url", host_of(F.col("url")).alias("host"), F.lit(None).cast("string").alias("declared"),
            F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"),
        )
    size = len(langs)
    rows = materialize(text_evidence(pages, model), "lang-evidence").withColumn("belief", normalised(F.col("likely")))
    levels = ["suffix", "domain", "host"]
    hosts = materialize(rows.groupBy(*levels).agg(sums_of("host_sums", size)), "lang-hosts")
    up = hosts.withColumnRenamed("host_sums", "belief")
    tables = [up.groupBy(*levels[:k]).agg(sums_of(f"{name}_sums", size)) for k, name in ((0, "all"), (1, "suffix"), (2, "domain"))]
    prior = hosts.join(F.broadcast(tables[0]))
    for k, part in ((1, tables[1]), (2, tables[2])):
        keys = [F.col(f"o.{c}").eqNullSafe(F.col(f"p.{c}")) for c in levels[:k]]
        same = keys[0] if k == 1 else keys[0] & keys[1]
        prior = prior.alias("o").join(part.alias("p"), same).drop(*[F.col(f"p.{c}") for c in levels[:k]])
    prior = materialize(prior, "lang-priors")
    said = rows.groupBy("declared").agg(sums_of("declared_sums", size))
    said = materialize(said, "lang-declared")
    met = rows.alias("r").join(prior.drop("suffix", "domain").alias("h"), F.col("r.host").eqNullSafe(F.col("h.host"))).drop(F.col("h.host"))
    met = met.alias("r").join(said.alias("d"), F.col("r.declared").eqNullSafe(F.col("d.declared"))).drop(F.col("d.declared"))

    def smoothed(i: int) -> Column:
        """The host's share of language i without this page, leaning on the levels above."""
        own = F.col("belief")[i]
        share = F.lit(1.0 / size)
        for name in ("all", "suffix", "domain", "host"):
            counts = F.col(f"{name}_sums")
            whole = F.aggregate(counts, F.lit(0.0), lambda a, b: a + b) - 1.0
            share = (F.greatest(counts[i] - own, F.lit(0.0)) + KAPPA * share) / (F.greatest(whole, F.lit(0.0)) + KAPPA)
        return share

    def trusted(i: int) -> Column:
        """How much more often this declaration is made in language i than elsewhere, without this page."""
        own = F.col("belief")[i]
        made = F.greatest(F.col("declared_sums")[i] - own, F.lit(0.0))
        of_language = F.greatest(F.col("all_sums")[i] - own, F.lit(0.0))
        return (made + KAPPA / size) / (of_language + KAPPA)

    logs = F.array(*[F.col("likely")[i] + F.log(smoothed(i)) + F.log(trusted(i)) for i in range(size)])
    told = met.select("page_id", "url", "host", "declared", logs.alias("logs")).withColumn("p", normalised(F.col("logs")))
    best = F.array_max("p")
    named = F.array(*[F.lit(name) for name in langs])
    return told.select(
        "page_id", "url", "host", "declared",
        F.element_at(named, F.array_position("p", best).cast("int")).alias("lang"), best.alias("probability"),
    )
