"""Language identification by Bayesian fusion of text, markup, address and host evidence.

    log P(lang | page) = text + declared markup + address suffix + host prior

text: mean log-likelihood of the text's letter trigrams under a model per language,
times the number of trigrams up to EVIDENCE (trigrams of one text are not
independent, so evidence does not grow without bound). markup and suffix: how
reliably a declared language is the true one, by smoothed counts. host: the
host's share of each language, shrunk towards its domain's share, that towards
the share of all rows. The shares are sums of text-only posteriors, computed by
grouped aggregation (partial sums before the shuffle, so hot hosts cost no more),
and every row leaves itself out of its host's and domain's sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, cut

LANGUAGES = ("de", "en", "es", "fr")
BUCKETS = 1 << 15
EVIDENCE = 60
# Labelled rows per language the model is fitted to (the smallest hashes of id and text).
SAMPLE_PER_LANGUAGE = 2_000
# Pseudo-counts with which a host leans on its domain, and a domain on all rows.
HOST_WEIGHT, DOMAIN_WEIGHT = 10.0, 50.0
# A document is rejected when no language reaches this posterior.
MIN_POSTERIOR = 0.5
# Share of rows taken beforehand to be in none of LANGUAGES: their trigrams are uniform over the buckets.
OTHER_SHARE = 0.01

# Bytes that count as letters: a-z (A-Z lower-cased) and the bytes of non-ASCII characters.
LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def trigrams(text: bytes) -> np.ndarray:
    """Bucket of every byte trigram of the letter runs of a text."""
    letters = np.frombuffer(b" " + b" ".join(text.translate(LETTERS).split()) + b" ", np.uint8).astype(np.uint32)
    if len(letters) < 4:
        return np.empty(0, np.int64)
    packed = (letters[:-2] << 16) | (letters[1:-1] << 8) | letters[2:]
    return ((packed * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


def fit(docs: DataFrame, text: str = "text", label: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE, row_id: str = "doc_id") -> np.ndarray:
    """Log-likelihood table (languages x buckets) from a bounded sample of labelled rows.

    The sample takes about `per_language` rows of each language by the hash of id and
    text, so copies of a text under many ids are sampled like other rows; the counts are
    summed in Spark. Labels outside LANGUAGES and null texts are not used; without any
    row all languages are alike.
    """
    rows = docs.select(F.col(row_id).alias("row_id"), F.col(text).alias("text"), F.col(label).alias("label")).where(F.col("label").isin(*LANGUAGES) & F.col("text").isNotNull())
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    share = F.lit(0.0)
    for language, n in sizes.items():
        share = F.when(F.col("label") == language, F.lit(min(1.0, per_language / n))).otherwise(share)
    picked = rows.where(F.pmod(F.xxhash64("row_id", "text"), F.lit(1 << 20)) < share * (1 << 20)).select("text", "label")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(LANGUAGES), BUCKETS), np.int64)
        for batch in batches:
            for language, t in zip(batch.column("label").to_pylist(), column_bytes(batch, "text")):
                sums[LANGUAGES.index(language)] += np.bincount(trigrams(t), minlength=BUCKETS)
        at, bucket = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bucket), pa.array(sums[at, bucket])], names=["language", "bucket", "n"])

    total = picked.mapInArrow(count, "language long, bucket long, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n"))
    counts = np.full((len(LANGUAGES), BUCKETS), 0.1)
    for r in total.collect():  # at most languages x buckets rows
        counts[r.language, r.bucket] += r.n
    return np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def text_scores(text: bytes, model: np.ndarray) -> tuple[np.ndarray, bool]:
    """Log-likelihood per language of one text, zeros (no evidence) without letters; whether another language is likelier.

    The other language is a background class with uniform trigrams, against the best of LANGUAGES.
    """
    found = trigrams(text)
    if not len(found):
        return np.zeros(len(LANGUAGES)), False
    evidence = min(len(found), EVIDENCE)
    scores = model.take(found, axis=1).mean(axis=1, dtype=np.float64) * evidence
    other = np.log(OTHER_SHARE) - np.log(BUCKETS) * evidence
    return scores - scores.max(), bool(other > scores.max() + np.log1p(-OTHER_SHARE))


def posterior(scores: np.ndarray) -> np.ndarray:
    """Rows of log scores as rows of probabilities."""
    weights = np.exp(scores - scores.max(axis=1, keepdims=True))
    return weights / weights.sum(axis=1, keepdims=True)


def _matrix(batch: pa.RecordBatch, prefix: str) -> np.ndarray:
    """Columns <prefix>_<language> as rows; null is 0."""
    return np.stack([batch.column(f"{prefix}_{x}").fill_null(0.0).to_numpy(zero_copy_only=False) for x in LANGUAGES], axis=1)


def _columns(prefix: str) -> str:
    return ", ".join(f"{prefix}_{x} double" for x in LANGUAGES)


def scored(rows: DataFrame, text: str, model: np.ndarray, keep: list[str]) -> DataFrame:
    """Columns `keep`, has_text, other (text in another language), t_<language> (text-only log-likelihood) and p_<language> (its posterior, 0 without letters)."""
    picked = rows.select(*keep, F.col(text).alias("text"))
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            judged = [text_scores(t, sent.value) for t in column_bytes(batch, "text")]
            scores = np.array([s for s, _ in judged]).reshape(-1, len(LANGUAGES))
            has_text = scores.any(axis=1)
            shares = np.where(has_text[:, None], posterior(scores), 0.0) if len(scores) else scores
            out = batch.drop_columns(["text"]).append_column("has_text", pa.array(has_text)).append_column("other", pa.array([o for _, o in judged], pa.bool_()))
            for prefix, values in (("t", scores), ("p", shares)):
                for i, language in enumerate(LANGUAGES):
                    out = out.append_column(f"{prefix}_{language}", pa.array(values[:, i], pa.float64()))
            yield out

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInArrow(run, f"{fields}, has_text boolean, other boolean, {_columns('t')}, {_columns('p')}")


def _declared(counts: DataFrame) -> dict[str, list[float]]:
    """Log P(declared value | language) by value, from smoothed counts.

    The values are the languages and `other`, so there are at most five rows.
    """
    table = {r[0]: [r[f"p_{x}"] or 0.0 for x in LANGUAGES] for r in counts.collect()}
    totals = np.sum(list(table.values()), axis=0) if table else np.zeros(len(LANGUAGES))
    return {v: np.log((np.array(sums) + 1.0) / (totals + len(LANGUAGES) + 1.0)).tolist() for v, sums in table.items()}


def _code(value: Column) -> Column:
    """A declared language as one of LANGUAGES, `other`, or null where none is declared."""
    code = F.lower(F.regexp_extract(F.coalesce(value, F.lit("")), r"^\s*([A-Za-z]{2})(?:[^A-Za-z]|$)", 1))
    return F.when(code == "", None).when(code.isin(*LANGUAGES), code).otherwise(F.lit("other"))


def identify(rows: DataFrame, text: str, declared: Column, suffix: Column, host: Column, domain: Column, model: np.ndarray, keep: list[str]) -> DataFrame:
    """Columns `keep`, host, declared, suffix, has_text, other, text_lang, lang, posterior; one row per row.

    Ties go to the first of LANGUAGES by name. Without letters the other evidence
    decides; without any evidence the prior of all rows does. A null host is no
    evidence. Scores (no texts) are written once below the shared folder.
    """
    named = rows.select(*keep, F.col(text).alias("_text"), _code(declared).alias("declared"), _code(suffix).alias("suffix"), host.alias("host"), domain.alias("domain"))
    base = cut(scored(named, "_text", model, [*keep, "declared", "suffix", "host", "domain"]))
    sums = [F.sum(f"p_{x}").alias(f"p_{x}") for x in LANGUAGES]
    everything = np.array([v or 0.0 for v in base.agg(*sums).first()])
    prior = (everything + 1.0) / (everything.sum() + len(LANGUAGES))
    markup = _declared(base.where("declared is not null").groupBy("declared").agg(*sums))
    address = _declared(base.where("suffix is not null").groupBy("suffix").agg(*sums))
    by_host = cut(base.where("host is not null").groupBy("host", "domain").agg(*[s.alias(f"h_{x}") for s, x in zip(sums, LANGUAGES)]))
    by_domain = cut(by_host.groupBy("domain").agg(*[F.sum(f"h_{x}").alias(f"d_{x}") for x in LANGUAGES]))
    at_host = by_host.withColumnsRenamed({"host": "_h", "domain": "_hd"})
    at_domain = by_domain.withColumnRenamed("domain", "_d")
    joined = (
        base.join(at_host, (F.col("host") == F.col("_h")) & F.col("domain").eqNullSafe(F.col("_hd")), "left")
        .join(at_domain, F.col("domain") == F.col("_d"), "left")
        .drop("_h", "_hd", "_d")
    )
    shown = ["host", "declared", "suffix", "has_text", "other"]

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(LANGUAGES)
        for batch in batches:
            if not batch.num_rows:
                continue
            text, own = _matrix(batch, "t"), _matrix(batch, "p")
            own[batch.column("host").is_null().to_numpy(zero_copy_only=False)] = 0.0
            towards = np.broadcast_to(prior, text.shape)
            for prefix, weight in (("d", DOMAIN_WEIGHT), ("h", HOST_WEIGHT)):
                others = np.maximum(_matrix(batch, prefix) - own, 0.0)  # a row is no evidence for itself
                towards = (others + weight * towards) / (others.sum(axis=1, keepdims=True) + weight)
            fused = text + np.log(towards)
            for column, table in (("declared", markup), ("suffix", address)):
                fused += np.array([table.get(v, [0.0] * len(LANGUAGES)) for v in batch.column(column).to_pylist()])
            shares = posterior(fused)
            out = batch.select([*keep, *shown])
            out = out.append_column("text_lang", pa.array(names[text.argmax(axis=1)]))
            out = out.append_column("lang", pa.array(names[shares.argmax(axis=1)]))
            yield out.append_column("posterior", pa.array(shares.max(axis=1)))

    kinds = dict(joined.dtypes)
    fields = ", ".join(f"`{c}` {kinds[c]}" for c in [*keep, *shown])
    return joined.mapInArrow(fuse, f"{fields}, text_lang string, lang string, posterior double")


# ---- pages and documents -----------------------------------------------------------


def page_text(html: Column) -> Column:
    """Visible text of a page: scripts, styles, comments and tags become spaces."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    return F.regexp_replace(bare, r"&#?\w{1,10};", " ")


def identify_pages(pages: DataFrame, model: np.ndarray, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, host, declared, suffix, text_lang, lang, posterior of every page.

    declared: the lang attribute of <html>; suffix: the host's country label, else the
    first path segment of two letters. Null urls have no host and no suffix. Other
    columns are not read.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    host = F.lower(F.regexp_extract("url", r"^.*?://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    host = F.when(host != "", host)
    label = F.regexp_extract(host, r"\.([a-z]{2})$", 1)
    segment = F.regexp_extract("url", r"^.*?://[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", 1)
    found = identify(
        rows.withColumn("visible", page_text(F.col("html"))),
        "visible",
        F.regexp_extract("html", r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1),
        F.when(label != "", label).otherwise(segment),
        host,
        F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1),
        model,
        ["page_id"],
    )
    return found.select("page_id", "host", "declared", "suffix", "text_lang", "lang", "posterior")


def keep_identified(docs: DataFrame, model: np.ndarray, min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """The documents whose language is known: with letters, likelier in one of LANGUAGES than in another, and one at `min_posterior`.

    Evidence: text, the declared `lang`, and `source` as the host. Rows with equal
    doc_id and text share their verdict. The rejected keys are written first, so
    Spark sees their size before it picks the join; texts move only if it must.
    """
    key = [F.col("doc_id").alias("r_id"), F.xxhash64("text").alias("r_text")]
    rows = docs.select(*key, F.col("text").alias("r_words"), F.col("lang").alias("r_lang"), F.col("source").alias("r_source"))
    none = F.lit(None).cast("string")
    found = identify(rows, "r_words", F.col("r_lang"), none, F.col("r_source"), none, model, ["r_id", "r_text"])
    rejected = cut(found.where(~F.col("has_text") | F.col("other") | (F.col("posterior") < min_posterior)).select("r_id", "r_text").distinct())
    same = docs["doc_id"].eqNullSafe(rejected["r_id"]) & (F.xxhash64(docs["text"]) == rejected["r_text"])
    return docs.join(rejected, same, "left_anti")
