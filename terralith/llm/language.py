"""Language ID by Bayesian fusion of text, declared language, address suffix and host priors.

Text: a multinomial model over hashed byte trigrams, fitted to a bounded sample of labelled rows
(``SAMPLE`` rows of every declared language in expectation, drawn by a hash of id and text). Every
declared language is modelled, however rare: labels are codes of two or three letters, and one
takes 256 KB. Its likelihood is tempered, because trigrams overlap. Evidence beside the text comes from counts over all rows, in which each row
counts by its text posterior: how often a declared language, or the last label of an address,
goes with each language, and priors of hosts. A host's prior is smoothed towards its domain's
and that towards the corpus's, each as ``SMOOTH`` rows. The tables of declared values, suffixes
and hosts stay DataFrames, however many there are; Spark broadcasts them only where they are
small. A row is accepted if it has a letter and one language's posterior reaches ``ACCEPT``; a
text too short for a trigram rests on the other evidence.
"""

from __future__ import annotations

from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralith.llm.common import free_name, materialise, table

SAMPLE = 1000
BITS = 16
#: Bytes of a text whose trigrams are held at once.
PIECE = 1 << 16
TEMPER = 0.25
#: Most a text can say for one language against another (natural log).
CAP = 30.0
SMOOTH = 20.0
ACCEPT = 0.6
#: Codes that say that a text has no one language (fixed values of ISO 639).
NO_LANGUAGE = ("und", "mul", "mis", "zxx")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def trigrams(text: str) -> np.ndarray:
    """Hashed trigrams of bytes (A-Z in lower case) that hold two letters at least."""
    return _hashed(np.frombuffer(f" {text} ".encode(), np.uint8))


def _hashed(raw: np.ndarray) -> np.ndarray:
    b = _LOWER[raw].astype(np.uint32)
    letters = _LETTER[b]
    keep = letters[:-2].astype(np.int8) + letters[1:-1] + letters[2:] >= 2
    h = (b[:-2] * 65536 + b[1:-1] * 256 + b[2:])[keep] * np.uint32(2654435761)
    return (h >> np.uint32(32 - BITS)).astype(np.int64)


def _pieces(text: str):
    """The trigrams of one text, ``PIECE`` bytes at a time; pieces share two bytes."""
    raw = np.frombuffer(f" {text} ".encode(), np.uint8)
    for at in range(0, len(raw) - 2, PIECE):
        yield _hashed(raw[at : at + PIECE + 2])


def _counts(text: str) -> np.ndarray:
    return sum((np.bincount(t, minlength=1 << BITS) for t in _pieces(text)), np.zeros(1 << BITS, np.int64))


def fit(texts: list[tuple[str, str]]) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities by language and trigram) of labelled texts in memory."""
    counts: dict[str, np.ndarray] = {}
    for lang, text in texts:
        counts[lang] = counts.get(lang, 0) + _counts(text)
    return _model(counts)


def _model(counts: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray]:
    languages = sorted(counts)
    table_ = np.array([counts[c] for c in languages] or [np.zeros(1 << BITS)]) + 0.05
    return languages, np.log(table_ / table_.sum(axis=1, keepdims=True)).astype(np.float32)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Fit on about ``sample`` labelled rows of each label, drawn by a hash of id and text.

    Texts stay with the executors: the driver gets one count for each label and trigram bucket.
    """
    labelled = docs.select(declared_code(F.col(lang_col)).alias("l"), F.col(text_col).cast("string").alias("t"), F.xxhash64(F.lit("language sample"), F.col(id_col), F.col(text_col)).alias("h"))
    labelled = labelled.filter("l is not null and t is not null")
    shares = {r["l"]: min(1.0, sample / r["n"]) for r in labelled.groupBy("l").agg(F.count("*").alias("n")).collect()}
    names = sorted(shares)
    if not names:
        return _model({})
    most = F.create_map(*[x for name in names for x in (F.lit(name), F.lit(min(2**63 - 1, int((2 * shares[name] - 1) * 2**63))))])
    drawn = labelled.filter(F.col("h") <= F.element_at(most, F.col("l")))

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[lang] = held.get(lang, 0) + _counts(text)
        for lang, found in held.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(found[at], pa.int64())], ["l", "g", "n"])

    summed = drawn.select("l", "t").mapInArrow(count, "l string, g int, n long").groupBy("l", "g").agg(F.sum("n").alias("n")).toArrow()
    counts = {lang: np.zeros(1 << BITS) for lang in names}
    for lang, at, n in zip(summed["l"].to_pylist(), summed["g"].to_pylist(), summed["n"].to_pylist(), strict=True):
        counts[lang][at] = n
    return _model(counts)


def declared_code(column):
    """Primary subtag of a declared language (two or three letters), lower case; null if there is none."""
    code = F.regexp_extract(F.lower(F.trim(column.cast("string"))), r"^([a-z]{2,3})(?:[^a-z]|$)", 1)
    return F.when(~code.isin("", *NO_LANGUAGE), code)


def posterior(languages: list[str], model: np.ndarray, text: str) -> tuple[list[float], int]:
    """(tempered log-likelihoods, 0 for the best and at least -CAP; number of letter bytes)."""
    n = int(np.count_nonzero(_LETTER[_LOWER[np.frombuffer(text.encode(), np.uint8)]]))
    if not languages:
        return [0.0], n
    score = sum((model[:, t].sum(axis=1, dtype=np.float64) for t in _pieces(text)), np.zeros(len(languages))) * TEMPER
    return np.maximum(score - score.max(), -CAP).tolist(), n


def _scored(rows: DataFrame, languages: list[str], model: np.ndarray, from_html: bool) -> DataFrame:
    """rows(key, declared, suffix, host, domain, text) with ll and n in place of the text."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        from terralith.llm.html import extract

        weights = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = [posterior(languages, weights, extract(t) if from_html else t or "") for t in part.column(5).to_pylist()]
                lls, ns = [f[0] for f in found], [f[1] for f in found]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(5)], pa.array(lls, pa.list_(pa.float64())), pa.array(ns, pa.int64())], _SCORED)

    return rows.select(*_SCORED[:5], "text").mapInArrow(run, "key long, declared string, suffix string, host string, domain string, ll array<double>, n long")


_SCORED = ["key", "declared", "suffix", "host", "domain", "ll", "n"]


def document_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Documents as rows to identify: the source is the host, there is no address."""
    none = F.lit(None).cast("string")
    return docs.select(
        F.col(id_col).cast("long").alias("key"), declared_code(F.col(lang_col)).alias("declared"), none.alias("suffix"),
        F.col(source_col).cast("string").alias("host"), none.alias("domain"), F.col(text_col).cast("string").alias("text"),
    )


def page_rows(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages as rows to identify: declared in the html tag, suffix, host and domain of the url."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.when(host != "", host)
    lang = F.regexp_extract(F.coalesce(F.col(html_col).cast("string"), F.lit("")), r"""(?i)<html\b[^<>]*?\s(?:xml:)?lang\s*=\s*["']?([A-Za-z_-]+)""", 1)
    suffix = F.substring_index(host, ".", -1)
    return pages.select(
        F.col(id_col).cast("long").alias("key"), declared_code(lang).alias("declared"), F.when(suffix.rlike("^[a-z]"), suffix).alias("suffix"),
        host.alias("host"), F.substring_index(host, ".", -2).alias("domain"), F.col(html_col).cast("string").alias("text"),
    )


def _sums(rows: DataFrame, by: list[str], prefix: str, k: int) -> DataFrame:
    return rows.groupBy(*by).agg(*[F.sum(F.col("p")[i]).alias(f"{prefix}{i}") for i in range(k)])


def fuse(scored: DataFrame, languages: list[str]) -> DataFrame:
    """scored rows with ``lang``, ``confidence`` and ``accepted``; see the module's text."""
    k = max(1, len(languages))
    total = F.aggregate(F.transform("ll", F.exp), F.lit(0.0), lambda a, x: a + x)
    rows = scored.withColumn("z", total).withColumn("p", F.transform("ll", lambda x: F.when(F.col("n") > 0, F.exp(x) / F.col("z")).otherwise(0.0)))
    overall = rows.agg(*[F.sum(F.col("p")[i]).alias(f"g{i}") for i in range(k)]).first()
    mass = [float(overall[f"g{i}"] or 0.0) for i in range(k)]
    share = [(m + 1.0) / (sum(mass) + k) for m in mass]

    def evidence(name: str):
        """log P(value | language), smoothed by one row of each language."""
        counts = _sums(rows.filter(F.col(name).isNotNull()), [name], "c", k)
        return counts.select(F.col(name), F.array(*[F.log((F.col(f"c{i}") + 0.5) / (mass[i] + 50.0)) for i in range(k)]).alias(f"e_{name}"))

    domains = _sums(rows.filter("domain is not null"), ["domain"], "d", k)
    hosts = _sums(rows.filter("host is not null"), ["host", "domain"], "h", k).withColumnRenamed("domain", "of")
    hosts = hosts.join(domains, F.col("of") == F.col("domain"), "left").drop("domain")
    d_all = sum((F.coalesce(F.col(f"d{i}"), F.lit(0.0)) for i in range(k)), F.lit(0.0))
    h_all = sum((F.col(f"h{i}") for i in range(k)), F.lit(0.0))
    middle = [(F.coalesce(F.col(f"d{i}"), F.lit(0.0)) + SMOOTH * share[i]) / (d_all + SMOOTH) for i in range(k)]
    prior = F.array(*[F.log((F.col(f"h{i}") + SMOOTH * m) / (h_all + SMOOTH)) for i, m in enumerate(middle)])
    hosts = hosts.select(F.col("host").alias("at"), F.col("of"), prior.alias("prior"))

    out = rows
    for name in ("declared", "suffix"):
        out = out.join(evidence(name).withColumnRenamed(name, f"v_{name}"), F.col(name) == F.col(f"v_{name}"), "left")
    out = out.join(hosts, (F.col("host") == F.col("at")) & F.col("domain").eqNullSafe(F.col("of")), "left")
    flat = F.array(*[F.lit(0.0)] * k)
    base = F.array(*[F.lit(log(s)) for s in share])
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    joint = plus(plus(F.col("ll"), F.coalesce("prior", base)), plus(F.coalesce("e_declared", flat), F.coalesce("e_suffix", flat)))
    out = out.withColumn("joint", joint).withColumn("top", F.array_max("joint"))
    norm = F.aggregate(F.transform("joint", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, x: a + x)
    names = F.array(*[F.lit(x) for x in languages or ["und"]])
    best = F.element_at(names, F.array_position("joint", F.col("top")).cast("int"))
    sure = F.lit(1.0) / norm
    accepted = (F.col("n") > 0) & (sure >= ACCEPT)
    return out.select("key", F.when(accepted, best).otherwise("und").alias("lang"), sure.alias("confidence"), accepted.alias("accepted"))




def identify(rows: DataFrame, model: tuple[list[str], np.ndarray], from_html: bool = False) -> DataFrame:
    """(key, lang, confidence, accepted) per row of ``document_rows`` or ``page_rows``.

    Null and empty texts, and texts without letters, are 'und' and not accepted; null declared
    values, addresses and hosts add no evidence; repeated rows give equal rows; ties of the
    posterior go to the first language by name; an empty table gives none.
    """
    return fuse(materialise(_scored(rows, *model, from_html)), model[0])


def accepted_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is found, all columns kept.

    An id goes if every row that carries it is rejected. Rejected ids are the small side, so
    whole texts are shuffled only if there are very many of them. Rows without an id stay.
    """
    found = identify(document_rows(docs), train(docs))
    key = free_name(docs, "key")
    gone = found.groupBy(F.col("key").alias(key)).agg(F.bool_or("accepted").alias("any")).filter("not any").select(key)
    return docs.join(gone, docs["doc_id"] == gone[key], "left_anti")


def op10_language_id(spark, sf_dir):
    """All ``documents`` and all ``pages``: doc_id or page_id, lang, confidence, accepted."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs)
    found = identify(document_rows(docs), model).select(F.col("key").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), "lang", "confidence", "accepted")
    pages = identify(page_rows(table(spark, sf_dir, "pages")), model, from_html=True)
    return found.unionByName(pages.select(F.lit(None).cast("long").alias("doc_id"), F.col("key").alias("page_id"), "lang", "confidence", "accepted"))
