"""Language identification by Bayesian fusion of evidence.

Each page brings a text likelihood (hashed word beginnings under a multinomial model per
language), the language its markup declares, the ending of its address, and its host. Posterior
over languages = host prior x declaration x ending x text, so pieces of evidence that are
missing or uninformative drop out.

The tables of declarations and endings and the host priors are estimated from the pages
themselves by grouped aggregation: pages are first judged by text alone; the soft counts per host
are smoothed towards the registered domain, the domain towards all pages. A declaration or ending
weighs by how its pages' languages differ from those of all pages. A page's own judgement is
taken out of every sum that it meets again, so its text counts once and no page votes for itself.
Aggregates are sums with partial sums per task; a host with a third of all pages costs one row
per task there, and its pages are spread by salt where they meet its prior.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from farewheel.functions.skew import join_hot_keys
from farewheel.llm.shipping import on_workers
from farewheel.llm.staging import staged
from farewheel.llm.words import hash_words, lower_ascii, slices, text_buffer

BUCKETS = 4096       # hashed word beginnings
PREFIX = 3           # bytes of a word beginning
ADD = 0.5            # added to every count of the text model
TEMPER = 0.25        # words of a page are far from independent
STRENGTH = 8.0       # pages' worth of prior at each level of the host hierarchy
EVIDENCE = 1.0       # pages' worth of neutral evidence for a declaration or an ending
CERTAIN = 0.5        # a page below this posterior is left undecided


def page_text(html: Column) -> Column:
    """Text of a page without scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(bare, r"<[^>]*>|&[#\w]+;", " ")


def declared_language(html: Column) -> Column:
    """Primary subtag of the lang attribute of the html element, lower case; null if none."""
    found = F.lower(F.regexp_extract(html, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})""", 1))
    return F.when(found != "", found)


def host_of(url: Column) -> Column:
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    return F.when(found != "", found)


def _bucket_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_buffer(column)
    words = hash_words(lower_ascii(data), offsets, PREFIX)
    return words.rows(), (words.prefix % np.uint64(BUCKETS)).astype(np.int64)


@on_workers
def train_text_model(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log probability of each bucket per language, and language shares.

    All texts with a language count. Each task sums its texts first, so what is shuffled is
    bounded by languages x buckets per task, and the model by languages x buckets.
    """
    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            row, bucket = _bucket_rows(batch.column("text"))
            langs = batch.column("lang").to_pylist()
            names = sorted(set(langs))
            number = {n: i for i, n in enumerate(names)}
            code = np.array([number[x] for x in langs])
            table = np.bincount(code[row] * (BUCKETS + 1) + bucket, minlength=len(names) * (BUCKETS + 1)).reshape(-1, BUCKETS + 1)
            table[:, BUCKETS] = np.bincount(code, minlength=len(names))  # texts
            for n, t in zip(names, table):
                sums[n] = sums.get(n, 0) + t
        for n, t in sums.items():
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array([n] * len(at)), pa.array(at, pa.int32()), pa.array(t[at], pa.int64())], ["lang", "bucket", "n"])
    rows = (
        docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").mapInArrow(count, "lang string, bucket int, n long")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pylist()
    )
    langs = sorted({r["lang"] for r in rows})
    table = np.zeros((len(langs), BUCKETS + 1))
    for r in rows:
        table[langs.index(r["lang"]), r["bucket"]] = r["n"]
    counts, texts = table[:, :BUCKETS] + ADD, table[:, BUCKETS]
    return langs, np.log(counts / counts.sum(1, keepdims=True)) if langs else counts, texts / max(1.0, texts.sum())


@on_workers
def text_posterior(rows: DataFrame, model: tuple, text: str = "text") -> DataFrame:
    """``rows`` without ``text``, with ``likelihood``: per language the tempered log likelihood
    of the whole text, the best one 0. A text without words leaves all at 0."""
    langs, logs, _ = model
    fields = [f for f in rows.schema if f.name != text]

    def run(batches):
        for batch in slices(batches):
            row, bucket = _bucket_rows(batch.column("_text"))
            # without any word bincount counts in whole numbers
            out = np.stack([np.bincount(row, TEMPER * l[bucket], batch.num_rows) for l in logs], 1).astype(np.float64)
            out -= out.max(1, keepdims=True)
            made = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(langs)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(f"_{i}") for i in range(len(fields))), made], [*(f"_{i}" for i in range(len(fields))), "_likelihood"])
    schema = ", ".join(f"_{i} {f.dataType.simpleString()}" for i, f in enumerate(fields))
    moved = rows.select(*[F.col(f.name).alias(f"_{i}") for i, f in enumerate(fields)], F.col(text).alias("_text"))
    out = moved.mapInArrow(run, f"{schema + ', ' if schema else ''}_likelihood array<double>")
    return out.select(*[F.col(f"_{i}").alias(f.name) for i, f in enumerate(fields)], F.col("_likelihood").alias("likelihood"))


def _normal(logs: Column) -> Column:
    """Probabilities from log weights."""
    top = F.array_max(logs)
    weights = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(weights, lambda x: x / F.aggregate(weights, F.lit(0.0), lambda a, b: a + b))


def _sums(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Soft counts of the n languages by key, as an array."""
    out = rows.groupBy(*keys).agg(*[F.sum(F.element_at("soft", i + 1)).alias(f"_{i}") for i in range(n)])
    return out.select(*keys, F.array(*[f"_{i}" for i in range(n)]).alias("counts"))


def _smoothed(counts: Column, parent: Column, strength: float) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, b: a + b)
    return F.zip_with(counts, parent, lambda c, p: (c + strength * p) / (total + strength))


@on_workers
def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, lang, probability, text_lang, declared, host, one row per row of ``pages``.

    ``lang`` is null where no language reaches CERTAIN or no language was ever declared in
    ``docs``. Null urls and pages bring no evidence of their kind and share the prior of all
    pages. Repeated rows get equal answers; hosts of one page lean on their domain.
    """
    model = train_text_model(docs)
    langs, _, shares = model
    host = host_of(F.col("url"))
    label = lambda n: F.concat_ws(".", F.slice(F.split(host, r"\."), -n, n)) if n else host
    parts = F.size(F.split(host, r"\."))
    facts = pages.select(
        F.col("page_id").cast("long"), host.alias("host"),
        F.when(parts >= 2, label(2)).otherwise(host).alias("domain"), F.element_at(F.split(host, r"\."), -1).alias("ending"),
        declared_language(F.col("html")).alias("declared"), F.coalesce(page_text(F.col("html")), F.lit("")).alias("text"))
    if not langs:
        none = F.lit(None).cast("string")
        return facts.select("page_id", none.alias("lang"), F.lit(None).cast("double").alias("probability"), none.alias("text_lang"), "declared", "host")
    read = staged(text_posterior(facts, model), "pages_read")
    return fuse(read, langs, shares)


def fuse(read: DataFrame, langs: list[str], shares: np.ndarray) -> DataFrame:
    """The answers of ``identify`` from pages with page_id, host, domain, ending, declared and
    the log likelihood of their text in each of ``langs``."""
    n = len(langs)
    names = F.array(*map(F.lit, langs))
    prior = F.array(*[F.lit(float(np.log(max(s, 1e-9)))) for s in shares])
    soft = read.withColumn("soft", _normal(F.zip_with("likelihood", prior, lambda a, b: a + b)))
    overall = _sums(soft, [], n).first()
    total = F.array(*[F.lit(float(x or 0)) for x in (overall["counts"] if overall else [0.0] * n)])
    lift = lambda rows, key, name: rows.groupBy(key).agg(*[F.sum(F.element_at("counts", i + 1)).alias(f"_{i}") for i in range(n)]).select(
        key, F.array(*[f"_{i}" for i in range(n)]).alias(name))
    hosts = staged(_sums(soft.filter("host IS NOT NULL"), ["ending", "domain", "host"], n), "host_counts")
    hosts = hosts.join(lift(hosts, "domain", "of_domain"), "domain").join(lift(hosts, "ending", "of_ending"), "ending").select(
        "host", F.col("counts").alias("of_host"), "of_domain", "of_ending")
    # two or three letters each
    said = lift(_sums(soft.filter("declared IS NOT NULL"), ["declared"], n), "declared", "of_declared")
    kinds = "array<double>"
    placed = join_hot_keys(soft.filter("host IS NOT NULL"), hosts, "host", ["page_id"]).unionByName(
        soft.filter("host IS NULL").withColumns({c: F.lit(None).cast(kinds) for c in ("of_host", "of_domain", "of_ending")}))
    others = lambda counts: F.zip_with(counts, "soft", lambda c, own: F.greatest(c - own, F.lit(0.0)))
    rest = others(total)
    everywhere = F.transform(rest, lambda x: (x + 1.0) / (F.aggregate(rest, F.lit(0.0), lambda a, b: a + b) + float(n)))
    weighed = placed.join(F.broadcast(said), "declared", "left").withColumn("root", everywhere)
    logs = lambda p: F.transform(p, lambda x: F.log(x))
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    weight = lambda counts: F.coalesce(
        F.zip_with(logs(_smoothed(others(counts), F.col("root"), EVIDENCE)), logs(F.col("root")), lambda a, b: a - b), F.array(*[F.lit(0.0)] * n))
    host_prior = _smoothed(others(F.col("of_host")), _smoothed(others(F.col("of_domain")), F.col("root"), STRENGTH), STRENGTH)
    score = plus(plus(F.col("likelihood"), logs(F.coalesce(host_prior, F.col("root")))), plus(weight(F.col("of_declared")), weight(F.col("of_ending"))))
    fused = weighed.withColumn("posterior", _normal(score)).withColumn("probability", F.array_max("posterior"))
    best = F.element_at(names, F.array_position("posterior", F.col("probability")).cast("int"))
    text_best = F.element_at(names, F.array_position("soft", F.array_max("soft")).cast("int"))
    return fused.select(
        "page_id", F.when(F.col("probability") >= CERTAIN, best).alias("lang"), F.round("probability", 9).alias("probability"),
        text_best.alias("text_lang"), "declared", "host")
