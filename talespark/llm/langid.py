"""Language identification with error-correcting output codes.

Every language has a codeword; one binary classifier for each bit tells, from
hashed byte n-grams, the languages whose bit is 1 from the rest. The classifiers
are n-gram likelihood ratios, so training is one distributed count over all
labelled texts. Decoding adds up, over the bits, the logistic loss between a
codeword and the bit margins, weighted by how reliable a bit is for a language;
the codeword of least loss wins, and a small lead is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_fold, pick, read
from .grams import hashed_grams

BITS, ORDERS = 15, (1, 2, 3)
#: Bound of the label set; more distinct labels than this are an error.
MAX_LANGUAGES = 512
#: A lead in probability below this is ambiguous.
AMBIGUOUS = 0.2
#: A text is rejected below this share of the median agreement of labelled held-out texts.
#: Texts of one language lie near 1, half one and half another near 0.5, noise below 0.35.
AGREEMENT = 0.57
LETTER = regex.compile(r"\p{L}")
#: ASCII other than letters and the apostrophe becomes a space.
TABLE = bytes(c if c >= 128 or chr(c).isalpha() or c == 39 else 32 for c in range(256))


def normal_bytes(text: str) -> bytes:
    """Lower-cased UTF-8 with runs of spaces and ASCII non-letters as one space."""
    return b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(TABLE).split()) + b" "


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k rows of +1 and -1: every split of the languages for up to 6 of them, else
    random balanced splits, about 12 log2(k), drawn until all rows are far apart."""
    if k < 2:
        return np.zeros((k, 0), np.int8)
    if k <= 6:
        cols = [[1 if (m >> i) & 1 else -1 for i in range(k)] for m in range(1, 2 ** (k - 1))]
        return np.array(cols, np.int8).T
    rng, n = np.random.default_rng(seed), int(np.ceil(12 * np.log2(k)))
    best, far = None, -1
    for _ in range(50):
        code = np.stack([rng.permutation([1] * (k // 2) + [-1] * (k - k // 2)) for _ in range(n)], 1).astype(np.int8)
        gap = (n - np.max(code.astype(int) @ code.T - 2 * n * np.eye(k, dtype=int))) // 2
        if gap > far:
            best, far = code, gap
    return best


@dataclass
class Model:
    """Bounded by MAX_LANGUAGES and the bucket count, whatever the corpus."""

    languages: list[str]
    code: np.ndarray  # languages x bits, +1 or -1
    weights: np.ndarray  # buckets x bits
    trust: np.ndarray  # languages x bits, rows sum to 1
    margin: np.ndarray  # languages x bits, mean margin of a bit in texts of each language


def count_grams(texts: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all rows of (text, lang), counted first inside each task."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pd.DataFrame]:
            for lang, n in held.items():
                at = np.flatnonzero(n)
                yield pd.DataFrame({"lang": lang, "bucket": at.astype(np.int32), "n": n[at]})
            held.clear()

        for pdf in batches:
            for text, lang in zip(pdf["text"], pdf["lang"]):
                if lang not in held and len(held) >= 64:
                    yield from flush()
                n = held.setdefault(lang, np.zeros(2**BITS, np.int64))
                n += np.bincount(hashed_grams(normal_bytes(text), ORDERS, BITS), minlength=2**BITS)
        yield from flush()

    return texts.mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(texts: DataFrame) -> Model:
    """Train on all rows of (text, lang) in which both are given."""
    counts = count_grams(texts.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()))
    got = counts.limit(MAX_LANGUAGES * 2**BITS + 1).toPandas()  # bounded: label set x buckets
    languages = sorted(got["lang"].unique())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"{len(languages)} labels; the bound is {MAX_LANGUAGES}")
    p = np.full((len(languages), 2**BITS), 0.5)
    at = {x: i for i, x in enumerate(languages)}
    np.add.at(p, (got["lang"].map(at).to_numpy(int), got["bucket"].to_numpy(int)), got["n"].to_numpy(float))
    p /= p.sum(1, keepdims=True)
    code = codewords(len(languages))
    weights = np.zeros((2**BITS, code.shape[1]), np.float32)
    for b in range(code.shape[1]):
        weights[:, b] = np.log(p[code[:, b] > 0].mean(0)) - np.log(p[code[:, b] < 0].mean(0))
    margin = np.maximum(code * (p @ weights), 1e-6)  # what a bit's margin is in texts of each language
    trust = margin / margin.sum(1, keepdims=True) if code.shape[1] else margin
    return Model(languages, code, weights, trust, margin)


def decode(model: Model, margins: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best language, its probability, its lead) from mean margins of n grams."""
    z = margins * np.minimum(n, 400)[:, None] * 0.25  # grams overlap, so they count for less than one each
    loss = (np.logaddexp(0, -z[:, None, :] * model.code[None]) * model.trust[None]).sum(2)
    e = np.exp(loss.min(1, keepdims=True) - loss)
    p = e / e.sum(1, keepdims=True)
    best = p.argmax(1)
    top = np.sort(p, 1)
    return best, top[:, -1], top[:, -1] - (top[:, -2] if p.shape[1] > 1 else 0)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", agreement: bool = False) -> DataFrame:
    """One row per document: id, lang_pred, score (0 to 1), ambiguous, and agreement if
    asked for: the text's bit margins along the codeword of lang_pred, as a share of what
    texts of that language have (0 for ``und``, 1 where only one language was learned).

    The whole text is read. ``und`` with score 0 is given to null texts, texts
    without a letter, and all texts where no language was learned. Rows are judged
    one by one: repeated ids are kept, other columns are ignored, an empty table
    gives no rows. Equal losses go to the language first in alphabetical order.
    """
    source = pick(docs, id_col, text_col).toDF("doc_id", "text")
    kind = source.schema["doc_id"].dataType.simpleString()

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            known = np.array([isinstance(t, str) and LETTER.search(t) is not None and bool(model.languages) for t in pdf["text"]], bool)
            lang, score, unsure = np.full(len(pdf), "und", object), np.zeros(len(pdf)), np.ones(len(pdf), bool)
            agree = np.zeros(len(pdf))
            if known.any():
                margins, n = np.zeros((known.sum(), model.code.shape[1])), np.zeros(known.sum())
                for i, text in enumerate(pdf["text"][known]):
                    at = hashed_grams(normal_bytes(text), ORDERS, BITS)
                    n[i] = len(at)
                    margins[i] = model.weights[at].sum(0) if len(at) < 2000 else np.bincount(at, minlength=2**BITS).astype(np.float32) @ model.weights
                margins /= np.maximum(n, 1)[:, None]
                best, p, lead = decode(model, margins, n)
                agree[known] = (margins * model.code[best]).sum(1) / model.margin[best].sum(1) if model.code.shape[1] else 1.0
                lang[known], score[known], unsure[known] = np.array(model.languages, object)[best], p, lead < AMBIGUOUS
            more = {"agreement": agree} if agreement else {}
            yield pd.DataFrame({id_col: pdf["doc_id"], "lang_pred": lang, "score": score, "ambiguous": unsure, **more})

    more = ", agreement double" if agreement else ""
    return source.mapInPandas(judge, f"`{id_col}` {kind}, lang_pred string, score double, ambiguous boolean{more}")


def agreement_limit(docs: DataFrame, model: Model, fold: int = 5) -> float:
    """AGREEMENT times the median agreement of the labelled documents of the fold that
    ``training_rows`` leaves out (1 if there are none)."""
    held_out = pick(docs, "doc_id", "text", "lang").filter((id_fold("doc_id", fold) == 0) & F.col("lang").isNotNull())
    judged = identify(held_out, model, agreement=True).filter("lang_pred <> 'und'")
    median = judged.agg(F.percentile_approx("agreement", 0.5)).first()[0]
    return AGREEMENT * (1.0 if median is None else median)


def training_rows(docs: DataFrame, fold: int = 5) -> DataFrame:
    """(text, lang) of the documents outside the held-out fold."""
    return pick(docs, "doc_id", "text", "lang").filter(id_fold("doc_id", fold) != 0).select("text", "lang")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = identify(docs, fit(training_rows(docs)))
    return out.select("doc_id", (id_fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "ambiguous")
