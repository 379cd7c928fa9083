"""Language identification of mixed documents: proportions by expectation-maximisation over word likelihoods.

Model: for each language the add-one log probabilities of letter trigrams (hashed into 2 ** `BITS` bins, words between
two marks), counted over all training documents. A word's likelihood under a language is the sum over its trigrams.
Inference: a document is a mixture of languages, each word drawn from one. EM estimates the proportions with all
languages, then within the 1, 2, 3 ... strongest; the set is kept that maximises log-likelihood minus half of
log(words) per further language. The prediction is the largest proportion of that set, the score that proportion.

The model has languages * 2 ** `BITS` numbers whatever the input, and travels with the tasks; documents are not shuffled.
More than `MAX_LANGS` languages are refused.

Null text, or text without a letter: `und`, score 0. A null doc_id counts as an empty string for the split. Without
training documents everything is `und`. Ties go to the first language in name order. Repeated rows are documents of
their own; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffers, table, tiles
from .op1_ppm_score import remainder

BITS, MAX_LANGS, ROUNDS, TILE = 16, 256, 12, 1 << 19
_CHARS: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower case of each code point, and whether it is a letter."""
    if not _CHARS:
        points = lambda: (chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(0x110000))
        _CHARS["low"] = np.fromiter((ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in points()), np.uint32, 0x110000)
        _CHARS["letter"] = np.fromiter((c.isalpha() for c in points()), bool, 0x110000)
    return _CHARS["low"], _CHARS["letter"]


def trigrams(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins of all letter trigrams, the first trigram of each word, and the words of each text."""
    low, letter = _tables()
    size = np.array([len(t) + 1 for t in texts], np.int64)
    c = np.frombuffer(" ".join([*texts, ""]).encode("utf-32-le", "replace"), np.uint32)
    is_letter = letter[c]
    c = np.where(is_letter, low[c], 0)
    # every letter closes a trigram with the two characters before it, and so does the mark after a word
    before, before2 = np.zeros_like(c), np.zeros_like(c)
    before[1:], before2[2:] = c[:-1], c[:-2]
    before2 = np.where(before == 0, 0, before2)
    closes = is_letter | (before != 0)
    h = c[closes].astype(np.uint32) * np.uint32(2654435761) ^ before[closes].astype(np.uint32) * np.uint32(2246822519) ^ before2[closes].astype(np.uint32) * np.uint32(3266489917)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    first = (is_letter & (before == 0))[closes]
    doc = np.repeat(np.arange(len(texts)), size)[closes]
    starts = np.flatnonzero(first)
    return (h >> np.uint32(32 - bits)).astype(np.int64), starts, np.bincount(doc[starts], minlength=len(texts))


def learn(docs: DataFrame, bits: int = BITS) -> tuple[list[str], np.ndarray]:
    """Language names and their log probabilities, from all rows of `text, lang`."""

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            texts, langs = b.column("text").to_pylist(), np.array(b.column("lang").to_pylist(), object)
            off = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
            for i, j in tiles(off, TILE):
                for lang in dict.fromkeys(langs[i:j]):
                    g, _, _ = trigrams([t for t, x in zip(texts[i:j], langs[i:j]) if x == lang], bits)
                    total[lang] = total.get(lang, 0) + np.bincount(g, minlength=1 << bits)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], names=["lang", "bin", "n"])

    counts = docs.where("text is not null and lang is not null").select("text", "lang").mapInArrow(count, "lang string, bin int, n long")
    langs = [r[0] for r in counts.select("lang").distinct().orderBy("lang").limit(MAX_LANGS + 1).collect()] if docs.columns else []
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    rows = counts.groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()  # at most languages * bins
    n = np.zeros((len(langs), 1 << bits))
    if len(rows):
        n[np.searchsorted(langs, rows["lang"].to_numpy().astype(str)), rows["bin"].to_numpy()] = rows["n"].to_numpy()
    return langs, np.log((n + 1) / (n.sum(1, keepdims=True) + (1 << bits)))


def em(like: np.ndarray, doc: np.ndarray, first: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the allowed languages per document, and the log-likelihood beside each word's scale."""
    n = np.diff(np.append(first, len(like)))[:, None]
    pi = allowed / allowed.sum(1, keepdims=True)
    for _ in range(rounds):
        share = like * pi[doc]
        share /= np.maximum(share.sum(1, keepdims=True), 1e-300)
        pi = np.add.reduceat(share, first, axis=0) / n
    return pi, np.add.reduceat(np.log(np.maximum((like * pi[doc]).sum(1), 1e-300)), first)


def infer(texts: list[str], logp: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: predicted language (-1: none), its proportion, languages in the chosen set."""
    pred, score, kinds = np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    g, starts, words = trigrams(texts, bits)
    some = np.flatnonzero(words)
    if not len(some) or not len(logp):
        return pred, score, kinds
    like = np.stack([np.add.reduceat(p[g], starts) for p in logp], 1)
    like = np.exp(np.maximum(like - like.max(1, keepdims=True), -60))
    size = words[some]
    doc, first = np.repeat(np.arange(len(some)), size), np.concatenate(([0], np.cumsum(size)[:-1]))
    full, _ = em(like, doc, first, np.ones((len(some), len(logp))), ROUNDS)
    rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1)
    best, best_pi, chosen = np.full(len(some), -np.inf), full, np.ones(len(some), np.int64)
    todo = np.ones(len(some), bool)  # documents whose next larger set may still be better
    for k in range(1, len(logp) + 1):
        at = np.flatnonzero(todo)
        if not len(at):
            break
        rows = todo[doc]
        sz = size[at]
        pi, ll = em(like[rows], np.repeat(np.arange(len(at)), sz), np.concatenate(([0], np.cumsum(sz)[:-1])), (rank[at] < k).astype(float), 1 if k == 1 else ROUNDS)
        gain = ll - 0.5 * (k - 1) * np.log(sz)
        better = gain > best[at]
        if k == 1:
            best_pi = np.zeros_like(full)
        best_pi[at[better]], best[at[better]], chosen[at[better]] = pi[better], gain[better], k
        todo[at[~better]] = False
    pred[some], score[some], kinds[some] = best_pi.argmax(1), best_pi.max(1), chosen
    return pred, score, kinds


def identify(docs: DataFrame, training: Column | None = None, bits: int = BITS) -> DataFrame:
    """`docs` with `lang_pred`, `lang_score`, `lang_kinds`; learned from the rows where `training` holds (all)."""
    langs, logp = learn(docs if training is None else docs.where(training), bits)
    names = np.array([*langs, "und"], object)
    clash = [c for c in ("lang_pred", "lang_score", "lang_kinds") if c in docs.columns]
    docs = docs.drop(*clash)

    def predict(batches):
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            off = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
            got = [infer(texts[i:j], logp, bits) for i, j in tiles(off, TILE)]
            pred, score, kinds = (np.concatenate(x) for x in zip(*got)) if got else (np.zeros(0, np.int64),) * 3
            new = [pa.array(names[pred].tolist(), pa.string()), pa.array(score.astype(np.float64)), pa.array(kinds.astype(np.int64))]
            yield pa.record_batch([*b.columns, *new], names=[*b.schema.names, "lang_pred", "lang_score", "lang_kinds"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(predict, f"{fields}, lang_pred string, lang_score double, lang_kinds long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (remainder(5) == 0).alias("held_out"))
    return identify(docs, ~F.col("held_out")).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), F.col("lang_kinds").alias("n_languages"))
