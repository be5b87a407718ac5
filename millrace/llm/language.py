"""Language identification: each document is a mixture of languages, inferred by expectation-maximisation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import bound_batches, tidy
from millrace.llm.ngrams import STEP, add_counts, mix, runs

#: Hash buckets of the n-gram models, and lengths of n-grams in bytes, each with its own buckets.
BUCKETS, SIZES = 1 << 18, (2, 3, 4)
#: Rounds of expectation and maximisation.
ROUNDS = 12
#: A further language must raise the log-likelihood by so much, times the logarithm of the number of words (as BIC).
PENALTY = 1.0

_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = True


def _ngrams(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets: one row a length, one column a byte, -1 for none; word of each byte or -1; text of each word).

    Words are runs of letters, with one blank on either side; all else is blank.
    """
    letter = _LETTER[data]
    start = np.flatnonzero(letter & ~np.concatenate([[False], letter[:-1]]))
    stop = np.flatnonzero(letter & ~np.concatenate([letter[1:], [False]])) + 1
    text = np.where(letter, data, 0).astype(np.uint64)
    # n-grams begin at the blank before a word and end at the blank behind it.
    text = np.concatenate([[np.uint64(0)], text, np.zeros(max(SIZES), np.uint64)])
    word = np.full(len(data) + 1, -1, np.int64)
    lengths = stop - start + 1
    places = np.arange(lengths.sum()) + np.repeat(start - (np.cumsum(lengths) - lengths), lengths)
    word[places] = np.repeat(np.arange(len(start)), lengths)
    behind = np.zeros(len(data) + 1, np.int64)
    behind[places] = np.repeat(stop + 2, lengths)
    at = np.arange(len(data) + 1)
    out = np.full((len(SIZES), len(data) + 1), -1, np.int64)
    h = np.zeros(len(data) + 1, np.uint64)
    row = 0
    for k in range(max(SIZES)):
        h = h * np.uint64(STEP) + text[k : k + len(data) + 1] + np.uint64(1)
        if k + 1 in SIZES:
            real = at + k + 1 <= behind
            out[row][real] = (mix(h[real]) % np.uint64(BUCKETS // len(SIZES))).astype(np.int64) + row * (BUCKETS // len(SIZES))
            row += 1
    return out, word, np.searchsorted(ends, start)


def train(docs: DataFrame) -> dict[str, np.ndarray]:
    """log-probability of each bucket by language, from all rows of docs (text, lang) with a lang."""

    def counted(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for at, data, ends in runs([(t or "").lower() for t in batch.column("text").to_pylist()]):
            grams, word, doc = _ngrams(data, ends)
            own = langs[at : at + len(ends)]
            of = np.where(word >= 0, doc[word], -1) if len(doc) else word
            for lang in set(own.tolist()):
                mine = np.append(own == lang, False)[of]
                found = grams[:, mine]
                yield lang, found[found >= 0]

    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("lang is not null and text is not null")
    counts = add_counts(rows, counted, BUCKETS)
    size = BUCKETS // len(SIZES)
    out = {}
    for lang, n in counts.items():
        p = np.zeros(BUCKETS)
        for k in range(len(SIZES)):
            part = n[k * size : (k + 1) * size] + 0.05
            p[k * size : (k + 1) * size] = np.log(part / part.sum())
        out[lang] = p / len(SIZES)
    return out


def _mixtures(loglik: np.ndarray, doc: np.ndarray, n_docs: int, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shares of the languages: one row a language, log-likelihood) by document; doc is sorted and has each document."""
    top = loglik.max(axis=0)
    like = np.exp(loglik - top)
    first = np.searchsorted(doc, np.arange(n_docs))
    n = np.diff(np.append(first, len(doc)))
    share = allowed / allowed.sum(axis=0)
    for _ in range(ROUNDS):
        r = share[:, doc]
        r *= like
        r /= r.sum(axis=0) + 1e-300
        share = np.add.reduceat(r, first, axis=1) / n
    total = np.log((share[:, doc] * like).sum(axis=0) + 1e-300) + top
    return share, np.add.reduceat(total, first)


def mixtures(texts: list[str | None], table: np.ndarray) -> np.ndarray:
    """Shares of the languages (rows of table) in each text; rows of zeros for texts without a letter.

    Words are the units: the n-grams of a word give its likelihood in each language, and EM the languages' shares among
    the words. Of the nested sets of the first 1, 2, ... languages by share, that of the largest likelihood less PENALTY
    times log(words) for each language is taken.
    """
    n_langs = len(table)
    out = np.zeros((len(texts), n_langs))
    for at, data, ends in runs([(t or "").lower() for t in texts]):
        grams, word, doc = _ngrams(data, ends)
        if not len(doc) or not n_langs:
            continue
        loglik = np.zeros((n_langs, len(doc)))
        for row in grams:
            real = np.flatnonzero(row >= 0)
            w = word[real]
            # Each word has bigrams at least: w is sorted, and sums by word are sums of runs.
            firsts = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]])) if len(w) else np.zeros(0, np.int64)
            if len(firsts):
                bucket = row[real]
                for j in range(n_langs):
                    loglik[j, w[firsts]] += np.add.reduceat(table[j][bucket], firsts)
        there, local = np.unique(doc, return_inverse=True)
        n = len(there)
        first = np.searchsorted(local, np.arange(n))
        words = np.diff(np.append(first, len(local)))
        # One language: the sum of its log-likelihoods.
        single = np.add.reduceat(loglik, first, axis=1)
        penalty = PENALTY * np.log(words + 1.0)
        best, score = np.eye(n_langs)[single.argmax(axis=0)], single.max(axis=0) - penalty
        full, most = _mixtures(loglik, local, n, np.ones((n_langs, n)))
        # No set can be likelier than all languages together: only where these beat the penalty sets are compared.
        open_ = np.flatnonzero(most - 2 * penalty > score)
        if len(open_):
            mine = np.isin(local, open_)
            sub, part = np.searchsorted(open_, local[mine]), loglik[:, mine]
            rank = np.argsort(np.argsort(-full[:, open_], axis=0, kind="stable"), axis=0)
            for k in range(2, n_langs + 1):
                share, total = _mixtures(part, sub, len(open_), (rank < k).astype(float))
                gains = total - k * penalty[open_] > score[open_]
                best[open_[gains]], score[open_[gains]] = share[:, gains].T, (total - k * penalty[open_])[gains]
        out[at + there] = best
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def predict(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, lang_pred, score, langs) of every row of docs (doc_id, text).

    lang_pred is the language of the largest share (of equal ones the first by name), score its share, and langs the
    languages of the chosen set with their shares. A text that is null or has no letter, or a model of no language,
    gives und, 0 and an empty list. A letter that the model can't use (no word of letters is found) can't occur: every
    letter is a word's. Other columns are ignored; repeated rows stay.
    """
    names = sorted(model)
    table = np.array([model[k] for k in names], np.float32) if names else np.zeros((0, BUCKETS), np.float32)
    shared = docs.sparkSession.sparkContext.broadcast(table)  # 1 MB a language, whatever the number of documents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column("text").to_pylist()
                share = mixtures(texts, shared.value)
                known = np.array([has_letter(t) for t in texts]) & (share.sum(axis=1) > 0) if names else np.zeros(len(texts), bool)
                best = share.argmax(axis=1) if names else np.zeros(len(texts), np.int64)
                langs = [[{"lang": names[j], "share": float(s[j])} for j in np.argsort(-s, kind="stable") if s[j] > 0] if ok else [] for ok, s in zip(known, share, strict=True)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column("doc_id"),
                        "lang_pred": [names[b] if ok else "und" for ok, b in zip(known, best, strict=True)],
                        "score": np.where(known, share[np.arange(len(texts)), best], 0.0) if names else np.zeros(len(texts)),
                        "langs": pa.array(langs, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))),
                    }
                )

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, langs array<struct<lang:string,share:double>>")


def held_out(doc_id: str | Column, folds: int = 5) -> Column:
    """Whether the remainder of crc32(doc_id as text) is 0; false for a null doc_id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))
