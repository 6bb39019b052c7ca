"""Language ID by mixture inference.

Each learned language has a table of hashed byte n-grams (at each byte of a word, the four bytes up
to it, fewer at its start; smoothed towards all languages together) that gives every word of a
text a likelihood. A text is a mixture of languages over its words:
expectation-maximisation estimates the proportions, for nested sets of languages, largest share
first, of any size that could still be best. The set whose log likelihood, less a multiple of log(words) for each further language, is
best is the text's language set; the prediction is its largest member, and the score that member's share.

Defined results: `und` with score 0 for null texts, texts without a letter, and where nothing was
learned; rows whose lang is null teach nothing; repeated rows get the same answer; ties go to the
language that sorts first; a very long text is read whole, by one task, in memory of some forty times
its size. No rows, no rows. Columns that clash with the output are replaced by it; others pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _sample
from ._spark import fold, fresh, table
from ._words import Block, blocks

UND = "und"
_LETTER = re.compile(r"[^\W\d_]")


class MixtureModel:
    def __init__(self, orders: int = 4, buckets_log2: int = 16, rounds: int = 8, penalty: float = 3.0, sharpness: float = 1.0):
        self.orders, self.buckets, self.rounds = orders, 1 << buckets_log2, rounds
        self.penalty, self.sharpness = penalty, sharpness
        self.langs: list[str] = []
        self.logs = np.zeros((self.buckets, 0), np.float32)

    def _contexts(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(bucket of the n-gram that ends at each byte of a word, the word of each), n the model's order or less at a word's start.

        A word is read with the byte before it, which marks its start.
        """
        lengths = block.ends - block.starts
        word = np.repeat(np.arange(len(lengths)), lengths)
        first = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        within = np.arange(len(word)) - first[word]
        end = block.starts[word] + within + 1
        start = np.maximum(end - self.orders, block.starts[word])
        # at a word's start the gram is shorter, and its salt tells it from the same bytes further in
        h = (block.sums[end] - block.sums[start]) * block.inverse[start]
        h ^= np.where(within < self.orders - 1, np.uint64(0x9E3779B97F4A7C15), np.uint64(0))
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        return (h >> np.uint64(64 - self.buckets.bit_length() + 1)).astype(np.int32), first

    def fit(self, texts: Sequence[str], langs: Sequence[str]) -> MixtureModel:
        self.langs = sorted(set(langs))
        of = {x: i for i, x in enumerate(self.langs)}
        label = np.array([of[x] for x in langs], np.int64)
        seen = np.zeros(self.buckets * len(self.langs))
        for a, b, block in blocks(texts):
            if not len(block.starts):
                continue
            grams, first = self._contexts(block)
            per_word = np.diff(np.append(first, len(grams)))
            of_word = np.repeat(label[a:b], block.counts)
            key = grams.astype(np.int64) * len(self.langs) + np.repeat(of_word, per_word)
            seen += np.bincount(key, minlength=len(seen))
        seen = seen.reshape(self.buckets, -1)
        shared = seen.sum(axis=1, keepdims=True) / max(1.0, seen.sum())
        total = seen.sum(axis=0)
        # each language's gram shares, smoothed towards those of all languages together and towards none
        p = (seen + 50 * shared + 0.02) / (total + 50 + 0.02 * self.buckets)
        self.logs = np.log(p / p.mean(axis=1, keepdims=True)).astype(np.float32)
        return self

    def _likelihoods(self, block: Block) -> np.ndarray:
        """words x languages, scaled so that each word's best is 1."""
        grams, first = self._contexts(block)
        ll = np.add.reduceat(self.logs[grams], first, axis=0) * self.sharpness
        ll -= ll.max(axis=1, keepdims=True)
        return np.exp(np.maximum(ll, -30))

    def _em(self, like: np.ndarray, text: np.ndarray, starts: np.ndarray, counts: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shares, log likelihood) of each text over the languages it may use."""
        share = allowed / allowed.sum(axis=1, keepdims=True)
        n = counts[:, None]
        for _ in range(self.rounds):
            r = share.astype(np.float32)[text] * like
            r /= r.sum(axis=1, keepdims=True) + 1e-30
            share = np.add.reduceat(r, starts, axis=0) / n
        total = np.log((share.astype(np.float32)[text] * like).sum(axis=1) + 1e-30)
        return share, np.add.reduceat(total.astype(np.float64), starts)

    def shares(self, block: Block) -> np.ndarray:
        """texts x languages: each text's proportions over its chosen set; 0 for texts without words."""
        out = np.zeros((block.n, len(self.langs)))
        has = np.flatnonzero(block.counts)
        if not len(has) or not self.langs:
            return out
        like = self._likelihoods(block)
        counts = block.counts[has]
        starts = np.concatenate(([0], np.cumsum(counts)))[:-1]
        text = np.repeat(np.arange(len(has)), counts)
        full, whole = self._em(like, text, starts, counts, np.ones((len(has), len(self.langs))))
        rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1, kind="stable")
        own = np.argmax(full, axis=1)
        best = np.add.reduceat(np.log(like[np.arange(len(text)), own[text]] + 1e-30).astype(np.float64), starts)
        won = (rank < 1).astype(np.float64)
        for k in range(2, len(self.langs) + 1):
            cost = self.penalty * (k - 1) * np.log(counts + 1)
            go = np.flatnonzero(-cost > best)  # no word is likelier than 1, so no larger set can be worth more than that
            if not len(go):
                break
            if k == len(self.langs):
                share, ll = full[go], whole[go]
            elif len(go) == len(has):
                share, ll = self._em(like, text, starts, counts, (rank < k).astype(np.float64))
            else:
                n, some = counts[go], np.zeros(len(has), bool)
                some[go] = True
                first = np.concatenate(([0], np.cumsum(n)))[:-1]
                share, ll = self._em(like[some[text]], np.repeat(np.arange(len(go)), n), first, n, (rank[go] < k).astype(np.float64))
            worth = ll - cost[go]
            better = worth > best[go]
            best[go[better]], won[go[better]] = worth[better], share[better]
        out[has] = won
        return out

    def predict(self, texts: Sequence[str | None]) -> tuple[list[str], np.ndarray, list[dict[str, float]]]:
        """Of each text: the language, its share, and the shares of its set."""
        langs, scores, sets = [], [], []
        for a, b, block in blocks(texts):
            shares = self.shares(block)
            for t, row in zip(texts[a:b], shares):
                if t is None or not row.any() or not _LETTER.search(t):
                    langs.append(UND)
                    scores.append(0.0)
                    sets.append({})
                    continue
                i = int(np.argmax(row))
                langs.append(self.langs[i])
                scores.append(float(min(1.0, row[i])))
                sets.append({self.langs[j]: float(row[j]) for j in np.flatnonzero(row > 0)})
        return langs, np.array(scores), sets


def train(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", max_docs: int = 1500, max_chars: int = 3_000_000, max_langs: int = 256, max_chars_in_all: int = 48_000_000,
    usable=None, **options,
) -> MixtureModel:
    """Fit on a bounded sample of labelled rows: at most max_docs texts a language, and max_chars of its text, or an equal share of max_chars_in_all where that is less.

    The sample is drawn by a hash of id and text, the same in every run and whatever a text's length; texts are
    whole, and one longer than what is left for its language is passed over. Characters are counted
    before texts are collected; copies with the same id count once. usable, a function of the id
    column's name, tells which rows may be learnt from. Of more than max_langs languages the most frequent are learnt.
    """
    known = docs.where(F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull())
    if usable is not None:
        known = known.where(usable(doc_id))
    many = {r["lang"]: r["n"] for r in known.groupBy(F.col(f"`{lang}`").alias("lang")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs).collect()}
    if not many:
        return MixtureModel(**options)
    shares = docs.sparkSession.createDataFrame([(name, min(1.0, max_docs / n)) for name, n in many.items()], "lang string, share double")
    rows = known.select(F.col(f"`{doc_id}`").cast("string").alias("id"), _sample.text_hash(text).alias("hash"), F.col(f"`{lang}`").cast("string").alias("lang"), F.length(f"`{text}`").alias("n"))
    rows = rows.withColumn("at", _sample.place(F.col("id"), F.col("hash"), salt=13)).join(F.broadcast(shares), "lang").where("at < share")  # a row a language
    # a hash's share of a language is near max_docs; the bound holds whatever the hash
    found = rows.groupBy("id", "hash", "lang").agg(F.min("at").alias("at"), F.max("n").alias("n")).orderBy("at", "id", "hash", "lang").limit(2 * max_docs * len(many)).collect()
    keys: list[tuple[str | None, int]] = []
    of: dict[tuple[str | None, int], list[str]] = {}
    for name in many:
        own = [((r["id"], r["hash"]), r["n"]) for r in found if r["lang"] == name]
        for key in _sample.within(own, min(max_chars, max_chars_in_all // len(many))):
            keys.append(key)
            of.setdefault(key, []).append(name)
    texts = _sample.texts_of(docs, sorted(of, key=str), doc_id, text)
    used = [(texts[k]["text"], name) for k in sorted(of, key=str) if k in texts for name in of[k]]
    return MixtureModel(**options).fit([t for t, _ in used], [name for _, name in used]) if used else MixtureModel(**options)


def identify(docs: DataFrame, model: MixtureModel, text: str = "text", lang_col: str = "lang_pred", score_col: str = "score", set_col: str | None = "lang_set") -> DataFrame:
    """docs with the language, its share, and the map of the language set's shares."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages, whatever the corpus

    @F.pandas_udf("struct<lang string, score double, shares map<string, double>>")
    def infer(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            langs, scores, sets = held.value.predict(texts.tolist())
            yield pd.DataFrame({"lang": langs, "score": scores, "shares": sets})

    (got,) = fresh(docs, "got")
    out = docs.withColumn(got, infer(F.col(f"`{text}`")))
    out = out.withColumn(lang_col, F.col(f"{got}.lang")).withColumn(score_col, F.col(f"{got}.score"))
    return (out.withColumn(set_col, F.col(f"{got}.shares")) if set_col else out).drop(got)


def keep_identified(docs: DataFrame, model: MixtureModel, text: str = "text", least_share: float = 0.4) -> DataFrame:
    """The rows of docs in one learned language for at least that share, with the columns of docs."""
    lang, share = fresh(docs, "lang", "share")
    found = identify(docs, model, text, lang, share, None)
    return found.where((F.col(lang) != UND) & (F.col(share) >= least_share)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, usable=lambda name: fold(name, 3) != 1)
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "lang_set")


QUERIES = {"op4_language_id": op4_language_id}
ORACLE_SQL: dict[str, str] = {}
