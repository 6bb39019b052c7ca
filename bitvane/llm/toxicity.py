"""Toxicity: a convolutional text classifier, trained in numpy.

A word's embedding is the sum of three hashed rows: of the whole word and of its first four and
five bytes, so an unseen ending of a known stem still counts. Filters one, two and three words
wide run over the embeddings; each keeps its maximum over the text; a linear layer gives the
logit. The rows start from the log odds of a hash in toxic against other texts that are trained
on, then all parameters are trained by Adam on the log loss, and kept as they were after the
epoch of least loss on a quarter of the texts that isn't trained on. On that quarter, too, thresholds are
calibrated by language: a language's cut is drawn towards that of all languages together, which weighs
as 20 examples of its rarer kind do; a language without examples of both kinds has that cut. The
language is the text's own, as its words tell (naive Bayes over hashed words); no column but the text
enters a score.

All labelled texts are learnt from, where they lie: they are dealt into parts of some PART_ROWS by a hash of the id and
written once. In each of the rounds every part is trained through from the same parameters, and what the parts
changed is averaged (of a hash's row, over the parts that changed it). Counts and changes are added as integers, so a
model is the same in every run. A task sends a matrix of the parameters' size, the driver gets one for each round.

score = sigmoid(logit - the language's threshold), so 0.5 is the calibrated cut.

Defined results: null and empty texts have no words and get the score of a text whose filters all
stay at rest; without labels of both kinds every score is 0; a text labelled twice is toxic if one
of its labels says so; null labels and ids in the label table are left out; a very long text is scored
whole, by one task, in memory of some forty times its size; repeated rows get the same score; of
places with the same maximum the first counts in training. No rows, no rows. Columns that clash with
the output are replaced by it; others pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _bloom, _sample
from ._spark import bound_batches, fold, fresh, materialize, scope, scratch_path, table
from ._words import Block, blocks

WIDTHS, FILTERS, DIM = (1, 2, 3), 8, 8
BATCH, RATE, ROUNDS = 96, 0.01, 6
#: Labelled texts of a part, on average, and the characters after which a step takes no more texts.
PART_ROWS, STEP_CHARS = 8000, 2_000_000
#: Languages with a threshold of their own: the most frequent ones.
MAX_LANGS = 256
#: Rows of parameters or counts that are added up together.
SLICE = 1024
#: Places to which logits are rounded before cuts are chosen.
CUTS = 256


@dataclass
class Sample:
    """Texts to learn from, already in order; lang None where it isn't known."""

    texts: list[str]
    toxic: np.ndarray
    lang: list[str | None] = field(default_factory=list)


class ConvClassifier:
    def __init__(self, buckets_log2: int = 18, lang_buckets_log2: int = 14, seed: int = 1):
        self.buckets, self.lang_buckets = 1 << buckets_log2, 1 << lang_buckets_log2
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.02, (self.buckets, DIM)).astype(np.float32)
        self.filters = [rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32)
        self.base = np.float32(0)
        self.langs: list[str] = []
        self.lang_table = np.zeros((self.lang_buckets, 0), np.float32)
        self.thresholds = np.zeros(1, np.float32)
        self.trained = False

    # -- features ---------------------------------------------------------------------------

    def _rows(self, block: Block) -> list[np.ndarray]:
        mask = np.uint64(self.buckets - 1)
        found = (block.words(1), block.prefixes(4, 2), block.prefixes(5, 3))
        return [(h & mask).astype(np.int32) for h in found]

    def _places(self, block: Block) -> tuple[np.ndarray, np.ndarray, int]:
        """Each word's place when every text is followed by resting places, so no filter spans two texts."""
        pad = max(WIDTHS)
        text = np.repeat(np.arange(block.n), block.counts)
        starts = block.first + pad * np.arange(block.n)
        return np.arange(len(block.starts)) + pad * text, starts, len(block.starts) + pad * block.n

    def _forward(self, block: Block, keep: bool = False):
        rows = self._rows(block)
        places, starts, size = self._places(block)
        x = np.zeros((size + max(WIDTHS), DIM), np.float32)
        x[places] = self.table[rows[0]] + self.table[rows[1]] + self.table[rows[2]]
        pooled, where = [], []
        for w, f in zip(WIDTHS, self.filters):
            a = x[:size] @ f[0]
            for j in range(1, w):
                a += x[j : size + j] @ f[j]
            # over the places from a text's first word to the resting place after its last
            m = np.maximum.reduceat(a, np.stack((starts, starts + block.counts + 1), axis=1).ravel(), axis=0)[::2]
            pooled.append(m)
            if keep:
                where.append(self._first_at(a, m, starts, size))
        z = np.concatenate(pooled, axis=1) + self.bias
        h = np.maximum(z, 0)
        logit = h @ self.out + self.base
        return (logit, z, h, where, x, rows, places) if keep else logit

    @staticmethod
    def _first_at(a: np.ndarray, m: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        """Where each text's maximum of each filter is first met."""
        text = np.zeros(size, np.int64)
        text[starts[1:]] = 1
        text = np.cumsum(text)
        at, column = np.nonzero(a == m[text])
        out = np.zeros(m.shape, np.int64)
        out[text[at[::-1]], column[::-1]] = at[::-1]
        return out

    def _lang_of(self, block: Block) -> np.ndarray:
        """Index of the likeliest language of each text."""
        if len(self.langs) < 2 or not len(block.starts):
            return np.zeros(block.n, np.int64)
        rows = (block.words(5) & np.uint64(self.lang_buckets - 1)).astype(np.int32)
        sums = np.concatenate((np.zeros((1, len(self.langs))), np.cumsum(self.lang_table[rows], axis=0, dtype=np.float64)))
        return np.argmax(sums[block.first + block.counts] - sums[block.first], axis=1)

    # -- training ---------------------------------------------------------------------------

    def fit(self, sample: Sample, epochs: int = ROUNDS, batch: int = BATCH, rate: float = RATE, seed: int = 3) -> ConvClassifier:
        """Train on three quarters of the sample; on the rest, choose the epoch of least log loss and calibrate."""
        y = np.asarray(sample.toxic, np.float32)
        if len(set(y.tolist())) < 2:
            return self
        order = np.random.default_rng(seed).permutation(len(y))
        aside = order % 4 == 0
        train = np.flatnonzero(~aside) if len(set(y[~aside].tolist())) == 2 else np.arange(len(y))
        held = np.flatnonzero(aside) if aside.any() else np.arange(len(y))
        self._start(sample, train, y)
        self._learn_langs(sample)
        rng = np.random.default_rng(seed)
        state, step = self._moments(), 0
        weight = np.where(y > 0, 0.5 / max(y[train].mean(), 1e-6), 0.5 / max(1 - y[train].mean(), 1e-6)).astype(np.float32)
        best, kept = self._loss(sample, held, y, weight), self._parameters()
        for _ in range(epochs):
            rng.shuffle(train)
            for i in range(0, len(train), batch):
                step += 1
                chosen = train[i : i + batch]
                self._step(Block([sample.texts[j] for j in chosen]), y[chosen], weight[chosen], rate, step, *state)
            loss = self._loss(sample, held, y, weight)
            if loss < best:
                best, kept = loss, self._parameters()
        self.table, self.filters, self.bias, self.out, self.base = kept
        self.trained = True
        self._calibrate(sample, held, y)
        return self

    def _moments(self) -> tuple:
        """What the optimisers remember, before the first step."""
        state = {k: [np.zeros_like(getattr(self, k)), np.zeros_like(getattr(self, k))] for k in ("bias", "out", "base")}
        return state, [[np.zeros_like(f), np.zeros_like(f)] for f in self.filters], np.zeros(self.buckets, np.float32)

    def _parameters(self) -> tuple:
        return self.table.copy(), [f.copy() for f in self.filters], self.bias.copy(), self.out.copy(), self.base

    def _loss(self, sample: Sample, held: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
        logit = np.concatenate([self._forward(block) for _, _, block in blocks([sample.texts[j] for j in held])])
        return float((weight[held] * np.logaddexp(0, np.where(y[held] > 0, -logit, logit))).sum() / weight[held].sum())

    def _start(self, sample: Sample, train: np.ndarray, y: np.ndarray) -> None:
        seen = np.zeros((2, self.buckets), np.float32)
        self._count([sample.texts[j] for j in train], y[train], seen)
        self._begin(seen, np.array([(y[train] == 0).sum(), (y[train] > 0).sum()], np.float32))

    def _count(self, texts: list[str], y: np.ndarray, seen: np.ndarray) -> None:
        """Add to seen, kinds x hashes, the texts of each kind that hold the hash."""
        for a, b, block in blocks(texts):
            text = np.repeat(np.arange(block.n), block.counts)
            for rows in self._rows(block):
                once = np.unique(text.astype(np.int64) * self.buckets + rows)
                labels = y[a:b][once // self.buckets] > 0
                for k in (0, 1):
                    np.add.at(seen[k], once[labels == bool(k)] % self.buckets, 1)

    def _begin(self, seen: np.ndarray, n: np.ndarray) -> None:
        """Rows' first coordinate: log odds of the hash in toxic texts; one filter of each width reads it."""
        odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
        few = seen.sum(axis=0) < 3
        self.table[:, 0] = np.where(few, 0, np.clip(odds, -2, 6) / 3)
        for f in self.filters:
            f[:, 0, 0] = 1.0 / len(f)
        self.bias[:: len(self.bias) // len(WIDTHS)] = -1.5
        self.out[:: len(self.out) // len(WIDTHS)] = 2.0
        self.base = np.float32(-2)

    def _step(self, block, y, weight, rate, step, state, fstate, tstate) -> None:
        logit, z, h, where, x, rows, places = self._forward(block, keep=True)
        g = ((1 / (1 + np.exp(-logit)) - y) * weight / len(y)).astype(np.float32)
        gh = g[:, None] * self.out * (z > 0)
        grads = {"bias": gh.sum(axis=0), "out": h.T @ g, "base": g.sum()}
        back = np.full(len(x), -1, np.int64)
        back[places] = np.arange(len(places))
        touched, tgrads = [], []
        for k, (w, f) in enumerate(zip(WIDTHS, self.filters)):
            gk, at = gh[:, k * FILTERS : (k + 1) * FILTERS], where[k]
            gf = np.zeros_like(f)
            for j in range(w):
                taken = x[at + j]  # texts x filters x DIM
                gf[j] = np.einsum("tf,tfd->df", gk, taken)
                word = back[at + j].ravel()
                gx = (gk[:, :, None] * f[j].T[None]).reshape(-1, DIM)
                real = (word >= 0) & (np.abs(gk).ravel() > 0)
                for r in rows:
                    touched.append(r[word[real]])
                    tgrads.append(gx[real])
            self._adam(f, gf, fstate[k], rate, step)
        for name, grad in grads.items():
            value = np.atleast_1d(getattr(self, name)).astype(np.float32)
            held = [np.atleast_1d(s) for s in state[name]]
            self._adam(value, np.atleast_1d(grad), held, rate, step)
            state[name] = held
            setattr(self, name, value if name != "base" else np.float32(value[0]))
        ids, at = np.unique(np.concatenate(touched), return_inverse=True)
        total = np.zeros((len(ids), DIM), np.float32)
        np.add.at(total, at, np.concatenate(tgrads))
        tstate[ids] += (total**2).mean(axis=1)  # AdaGrad by row: the rows that a batch meets are few
        self.table[ids] -= rate * total / (np.sqrt(tstate[ids])[:, None] + 1e-6)

    @staticmethod
    def _adam(value, grad, moments, rate, step) -> None:
        moments[0] *= 0.9
        moments[0] += 0.1 * grad
        moments[1] *= 0.999
        moments[1] += 0.001 * grad**2
        value -= rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-7)

    def _learn_langs(self, sample: Sample) -> None:
        self.langs = sorted({x for x in sample.lang if x is not None})
        if len(self.langs) < 2:
            return
        seen = np.zeros((self.lang_buckets, len(self.langs)), np.float64)
        of = {x: i for i, x in enumerate(self.langs)}
        known = [i for i, x in enumerate(sample.lang) if x is not None]
        self._count_langs([sample.texts[i] for i in known], np.array([of[sample.lang[i]] for i in known]), seen)
        self._set_langs(seen)

    def _count_langs(self, texts: list[str], lang: np.ndarray, seen: np.ndarray) -> None:
        """Add to seen, hashes x languages, the words of texts in the languages of these indices."""
        for a, b, block in blocks(texts):
            rows = (block.words(5) & np.uint64(self.lang_buckets - 1)).astype(np.int64)
            label = np.repeat(lang[a:b], block.counts)
            np.add.at(seen, (rows, label), 1)

    def _set_langs(self, seen: np.ndarray) -> None:
        p = (seen + 0.1) / (seen + 0.1).sum(axis=0)
        self.lang_table = np.log(p / p.mean(axis=1, keepdims=True)).astype(np.float32)

    def _calibrate(self, sample: Sample, held: np.ndarray, y: np.ndarray, drawn: float = 20.0) -> None:
        """Each language's cut: the middle of the widest gap among the cuts with the most right answers.

        It is averaged with the general cut, by n examples of the language's rarer kind against drawn.
        """
        logits, langs = [], []
        for _, _, block in blocks([sample.texts[j] for j in held]):
            logits.append(self._forward(block))
            langs.append(self._lang_of(block))
        self._set_thresholds(np.concatenate(logits), np.concatenate(langs), y[held], None, drawn)

    def _set_thresholds(self, logit: np.ndarray, lang: np.ndarray, y: np.ndarray, times: np.ndarray | None, drawn: float = 20.0) -> None:
        """_calibrate() of logits, their languages and labels; times, how often each is met, if not once."""
        times = np.ones(len(y), np.int64) if times is None else times
        general = self._cut(logit, y, 0.0, times)
        self.thresholds = np.full(max(1, len(self.langs)), general, np.float32)
        for k in range(len(self.langs)):
            own = lang == k
            toxic = int(times[own & (y > 0)].sum())
            n = min(toxic, int(times[own].sum()) - toxic)
            if n:
                self.thresholds[k] = (n * self._cut(logit[own], y[own], general, times[own]) + drawn * general) / (n + drawn)

    @staticmethod
    def _cut(logit: np.ndarray, y: np.ndarray, otherwise: float, times: np.ndarray | None = None) -> float:
        if len(set(y.tolist())) < 2:
            return otherwise
        order = np.argsort(logit, kind="stable")
        a, t, n = logit[order], y[order] > 0, np.ones(len(y), np.int64) if times is None else times[order]
        # a cut before place i calls i.. toxic: errors are the toxic before it and the others after it
        errors = np.concatenate(([0], np.cumsum(t * n))) + np.concatenate((np.cumsum((~t * n)[::-1])[::-1], [0]))
        edge = np.concatenate(([a[0] - 1], a, [a[-1] + 1])).astype(np.float64)
        gap = np.where(errors == errors.min(), edge[1:] - edge[:-1], -1)
        i = int(np.argmax(gap))
        return float((edge[i] + edge[i + 1]) / 2)

    # -- parameters as one matrix -------------------------------------------------------------

    def _flat(self) -> np.ndarray:
        """All parameters as rows of DIM: the hashed rows, then the others."""
        others = np.concatenate([*[f.ravel() for f in self.filters], self.bias, self.out, [self.base]]).astype(np.float32)
        return np.concatenate((self.table, np.pad(others, (0, -len(others) % DIM)).reshape(-1, DIM)))

    def _from_flat(self, flat: np.ndarray) -> None:
        self.table, others, at = flat[: self.buckets].copy(), flat[self.buckets :].ravel(), 0
        taken = []
        for like in (*self.filters, self.bias, self.out, np.zeros(1)):
            taken.append(others[at : at + like.size].reshape(like.shape).astype(np.float32))
            at += like.size
        self.filters, self.bias, self.out, self.base = taken[: len(self.filters)], taken[-3], taken[-2], np.float32(taken[-1][0])

    # -- scoring ----------------------------------------------------------------------------

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not self.trained:
            return np.zeros(len(texts))
        out = np.empty(len(texts))
        for a, b, block in blocks(texts):
            logit = self._forward(block).astype(np.float64) - self.thresholds[self._lang_of(block)]
            out[a:b] = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
        return out


def train(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    lang: str | None = "lang",
    max_toxic: int | None = None,
    max_other: int | None = None,
    max_chars: int | None = None,
    usable=None,
) -> ConvClassifier:
    """Fit on all labelled documents, in the workers. Any of max_toxic, max_other and max_chars asks for a sample, which is fitted on the driver.

    Of rows that repeat an id one is learnt from, that of the least text hash. Ids of any type are compared as text.
    usable, a function of the id column's name, tells which labelled rows may be learnt from.
    """
    name = F.col(f"`{doc_id}`")
    known, rows = labels.where(name.isNotNull() & F.col(f"`{label}`").isNotNull()), docs.where(name.isNotNull())
    if usable is not None:
        known, rows = known.where(usable(doc_id)), rows.where(usable(doc_id))
    known = known.groupBy(name.cast("string").alias("id")).agg((F.max(f"`{label}`") > 0).alias("toxic"))
    if max_toxic is not None or max_other is not None or max_chars is not None:
        bounds = [default if x is None else x for x, default in ((max_toxic, 2000), (max_other, 4000), (max_chars, 24_000_000))]
        return _train_sample(docs, known, doc_id, text, lang, *bounds)
    language = F.col(f"`{lang}`").cast("string") if lang and lang in docs.columns else F.lit(None).cast("string")
    rows = rows.select(name.cast("string").alias("id"), F.col(f"`{text}`").alias("text"), language.alias("lang"))
    bound_batches(docs.sparkSession)
    with scope(docs.sparkSession):
        return _train_parts(_written_parts(rows, known))


def _written_parts(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(part, aside, toxic, text, lang) of labelled rows (id, text, lang), a file a part, in the order of a hash."""
    spark, n = rows.sparkSession, known.count()
    parts, h = max(1, -(-n // PART_ROWS)), F.xxhash64("id")
    # only texts that may have a label are shuffled
    filters = _bloom.block_count(n, 16, 64 << 20)
    rows, maybe = _bloom.flag(rows, h, _bloom.build(known, h, filters), filters)
    dealt = rows.where(F.col(maybe)).drop(maybe).repartition(parts, "id")
    first = F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64("text"), "text", "lang"))
    dealt = dealt.withColumn("_first", first).where("_first = 1").join(known.repartition(parts, "id"), "id")
    placed = dealt.withColumn("part", F.pmod(F.hash("id"), F.lit(parts))).withColumn("at", _sample.place(F.col("id"), salt=11))
    path = scratch_path(spark, "toxicity")
    ordered = placed.sortWithinPartitions("part", "at", "id").select("part", (_sample.place(F.col("id"), salt=13) < 0.25).alias("aside"), "toxic", "text", "lang")
    ordered.write.option("compression", "zstd").parquet(path)
    return spark.read.schema("part int, aside boolean, toxic boolean, text string, lang string").parquet(path)


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[Iterator[pd.DataFrame]]:
    """The batches of a task by part, cut where one ends and the next begins."""
    pieces = (piece for batch in batches if len(batch) for _, piece in batch.groupby("part", sort=False))
    for _, run in groupby(pieces, lambda piece: piece["part"].iloc[0]):
        yield run


def _steps(texts: list[str | None]) -> Iterator[slice]:
    """Slices of at most BATCH texts, that end where their characters pass STEP_CHARS."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if i + 1 - at == BATCH or size > STEP_CHARS:
            yield slice(at, i + 1)
            at, size = i + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


def _slices(kind: int, matrix: np.ndarray) -> pd.DataFrame:
    """(kind, slice, data) of a matrix' rows, SLICE rows at a time; those of zeros alone are left out."""
    matrix = np.ascontiguousarray(np.pad(matrix, ((0, -len(matrix) % SLICE), (0, 0))))
    cut = matrix.reshape(-1, SLICE * matrix.shape[1])
    used = np.flatnonzero(cut.any(axis=1))
    return pd.DataFrame({"kind": np.full(len(used), kind, np.int32), "slice": used.astype(np.int32), "data": [cut[i].tobytes() for i in used]})


SLICES = "kind int, slice int, data binary"


def _added(sent: DataFrame, kind: str, out) -> dict[tuple[int, int], np.ndarray]:
    """By kind and slice: out(sum, parts that aren't zero) of the tasks' data, added as integers, so in any order."""

    def total(key: tuple, frames: pd.DataFrame) -> pd.DataFrame:
        sums = used = None
        for data in frames["data"]:
            x = np.frombuffer(data, kind)
            x = np.rint(x.astype(np.float64) * (1 << 24)).astype(np.int64) if kind == "<f2" else x.astype(np.int64)
            any_ = x.reshape(-1, DIM).any(axis=1) if kind == "<f2" else np.zeros(0)
            sums, used = (x, any_.astype(np.int64)) if sums is None else (sums + x, used + any_)
        return pd.DataFrame({"kind": [key[0]], "slice": [key[1]], "data": [out(sums, used).tobytes()]})

    return {(r["kind"], r["slice"]): r["data"] for r in sent.groupBy("kind", "slice").applyInPandas(total, SLICES).collect()}  # a matrix of parameters or counts


def _whole(found: dict, kind: int, shape: tuple[int, int], dtype) -> np.ndarray:
    rows, width = shape
    out = np.zeros((-(-rows // SLICE), SLICE * width), dtype)
    for (k, at), data in found.items():
        if k == kind:
            out[at] = np.frombuffer(data, dtype)
    return out.reshape(-1, width)[:rows]


def _train_parts(data: DataFrame) -> ConvClassifier:
    """Rounds over the parts that _written_parts() wrote; what is counted, trained and calibrated is all their rows."""
    spark, model = data.sparkSession, ConvClassifier()
    share = {(r["aside"], r["toxic"]): r["n"] for r in data.groupBy("aside", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    both = lambda asides: [sum(share.get((a, k), 0) for a in asides) for k in (False, True)]
    if min(both((False, True))) == 0:
        return model
    # too few to set a quarter aside: all are trained on
    trained = (False,) if min(both((False,))) else (False, True)
    held = (True,) if sum(both((True,))) else (False, True)
    n = np.array(both(trained), np.float32)
    most = data.where(F.col("lang").isNotNull()).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS)
    model.langs = sorted(r["lang"] for r in most.collect())
    _count_parts(data, model, trained, n)
    weight = 0.5 / np.maximum(n / n.sum(), 1e-6)
    best, kept = np.inf, None
    for r in range(ROUNDS + 1):
        flat = model._flat()
        loss, changed = _round(data, model, trained, held, weight, r)
        if loss < best:
            best, kept = loss, flat
        if changed is not None:
            model._from_flat(flat + changed)
    model._from_flat(kept)
    model.trained = True
    _calibrate_parts(data, model, held)
    return model


def _chosen(piece: pd.DataFrame, asides: tuple) -> pd.DataFrame:
    return piece[piece["aside"].isin(asides)]


def _count_parts(data: DataFrame, model: ConvClassifier, trained: tuple, n: np.ndarray) -> None:
    """Start the model from counts over all texts that are trained on, and languages from all texts."""
    sent = _sent(data, model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        of = {x: i for i, x in enumerate(m.langs)}
        seen, spoken = np.zeros((2, m.buckets), np.int32), np.zeros((m.lang_buckets, len(of)), np.int32)
        for batch in batches:
            own = _chosen(batch, trained)
            m._count(own["text"].tolist(), own["toxic"].to_numpy(np.float32), seen)
            if len(of) > 1:
                own = batch[batch["lang"].isin(m.langs)]
                m._count_langs(own["text"].tolist(), own["lang"].map(of).to_numpy(np.int64), spoken)
        yield _slices(0, seen.T)
        for i in range(len(of)):
            yield _slices(1 + i, spoken[:, i : i + 1])

    found = _added(data.mapInPandas(run, SLICES), "<i4", lambda sums, _: sums)
    model._begin(_whole(found, 0, (model.buckets, 2), np.int64).T.astype(np.float32), n)
    if len(model.langs) > 1:
        model._set_langs(np.concatenate([_whole(found, 1 + i, (model.lang_buckets, 1), np.int64) for i in range(len(model.langs))], axis=1).astype(np.float64))


def _sent(data: DataFrame, model: ConvClassifier):
    return data.sparkSession.sparkContext.broadcast(model)  # a few MB, whatever the corpus


def _round(data: DataFrame, model: ConvClassifier, trained: tuple, held: tuple, weight: np.ndarray, r: int) -> tuple[float, np.ndarray | None]:
    """(loss on the texts held out, the change that the parts make on average) from the model; after the last round the loss alone."""
    sent, rate = _sent(data, model), RATE

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        start, loss = m._flat(), 0
        for part in _runs(batches):
            own = ConvClassifier()
            own._from_flat(start)
            state, step = own._moments(), 0
            for piece in part:
                aside = _chosen(piece, held)
                y = aside["toxic"].to_numpy(np.float32)
                for a, b, block in blocks(aside["text"].tolist()):
                    logit = m._forward(block).astype(np.float64)
                    # millionths, as they are added in any order
                    loss += int(np.rint(1e6 * weight[y[a:b].astype(int)] * np.logaddexp(0, np.where(y[a:b] > 0, -logit, logit))).sum())
                if r == ROUNDS:
                    continue
                piece = _chosen(piece, trained)
                texts, y = piece["text"].tolist(), piece["toxic"].to_numpy(np.float32)
                w = weight[y.astype(int)].astype(np.float32)
                for at in _steps(texts):
                    step += 1
                    own._step(Block(texts[at]), y[at], w[at], rate, step, *state)
            if step:
                change = np.clip(own._flat() - start, -1000, 1000).astype("<f2")
                yield _slices(0, change)
        yield pd.DataFrame({"kind": np.array([1], np.int32), "slice": np.array([0], np.int32), "data": [np.array([loss], "<i8").tobytes()]})

    rows = data.mapInPandas(run, SLICES)
    rows = materialize(rows, f"toxicity-round-{r}")
    loss = sum(int(np.frombuffer(x["data"], "<i8")[0]) for x in rows.where("kind = 1").collect())  # a number a task
    if r == ROUNDS:
        return loss, None
    found = _added(rows.where("kind = 0"), "<f2", lambda sums, used: (sums.reshape(-1, DIM) / (1 << 24) / np.maximum(used, 1)[:, None]).astype(np.float32))
    return loss, _whole(found, 0, model._flat().shape, np.float32)


def _calibrate_parts(data: DataFrame, model: ConvClassifier, held: tuple) -> None:
    """Thresholds from all texts held out, of logits that are rounded to 1 / CUTS."""
    sent = _sent(data, model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = _chosen(batch, held)
            toxic = own["toxic"].to_numpy(bool)
            for a, b, block in blocks(own["text"].tolist()):
                place = np.rint(np.clip(sent.value._forward(block).astype(np.float64), -1000, 1000) * CUTS).astype(np.int64)
                yield pd.DataFrame({"lang": sent.value._lang_of(block), "place": place, "toxic": toxic[a:b]})

    counts = data.mapInPandas(run, "lang long, place long, toxic boolean").groupBy("lang", "place", "toxic").agg(F.count(F.lit(1)).alias("n"))
    found = counts.orderBy("lang", "place", "toxic").toPandas()  # of bounded places
    model._set_thresholds(found["place"].to_numpy() / CUTS, found["lang"].to_numpy(), found["toxic"].to_numpy(np.float32), found["n"].to_numpy())


def _train_sample(docs: DataFrame, known: DataFrame, doc_id: str, text: str, lang: str | None, max_toxic: int, max_other: int, max_chars: int) -> ConvClassifier:
    """Fit on a bounded sample: at most max_toxic and max_other labelled documents, of max_chars in all.

    The sample is drawn by a hash of the id, the same in every run and whatever a text's length; texts are whole,
    and one longer than what is left of max_chars is passed over. Characters are counted before texts
    are collected.
    """
    name = F.col(f"`{doc_id}`")
    many = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    at = _sample.place(F.col("id"), salt=11)
    ids: dict[str, tuple[float, bool]] = {}
    for kind, most in ((True, max_toxic), (False, max_other)):
        share = min(1.0, 1.2 * most / max(1, many.get(kind, 0)))
        drawn = known.where((F.col("toxic") == kind) & (at < share)).select("id", at.alias("at")).orderBy("at", "id").limit(most)
        ids.update({r["id"]: (r["at"], kind) for r in drawn.collect()})
    if not ids:
        return ConvClassifier()
    picked = docs.sparkSession.createDataFrame([(i,) for i in ids], "_id string")
    rows = docs.select(name.cast("string").alias("_id"), F.struct(_sample.text_hash(text).alias("hash"), F.length(f"`{text}`").alias("n")).alias("of"))
    found = rows.join(F.broadcast(picked), "_id").groupBy("_id").agg(F.min("of").alias("of")).collect()  # a bounded list of ids
    found.sort(key=lambda r: (ids[r["_id"]][0], r["_id"]))
    keys = _sample.within((((r["_id"], r["of"]["hash"]), r["of"]["n"] or 0) for r in found), max_chars)
    more = [lang] if lang and lang in docs.columns else []
    texts = _sample.texts_of(docs, keys, doc_id, text, *more)
    used = [(texts[k], ids[k[0]][1]) for k in sorted(k for k in keys if k in texts)]
    return ConvClassifier().fit(Sample([r["text"] or "" for r, _ in used], np.array([y for _, y in used], np.float32), [r[lang] if more else None for r, _ in used]))


def score(docs: DataFrame, model: ConvClassifier, text: str = "text", score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """docs with a score in 0..1 and predicted, 1 where the score is at least 0.5."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, whatever the corpus

    @F.pandas_udf("double")
    def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(held.value.score(texts.tolist()))

    scored = docs.withColumn(score_col, toxic(F.col(f"`{text}`")))
    return scored.withColumn(predicted_col, (F.col(score_col) >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: ConvClassifier, text: str = "text") -> DataFrame:
    """The rows of docs that aren't predicted toxic, with the columns of docs."""
    s, p = fresh(docs, "score", "predicted")
    return score(docs, model, text, s, p).where(F.col(p) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), usable=lambda name: fold(name, 5) != 0)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


QUERIES = {"op1_toxicity": op1_toxicity}
ORACLE_SQL: dict[str, str] = {}
