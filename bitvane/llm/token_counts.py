"""Token counts as delta-maintained rollups.

A ledger is a folder of numbered commits. Each holds a batch's signed entries by document (+ for an
insert, - for a delete, both for a revision) and their sums by source, language and tokenizer version,
the batch's delta. Totals are the sums of the deltas, so no commit reads the corpus again. Compaction
adds up all commits so far and commits the result as a snapshot, which later reads start from:
a delete or revision reads the entries of its own documents, in the snapshot and the commits after it.

A batch is written beside the ledger and committed by renaming its folder to the next number, which
only one writer can do on a file system whose rename is atomic, as HDFS's is and most object stores' isn't. A batch id that is committed already is not written again: commits are
idempotent, and a batch that fails leaves the totals as they were. A delete, revision or
compaction that finds another commit between its reading and its own is computed again on what is there
then, so that no two take the same entry away; an insert depends on nothing and takes the next number.

Documents and revisions are counted in whole texts; counts are whatever the counter gives, one for
each tokenizer version.

Defined results: null text has no tokens and no characters, and is the same text as the empty one;
null sources and languages are groups of their own; null ids are documents like others, but no delete
or revision reaches them; an id that is inserted twice counts twice, and a delete takes away all it has;
deleting or revising an unknown id changes nothing. A revision takes the place of one row of its id, and
where old texts are given, of one with its old text; the other rows stay. Of more revisions than there
are rows to replace, the longest count. A very long text is counted whole, by one task. A batch
without rows is committed and changes nothing; an empty ledger has no totals. Ids are integers, or
cast to them; other columns, of whatever name, play no part.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import map_frames, materialize, scope, scratch_path, table

GROUP = ("source", "lang", "tokenizer_version")
ENTRY = "doc_id bigint, text_hash bigint, source string, lang string, tokenizer_version string, docs bigint, tokens bigint, chars bigint"
DELTA = "source string, lang string, tokenizer_version string, docs bigint, tokens bigint, chars bigint"
#: Makes the counts of some texts.
Counter = Callable[[Sequence[str]], Sequence[int]]


class BpeCounter:
    """Counts by a rank file beside the driver; a call, once in each task, makes the counter."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.lines = f.read().splitlines()
        self.pattern = pattern

    def __call__(self) -> Counter:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in self.lines if line)}
        encoding = tiktoken.Encoding("counts", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]


def _hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def counted(docs: DataFrame, makers: dict[str, Callable[[], Counter]], old: str | None = None) -> DataFrame:
    """Entries of docs (doc_id, source, lang, text), one for each tokenizer version, with docs = 1 and the text's hash.

    was is the hash of the column old, the text that is replaced, or 0 without it.
    """
    held = docs.sparkSession.sparkContext.broadcast(makers)  # the vocabularies

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counters = {version: make() for version, make in held.value.items()}
        for batch in batches:
            texts = batch["text"].tolist()
            for version, count in counters.items():
                out = batch[["doc_id", "source", "lang", "text_hash", "was"]].copy()
                out["tokenizer_version"] = version
                out["docs"] = 1
                out["tokens"] = list(count(texts))
                out["chars"] = list(map(len, texts))
                yield out

    text = F.coalesce(F.col("text"), F.lit(""))
    ids = F.col("doc_id").cast("bigint").alias("doc_id")
    was = _hash(old) if old else F.lit(0).cast("bigint")
    rows = docs.select(ids, "source", "lang", text.alias("text"), _hash("text").alias("text_hash"), was.alias("was"))
    return map_frames(rows, run, f"{ENTRY}, was bigint")


def _summed(entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    return entries.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("docs", "tokens", "chars")])


def _signed(entries: DataFrame, sign: int) -> DataFrame:
    return entries.select("doc_id", "text_hash", *GROUP, *[(F.col(c) * sign).alias(c) for c in ("docs", "tokens", "chars")])


class Conflict(Exception):
    """Other commits kept coming between a batch's reading of the state and its own commit."""


@dataclass(frozen=True)
class Commit:
    number: int
    batch_id: str | None  # None for a snapshot


class Ledger:
    def __init__(self, spark: SparkSession, path: str, tries: int = 5, compact_every: int = 100):
        self.spark, self.path, self.tries, self.compact_every = spark, path.rstrip("/"), tries, compact_every
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._Path(f"{self.path}/commits"))

    # -- reading -----------------------------------------------------------------------------

    def commits(self) -> list[Commit]:
        """The last snapshot, if there is one, and all commits after it, in order."""
        out: list[Commit] = []
        for found in self._fs.globStatus(self._Path(f"{self.path}/commits/*/id-*")) or []:
            at = found.getPath()
            name, number = at.getName(), int(at.getParent().getName())
            out.append(Commit(number, None if name == "id-" else name.removeprefix("id-b-")))
        out.sort(key=lambda c: c.number)
        last = max((i for i, c in enumerate(out) if c.batch_id is None), default=0)
        return out[last:]

    def batches(self) -> list[str]:
        """Committed batches' ids."""
        return sorted(self._ids(self.commits()))

    def _ids(self, commits: list[Commit]) -> set[str]:
        found = {c.batch_id for c in commits if c.batch_id is not None}
        for c in commits:
            if c.batch_id is None:
                found |= {r["id"] for r in self.spark.read.schema("id string").parquet(f"{self._folder(c)}/ids").collect()}  # of batches
        return found

    def _folder(self, commit: Commit) -> str:
        return f"{self.path}/commits/{commit.number:012d}"

    def _read(self, what: str, schema: str, commits: list[Commit] | None = None) -> DataFrame:
        paths = [f"{self._folder(c)}/{what}" for c in (self.commits() if commits is None else commits)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, docs, tokens, chars; groups that came to nothing are left out."""
        return _summed(self._read("delta", DELTA), GROUP).where("docs <> 0 or tokens <> 0 or chars <> 0")

    def state(self, ids: DataFrame | None = None, commits: list[Commit] | None = None) -> DataFrame:
        """What each document, or each of ids (doc_id), adds to the totals now, an entry for each text and group it has."""
        entries = self._read("entries", ENTRY, commits).where("doc_id is not null")
        if ids is not None:
            entries = entries.join(ids, "doc_id", "left_semi")
        return _summed(entries, ("doc_id", "text_hash", *GROUP)).where("docs <> 0")

    # -- writing -----------------------------------------------------------------------------

    def insert(self, batch_id: str, docs: DataFrame, makers: dict[str, Callable[[], Counter]]) -> bool:
        return self._commit(batch_id, lambda _: counted(docs, makers).drop("was"), reads=False)

    def delete(self, batch_id: str, ids: DataFrame) -> bool:
        """Take away all that the ids (doc_id) count for."""
        gone = ids.select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id is not null").distinct()
        return self._commit(batch_id, lambda commits: _signed(self.state(gone, commits), -1))

    def revise(self, batch_id: str, docs: DataFrame, makers: dict[str, Callable[[], Counter]], old: str | None = None) -> bool:
        """Replace what rows of known documents count for by new texts, sources and languages.

        A row of docs replaces one row of its id, one whose text is that of the column old if it is given.
        """
        key = ("doc_id", "was")

        def entries(commits: list[Commit]) -> DataFrame:
            # texts are counted where they are read; only counts are shuffled
            revised = materialize(counted(docs.where("doc_id is not null"), makers, old), "op10-counted")
            known = self.state(revised.select("doc_id").distinct(), commits).withColumn("was", F.col("text_hash") if old else F.lit(0).cast("bigint"))
            has = known.groupBy(*key, "tokenizer_version").agg(F.sum("docs").alias("n")).groupBy(*key).agg(F.max("n").alias("n"))
            longest = Window.partitionBy(*key, "tokenizer_version").orderBy(*[F.desc(c) for c in ("chars", "text_hash", "tokens", "source", "lang")])
            new = revised.withColumn("place", F.row_number().over(longest))
            new = new.join(has, list(key)).where("place <= n").drop("n")
            new = materialize(new, "op10-revised")
            many = new.groupBy(*key).agg(F.max("place").alias("many"))
            ahead = Window.partitionBy(*key, "tokenizer_version").orderBy("source", "lang", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
            gone = known.join(many, list(key)).withColumn("ahead", F.coalesce(F.sum("docs").over(ahead), F.lit(0)))
            gone = gone.withColumn("some", F.least("docs", F.col("many") - F.col("ahead"))).where("some > 0")
            # an entry's rows have one text, so each has an equal part of its counts
            gone = gone.withColumns({"tokens": F.expr("tokens div docs * some"), "chars": F.expr("chars div docs * some"), "docs": F.col("some")})
            return _signed(gone, -1).unionByName(new.drop("was", "place"))

        return self._commit(batch_id, entries)

    def compact(self) -> bool:
        """Commit a snapshot: the entries and sums of all commits so far, added up, and their batches' ids. Totals and state stay the same."""

        def write(draft: str, commits: list[Commit]) -> None:
            _summed(self._read("entries", ENTRY, commits), ("doc_id", "text_hash", *GROUP)).where("docs <> 0 or tokens <> 0 or chars <> 0").write.parquet(f"{draft}/entries")
            _summed(self._read("delta", DELTA, commits), GROUP).coalesce(1).write.parquet(f"{draft}/delta")  # a row a group
            self.spark.createDataFrame([(i,) for i in sorted(self._ids(commits))], "id string").coalesce(1).write.parquet(f"{draft}/ids")

        return self._claim(None, write, reads=True)

    def vacuum(self) -> int:
        """Delete the commits that the last snapshot stands for, and drafts; how many commits went. For a time when none is being written."""
        commits = self.commits()
        gone = 0
        if commits and commits[0].batch_id is None:
            for found in self._fs.listStatus(self._Path(f"{self.path}/commits")):
                if int(found.getPath().getName()) < commits[0].number:
                    gone += bool(self._fs.delete(found.getPath(), True))
        self._fs.delete(self._Path(f"{self.path}/drafts"), True)
        return gone

    def _commit(self, batch_id: str, entries: Callable[[list[Commit]], DataFrame], reads: bool = True) -> bool:
        """False, and nothing written, if the batch is committed already."""
        if not batch_id or "/" in batch_id:
            raise ValueError(f"no batch id: {batch_id!r}")

        def write(draft: str, commits: list[Commit]) -> None:
            with scope(self.spark):
                entries(commits).write.parquet(f"{draft}/entries")
            written = self.spark.read.schema(ENTRY).parquet(f"{draft}/entries")
            _summed(written, GROUP).coalesce(1).write.parquet(f"{draft}/delta")  # a row a group

        done = self._claim(batch_id, write, reads)
        if done and len(self.commits()) > self.compact_every:
            self.compact()
        return done

    def _claim(self, batch_id: str | None, write: Callable[[str, list[Commit]], None], reads: bool) -> bool:
        """Write a draft and rename it to the number after the last commit.

        A number that is taken means that another commit came between. What the draft holds is then computed
        anew if it depends on the commits before it; else the next number is tried.
        """
        draft, tried = "", 0
        while True:
            commits = self.commits()
            if batch_id is not None and batch_id in self._ids(commits):
                if draft:
                    self._fs.delete(self._Path(draft), True)
                return False
            if not draft or reads:
                if tried == self.tries:
                    raise Conflict(f"batch {batch_id!r} met other commits {tried} times")
                if draft:
                    self._fs.delete(self._Path(draft), True)
                draft = f"{self.path}/drafts/{uuid.uuid4().hex}"
                write(draft, commits)
                self._fs.create(self._Path(f"{draft}/{'id-' if batch_id is None else f'id-b-{batch_id}'}"), False).close()
                tried += 1
            final = self._folder(Commit(commits[-1].number + 1 if commits else 1, batch_id))
            if not self._fs.exists(self._Path(final)) and self._fs.rename(self._Path(draft), self._Path(final)):
                late = self._Path(f"{final}/{draft.rsplit('/', 1)[1]}")
                if not self._fs.exists(late):
                    return True
                self._fs.rename(late, self._Path(draft))  # another writer was first, and the rename went into its folder


def collapsed(text: str = "text") -> Column:
    """The text with runs of white space made one space, and trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " "))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches over whole tables: all documents in, those labelled of no quality out,
    all others revised to single spaces on a snapshot of the first two, and the first batch once more, which changes nothing."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    makers = {"byte_bpe_50k": BpeCounter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)}
    ledger = Ledger(spark, scratch_path(spark, "op10"))
    ledger.insert("0001-ingest", docs, makers)
    ledger.delete("0002-quality", table(spark, sf_dir, "labels").where("quality = 0").select("doc_id"))
    ledger.compact()
    new = collapsed()
    ledger.revise("0003-spaces", docs.where(new != F.coalesce("text", F.lit(""))).withColumns({"old": F.col("text"), "text": new}), makers, "old")
    ledger.insert("0001-ingest", docs, makers)
    return ledger.totals()


QUERIES = {"op10_token_counts": op10_token_counts}
ORACLE_SQL: dict[str, str] = {}
