"""Language identification by word-first backoff.

A known word adds, for every language that holds it, its log frequency there over that
of a word the language lacks. An unseen word falls back to its character n-grams,
longest first: the first length with a known n-gram adds the mean of the known ones.
The language with the highest sum wins; the score is its posterior.

The frequency of a word or n-gram in a language is ``n / (total + SHRINK) + FLOOR``: the
floor, which is all that an unseen one has, is the same in every language, so a language
with little training text gains nothing from what it has never held, and ``SHRINK`` keeps
its few words from weighing more than the words of a large one.

The model is fitted on a bounded sample of labelled rows: of every label an equal part of
``train_docs`` distinct texts and of ``train_chars`` characters, about, by a hash threshold
on the text, so that null or repeated ids and copies do not swell it, and at least one
text. All words and n-grams of the sample are kept; what is broadcast grows with the
sample, so with these two parameters and the number of labels. Every text is judged whole.

Null texts and texts without a letter are ``und`` with score 0; so is every text when
nothing was learned. Ties go to the first language by name. An empty table gives no
rows; repeated rows and null ids each keep their row; columns named ``lang_pred`` or
``score`` are replaced and other columns kept.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickyard.llm.common import discard, materialize, small_batches, small_side

TRAIN_DOCS, TRAIN_CHARS = 12_000, 128_000_000
ORDERS = (4, 3, 2, 1)
UNKNOWN = "und"
SHRINK, FLOOR = 1000.0, 1e-7
CACHE_WORDS = 150_000
#: Most characters of the texts judged at once, and cells of their table of sums by language.
GROUP_CHARS, GROUP_CELLS = 1_000_000, 4_000_000

runs_of = re.compile(r"[^\W\d_]+").findall


def words_of(text: str) -> list[str]:
    """The letter runs of a text, lower-cased; a sign such as a raised digit ends a run."""
    runs = runs_of(text.lower())
    if text.isascii():
        return runs
    return [w for run in runs for w in ((run,) if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split())]


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 on division by 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class LanguageModel:
    """Gains of words and n-grams: row i is ``columns`` and ``gains`` from ``ends[i - 1]`` to ``ends[i]``."""

    languages: list[str]
    prior: np.ndarray
    words: dict[str, int]
    grams: dict[str, int]
    ends: np.ndarray
    columns: np.ndarray
    gains: np.ndarray


class Judge:
    """Predictions of one worker, with a bounded cache of the rows of words it has met."""

    def __init__(self, model: LanguageModel, limit: int = CACHE_WORDS):
        self.model, self.limit = model, limit
        self.starts = np.concatenate(([0], model.ends[:-1])).astype(np.int64)
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.first, self.last = [self.starts], [self.model.ends]
        self.columns, self.gains = [self.model.columns], [self.model.gains]
        self.size, self.n_rows = len(self.model.gains), len(self.starts)

    def spread(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(how many, which) entries the rows from ``first`` to ``last`` have."""
        counts = last - first
        ends = np.cumsum(counts)
        return counts, np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + counts, counts)

    def known_grams(self, word: str) -> list[int]:
        """The rows of the longest known n-grams of a word."""
        padded, grams = f"_{word}_", self.model.grams
        for n in ORDERS:
            if known := [grams[g] for i in range(len(padded) - n + 1) if (g := padded[i : i + n]) in grams]:
                return known
        return []

    def learn(self, words: set[str]) -> None:
        new = list(words - self.rows.keys())
        if len(self.rows) + len(new) > self.limit:
            self.forget()
            new = list(words)
        unseen = []
        for w in new:
            at = self.model.words.get(w)
            if at is None:
                at = self.n_rows + len(unseen)
                unseen.append(self.known_grams(w))
            self.rows[w] = at
        if not unseen:
            return
        sizes = np.fromiter(map(len, unseen), np.int64, len(unseen))
        grams = np.fromiter(chain.from_iterable(unseen), np.int64, int(sizes.sum()))
        counts, at = self.spread(self.starts[grams], self.model.ends[grams])
        share = np.repeat(np.repeat(1 / np.maximum(sizes, 1), sizes), counts)
        owner = np.repeat(np.repeat(np.arange(len(unseen)), sizes), counts)
        last = self.size + np.cumsum(np.bincount(owner, minlength=len(unseen)))
        self.first.append(np.concatenate(([self.size], last[:-1])))
        self.last.append(last)
        self.columns.append(self.model.columns[at])
        self.gains.append((self.model.gains[at] * share).astype(np.float32))
        for parts in (self.first, self.last, self.columns, self.gains):
            while len(parts) > 2 and len(parts[-2]) <= 2 * len(parts[-1]):  # each entry is copied a few times at most
                parts[-2:] = [np.concatenate(parts[-2:])]
        self.size, self.n_rows = int(last[-1]), self.n_rows + len(unseen)

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        group, chars = [], 0
        for t in texts:
            group.append(words_of(t) if t is not None else [])
            chars += len(t or "")
            if chars > GROUP_CHARS or len(group) * len(self.model.languages) > GROUP_CELLS:
                yield from self.judge(group)
                group, chars = [], 0
        yield from self.judge(group)

    def judge(self, group: list[list[str]]) -> Iterator[tuple[str, float]]:
        languages = self.model.languages
        if not languages:
            yield from [(UNKNOWN, 0.0)] * len(group)
            return
        self.learn(set().union(*group))
        first, last, columns, gains = (np.concatenate(x) if len(x) > 1 else x[0] for x in (self.first, self.last, self.columns, self.gains))
        sizes = np.fromiter(map(len, group), np.int64, len(group))
        rows = np.fromiter(map(self.rows.__getitem__, chain.from_iterable(group)), np.int64, int(sizes.sum()))
        counts, at = self.spread(first[rows], last[rows])
        doc = np.repeat(np.repeat(np.arange(len(group)), sizes), counts)
        sums = np.bincount(doc * len(languages) + columns[at], weights=gains[at], minlength=len(group) * len(languages)).reshape(len(group), len(languages))
        sums = sums + np.log(self.model.prior)
        best = sums.argmax(axis=1)
        scores = 1 / np.exp(sums - sums.max(axis=1)[:, None]).sum(axis=1)
        for n, b, score in zip(sizes.tolist(), best.tolist(), scores.tolist(), strict=True):
            yield (languages[b], score) if n else (UNKNOWN, 0.0)


def _grams(word: Column, n: int) -> Column:
    """All runs of n characters; a shorter word gives itself."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(word) - n + 1, F.lit(1)))
    return F.transform(starts, lambda i: F.substring(word, i, F.lit(n)))


def sample_of(labelled: DataFrame, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> tuple[DataFrame, dict[str, int]]:
    """The training sample, (lang, text), and the number of labelled rows of each language."""
    usable = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("text is not null and lang is not null")
    slots = 1 << 40
    place = F.pmod(F.xxhash64("text"), F.lit(slots))
    counted = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.min(place).alias("least")).orderBy("lang").collect()
    part, part_chars = train_docs // max(1, len(counted)) + 1, train_chars // max(1, len(counted)) + 1
    kept = [(r.lang, max(r.least + 1, min(slots, slots * part // r.n + 1, slots * part_chars // max(1, r.chars) + 1))) for r in counted]
    limits = small_side(labelled.sparkSession.createDataFrame(kept, "lang string, kept long"), sum(40 + len(lang) for lang, _ in kept))
    return usable.join(limits, "lang").filter(place < F.col("kept")).select("text", "lang").distinct(), {r.lang: r.n for r in counted}


def fit(labelled: DataFrame, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> LanguageModel:
    """Learn from the columns text and lang; rows where one is null teach nothing."""
    sample, per_lang = sample_of(labelled, train_docs, train_chars)
    languages = list(per_lang)

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, texts in pdf.groupby("lang")["text"]:
                seen: Counter = Counter()
                for t in texts:
                    seen.update(words_of(t))
                yield pd.DataFrame({"lang": pd.Series([lang] * len(seen), dtype=object), "word": pd.Series(list(seen), dtype=object), "n": pd.Series(list(seen.values()), dtype="int64")})

    words = materialize(sample.mapInPandas(counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
    grams = F.flatten(F.array(*[_grams(F.concat(F.lit("_"), "word", F.lit("_")), n) for n in ORDERS]))
    of_grams = words.select("lang", "n", F.explode(grams).alias("word")).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    tables = [df.select("word", "lang", "n").toArrow().to_pandas() for df in (words, of_grams)]
    discard(words)
    column = {lang: i for i, lang in enumerate(languages)}
    found: list[tuple[dict[str, int], np.ndarray, np.ndarray, np.ndarray]] = []
    for table in tables:
        names, keys = pd.factorize(table["word"])
        lang, n = table["lang"].map(column).to_numpy(np.int64), table["n"].to_numpy(float)
        totals = np.bincount(lang, n, len(languages)) if len(n) else np.zeros(len(languages))
        gain = np.log1p(n / (totals[lang] + SHRINK) / FLOOR)
        order = np.lexsort((lang, names))
        found.append((dict(zip(keys, range(len(keys)), strict=True)), np.cumsum(np.bincount(names, minlength=len(keys))), lang[order], gain[order]))
    (of_word, word_ends, *word_rows), (of_gram, gram_ends, *gram_rows) = found
    entries = word_ends[-1] if len(word_ends) else 0
    prior = np.array([per_lang[x] for x in languages], float)
    return LanguageModel(
        languages,
        prior / prior.sum() if languages else prior,
        of_word,
        {g: i + len(of_word) for g, i in of_gram.items()},
        np.concatenate([word_ends, gram_ends + entries]).astype(np.int64),
        np.concatenate([word_rows[0], gram_rows[0]]).astype(np.int32),
        np.concatenate([word_rows[1], gram_rows[1]]).astype(np.float32),
    )


def _judged(docs: DataFrame, model: LanguageModel) -> tuple[DataFrame, str]:
    """``docs`` with a struct of lang_pred and score, and the name of that column, which no other has."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Judge(shared.value)
        for texts in batches:
            yield pd.DataFrame(list(own.predict(texts.tolist())), columns=["lang_pred", "score"]).astype({"lang_pred": object, "score": float})

    name = "lang_judged"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, judge(F.col("text").cast("string"))), name


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with lang_pred and score, from the text alone."""
    out, name = _judged(docs, model)
    return out.withColumn("lang_pred", F.col(f"{name}.lang_pred")).withColumn("score", F.col(f"{name}.score")).drop(name)


def fit_open_part(docs: DataFrame, **bounds) -> LanguageModel:
    """Learn from the rows that are not held out."""
    return fit(docs.filter(~held_out(F.col("doc_id"))), **bounds)


def keep_identified(docs: DataFrame, **bounds) -> DataFrame:
    """The rows whose text has a recognised language, with all their own columns as they were."""
    out, name = _judged(docs, fit_open_part(docs, **bounds))
    return out.filter(F.col(f"{name}.lang_pred") != UNKNOWN).drop(name)
