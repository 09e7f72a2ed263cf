"""Language identification by word-first backoff (operator 3).

The model holds, per language, log frequencies of known words and of
character n-grams of 1 to ``LONGEST`` letters.  A known word of a text scores
by its log frequency in each language.  A word the model doesn't know falls
back to its character n-grams: the longest length of which the model knows
at least one n-gram decides, by the mean of their log frequencies.  A word
with no known letter says nothing.

Training reads labelled rows only.  It is fitted on a bounded, documented
sample (``SAMPLE_PER_LANGUAGE`` rows of each language, chosen by a hash of
the id; 0 to ``LONGEST`` letters) and keeps ``KEPT_WORDS`` words and
``KEPT_GRAMS`` n-grams of each length per language, so the model that is sent
to the tasks has a bounded size.  Counting is a Spark aggregation over the
sampled rows.

Defined results: a null text, or one without a letter, is ``und`` with score
0; with no labelled row every text is ``und``.  Ties go to the language that
sorts first.  Languages, sources and ids of scored rows are never read.
``keep_identified(by_evidence=True)`` also drops texts of which the model knows
neither a word nor a letter: all languages score alike there.  Numerals that
are no digits (a half, a Roman eight) are no letters.  Very long texts are
scored whole; repeated rows get the same result each; other columns, of
whatever name, are left alone; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import sys
from collections import defaultdict
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, single_user_column

UNKNOWN = "und"
SAMPLE_PER_LANGUAGE = 1000
KEPT_WORDS = 20_000
KEPT_GRAMS = 5_000
LONGEST = 5
CHUNK_BYTES = 4 << 20
CACHE_WORDS = 150_000
RANK_PARTS = 64

# runs of letters, and of the numerals that are no digits (a half, a Roman eight), which _words cuts out again
_WORD = re.compile(r"[^\W\d_]+")
_NUMERALS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
_LETTERS = re.compile(rf"[^\W\d_{_NUMERALS}]+")
# a text without any of these holds no such numeral: those of Latin-1, and all characters from the first one beyond
_MAY_HOLD_NUMERALS = re.compile(f"[{''.join(c for c in _NUMERALS if c <= chr(255))}{min(c for c in _NUMERALS if c > chr(255))}-{chr(sys.maxunicode)}]")


def _words(text: str) -> list[str]:
    """Maximal runs of letters."""
    found = _WORD.findall(text)
    if _MAY_HOLD_NUMERALS.search(text) is None:
        return found
    return [run for word in found for run in ((word,) if word.isalpha() else _LETTERS.findall(word))]


class Model:
    """Log frequencies of words and n-grams, one row each with one column per language."""

    def __init__(self, words: list[tuple[str, str, int]], grams: list[tuple[str, str, int]]):
        """Counts as (language, word or n-gram, occurrences)."""
        self.languages = sorted({lang for lang, _, _ in words} | {lang for lang, _, _ in grams})
        by_length: dict[int, list] = defaultdict(list)
        for row in grams:
            by_length[len(row[1])].append(row)
        # kept in few large objects: the model is sent to every worker
        self.counts = {n: self._counts(rows) for n, rows in [(0, words), *by_length.items()]}

    def _counts(self, rows) -> tuple[str, np.ndarray]:
        """Items joined by line feeds, and their counts by language."""
        at = {item: i for i, item in enumerate(dict.fromkeys(item for _, item, _ in rows))}
        counts = np.zeros((len(at), len(self.languages)), dtype=np.int64)
        for lang, item, n in rows:
            counts[at[item], self.languages.index(lang)] += n
        return "\n".join(at), counts


class Scorer:
    """Scores the words of texts by a model; remembers words it has met.

    Made for each task: quick, and a worker that goes on with another
    operator doesn't keep it.
    """

    def __init__(self, model: Model):
        self.languages = model.languages
        items, tables, first = {}, [], 0
        for n, (joined, counts) in model.counts.items():
            names = joined.split("\n") if joined else []
            items[n] = {item: first + i for i, item in enumerate(names)}
            tables.append(np.log((counts + 1) / (counts + 1).sum(axis=0)) if len(counts) else counts.astype(float))
            first += len(names)
        self.words = items.pop(0)
        self.grams = sorted(items.items(), reverse=True)  # longest first
        self.table = np.concatenate(tables) if tables else np.zeros((0, 0))
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.known = np.zeros(0, dtype=bool)  # some of the word is in the model
        self.scores = np.zeros((0, len(self.languages)))

    def learn(self) -> None:
        """Score the words that came up since the last call.

        A known word scores by its own log frequencies; another by the mean of
        its longest known n-grams; a word without a known letter by zeros.
        """
        fresh = list(islice(self.index, len(self.scores), None))
        if not fresh:
            return
        rows, counts = [], []
        for word in fresh:
            known = self.words.get(word)
            found = [known] if known is not None else ()
            if not found:
                for n, table in self.grams:
                    found = [k for i in range(len(word) - n + 1) if (k := table.get(word[i:i + n])) is not None]
                    if found:
                        break
            rows += found
            counts.append(len(found))
        counts = np.array(counts)
        out = np.zeros((len(fresh), len(self.languages)))
        if rows:
            has = np.flatnonzero(counts)
            starts = (np.cumsum(counts) - counts)[has]
            out[has] = np.add.reduceat(self.table[rows], starts) / counts[has][:, None]
        self.known = np.concatenate([self.known, counts > 0])
        self.scores = np.concatenate([self.scores, out])

    def word_score(self, word: str) -> np.ndarray:
        at = self.index.setdefault(word, len(self.index))
        self.learn()
        return self.scores[at]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text."""
        langs, scores, _ = self.judge(texts)
        return langs, scores

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language and score of each text, and whether the model knows any of it."""
        if len(self.index) > CACHE_WORDS:
            self.forget()
        index = self.index
        words = [[index.setdefault(w, len(index)) for w in _words(t.lower())] if t and self.languages else []
                 for t in texts]
        self.learn()
        n = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        langs, scores, known = [UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)
        has = np.flatnonzero(n)
        if not len(has):
            return langs, scores, known
        flat = np.fromiter(chain.from_iterable(words), dtype=np.int64, count=int(n.sum()))
        totals = np.add.reduceat(self.scores[flat], (np.cumsum(n) - n)[has])
        evidence = np.logical_or.reduceat(self.known[flat], (np.cumsum(n) - n)[has])
        # words of a text depend on one another: evidence grows with the root of their number
        z = (totals - totals.max(axis=1, keepdims=True)) / np.sqrt(n[has])[:, None]
        score = 1 / np.exp(z).sum(axis=1)
        for i, best, s, e in zip(has.tolist(), totals.argmax(axis=1).tolist(), score.tolist(), evidence.tolist(), strict=True):
            langs[i], scores[i], known[i] = self.languages[best], s, e
        return langs, scores, known


def held_out(id_col) -> F.Column:
    """Rows kept from training: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample_per_language: int = SAMPLE_PER_LANGUAGE, kept_words: int | None = KEPT_WORDS,
          kept_grams: int | None = KEPT_GRAMS) -> Model:
    """Fit on a bounded sample of the labelled rows that aren't held out.

    ``kept_words`` and ``kept_grams`` bound the model by language (and
    length); None keeps all that the sample holds.
    """
    labelled = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang")) \
        .where(F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out("id"))
    drawn = labelled.withColumn("draw", F.xxhash64(F.col("id").cast("string")))
    chosen = _sample(drawn, sample_per_language).select("id", "lang").distinct()
    # at most sample_per_language rows of each language: small enough for every executor
    texts = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")) \
        .join(F.broadcast(chosen), ["id", "lang"]).where(F.col("text").isNotNull())
    words = texts.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"))).alias("item")) \
        .groupBy("lang", "item").agg(F.count(F.lit(1)).alias("n"))
    words = words.persist()
    try:
        grams = words.select("lang", "n", F.explode(F.array_distinct(F.flatten(F.transform(
            F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("item"))),
            lambda size: F.transform(
                F.sequence(F.lit(1), F.length("item") - size + 1),
                lambda i: F.col("item").substr(i, size)))))).alias("item")) \
            .groupBy("lang", "item").agg(F.sum("n").alias("n"))
        by_word = _most_frequent(words, ["lang"], kept_words).collect()
        by_gram = _most_frequent(grams.withColumn("size", F.length("item")), ["lang", "size"], kept_grams).collect()
    finally:
        words.unpersist()
    return Model([(r["lang"], r["item"], r["n"]) for r in by_word],
                 [(r["lang"], r["item"], r["n"]) for r in by_gram])


def _sample(drawn: DataFrame, most: int) -> DataFrame:
    """The ``most`` rows of each language with the smallest ``draw``.

    Rows are counted by ranges of the draw first, 4,096 to a language; the
    ranges that can hold one of the smallest go on, so a language's last
    ranking sees ``most`` rows and one range at most.
    """
    ranged = drawn.withColumn("part", F.shiftright("draw", 52))
    counts = ranged.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < most).select("lang", "part")
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "id"))
    return ranged.join(first, ["lang", "part"]).withColumn("turn", turn).where(F.col("turn") <= most)


def _first_of(rows: DataFrame, keys: list[str], order: list, spread: str, most: int) -> DataFrame:
    """The first ``most`` rows of each key; ranked inside hashed parts of a key first, so that none is one task."""
    part = F.pmod(F.xxhash64(spread), F.lit(RANK_PARTS))
    for by in ([*keys, "part"], keys):
        place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        rows = (rows.withColumn("part", part) if "part" in by else rows).withColumn("place", place) \
            .where(F.col("place") <= most).drop("place")
    return rows.drop("part")


def _most_frequent(counts: DataFrame, keys: list[str], most: int | None) -> DataFrame:
    kept = counts if most is None else _first_of(counts, keys, [F.desc("n"), F.col("item")], "item", most)
    return kept.select("lang", "item", "n")


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = Scorer(shared.value)
        for whole in batches:
            for batch in chunks(whole, "text", CHUNK_BYTES):
                langs, scores = m.predict(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                    ["id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")) \
        .mapInArrow(run, f"id {kind}, lang_pred string, score double")
    return found.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", by_evidence: bool = False) -> DataFrame:
    """The rows of which some language could be identified (all columns kept).

    ``by_evidence`` asks for a word or letter that the model knows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    verdict = single_user_column(docs, "lang_pred")

    def run(columns):
        import pandas as pd

        m = Scorer(shared.value)
        for column in columns:
            langs, _, known = m.judge(column.tolist())
            yield pd.Series([lang if k or not by_evidence else UNKNOWN for lang, k in zip(langs, known, strict=True)], dtype="object")

    udf = F.pandas_udf(run, "string", F.PandasUDFType.SCALAR_ITER)
    return docs.withColumn(verdict, udf(docs[text_col])).where(F.col(verdict) != UNKNOWN).drop(verdict)
