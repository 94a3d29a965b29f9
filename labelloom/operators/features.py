"""TF-IDF, keyword and structural features as column expressions.

Fitting the vocabulary is the only step that shuffles. N-grams are counted in whole-array steps over
slices of texts, words as numbers; encoding looks the numbers of a frozen vocabulary up in the same way and
is narrow. The weighting is array arithmetic in the JVM.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from labelloom.functions import text as tx
from labelloom.functions.columns import double_array, let, str_array
from labelloom.functions.sizing import bounded_rows, estimated_bytes
from labelloom.session import work_path

CELLS = 1 << 18  # hash cells of n-grams: few for a task to send, many for a rare n-gram to be told
SAMPLE = 16  # one text in so many is looked at for a guess
SURE = 8  # occurrences in the sample that make a guess
PRUNE_FROM_BYTES = 8 * 1024 * 1024
SLICE_BYTES = 8 * 1024 * 1024  # texts counted together
SLICE_ROWS = 1 << 16
SENT_ROWS = 10_000
KEY_BYTES = 4 * 1024 * 1024  # estimated bytes of input behind one partition of counts by key
UNKNOWN_BYTES = 1 << 40  # an estimate of so much is none: a table without statistics or a product of sizes
NOT_WORD = tx.WORD.replace("[", "[^")
DOCUMENTS = ""  # pseudo term whose document frequency is the number of documents

# Task functions travel with the job: executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class FeatureSpace:
    """Frozen feature definition: terms with IDF, keyword groups, structural block."""

    terms: tuple[str, ...]
    idf: tuple[float, ...]
    keyword_groups: tuple[tuple[str, tuple[str, ...]], ...] = ()
    ngram_range: tuple[int, int] = (1, 2)
    sublinear: bool = True

    @cached_property
    def names(self) -> list[str]:
        return [
            *self.terms,
            *[f"keyword__{label}" for label, _ in self.keyword_groups],
            *tx.STRUCTURAL_NAMES,
        ]

    @property
    def size(self) -> int:
        return len(self.terms) + len(self.keyword_groups) + len(tx.STRUCTURAL_NAMES)


def grams_of(text: Column, ngram_range: tuple[int, int] = (1, 2)) -> Column:
    """n-grams of raw text."""
    return tx.ngrams(tx.words(tx.normalize(text)), *ngram_range)


def word_text(text: Column) -> Column:
    """Words of raw text between blanks: those of ``tx.words(tx.normalize(text))``, as no word holds white space."""
    return F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), NOT_WORD, " ")


@dataclass
class WordCodes:
    """Words of a slice of texts as numbers, in order, and the row of each."""

    codes: np.ndarray
    row: np.ndarray
    words: pa.Array
    rows: int

    @staticmethod
    def of(texts: pa.Array) -> WordCodes:
        lists = pc.split_pattern(texts, " ")
        words = lists.flatten()
        held = pc.not_equal(words, "")
        coded = words.filter(held).dictionary_encode()
        row = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))[held.to_numpy(zero_copy_only=False)]
        return WordCodes(coded.indices.to_numpy().astype(np.int64), row, coded.dictionary, len(texts))

    def grams(self, n: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """Different n-grams, and for each (n-gram, row) its number, its row and how often it occurs, by number."""
        base, last = len(self.words) + 1, max(0, len(self.codes) - n + 1)
        whole = np.flatnonzero(self.row[:last] == self.row[n - 1:])
        code, tables = self.codes[whole], []
        for k in range(1, n):
            if k > 1:  # dense again, so that no product overflows
                table, code = np.unique(code, return_inverse=True)
                tables.append(table)
            code = code * base + self.codes[whole + k]
        code, of, times = runs(code, self.row[whole], self.rows)
        first = starts(code)
        number = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(code)]))
        left, parts = code[first], []
        for k in range(n - 1, 0, -1):
            parts.append(left % base)
            left = left // base
            if k > 1:
                left = tables[k - 2][left]
        found = [self.words.take(pa.array(p)) for p in (left, *parts[::-1])]
        return found[0] if n == 1 else pc.binary_join_element_wise(*found, " "), number, of, times


def starts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.empty(0, np.int64)


def runs(high: np.ndarray, low: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different pairs in order, low numbers being below ``size``, and how often each occurs."""
    both = np.sort(high * size + low)
    first = starts(both)
    return both[first] // size, both[first] % size, np.diff(np.r_[first, len(both)])


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``SLICE_BYTES`` and ``SLICE_ROWS``, or of one text."""
    ends, at = np.r_[0, np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)], 0
    while at < len(texts):
        end = int(np.searchsorted(ends, ends[at] + SLICE_BYTES, side="right")) - 1
        end = min(max(at + 1, end), at + SLICE_ROWS)
        yield at, end
        at = end


def _sent(rows: dict) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_pydict(rows)
    for at in range(0, whole.num_rows, SENT_ROWS):
        yield whole.slice(at, SENT_ROWS)


def gram_rows(df: DataFrame, text: str, ngram_range: tuple[int, int]) -> DataFrame:
    """(term, cf, df) of every slice of texts, to be added up: narrow, a row per n-gram and slice.

    The pseudo term DOCUMENTS carries the number of documents along.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(0)):
                coded = WordCodes.of(batch.column(0).slice(a, b - a))
                yield from _sent({"term": [DOCUMENTS], "cf": [b - a], "df": [b - a]})
                for n in range(ngram_range[0], ngram_range[1] + 1):
                    term, number, _, times = coded.grams(n)
                    first = starts(number)
                    if len(first):
                        yield from _sent({"term": term, "cf": np.add.reduceat(times, first),
                                          "df": np.diff(np.r_[first, len(number)])})

    return df.select(word_text(F.col(text)).alias("words")).mapInArrow(run, "term string, cf long, df long")


def grams_by_key(df: DataFrame, key: str, text: str, ngram_range: tuple[int, int]) -> DataFrame:
    """(key, term, tf) of every row; narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                coded, keys = WordCodes.of(batch.column(1).slice(a, b - a)), batch.column(0).slice(a, b - a)
                for n in range(ngram_range[0], ngram_range[1] + 1):
                    term, number, of, times = coded.grams(n)
                    for at in range(0, len(number), SENT_ROWS):
                        part = slice(at, at + SENT_ROWS)
                        yield pa.RecordBatch.from_arrays(
                            [keys.take(pa.array(of[part])), term.take(pa.array(number[part])), pa.array(times[part], pa.int64())],
                            names=["key", "term", "tf"])

    rows = df.select(F.col(key).alias("key"), word_text(F.col(text)).alias("words"))
    return rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, term string, tf long").withColumnRenamed("key", key)


def term_counts(df: DataFrame, text: str = "prompt", ngram_range: tuple[int, int] = (1, 2),
                cells: DataFrame | None = None) -> DataFrame:
    """(term, cf, df): corpus count and document frequency of every n-gram.

    One scan and one shuffle: slices of texts give counts of their own, which are added up by term,
    map-side first. The pseudo term DOCUMENTS carries the number of documents along. With ``cells``,
    only n-grams of those hash cells are counted.
    """
    rows = gram_rows(df, text, ngram_range)
    if cells is not None:
        rows = rows.join(F.broadcast(cells), gram_cell(F.col("term")) == F.col("cell")).select("term", "cf", "df")
    return rows.groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))


def frequent_cells(df: DataFrame, least: int, text: str, ngram_range: tuple[int, int]) -> DataFrame:
    """(cell): hash cells whose n-grams together occur ``least`` times or more, and that of DOCUMENTS.

    No n-gram of another cell can occur that often. Counts by cell are fixed in number and width, so this
    shuffles no text; the cells found are at most all n-grams / ``least``.
    """
    rows = gram_rows(df, text, ngram_range).filter(F.col("term") != DOCUMENTS).select(gram_cell(F.col("term")).alias("cell"), "cf")
    found = rows.groupBy("cell").agg(F.sum("cf").alias("n")).filter(F.col("n") >= least).select("cell")
    return found.unionByName(df.sparkSession.range(1).select(gram_cell(F.lit(DOCUMENTS)).alias("cell"))).distinct()


def gram_cell(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(CELLS))


def _guess(df: DataFrame, text: str, max_features: int, min_df: int, ngram_range: tuple[int, int]) -> int:
    """About half as often as the last term of the vocabulary occurs, from a sample; 0 if that tells nothing."""
    sample = df.filter(F.pmod(F.xxhash64(F.col(text)), F.lit(SAMPLE)) == 0)
    counted = term_counts(sample, text, ngram_range).filter((F.col("term") != DOCUMENTS) & (F.col("df") * SAMPLE >= min_df))
    last = counted.orderBy(F.col("cf").desc()).limit(max_features).agg(F.min("cf"), F.count(F.lit(1))).first()
    return last[0] * SAMPLE // 2 if last[1] == max_features and last[0] >= SURE else 0


def _top(counts: DataFrame, max_features: int, min_df: int) -> DataFrame:
    """The most frequent terms, ties by term, and the pseudo term in front."""
    is_total = F.col("term") == DOCUMENTS
    return counts.filter(is_total | (F.col("df") >= min_df)).orderBy(
        is_total.desc(), F.col("cf").desc(), F.col("term")).limit(max_features + 1)


def top_terms(df: DataFrame, text: str, max_features: int, min_df: int, ngram_range: tuple[int, int]) -> DataFrame:
    """(term, cf, df) of the ``max_features`` most frequent terms and of DOCUMENTS.

    In three steps where a sample promises to spare the shuffle of rare n-grams: guess a count that the
    wanted terms surely reach, count n-grams by hash cells, then count the n-grams of cells that reach the
    guess. If the last term found does reach it, no n-gram left out can be among the wanted; if not, or if
    there is nothing to guess from, all n-grams are counted.
    """
    spark = df.sparkSession
    least = _guess(df, text, max_features, min_df, ngram_range) if estimated_bytes(df) >= PRUNE_FROM_BYTES else 0
    if least > 1:
        path = work_path(spark, "gram-cells")
        frequent_cells(df, least, text, ngram_range).write.parquet(path)
        found = _top(term_counts(df, text, ngram_range, spark.read.parquet(path)), max_features, min_df)
        path = work_path(spark, "top-terms")
        found.write.parquet(path)
        found = spark.read.parquet(path)
        last = found.filter(F.col("term") != DOCUMENTS).agg(F.min("cf"), F.count(F.lit(1))).first()
        if last[1] == max_features and last[0] >= least:
            return found
    return _top(term_counts(df, text, ngram_range), max_features, min_df)


def fit_vocabulary(
    df: DataFrame,
    text: str = "prompt",
    max_features: int = 3000,
    min_df: int = 1,
    ngram_range: tuple[int, int] = (1, 2),
) -> DataFrame:
    """(idx, term, cf, df, n_docs, idf): the most frequent terms by corpus count, ties by term.

    ``idx`` is alphabetical. The sort is a top-k; the two windows see at most max_features + 1 rows.
    """
    top = top_terms(df, text, max_features, min_df, ngram_range)
    is_total = F.col("term") == DOCUMENTS
    n_docs = F.max(F.when(is_total, F.col("df"))).over(W.partitionBy(F.lit(0)))
    idf = F.log((F.lit(1.0) + F.col("n_docs")) / (F.lit(1.0) + F.col("df"))) + 1.0
    index = F.row_number().over(W.partitionBy(F.lit(0)).orderBy("term")) - 1
    return (
        top.withColumn("n_docs", n_docs)
        .filter(~is_total)
        .select(index.cast("int").alias("idx"), "term", "cf", "df", "n_docs", idf.alias("idf"))
    )


def space_from_vocabulary(
    vocabulary: DataFrame,
    keyword_groups: Sequence[tuple[str, Sequence[str]]] = (),
    ngram_range: tuple[int, int] = (1, 2),
    sublinear: bool = True,
    bound: int = 1_000_000,
) -> FeatureSpace:
    """Freeze a fitted vocabulary table (its length is max_features at most)."""
    rows = sorted(bounded_rows(vocabulary.select("idx", "term", "df", "n_docs"), bound, "vocabulary"))
    return FeatureSpace(
        tuple(r["term"] for r in rows),
        tuple(log((1.0 + r["n_docs"]) / (1.0 + r["df"])) + 1.0 for r in rows),
        tuple((label, tuple(kws)) for label, kws in keyword_groups),
        ngram_range,
        sublinear,
    )


def sublinear_tf(count: Column) -> Column:
    return F.lit(1.0) + F.log(count)


def l2_normalize(values: Column) -> Column:
    """Scale a vector to unit length; a zero vector stays zero."""

    def scaled(v: Column) -> Column:
        length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        return let(length, lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x)))

    return let(values, scaled)


@dataclass
class TermLookup:
    """Terms by the numbers of their words: a sorted table of (state, next word) for every word after the first.

    A state stands for the words so far; ``index`` has the term that ends in it, or -1.
    """

    words: pa.Array
    keys: list[np.ndarray]
    index: list[np.ndarray]

    @staticmethod
    def of(terms: Sequence[str], ngram_range: tuple[int, int]) -> TermLookup:
        low, high = ngram_range
        split = [(i, p) for i, t in enumerate(terms) if low <= len(p := t.split(" ")) <= high and all(p)]
        words = sorted({w for _, p in split for w in p})
        place = {w: k for k, w in enumerate(words)}
        state = {i: place[p[0]] for i, p in split}
        keys, index = [], [np.full(len(words), -1)]
        for n in range(1, high + 1):
            for i, p in split:
                if len(p) == n:
                    index[-1][state[i]] = i
            following = {i: state[i] * len(words) + place[p[n]] for i, p in split if len(p) > n}
            keys.append(np.unique(np.array([*following.values()], np.int64)))
            index.append(np.full(len(keys[-1]), -1))
            state |= dict(zip(following, np.searchsorted(keys[-1], [*following.values()]).tolist()))
        return TermLookup(pa.array(words, pa.string()), keys, index)

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, term and count of all terms in texts of ``word_text``, ascending."""
        coded = WordCodes.of(texts)
        known = pc.index_in(coded.words.cast(pa.string()), self.words).fill_null(-1).to_numpy().astype(np.int64)
        word, row = known[coded.codes] if len(known) else coded.codes, coded.row
        at = np.flatnonzero(word >= 0)
        state, found = word[at], []
        for n, index in enumerate(self.index, 1):
            term = index[state]
            found.append((row[at[term >= 0]], term[term >= 0]))
            if n > len(self.keys) or not len(self.keys[n - 1]):
                break
            more = np.flatnonzero(at < len(word) - n)
            more = more[(row[at[more] + n] == row[at[more]]) & (word[at[more] + n] >= 0)]
            at, key = at[more], state[more] * len(self.words) + word[at[more] + n]
            state = np.minimum(np.searchsorted(self.keys[n - 1], key), len(self.keys[n - 1]) - 1)
            same = self.keys[n - 1][state] == key
            at, state = at[same], state[same]
        rows, terms = (np.concatenate(c) for c in zip(*found))
        return runs(rows, terms, int(terms.max()) + 1 if len(terms) else 1)


def term_rows(df: DataFrame, space: FeatureSpace, text: str) -> DataFrame:
    """Adds ``_i ARRAY<INT>``, the terms of a text in ascending order, and ``_n ARRAY<DOUBLE>``, their counts."""
    keep, shared = df.columns, df.sparkSession.sparkContext.broadcast(TermLookup.of(space.terms, space.ngram_range))
    named = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]
    schema = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(df.schema)]).add(
        "indices", ArrayType(IntegerType())).add("counts", ArrayType(DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(0)):
                part = batch.slice(a, b - a)
                row, term, count = shared.value.counts(part.column(0))
                ends = pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=b - a))], pa.int32())
                found = [pa.ListArray.from_arrays(ends, pa.array(v, t)) for v, t in ((term, pa.int32()), (count, pa.float64()))]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *found], names=schema.names)

    return df.select(word_text(F.col(text)).alias("words"), *named).mapInArrow(run, schema).toDF(*keep, "_i", "_n")


def encode(df: DataFrame, space: FeatureSpace, text: str = "prompt") -> DataFrame:
    """Adds ``indices ARRAY<INT>`` and ``values ARRAY<DOUBLE>``: TF-IDF, then keywords, then structure.

    Narrow: no shuffle, and terms outside the vocabulary are dropped.
    """
    keep = df.columns
    if space.terms:
        counted = term_rows(df, space, text)
        idf = double_array(space.idf)
        weight = sublinear_tf if space.sublinear else (lambda c: c)
        raw = F.zip_with("_i", "_n", lambda i, c: weight(c) * F.get(idf, i))
        tf_idx, tf_val = F.col("_i"), l2_normalize(raw)
    else:
        counted = df
        tf_idx, tf_val = F.array().cast("array<int>"), F.array().cast("array<double>")
    counted = counted.withColumn("_t", tx.normalize(F.col(text)))

    base = len(space.terms)
    kw = len(space.keyword_groups)
    dense = [F.array(*tx.structural(F.col("_t")))]
    if kw:
        dense.insert(0, F.transform(tx.keyword_flags(F.col("_t"), space.keyword_groups), lambda b: b.cast("double")))
    # Only non-zero cells are stored.
    cells = F.filter(
        F.transform(F.concat(*dense), lambda v, i: F.struct((i + F.lit(base)).alias("i"), v.alias("v"))),
        lambda c: c["v"] != 0,
    )
    built = counted.select(*keep, tf_idx.alias("_ti"), tf_val.alias("_tv"), cells.alias("_c"))
    return built.select(
        *keep,
        F.concat("_ti", F.col("_c.i")).alias("indices"),
        F.concat("_tv", F.col("_c.v")).alias("values"),
    )


def features_long(encoded: DataFrame, space: FeatureSpace, keys: Sequence[str]) -> DataFrame:
    """(keys, idx, feature, value) rows of encoded prompts."""
    cells = F.arrays_zip(F.col("indices").alias("i"), F.col("values").alias("v"))
    return encoded.select(*keys, F.explode_outer(cells).alias("c")).filter(F.col("c").isNotNull()).select(
        *keys,
        F.col("c.i").alias("idx"),
        F.get(str_array(space.names), F.col("c.i")).alias("feature"),
        F.col("c.v").alias("value"),
    )


def key_parts(df: DataFrame) -> int:
    """Partitions for counts by key: one for ``KEY_BYTES`` of input, and as the session says if its size is not known."""
    size = estimated_bytes(df)
    if size >= UNKNOWN_BYTES:
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-size // KEY_BYTES))


def tfidf_by_join(df: DataFrame, vocabulary: DataFrame, key: str, text: str = "prompt",
                  ngram_range: tuple[int, int] = (1, 2)) -> DataFrame:
    """(key, term, value) TF-IDF against a vocabulary table of any size, which has a row per term.

    For vocabularies too large to ship to every task: the join is left to Spark, with AQE splitting
    the partitions of very common terms. Texts are counted where they are; counts that the vocabulary
    knows are partitioned by key, into parts that grow in number with the input and not in size, so
    adding up and normalising need no further shuffle.
    """
    known = grams_by_key(df, key, text, ngram_range).join(vocabulary.select("term", "idf"), "term")
    counted = known.repartition(key_parts(df), F.col(key)).groupBy(key, "term").agg(
        F.sum("tf").alias("tf"), F.first("idf").alias("idf"))
    raw = counted.withColumn("x", sublinear_tf(F.col("tf")) * F.col("idf"))
    length = F.sqrt(F.sum(F.col("x") * F.col("x")).over(W.partitionBy(key)))
    return raw.withColumn("n", length).select(key, "term", (F.col("x") / F.col("n")).alias("value"))


def registry(space_vocabulary: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(idx, feature, block): every feature in vector order."""
    spark = space_vocabulary.sparkSession
    tail = [(f"keyword__{l}", "keyword") for l in labels] + [(n, "structural") for n in tx.STRUCTURAL_NAMES]
    fixed = spark.createDataFrame([(i, n, b) for i, (n, b) in enumerate(tail)], "off int, feature string, block string")
    size = space_vocabulary.select(F.lit(0).alias("off"), "idx", F.col("term").alias("feature"), F.lit("tfidf").alias("block"))
    both = size.unionByName(fixed.withColumn("idx", F.lit(None).cast("int")))
    base = F.coalesce(F.max("idx").over(W.partitionBy(F.lit(0))) + 1, F.lit(0))  # a few thousand rows
    return both.withColumn("b", base).select(
        F.coalesce("idx", F.col("b") + F.col("off")).cast("int").alias("idx"), "feature", "block"
    )
