"""Variant spellings linked to listed entities: MinHash banding over padded q-grams, Monge-Elkan, star clustering.

1. Words of the spellings and of the listed names are hashed once each: MinHash signatures over padded q-grams, cut
   into bands. Bands and rows come from the collision curve 1 - (1 - s^r)^b: ``tune_bands`` takes the most rows whose
   bands reach the wanted recall at the least similarity within a number of hashes.
2. Words of the same scope (a school, or none) that share a band are candidates; a word pair stays if its edit
   similarity is high enough. The band hash carries the scope, so a scope with a third of all rows is split by bands.
   ``words_in_scopes`` needs no bands, and misses nothing: all word pairs of a scope are candidates, whatever its size.
3. Spellings and listed names that share such a word are compared by Monge-Elkan: every word's best partner, averaged
   with the words' lengths as weights, in both directions.
4. Star clustering with the listed entities as centres: each spelling joins the centre of the highest score. Two
   centres of different names whose scores are (nearly) equal leave the spelling unlinked.

Cases: null or wordless spellings link to nothing; repeated spellings are compared once; two listed entities of one
name (and scope) count as one, the smaller id; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import Stored, parallelism, store

Q = 2


def collision(similarity: float, bands: int, rows: int) -> float:
    """Chance that two sets of this Jaccard similarity share a band."""
    return 1 - (1 - similarity**rows) ** bands


def tune_bands(similarity: float, recall: float, hashes: int = 72) -> tuple[int, int]:
    """(bands, rows): the most rows a band that still reach ``recall`` at ``similarity`` with at most ``hashes``.

    ValueError if even bands of one row need more hashes.
    """
    if not 0 < similarity < 1 or not 0 < recall < 1:
        raise ValueError("similarity and recall lie between 0 and 1")
    for rows in range(8, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if bands * rows <= hashes:
            return bands, rows
    raise ValueError(f"a recall of {recall} at similarity {similarity} needs {bands} hashes, more than {hashes}")


_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on whole arrays."""
    x = x + _MIX[0]
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def band_hashes(words: list[str], bands: int, rows: int, q: int = Q) -> np.ndarray:
    """(words, bands): a hash a band of each word's MinHash signature over its q-grams, padded by ^ and $."""
    padded = ["^" + w + "$" for w in words]
    sizes = np.array([len(w) for w in padded], dtype=np.int64)
    points = np.frombuffer("".join(padded).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    ends = np.cumsum(sizes)
    grams, count = points.copy(), np.maximum(sizes - (q - 1), 1)
    with np.errstate(over="ignore"):
        for i in range(1, q):
            grams = grams * np.uint64(1 << 21) + np.append(points[i:], np.zeros(i, dtype=np.uint64))
        starts = np.append(0, np.cumsum(count)[:-1])
        at = np.repeat(ends - sizes - starts, count) + np.arange(count.sum())
        base = _mixed(grams[at])
        out = np.empty((len(words), bands), dtype=np.uint64)
        for band in range(bands):
            key = np.full(len(words), band, dtype=np.uint64)
            for r in range(rows):
                key = _mixed(key ^ np.minimum.reduceat(_mixed(base ^ _mixed(np.array([band * rows + r + 1], dtype=np.uint64))), starts))
            out[:, band] = key
    return out.view(np.int64)


def with_bands(words: DataFrame, bands: int, rows: int) -> DataFrame:
    """(word, _h) of a table of words; _h has one hash a band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                hashes = band_hashes(b.column(0).to_pylist(), bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, hashes.size + 1, bands, dtype=np.int32)), pa.array(hashes.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["word", "_h"])

    return words.select("word").mapInArrow(run, "word string, _h array<bigint>")


def edit_similarity(x: Column, y: Column) -> Column:
    """1 - edits / longer length; two letters swapped are one edit."""
    swapped = (F.length(x) == F.length(y)) & (F.levenshtein(x, y, 2) == 2) & (F.array_sort(F.split(x, "")) == F.array_sort(F.split(y, "")))
    return 1 - (F.levenshtein(x, y) - F.when(swapped, 1).otherwise(0)) / F.greatest(F.length(x), F.length(y), F.lit(1))


def close_enough(x: str, y: str, least: float) -> Column:
    """A quick necessary condition of edit_similarity >= least: a swap costs two plain edits, so one more is allowed."""
    return F.expr(f"levenshtein({x}, {y}, cast({1 - least} * greatest(length({x}), length({y})) as int) + 1) >= 0")


def word_matrix(a: Column, b: Column, similarity) -> Column:
    """The similarity of every word of a (a row each) to every word of b; each is computed once."""
    return F.transform(a, lambda x: F.transform(b, lambda y: similarity(x, y)))


def best_in_rows(matrix: str) -> Column:
    return F.transform(matrix, lambda row: F.array_max(row))


def best_in_columns(matrix: str) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(F.element_at(matrix, 1))), lambda j: F.array_max(F.transform(matrix, lambda row: F.element_at(row, j))))


def monge_elkan(best: Column, words: Column, weight) -> Column:
    """Weighted mean of the words' best similarities; both arrays have one entry a word, and there is a word."""
    parts = F.zip_with(best, words, lambda s, x: F.struct((s * weight(x)).alias("s"), weight(x).alias("w")))
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w"))
    return F.aggregate(parts, zero, lambda acc, p: F.struct((acc.s + p.s).alias("s"), (acc.w + p.w).alias("w")), lambda t: t.s / t.w)


def similar_words(left: DataFrame, right: DataFrame, bands: int, rows: int, least: float) -> Stored:
    """Stored (scope, l, r): words of one scope that share a band and are similar enough; inputs are distinct (scope, word).

    The band join moves pairs of 64-bit numbers only; a word that is listed as it is joins directly, not band by band.
    """
    spark = left.sparkSession
    words = left.select("word").unionByName(right.select("word")).distinct().repartition(parallelism(spark))
    vocabulary = store(with_bands(words, bands, rows), "words")
    named = lambda side, name: side.select(F.xxhash64("scope", "word").alias(f"_{name}"), "scope", F.col("word").alias(name))

    def banded(side: DataFrame, name: str) -> DataFrame:
        hashed = side.join(vocabulary.df, "word").select(F.xxhash64("scope", "word").alias(f"_{name}"), "scope", F.explode("_h").alias("_h"))
        return hashed.select(F.xxhash64("scope", "_h").alias("_k"), f"_{name}")

    pairs = banded(left, "l").join(banded(right, "r"), "_k").where("_l <> _r").select("_l", "_r").distinct()
    near = pairs.join(named(left, "l"), "_l").join(named(right, "r").withColumnRenamed("scope", "_s2"), "_r").where("scope = _s2 AND l <> r")
    near = near.where(close_enough("l", "r", least) & (edit_similarity(F.col("l"), F.col("r")) >= least)).select("scope", "l", "r")
    same = left.join(right, ["scope", "word"]).select("scope", F.col("word").alias("l"), F.col("word").alias("r"))
    found = store(near.unionByName(same), "near-words")
    vocabulary.drop()
    return found


def letter_bits(words: list[str]) -> np.ndarray:
    """How often each word has each letter, in two bits (once, twice or more) for each of 32 kinds of letters, as int64."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    kind = np.where((points >= 97) & (points <= 122), points - 97, 26 + points % 6)
    counts = np.bincount(np.repeat(np.arange(len(words)), sizes) * 32 + kind, minlength=32 * len(words)).reshape(-1, 32)
    bits = np.uint64(1) << (np.arange(32, dtype=np.uint64) * np.uint64(2))
    return ((counts >= 1) @ bits + (counts >= 2) @ (bits * np.uint64(2))).astype(np.uint64).view(np.int64)


def with_letters(side: DataFrame) -> DataFrame:
    """(scope, word, weak) with ``_m``, the words' letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(letter_bits(b.column(1).to_pylist()))], names=["scope", "word", "weak", "_m"])

    kind = dict(side.dtypes)["scope"]
    return side.select("scope", "word", "weak").mapInArrow(run, f"scope {kind}, word string, weak boolean, _m bigint")


#: Most word pairs of a scope that are compared in one piece; larger scopes are cut, not compared otherwise.
ALL_PAIRS = 4_000_000


def _measured(side: DataFrame, name: str, least: float, strict: float) -> DataFrame:
    """Words with length, letters, and the edits that either limit leaves them."""
    n = F.length("word")
    edits = lambda limit: F.floor((1 - limit) * n + 0.001).cast("int")
    return with_letters(side).select("scope", F.col("word").alias(name), n.alias(f"_n{name}"), F.col("_m").alias(f"_m{name}"), F.when(F.col("weak"), -1).otherwise(edits(strict)).alias(f"_s{name}"), edits(least).alias(f"_e{name}"))


def _in_pieces(side: DataFrame, large: DataFrame, name: str, own: str, other: str) -> DataFrame:
    """Each word at its place along ``own``, once for every place along ``other``; scopes that are not large are one piece."""
    cut = side.join(large, "scope", "left")
    at = F.pmod(F.xxhash64(name), F.coalesce(f"_k{own}", F.lit(1))).cast("int")
    return cut.select(*side.columns, at.alias(f"_{own}"), F.explode(F.sequence(F.lit(0), F.coalesce(f"_k{other}", F.lit(1)) - 1)).alias(f"_{other}"))


#: Two words are alike if their plain edits fit in _e, or if they have two swapped letters and one edit fits.
_EDITS = "IF(least(_sl, _sr) < 0, greatest(_el, _er), greatest(_sl, _sr))"
_MAY = f"abs(_nl - _nr) <= {_EDITS} AND bit_count(_ml & ~_mr) <= {_EDITS} AND bit_count(_mr & ~_ml) <= {_EDITS}"
_ALIKE = f"levenshtein(l, r, {_EDITS}) >= 0 OR ({_EDITS} = 1 AND _nl = _nr AND levenshtein(l, r, 2) = 2 AND array_sort(split(l, '')) = array_sort(split(r, '')))"


def words_in_scopes(left: DataFrame, right: DataFrame, bands: int, rows: int, least: float, strict: float, all_pairs: int = ALL_PAIRS) -> list[Stored]:
    """Stored (scope, l, r) of many scopes: all word pairs of a scope are compared, in pieces of about ``all_pairs`` each.

    Inputs are distinct (scope, word, weak); pairs without a weak word need the ``strict`` similarity, others ``least``.
    A large scope is a grid of pieces that are compared in different tasks: every pair meets in one of them, so the
    result is the same whatever the sizes. ``bands`` and ``rows`` have no use: bands miss pairs, however many there are.
    """
    most = max(math.isqrt(all_pairs), 1)
    count = lambda side, name: side.groupBy("scope").agg(F.count(F.lit(1)).alias(name))
    sizes = count(left, "_nl").join(count(right, "_nr"), "scope").where(F.col("_nl") * F.col("_nr") > all_pairs)
    pieces = lambda n: F.ceil(F.col(n) / most).cast("int")
    large = store(sizes.select("scope", pieces("_nl").alias("_ka"), pieces("_nr").alias("_kb")), "large-scopes")
    l, r, on = _measured(left, "l", least, strict), _measured(right, "r", least, strict), ["scope"]  # noqa: E741
    if not large.df.isEmpty():
        on = ["scope", "_a", "_b"]
        l, r = (x.repartition(parallelism(left.sparkSession), *on) for x in (_in_pieces(l, large.df, "l", "a", "b"), _in_pieces(r, large.df, "r", "b", "a")))  # noqa: E741 - by number, since pieces are few bytes that Spark would put into one task
    found = store(l.join(r, on).where(_MAY).where(_ALIKE).select("scope", "l", "r"), "near-words")
    large.drop()
    return [found]


def star_clusters(scored: DataFrame, node: str, centre: str, score: str, label: str, margin: float = 1e-9) -> DataFrame:
    """(node, centre, score): each node at its best centre; none if a centre of another label is within ``margin``.

    scored is read twice, so it should be a stored table or a light plan on one.
    """
    edges = scored.select(node, centre, score, label)
    best = edges.groupBy(node).agg(F.max(score).alias("_top"))
    tied = edges.join(best, node).where(F.col(score) >= F.col("_top") - margin)
    one = tied.groupBy(node).agg(F.min_by(centre, F.struct(-F.col(score), F.col(centre))).alias(centre), F.min(label).alias("_lo"), F.max(label).alias("_hi"), F.max(score).alias(score))
    return one.where("_lo = _hi").select(node, centre, score)
