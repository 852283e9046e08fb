"""Reading level of each document: classic readability formulas, calibrated on labelled anchors, joined by their median.

Counting works on the bytes of whole Arrow batches with array operations, never word by word in Python (eight built-in
regular expressions over each text took ten times the CPU). Syllables follow hyphenation-style rules: a group of vowels
is a syllable, but a silent final e, es or ed is none, and vowels that meet in hiatus (i before a, o, u outside -tion
and the like; eo; ua) are two.

Five formulas give one estimate each, by the terms of Flesch-Kincaid (words a sentence, syllables a word), Gunning Fog
(words a sentence, share of words of three syllables and more), SMOG (such words a sentence, syllables a word), ARI
(words a sentence, letters a word) and LIX (words a sentence, share of words of over six letters). Their published
coefficients give school grades; for the anchors' scale each formula keeps its terms (in logarithms, with squares) and
its coefficients are fitted by least squares on the anchors. The weighted median of the five, each weighing as much as its
squared error on the anchors is small, is cut at the borders between levels that misplace the fewest anchors.

Lines of fewer than ``short_line`` bytes without closing punctuation (headings, page lines, addresses) and names of
character entities (&amp;) are no prose and not counted; a text without any line of prose is counted whole. Text without a single letter,
empty or null has a null level, and so has every text if no anchor has a text and a level. Letter case and spacing play no part. Documents stay as many rows as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTS = ["words", "sentences", "syllables", "hard_words", "letters", "long_words"]
#: The terms of the five formulas, by the names of TERMS.
FORMULAS = {"flesch_kincaid": ("wps", "spw"), "fog": ("wps", "hard"), "smog": ("hps", "spw"), "ari": ("wps", "cpw"), "lix": ("wps", "long")}
#: Largest number of anchors that is read to fit; of more, those with the smallest ids.
MAX_ANCHORS = 20_000


def _lookup(chars: bytes, high: bool = False) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    out[128:] = high
    return out


_LETTER = _lookup(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", True)
_INSIDE = _lookup(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ'-", True)
_VOWEL = _lookup(b"aeiouyAEIOUY", True)  # a letter beyond ASCII counts as a vowel
_SPACE, _DIGIT, _STOP, _CLOSE = _lookup(b" \t\r\n\f\v"), _lookup(b"0123456789"), _lookup(b".!?"), _lookup(b"\"')")
_SILENT = {end: _lookup(bytes(letters, "ascii")) for end, letters in (("e", "bcdfghjkmnpqrstvwxz"), ("s", "bdfhjkmnpqrtvw"), ("d", "bcfghjklmnpqrsvwxz"))}
#: Lines of fewer bytes without closing punctuation are no prose; 0 counts every line.
SHORT_LINE = 120
#: Bytes that are counted at once, whole documents at least.
BLOCK = 1 << 21


def count_block(raw: np.ndarray, ends: np.ndarray, short_line: int = SHORT_LINE) -> np.ndarray:
    """COUNTS of every document; raw: bytes of the documents, each closed by a line feed, ends: where they end (exclusive)."""
    n = len(raw)
    low = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    nxt = np.append(raw[1:], 10)
    inside = _INSIDE[raw]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # a document ends with a line feed
    line_end = np.flatnonzero(raw == 10)
    visible = np.maximum.accumulate(np.where(_SPACE[raw], -1, np.arange(n, dtype=np.int64)))
    last = visible[line_end]
    first = np.append(0, line_end[:-1] + 1)
    closed = np.where(last >= first, _STOP[raw[last]] | _CLOSE[raw[last]], False) | (raw[np.maximum(last, 0)] >= 128) & (raw[np.maximum(last - 2, 0)] == 0xE2)
    heading = ~closed & (line_end - first < short_line)
    doc_of_line = np.searchsorted(ends, line_end, side="right")
    prose = np.bincount(doc_of_line, weights=~heading & (last >= first), minlength=len(ends)) > 0
    heading &= prose[doc_of_line]  # a text without any line of prose is counted whole

    vowel = _VOWEL[raw]
    group = vowel & ~np.append(False, vowel[:-1])
    prv = np.append(10, low[:-1])
    aou = (low == 97) | (low == 111) | (low == 117)
    soft = _lookup(b"tscgx")[np.append([10, 10], low[:-2])]
    hiatus = (prv == 105) & aou & ~soft | (prv == 101) & (low == 111) | (prv == 117) & (low == 97) & ~_lookup(b"gq")[np.append([10, 10], low[:-2])]
    sums = np.append(0, np.cumsum(group.astype(np.int32) + hiatus, dtype=np.int64))
    letters_sum = np.append(0, np.cumsum(_LETTER[raw] & ((raw < 128) | (raw >= 0xC0)), dtype=np.int64))
    vowels, letters = sums[stops] - sums[starts], letters_sum[stops] - letters_sum[starts]
    z, y, x = low[stops - 1], low[np.maximum(stops - 2, 0)], low[np.maximum(stops - 3, 0)]
    silent = (z == 101) & _SILENT["e"][y] | (z == 115) & (y == 101) & _SILENT["s"][x] | (z == 100) & (y == 101) & _SILENT["d"][x]
    syllables = np.maximum(vowels - (silent & (vowels > 1)), 1)
    entity = (starts > 0) & (raw[np.maximum(starts - 1, 0)] == 38) & (raw[np.minimum(stops, n - 1)] == 59)
    keep = (letters > 0) & ~heading[np.searchsorted(line_end, starts)] & ~entity
    doc = np.searchsorted(ends, starts, side="right")[keep]
    per = lambda w=None: np.bincount(doc, weights=w, minlength=len(ends)).astype(float)

    at = np.flatnonzero(_STOP[raw] & ~_STOP[nxt] & (_SPACE[nxt] | _CLOSE[nxt] | (nxt == 0xE2)))
    follower = raw[np.minimum(at + 2, n - 1)]
    at = at[~(_DIGIT[follower] & (nxt[at] == 32)) & ~heading[np.searchsorted(line_end, at)]]
    sentences = np.bincount(np.searchsorted(ends, at, side="right"), minlength=len(ends)).astype(float)
    syllables, letters = syllables[keep], letters[keep]
    return np.stack([per(), np.maximum(sentences, 1), per(syllables), per(syllables >= 3), per(letters), per(letters > 6)], axis=1)


def count_texts(texts: pa.Array, short_line: int = SHORT_LINE) -> np.ndarray:
    """COUNTS of every text of an Arrow string array; null counts as empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    out, i = [np.zeros((0, len(COUNTS)))], 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, side="right")) - 1)
        own = offsets[i : j + 1] - offsets[i]
        block = np.insert(data[offsets[i] : offsets[j]], own[1:], 10)
        out.append(count_block(block, own[1:] + np.arange(1, j - i + 1), short_line))
        i = j
    return np.concatenate(out)


def with_counts(df: DataFrame, text: str, out: str = "_counts") -> DataFrame:
    """``df`` with a struct of COUNTS, named ``out``, in place of its text; another column of that name is replaced."""
    kept = [(c, t) for c, t in df.dtypes if c not in (text, out)]
    inner = [f"c{i}" for i in range(len(kept))]
    schema = ", ".join([f"{i} {t}" for i, (_, t) in zip(inner, kept)] + [f"{c} double" for c in COUNTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = count_texts(b.column(len(kept)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *[pa.array(np.ascontiguousarray(counts[:, i])) for i in range(len(COUNTS))]], names=[*inner, *COUNTS])

    quoted = lambda c: F.col(f"`{c.replace('`', '``')}`")
    counted = df.select(*[quoted(c).alias(i) for i, (c, _) in zip(inner, kept)], quoted(text).alias("text")).mapInArrow(run, schema)
    return counted.select(*[F.col(i).alias(c) for i, (c, _) in zip(inner, kept)], F.struct(*COUNTS).alias(out))


def terms(counts: str = "_counts") -> dict[str, Column]:
    c = {k: F.col(f"{counts}.{k}") for k in COUNTS}
    w = F.greatest(c["words"], F.lit(1.0))
    syllables = F.greatest(c["syllables"], w)
    return {"wps": F.log(w / c["sentences"]), "spw": F.log(syllables / w), "hard": F.log((c["hard_words"] + 1) / w), "hps": F.log((c["hard_words"] + 0.5) / c["sentences"]),
            "cpw": F.log((c["letters"] + 1) / w), "long": F.log((c["long_words"] + 1) / w)}


@dataclass(frozen=True)
class LevelModel:
    """Least-squares coefficients and weight of each formula, and the cuts between levels of their weighted median."""

    coefficients: dict[str, list[float]]
    weights: dict[str, float]
    cuts: list[tuple[int, float]]
    lowest: int | None


def _design(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(a)), a, b, a * a, a * b, b * b], axis=1)


def fit(anchors: DataFrame, text: str, level: str, key: str, limit: int = MAX_ANCHORS) -> LevelModel:
    """Fit on at most ``limit`` labelled anchors; rows without text or level are left out."""
    rows = with_counts(anchors.where(F.col(text).isNotNull() & F.col(level).isNotNull()).orderBy(key).limit(limit), text)
    t = terms()
    got = rows.select(F.col(level).cast("int"), *t.values()).toPandas().to_numpy(dtype=float)
    if not len(got):
        return LevelModel({}, {}, [], None)
    y, x = got[:, 0], {k: got[:, i + 1] for i, k in enumerate(t)}
    betas, estimates = {}, []
    for name, (a, b) in FORMULAS.items():
        design = _design(x[a], x[b])
        betas[name] = np.linalg.lstsq(design, y, rcond=None)[0].tolist()
        estimates.append(design @ np.array(betas[name]))
    weights = _weights(np.stack(estimates), y)
    middle = _weighted_median(np.stack(estimates), weights)
    levels = sorted(set(y.astype(int).tolist()))
    return LevelModel(betas, dict(zip(betas, weights.tolist())), [(hi, _cut(middle, y, lo)) for lo, hi in zip(levels, levels[1:])], levels[0])


def _weights(estimates: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Shares of the formulas' say: inverse mean squared errors (none below a thousandth of a level squared)."""
    w = 1 / np.maximum(((estimates - y) ** 2).mean(axis=1), 1e-3)
    return w / w.sum()


def _weighted_median(estimates: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Of each column: the smallest estimate up to which half of the weights lie."""
    order = np.argsort(estimates, axis=0, kind="stable")
    reached = np.cumsum(weights[order], axis=0) >= 0.5 - 1e-12
    return np.take_along_axis(np.take_along_axis(estimates, order, 0), reached.argmax(axis=0)[None], 0)[0]


def _cut(score: np.ndarray, y: np.ndarray, below: int) -> float:
    """The border with the fewest misplaced anchors; among equals the middle one."""
    points = np.unique(score)
    if len(points) < 2:
        return float(below) + 0.5
    mids = (points[1:] + points[:-1]) / 2
    low, high = np.sort(score[y <= below]), np.sort(score[y > below])
    wrong = (len(low) - np.searchsorted(low, mids, side="right")) + np.searchsorted(high, mids, side="right")
    best = mids[wrong == wrong.min()]
    return float(best[len(best) // 2])


# The published formulas, as school grades, of words a sentence, syllables a word, shares of hard and long
# words, hard words a sentence and letters a word. LIX comes as points, about four of which are one grade.
GRADES = {
    "flesch_kincaid": lambda c: 0.39 * c["wps"] + 11.8 * c["spw"] - 15.59,
    "fog": lambda c: 0.4 * (c["wps"] + 100 * c["hard"]),
    "smog": lambda c: 1.0430 * np.sqrt(30 * c["hps"]) + 3.1291,
    "ari": lambda c: 4.71 * c["cpw"] + 0.5 * c["wps"] - 21.43,
    "lix": lambda c: (c["wps"] + 100 * c["long"]) / 4 - 1,
}


def cross_validated(anchors: DataFrame, text: str, level: str, key: str, folds: int = 5, limit: int = MAX_ANCHORS) -> list[tuple[str, str, int, int]]:
    """(coefficients, estimate, anchors, placed right) of held-out anchors, for each formula, and for their median and weighted median.

    ``published``: grades by the published coefficients, only the cuts between levels are fitted; ``refitted``: the
    coefficients too, as ``fit`` does. At most ``limit`` anchors, those with the smallest ids.
    """
    rows = with_counts(anchors.where(F.col(text).isNotNull() & F.col(level).isNotNull()).orderBy(key).limit(limit).withColumn("_fold", F.pmod(F.xxhash64(key), F.lit(folds))), text)
    t = terms()
    got = rows.select("_fold", F.col(level).cast("int"), *t.values(), *[F.col(f"_counts.{c}") for c in COUNTS]).toPandas().to_numpy(dtype=float)
    if not len(got):
        return []
    fold, y, x = got[:, 0], got[:, 1].astype(int), {k: got[:, i + 2] for i, k in enumerate(t)}
    words, sentences, syllables, hard, letters, long = (got[:, 2 + len(t) + i] for i in range(len(COUNTS)))
    words = np.maximum(words, 1)
    raw = {"wps": words / sentences, "spw": np.maximum(syllables, words) / words, "hard": hard / words, "hps": hard / sentences, "cpw": letters / words, "long": long / words}
    published = {name: grade(raw) for name, grade in GRADES.items()}
    right: dict[tuple[str, str], int] = {}
    for k in range(folds):
        train, test = fold != k, fold == k
        if not test.any() or not train.any():
            continue
        refitted = {}
        for name, (a, b) in FORMULAS.items():
            design = _design(x[a], x[b])
            refitted[name] = design @ np.linalg.lstsq(design[train], y[train].astype(float), rcond=None)[0]
        for kind, estimates in (("published", published), ("refitted", refitted)):
            stacked = np.stack(list(estimates.values()))
            joined = [("median", np.median(stacked, axis=0))]
            if kind == "refitted":
                joined.append(("weighted_median", _weighted_median(stacked, _weights(stacked[:, train], y[train]))))
            for name, e in (*estimates.items(), *joined):
                levels = sorted(set(y[train].tolist()))
                cuts = [_cut(e[train], y[train].astype(float), lo) for lo in levels[:-1]]
                placed = np.array(levels)[np.searchsorted(cuts, e[test])]
                right[kind, name] = right.get((kind, name), 0) + int((placed == y[test]).sum())
    return [(kind, name, len(y), n) for (kind, name), n in right.items()]


def reading_levels(df: DataFrame, text: str, model: LevelModel) -> DataFrame:
    """``df`` without its text, with the five estimates, their median and the level (bigint); columns of these names are replaced."""
    results = [*[f"{name}_estimate" for name in FORMULAS], "median_estimate", "reading_level"]
    rest = [c for c in df.columns if c != text and c not in results]
    quoted = lambda c: F.col(f"`{c.replace('`', '``')}`")
    counted = with_counts(df.select(F.struct(*[quoted(c).alias(f"c{i}") for i, c in enumerate(rest)], F.lit(0).alias("z")).alias("_row"), quoted(text).alias("_text")), "_text")
    t = terms()
    counted = counted.withColumns({f"_{k}": v for k, v in t.items()})
    estimates = {}
    for name, (a, b) in FORMULAS.items():
        k, p, q = model.coefficients.get(name) or [None] * 6, F.col(f"_{a}"), F.col(f"_{b}")
        estimates[f"{name}_estimate"] = F.lit(k[0]).cast("double") + p * k[1] + q * k[2] + p * p * k[3] + p * q * k[4] + q * q * k[5] if k[0] is not None else F.lit(None).cast("double")
    counted = counted.withColumns(estimates)
    said = F.array_sort(F.array(*[F.struct(F.col(f"{name}_estimate").alias("e"), F.lit(model.weights.get(name, 0.0)).alias("w")) for name in FORMULAS]))
    start = F.struct(F.lit(0.0).alias("c"), F.lit(None).cast("double").alias("v"))
    reach = lambda acc, x: F.struct((acc.c + x.w).alias("c"), F.coalesce(acc.v, F.when(acc.c + x.w >= 0.5 - 1e-12, x.e)).alias("v"))
    middle = F.aggregate(said, start, reach, lambda acc: acc.v)
    counted = counted.withColumn("median_estimate", F.when(F.col("_counts.letters") > 0, middle))
    level = F.lit(model.lowest)
    for value, cut in model.cuts:
        level = F.when(F.col("median_estimate") > cut, F.lit(value)).otherwise(level)
    counted = counted.withColumn("reading_level", F.when(F.col("median_estimate").isNotNull(), level).cast("bigint"))
    return counted.select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(rest)], *results)
