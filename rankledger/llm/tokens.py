"""Token counts of whole texts by a public tokenizer's vocabulary file, in Arrow batches."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Vocabulary file (ranks of byte-level BPE); a parameter of every operator that counts tokens.
VOCABULARY = os.environ.get("RANKLEDGER_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the word pattern that this vocabulary was made with.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer texts are encoded in stretches; no word of PATTERN reaches over a space between two visible characters.
STRETCH = 50_000
_GAP = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, vocabulary: str = VOCABULARY) -> int:
    enc, n, at = encoder(vocabulary), 0, 0
    while len(text) - at > STRETCH:
        gap = _GAP.search(text, at + STRETCH)
        if gap is None:
            break
        n += len(enc.encode_ordinary(text[at : gap.start()]))
        at = gap.start()
    return n + len(enc.encode_ordinary(text[at:]))


def with_token_counts(df: DataFrame, text: str, out: str = "n_tokens", vocabulary: str = VOCABULARY, extra: dict[str, Callable[[pa.Array], np.ndarray]] | None = None) -> DataFrame:
    """``df`` without its text and with the number of its tokens; a null text has none.

    extra: further double columns, each by a function of the batch's texts, so that texts cross to Python once. Columns
    of the new names are replaced.
    """
    more = extra or {}
    kept = [(c, t) for c, t in df.dtypes if c != text and c != out and c not in more]
    ordered = df.select(*[c for c, _ in kept], text)
    schema = ", ".join([f"`{c.replace('`', '``')}` {t}" for c, t in kept] + [f"{out} bigint"] + [f"{name} double" for name in more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pa.array([count_tokens(t, vocabulary) if t else 0 for t in b.column(len(kept)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], sizes, *[pa.array(f(b.column(len(kept))), pa.float64()) for f in more.values()]], names=[*[c for c, _ in kept], out, *more])

    return ordered.mapInArrow(run, schema)
