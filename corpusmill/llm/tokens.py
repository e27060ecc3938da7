"""Token counts by a public tokenizer, and ranks within keys that may hold a large share of all rows."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Where the vocabulary lies by default; any file of ranks in the same format will do.
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Texts are encoded in stretches of about so many characters, split where a word begins, which changes no count.
STRETCH = 200_000


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(VOCABULARY))


@lru_cache(maxsize=2)
def encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("counted", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, path: str) -> int:
    """Tokens of a whole text."""
    own, total, at = encoder(path), 0, 0
    while len(text) - at > STRETCH:
        cut = at + STRETCH
        while cut < len(text) and not (text[cut] == " " and not text[cut - 1].isspace()):
            cut += 1
        total += len(own.encode_ordinary(text[at:cut]))
        at = cut
    return total + len(own.encode_ordinary(text[at:]))


def token_count(text: Column, path: str | None = None) -> Column:
    """Tokens of a string column; a null text has none."""
    path = path or default_vocabulary()

    @F.pandas_udf("long")
    def of(values: pd.Series) -> pd.Series:
        return values.map(lambda v: count_tokens(v, path) if v else 0)

    return of(text)


def rank_within(df: DataFrame, keys: list[str], order: list[Column], salts: int = 64) -> DataFrame:
    """``df`` with ``rank``, from 0 and without gaps within each key, in an order of the engine's choice.

    Rows of a key are split into salted parts by their order columns; a part's ranks follow those of the parts before
    it. No task sorts more than one part, so a key with a third of all rows is no obstacle. Order columns must tell
    rows apart; ``df`` must give the same rows when it is read twice.
    """
    salted = df.withColumn("salt_", F.pmod(F.xxhash64(*order), F.lit(salts)))
    sizes = salted.groupBy(*keys, "salt_").agg(F.count("*").alias("n_"))
    before = Window.partitionBy(*keys).orderBy("salt_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "salt_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("before_"))
    own = F.row_number().over(Window.partitionBy(*keys, "salt_").orderBy(*order))
    ranked = salted.withColumn("own_", own).join(offsets, [*keys, "salt_"])
    return ranked.withColumn("rank", F.col("before_") + F.col("own_") - 1).drop("salt_", "own_", "before_")
