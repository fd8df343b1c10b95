"""Token counts of whole texts and of all their prefixes, by prefix dynamic programming.

One pass stores, for every text, the exact number of tokens of every prefix. Length, truncation and budget questions are
then lookups: nothing is encoded again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cartolith.llm.wordbpe import word_bpe

_CHARACTERS = 2_000_000  # per Arrow batch sent back


def prefix_counts(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, prefix_tokens), one row per row of docs: prefix_tokens[n] (from 1) counts the tokens of n characters.

    * counts are those of the library for the vocabulary file, without added special tokens, truncation or padding;
      special strings inside a text count as the library counts them
    * characters are code points of the text's NFC form, which the vocabulary's rules start with; n_bytes is the UTF-8
      length of the text as given
    * null and empty texts have no prefixes and 0 bytes; null ids and repeated rows are kept; texts of any length are
      counted whole; extra columns are ignored; an empty table gives an empty result
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = word_bpe(vocabulary)

        def packed(ids, sizes, counts):
            ends = np.cumsum([0, *map(len, counts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int32)))
            return pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), lists], ["id", "n_bytes", "prefix_tokens"])

        for batch in batches:
            sizes, counts, held, first = [], [], 0, 0
            for i, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                sizes.append(len(text.encode("utf-8", "surrogatepass")))
                counts.append(counter.prefix_counts(text))
                held += len(text)
                if held >= _CHARACTERS:
                    yield packed(batch.column(0).slice(first, i + 1 - first), sizes, counts)
                    sizes, counts, held, first = [], [], 0, i + 1
            if counts:
                yield packed(batch.column(0).slice(first), sizes, counts)

    narrow = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return narrow.mapInArrow(run, "id long, n_bytes long, prefix_tokens array<int>")


def tokens(prefix_tokens: Column | str = "prefix_tokens") -> Column:
    """Tokens of the whole text."""
    return F.coalesce(F.try_element_at(prefix_tokens, F.lit(-1)), F.lit(0)).cast("long")


def tokens_of_first(characters: Column | int, prefix_tokens: Column | str = "prefix_tokens") -> Column:
    """Tokens of the first so many characters; 0 for none, all for more than there are."""
    n = F.least(F.lit(characters) if isinstance(characters, int) else characters, F.size(prefix_tokens))
    return F.when(n <= 0, F.lit(0)).otherwise(F.try_element_at(prefix_tokens, F.greatest(n, F.lit(1)))).cast("long")


def characters_within(budget: int, prefix_tokens: Column | str = "prefix_tokens") -> Column:
    """Length of the longest prefix of at most ``budget`` tokens; counts can fall when a letter completes a token."""
    fits = F.transform(prefix_tokens, lambda t, i: F.when(t <= budget, i + 1).otherwise(0))
    return F.coalesce(F.array_max(fits), F.lit(0)).cast("long")


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counted = prefix_counts(docs, public_tokenizers.path("word_bpe_49k.json"))
    return counted.select(F.col("id").alias("doc_id"), "n_bytes", tokens().alias("n_tokens"), (tokens() > 2048).alias("over_limit"))
