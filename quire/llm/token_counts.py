"""Token counts by an exact length histogram.

Documents are encoded whole and only their lengths are kept: a batch's lengths are counted where they are made, then summed.
Suffix sums over the histogram answer, for every context limit, how many documents reach it and how many tokens remain when
each is truncated there; prefix sums give quantiles. The sums run in two levels (lengths within a block of ``BLOCK`` lengths,
then block totals), so no task sees all lengths.

A run of white space is one piece of the pattern, but for its last character where text follows. Long runs are handed to the encoder
as that piece, as its pattern search overflows the stack on a run of a megabyte; short ones give the same counts either way.

Cases: a null or empty text has length 0; an empty table gives an empty histogram; other columns are ignored. The tokenizer's
file is read once by the driver and sent to the executors (its size does not depend on the input).
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import cut, text_batches
from .textvec import chunks, tidy

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK = 1024
#: White space in the sense of the pattern, from so many characters on.
LONG_RUN = 10_000
_SPACE = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def load_encoder(data: bytes, pattern: str = PATTERN):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encoded_length(encoder, text: str, pattern: str = PATTERN, long_run: int = LONG_RUN) -> int:
    """Tokens of a whole text. Another pattern than PATTERN is left to the encoder alone."""
    if pattern != PATTERN:
        return len(encoder.encode_ordinary(text))
    total = at = 0
    for run in re.finditer(f"(?<!{_SPACE}){_SPACE}{{{max(2, long_run)},}}", text):
        end = run.end() - (run.end() < len(text))
        total += len(encoder.encode_ordinary(text[at : run.start()])) + len(encoder._encode_single_piece(text[run.start() : end]))
        at = end
    return total + len(encoder.encode_ordinary(text[at:]))


def _lengths(data, pattern: str):
    @tidy
    def run(batches):
        encoder = load_encoder(data.value, pattern)
        for batch in batches:
            for _, part in chunks(batch.column(0)):
                got = np.fromiter((encoded_length(encoder, t, pattern) if t else 0 for t in part.to_pylist()), dtype=np.int64, count=len(part))
                values, counts = np.unique(got, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts)], names=["n_tokens", "c"])

    return run


def length_histogram(docs: DataFrame, text_col: str = "text", tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """(n_tokens, n_docs): how many documents have each encoded length."""
    text_batches(docs.sparkSession)
    with open(tokenizer, "rb") as file:
        data = docs.sparkSession.sparkContext.broadcast(file.read())
    return docs.select(F.col(text_col)).mapInArrow(_lengths(data, pattern), "n_tokens long, c long").groupBy("n_tokens").agg(F.sum("c").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length L that occurs: n_docs, tokens, docs_at_least (length >= L), docs_at_most, tokens_at_most, truncated_total
    (tokens left when every document is cut to L) and share_at_most (the quantile that L is)."""
    held = cut(histogram.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("block", F.floor(F.col("n_tokens") / BLOCK)), "lengths")
    totals = held.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    totals = cut(totals.select("block", F.coalesce(F.sum("bd").over(before), F.lit(0)).alias("d0"), F.coalesce(F.sum("bt").over(before), F.lit(0)).alias("t0"), F.sum("bd").over(all_rows).alias("all_docs")), "blocks")
    within = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = held.join(totals, "block").withColumn("docs_at_most", F.col("d0") + F.sum("n_docs").over(within)).withColumn("tokens_at_most", F.col("t0") + F.sum("tokens").over(within))
    longer = F.col("all_docs") - F.col("docs_at_most")
    return run.select("n_tokens", "n_docs", "tokens", (longer + F.col("n_docs")).alias("docs_at_least"), "docs_at_most", "tokens_at_most", (F.col("tokens_at_most") + longer * F.col("n_tokens")).alias("truncated_total"), (F.col("docs_at_most") / F.col("all_docs")).alias("share_at_most"))


def truncated_total(sums: DataFrame, limit: int) -> int:
    """Tokens left when every document is cut to ``limit``: the last length up to it, and all longer ones at the limit."""
    row = sums.where(F.col("n_tokens") <= limit).agg(F.max_by(F.struct("n_tokens", "truncated_total", (F.col("docs_at_least") - F.col("n_docs")).alias("longer")), "n_tokens").alias("r")).first().r
    if row is None:
        row = sums.agg(F.max("docs_at_least").alias("n")).first()
        return limit * (row.n or 0)
    return row.truncated_total + row.longer * (limit - row.n_tokens)


def length_quantile(sums: DataFrame, q: float) -> int | None:
    """The smallest length that at least the share ``q`` of documents does not exceed."""
    return sums.where(F.col("share_at_most") >= q).agg(F.min("n_tokens").alias("v")).first().v
