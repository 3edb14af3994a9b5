"""Token counts: pieces counted once per distinct pre-token, joined to per-document frequencies.

A document's count is the sum over its distinct pre-tokens of frequency x pieces, plus its special
strings; no id sequence of a document is built. The join runs inside each task: a batch's distinct
pre-tokens that its table does not hold yet are counted in one call to the library, and the table is
emptied when it exceeds ``memo_entries``, so memory is bounded and nothing is shuffled. (A shuffled join
of all (document, pre-token) pairs would move several times the corpus.)
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm._common import map_arrow, table
from quillon.llm.tokenize import default_path, load

LIMIT = 1024
#: Distinct pre-tokens that one Python worker remembers.
MEMO_ENTRIES = 1_000_000

_memo: dict[str, dict[str, int]] = {}


def count_batch(texts: list[str | None], path: str, memo_entries: int = MEMO_ENTRIES) -> list[int]:
    """Token counts of some texts (null counts as empty)."""
    tok = load(path)
    memo = _memo.setdefault(path, {})
    counted = [(Counter(words), specials) for words, specials in (tok.pre_tokens(t or "") for t in texts)]
    new = list({w for c, _ in counted for w in c if w not in memo})
    if new:
        if len(memo) + len(new) > memo_entries:
            memo.clear()
            new = list({w for c, _ in counted for w in c})
        for w, e in zip(new, tok.library.encode_batch_fast(new, add_special_tokens=False), strict=True):
            memo[w] = len(e)
    return [sum(n * memo[w] for w, n in c.items()) + specials for c, specials in counted]


def token_counts(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_path: str | None = None,
    limit: int = LIMIT,
    memo_entries: int = MEMO_ENTRIES,
) -> DataFrame:
    """Per document row ``doc_id, n_bytes, n_tokens, over_limit``.

    Null and empty texts have 0 bytes and 0 tokens; repeated rows each get their row; other columns are
    ignored.
    """
    path = tokenizer_path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n = count_batch(part.column(2).to_pylist(), path, memo_entries)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
        F.col(text_col).alias("text"),
    )
    counted = map_arrow(source, run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
