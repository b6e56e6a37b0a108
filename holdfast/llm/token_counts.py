"""Token counts by a two-tier lookup on the map side.

First tier: a broadcast hash table from frequent pre-tokens to their lengths in tokens (at most
65,536 short strings). Second tier: each Python worker's cache of the others, kept for its later
tasks, filled by the tokenizer and emptied when it holds 400,000. No pre-token is shuffled and no text leaves its
task, so the job is one scan at any size.

Defined results: a null or empty text has 0 bytes and 0 tokens; texts are encoded whole, however
long; special strings inside a text become their special token, the library's default; repeated
rows and null ids give a row each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from holdfast.llm.pieces import frequent_stretches, frequent_table, give_back, kept_pieces, tokenizer
from holdfast.llm.tables import whole_text

LIMIT = 512


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = LIMIT, cut: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` by the tokenizer file at ``path``.

    ``cut=False`` encodes each text in one call: for ``.json`` files other than byte-level BPE
    and for ``.model`` files, whose pre-tokens may reach across spaces.
    """
    spark = docs.sparkSession
    table = frequent_table(frequent_stretches(docs, text_col, id_col), path, len) if cut else {}
    shared = spark.sparkContext.broadcast(table)
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        F.octet_length(whole_text(text_col)).cast("long").alias("n_bytes"),
        whole_text(text_col).alias("text"),
    )

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if cut:
            lengths = kept_pieces(path, len, shared.value).lengths
        elif path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            lengths = lambda texts: [len(model.encode(t, num_threads=1)) for t in texts.to_pylist()]
        else:
            encode = tokenizer(path).encode
            lengths = lambda texts: [len(encode(t, add_special_tokens=False).ids) for t in texts.to_pylist()]
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lengths(batch.column(2)), pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )
        give_back()

    kind = narrow.schema["doc_id"].dataType.simpleString()
    rows = narrow.mapInArrow(counted, f"doc_id {kind}, n_bytes long, n_tokens long")
    return rows.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
