"""Token counts: pieces are counted once per distinct pre-token and summed by document, without ids."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, documents, string_array, text_column

RUNS = re.compile(r" +[^ ]*")
SPACE_MARK = "▁"  # fixed value: the vocabulary's sign for a space


def pre_tokens(text: str) -> list[str]:
    """The parts of a text across which no piece of the vocabulary can reach.

    The library puts one space before a text and no piece has anything before a space sign, so a part is a run of
    spaces with what follows up to the next; the first of its spaces is left out, as the library adds it again.
    """
    if SPACE_MARK in text:
        text = text.replace(SPACE_MARK, " ")
    if not text:
        return []
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [x[1:] for x in RUNS.findall(" " + text)]
    return text.split(" ")


class PieceCounter:
    """Counts of pieces by pre-token; each distinct pre-token is encoded once as long as it is remembered."""

    def __init__(self, model: str, most: int = 1_000_000):
        import sentencepiece

        self.model, self.most, self.known = sentencepiece.SentencePieceProcessor(model_file=model), most, {}

    def counts(self, texts: list[str]) -> list[int]:
        """The number of pieces of each text: its pre-token frequencies joined to the pieces of each pre-token."""
        frequencies = [Counter(pre_tokens(x)) for x in texts]
        if len(self.known) > self.most:  # bounds the memory; what is forgotten is counted anew
            self.known = {}
        new = list(set().union(*frequencies).difference(self.known)) if frequencies else []
        for a in range(0, len(new), 4096):
            part = new[a : a + 4096]
            self.known.update(zip(part, map(len, self.model.encode(part, num_threads=1)), strict=True))
        # a lone space is an empty pre-token: the library gives it one piece, but nothing for an empty text
        self.known[""] = 1
        known = self.known
        return [sum(known[w] * n for w, n in x.items()) for x in frequencies]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, limit: int = 4096) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit, n_pretokens (all, not only the distinct ones).

    A map over partitions without a shuffle: for each batch, pre-token frequencies by document, the distinct
    pre-tokens that this task has not met yet encoded once, and a join of both summed by document. Null texts count
    as empty and have no tokens; repeated rows give repeated results; other columns are ignored.
    """
    import public_tokenizers

    model = model or public_tokenizers.path("piece_bpe_32k.model")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(model)
        for batch in batches:
            texts = string_array(batch.column(1))
            sizes = []
            for a in range(0, len(texts), 256):
                sizes += counter.counts(texts[a : a + 256].to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64())], ["id", "n_bytes", "n_tokens"])

    rows = docs.select(col(id_col).alias("id"), text_column(text_col).alias("t"), F.octet_length(text_column(text_col)).cast("long").alias("n_bytes"))
    kind = dict(rows.dtypes)["id"]
    rows = rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
    return rows.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
