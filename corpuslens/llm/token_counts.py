"""Counting a SentencePiece model's tokens with a whole-token shortcut (operator 8).

No piece of the vocabulary holds a space after another character, so merging never crosses from a word
into the space that follows: each run of spaces with the word after it (a pre-token) is encoded alike
alone and inside its text. ``TokenCounter`` checks that property of the model when it loads it, then
asks the library, once for every vocabulary string, whether the string alone is one token. Pre-tokens
that match such a proven string count 1; only the others are merged by the library, and a bounded memo
keeps their counts.

Defined results: a null or empty text has 0 bytes and 0 tokens; a text of spaces has the library's
count; texts are never cut; repeated rows and other columns play no part.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.hashing import bound_batches

MARK = "▁"
MEMO = 1 << 20
LONGEST_IN_MEMO = 64


class TokenCounter(dict):
    """Word (without the space before it) -> tokens, proven ones first, others as they are asked for."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = ("is_byte", "is_control", "is_unknown", "is_unused")
        ids = [i for i in range(self.model.get_piece_size()) if not any(getattr(self.model, f)(i) for f in special)]
        pieces = [self.model.id_to_piece(i) for i in ids]
        self.splits = not any(MARK in p.lstrip(MARK) for p in pieces) and self.model.encode("x  y", out_type=str)[0] == f"{MARK}x"
        alone = [(p[1:], i) for p, i in zip(pieces, ids, strict=True) if p.startswith(MARK) and MARK not in p[1:]]
        self.proven = {w: 1 for (w, i), got in zip(alone, self.model.encode([w for w, _ in alone], num_threads=1), strict=True) if got == [i]}
        self.proven[""] = 1
        self.update(self.proven)

    def __missing__(self, word: str) -> int:
        n = len(self.model.encode(word))
        if len(word) <= LONGEST_IN_MEMO:
            if len(self) >= MEMO + len(self.proven):
                self.clear()
                self.update(self.proven)
            self[word] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.splits:
            return len(self.model.encode(text))
        text = text.replace(MARK, " ")
        if "  " in text or text[0] == " ":
            return sum(self[x[1:]] if x.strip(" ") else len(self.model.encode(x[1:])) or 1 for x in re.findall(" +[^ ]+| +", f" {text}"))
        return sum(map(self.__getitem__, text.split(" ")))


@functools.lru_cache(maxsize=4)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def count_tokens(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """One row for each row of ``docs``: id, n_bytes (UTF-8), n_tokens, over_limit. No shuffle; one pass of Arrow batches."""

    def batches(rows):
        count = counter(path).count
        for batch in rows:
            n = [count(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")).mapInArrow(batches, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
