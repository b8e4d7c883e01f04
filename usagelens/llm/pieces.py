"""SentencePiece encoding and decoding through a table of distinct marked words.

If no piece of the model has a word marker behind another character, and none
holds a line feed, then merges never cross the border before a marker or around
a line feed, and the ids of a text are the ids of its marked words, one after
the other. Each task segments a distinct word once, keeps the result in a table
of bounded size and joins ids back by position. A table for all tasks would
have to shuffle every word of every text out and back, several times the input.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import text_of

MARK = "▁"
TABLE_WORDS, LONG_WORD = 200_000, 256
OUT_CHARS = 2_000_000


class Words(dict):
    """Marked word -> (ids as int32 bytes, decoded text); emptied when full.

    Words above LONG_WORD characters (texts of scripts without spaces) hardly
    come twice; they are segmented where they stand, so the table has a bounded
    number of bytes as well as of words.
    """

    CHUNK = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")

    def __init__(self, model: str, limit: int = TABLE_WORDS):
        super().__init__()
        self.processor = sentencepiece.SentencePieceProcessor(model_file=model)
        self.limit = limit
        sp, lead = self.processor, "\n"
        self.before = sp.encode(lead)
        self.start = len(sp.decode(self.before))
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        same = [" a", "é́ ﬁ", "a  b ", "Ａ　b"]  # no rewriting of characters, one space added in front
        self.separable = (not any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in pieces)
                          and all(sp.normalize(t) == MARK + t.replace(" ", MARK) for t in same)
                          and [sp.id_to_piece(i) for i in self.before] == [MARK, "<0x0A>"])

    def __missing__(self, word: str) -> tuple[bytes, str]:
        ids = self.processor.encode("\n" + word)[len(self.before):]
        made = np.array(ids, dtype=np.int32).tobytes(), self.processor.decode(self.before + ids)[self.start:]
        if len(word) <= LONG_WORD:
            if len(self) >= self.limit:
                self.clear()
            self[word] = made
        return made

    def encode(self, text: str) -> tuple[bytes, str]:
        """The ids of a text as int32 bytes, and what they decode to."""
        if not text:
            return b"", ""
        if not self.separable:
            ids = self.processor.encode(text)
            return np.array(ids, dtype=np.int32).tobytes(), self.processor.decode(ids)
        found = list(map(self.__getitem__, self.CHUNK.findall(MARK + text.replace(" ", MARK))))
        return b"".join([f[0] for f in found]), "".join([f[1] for f in found])[1:]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", table_words: int = TABLE_WORDS) -> DataFrame:
    """doc_id, ids array<int>, decoded of every row, as the sentencepiece library gives them.

    No begin or end ids, no sampling. Null and empty texts have no ids and decode
    to the empty text. `model` is a path that every executor has. A model whose
    pieces do cross markers, or that rewrites characters, is run on whole texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(model, table_words)
        for batch in batches:
            at, ids, texts, size = 0, [], [], 0
            for i, text in enumerate(batch.column(1)):
                code, decoded = words.encode(text.as_py())
                ids.append(code)
                texts.append(decoded)
                size += len(decoded)
                if size >= OUT_CHARS or i + 1 == batch.num_rows:
                    ends = np.cumsum([0, *map(len, ids)], dtype=np.int64) // 4
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), dtype=np.int32)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, i + 1 - at), lists, pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])
                    at, ids, texts, size = i + 1, [], [], 0

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(F.col(text_col)).alias("t")).mapInArrow(
        run, "doc_id long, ids array<int>, decoded string")


def digests(encoded: DataFrame, *more: str) -> DataFrame:
    """n_tokens and the digests of ids and decoded text; `more` columns come along."""
    return encoded.select(
        "doc_id", *more, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
