"""SentencePiece encoding and decoding over a table of distinct marked words.

In the model's input, white space is the mark U+2581. If no piece of the vocabulary holds a mark
after another character, and none holds a line feed beside anything else, no merge can cross the
start of a run of marks or a line feed. So a text is cut there, each distinct chunk is segmented
once by the library, and ids are joined back in the order of the chunks. A vocabulary that breaks
the condition is refused.

The table of distinct chunks is kept by each Python worker, beside the rows it encodes: the words
of a text neither leave their row nor are gathered again, so nothing is shuffled. It is emptied
when it holds `table_size` chunks, so its memory is bounded and only repeated work is lost.

Defined cases: null and empty texts have no ids and decode to the empty string; a mark in the text
is white space, as in the library. Rows, ids and columns stay as they are otherwise.
"""

from __future__ import annotations

import functools
import hashlib
import re
from itertools import chain

import pandas as pd
import sentencepiece
from pyspark.sql import Column, functions as F

MARK = "▁"
TABLE_SIZE = 200_000
_CHUNK = re.compile(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*")


class ChunkEncoder(dict):
    """Ids of each distinct chunk; chunks start with marks or with a line feed."""

    def __init__(self, model: str, table_size: int = TABLE_SIZE):
        super().__init__()
        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        self.table_size = table_size
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        if any(MARK in p.lstrip(MARK) or (len(p) > 1 and "\n" in p) for p in names):
            raise ValueError("a piece crosses the mark of white space or a line feed")
        self.mark_id = self.library.encode("\n")[0]
        if self.library.id_to_piece(self.mark_id) != MARK:
            raise ValueError("the model does not put a mark before a text")
        self.names = [str(i) for i in range(len(names))]

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        if len(self) >= self.table_size:
            self.clear()
        if chunk[0] == MARK:  # the library puts the first mark itself
            ids = tuple(self.library.encode(chunk[1:].replace(MARK, " "), num_threads=1)) if chunk != MARK else (self.mark_id,)
        else:
            ids = tuple(self.library.encode(chunk, num_threads=1))[1:]
        self[chunk] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        chunks = _CHUNK.findall(MARK + text.replace(" ", MARK))
        return list(chain.from_iterable(map(self.__getitem__, chunks)))

    def joined(self, ids: list[int]) -> str:
        return ",".join([self.names[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids) if ids else ""


@functools.lru_cache(maxsize=2)
def encoder(model: str) -> ChunkEncoder:
    return ChunkEncoder(model)


def encoded(text: Column, model: str) -> Column:
    """The ids of each text."""

    @F.pandas_udf("array<int>")
    def of(texts: pd.Series) -> pd.Series:
        own = encoder(model)
        return pd.Series([own.encode(t) for t in texts])

    return of(text)


def decoded(ids: Column, model: str) -> Column:
    """The text of each list of ids."""

    @F.pandas_udf("string")
    def of(lists: pd.Series) -> pd.Series:
        own = encoder(model)
        return pd.Series([own.decode([] if x is None else [int(i) for i in x]) for x in lists], dtype=object)

    return of(ids)


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def digests(text: Column, model: str) -> Column:
    """n_tokens, ids_sha256 and decoded_sha256 of each text, without moving its ids."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def of(texts: pd.Series) -> pd.DataFrame:
        own, rows = encoder(model), []
        for text in texts:
            ids = own.encode(text)
            rows.append((len(ids), _sha256(own.joined(ids)), _sha256(own.decode(ids))))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return of(text)
