"""Token counts of whole texts with a sentencepiece model, chunk by chunk where a document is huge.

A huge text is encoded in chunks that overlap. Two neighbouring chunks are spliced at a place in their overlap where
both have a token boundary and which is proven stable: a space follows a character other than a space, and no piece of
the vocabulary spans that. What a chunk has from its first to its last such splice is what the whole text has. Where
the overlap holds no such place, it is widened, up to the rest of the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.llm.common import byte_rows, slices
from undula.llm.tokens import MARK, PieceVocabulary

CHUNK, OVERLAP = 32_768, 512
#: A space after a character that is neither a space nor the word mark.
_STABLE = re.compile(f"(?<=[^ {MARK}]) ")


@lru_cache(maxsize=2)
def piece_vocabulary(path: str) -> PieceVocabulary:
    return PieceVocabulary(path)


def _splice(text: str, at: int, stop: int, before: set[int], after: set[int]) -> int | None:
    """The last stable place in text[at:stop] where both chunks have a boundary."""
    for m in reversed(list(_STABLE.finditer(text, at, stop))):
        if m.start() in before and m.start() in after:
            return m.start()
    return None


def count_tokens(text: str, vocabulary: PieceVocabulary, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of the whole text, as the model gives them without begin or end tokens."""
    if len(text) <= chunk or not vocabulary.words_end_tokens:
        return len(vocabulary.encode([text])[0])
    total, begin, size = 0, 0, chunk
    #: own: starts of the tokens of the chunk that begins at `begin`, which counts from `spliced` on.
    spliced, own = 0, vocabulary.token_starts(text[:chunk])
    while begin + size < len(text):
        end, wide, place = begin + size, overlap, None
        starts = {begin + s for s in own}
        while place is None:
            back = max(spliced + 1, end - wide)
            following = vocabulary.token_starts(text[back : back + chunk + wide])
            # the chunk's own beginning and the other's end are cut, not places where a token ends
            place = _splice(text, back + 1, end - 1, starts, {back + s for s in following})
            if place is None and wide >= end - spliced:
                break
            wide *= 2
        if place is None:
            # no stable place since the last splice: the chunk grows instead
            size *= 2
            own = vocabulary.token_starts(text[begin : begin + size])
            continue
        total += sum(spliced <= begin + s < place for s in own)
        spliced, begin, size, own = place, back, chunk + wide // 2, following
    return total + sum(spliced <= begin + s for s in own)


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, n_bytes, n_tokens) for each row. Null text counts as empty: 0 and 0. Rows are independent, so repeated rows
    and null ids come back as they are; nothing is shuffled."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        v = piece_vocabulary(vocabulary)
        for b in batches:
            texts, counts = byte_rows(b.column(1)), []
            for a, z in slices(texts, 1 << 20):
                some = [t.decode("utf-8", "replace") for t in texts[a:z]]
                short = [t if len(t) <= chunk else "" for t in some]
                counts += [len(ids) if s or not t else count_tokens(t, v, chunk, overlap) for t, s, ids in zip(some, short, v.encode(short), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n_bytes long, n_tokens long")
