"""Token counts of texts of any length: overlapping chunks, spliced where both sides provably agree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a chunk, and by how many the next one starts before its end at first.
CHUNK, OVERLAP = 65_536, 1024
#: How white space is written in pieces of this family of vocabularies.
MARK = "▁"


class Encoder:
    """A vocabulary of pieces, with the proof that a cut before white space changes nothing.

    Pieces come from merging neighbours. If no piece holds the white-space mark
    after any other character, no merge crosses the place between a character that
    is no mark and a mark, so both sides of it are encoded as if alone. The check
    runs over the whole vocabulary; where it fails, texts are encoded in one go.
    Characters are kept as they are by the vocabulary's own normaliser, except that
    blanks become marks and one mark is put in front of the text.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        plain = all(MARK not in piece.lstrip(MARK) for piece in pieces)
        probe = "  a éﬁ\t\n x "
        self.splits = plain and self.model.normalize(probe) == MARK + probe.replace(" ", MARK)

    def ends(self, data: bytes) -> np.ndarray:
        """Byte offsets at which the tokens of ``data`` end; the bytes of a spelled-out character end with it."""
        return np.array([p.end for p in self.model.encode(data.decode(), out_type="proto").pieces], dtype=np.int64)

    def tokens(self, text: str) -> int:
        return len(self.model.encode_as_ids(text))


_BLANK, _MARK = 0x20, MARK.encode()


def _stable(data: bytes, at: int) -> bool:
    """Whether no merge can cross ``at``: a blank follows something that is neither blank nor mark."""
    return data[at] == _BLANK and data[at - 1] != _BLANK and data[at - 3 : at] != _MARK


def count_tokens(text: str | None, encoder: Encoder, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Number of tokens of the whole text, exactly as if encoded in one go.

    The text is encoded in chunks that overlap. Where both chunks end a token at the
    same offset inside the overlap, and that offset is stable, the left chunk's
    tokens count up to it and the next chunk goes on from it. If there is no such
    offset the overlap is doubled, and in the end the left chunk grows to hold the
    rest, so texts without blanks are encoded whole.
    """
    if not text:
        return 0
    data = text.encode()
    if len(data) <= chunk or not encoder.splits:
        return encoder.tokens(text)

    def whole_character(at: int) -> int:
        while at < len(data) and data[at] & 0xC0 == 0x80:
            at += 1
        return at

    total, start = 0, 0  # tokens before the start, which is a stable offset
    size, width = chunk, overlap
    while start + size < len(data):
        # a chunk after the first begins with a blank, for which the library's own leading mark stands
        shift = 1 if start else 0
        stop = whole_character(start + size)
        left = encoder.ends(data[start + shift : stop]) + start + shift
        splice = 0
        while not splice and width <= size:
            begin = whole_character(max(stop - width, start + 1))
            right = set((encoder.ends(data[begin:stop]) + begin).tolist())
            common = (e for e in reversed(left.tolist()) if begin < e < stop and e in right and _stable(data, e))
            splice = next(common, 0)
            width *= 2
        if splice:
            total += int(np.searchsorted(left, splice, side="right"))
            start, size = splice, chunk
        else:
            size *= 2
        width = overlap
    return total + encoder.tokens(data[start + (1 if start else 0) :].decode())


def token_counts(docs: DataFrame, path: str, most: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of each row, in one pass without a shuffle.

    ``path``: the vocabulary file, at the same place on every executor. Null texts
    count as empty: no bytes, no tokens. Repeated rows and null ids are kept, other
    columns not looked at; an empty table stays empty.
    """

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for part in parts:
            found = np.array([count_tokens(t.as_py(), encoder, chunk, overlap) for t in part.column(1)], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(found)], ["doc_id", "n_bytes", "n_tokens"]
            )

    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    rows = docs.select(F.col("doc_id").cast("long"), "text", n_bytes)
    counted = rows.mapInArrow(batches, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > most)
