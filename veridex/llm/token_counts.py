"""Token counts of whole texts by overlap resynchronisation.

A text of up to ``chunk`` characters is one chunk.  A longer one is encoded in overlapping chunks with offsets.  Two
neighbours are spliced at a position that is a token boundary in both and proven stable; where the overlap has none, it
is widened, at the most to the rest of the text.  Stable means: a space after another character.  No vocabulary piece
has a space sign after another character (checked when the model is loaded), so no merge crosses such a position and
the tokens on either side don't depend on the other side.
"""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridex.llm.arrowtext import map_texts

SPACE = "▁"
STABLE = re.compile(f"(?<=[^ {SPACE}]) ")
_MODELS: dict = {}


class ResyncCounter:
    """Counts the tokens of a SentencePiece BPE model over overlapping chunks."""

    def __init__(self, model_path: str, chunk: int = 32_768, overlap: int = 256):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.chunk, self.overlap = chunk, overlap
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.provable = not any(SPACE in piece.lstrip(SPACE) for piece in pieces)

    def starts(self, text: str, begin: int, end: int) -> list[int]:
        """Positions in text at which the tokens of text[begin:end] start."""
        found = self.model.encode(text[begin:end], return_type="offset_mapping")["offsets"]
        return [begin + own for own, _ in found]

    @staticmethod
    def stable(text: str, at: int) -> bool:
        return text[at] == " " and text[at - 1] not in (" ", SPACE)

    def count(self, text: str) -> int:
        """The number of tokens of one whole text.

        A chunk reaches over the next stable position, so the overlap of two chunks holds one; a stretch without any, such
        as text that has no spaces, is one chunk as a whole and costs what the library takes for it.
        """
        if len(text) <= self.chunk or not self.provable:
            return len(self.model.encode(text))
        stable = [match.start() for match in STABLE.finditer(text)]

        def reach(at: int) -> int:
            """Past the first stable position from at on; the end of the text if there is none."""
            number = bisect.bisect_left(stable, at)
            return min(len(text), stable[number] + self.overlap) if number < len(stable) else len(text)

        total, since = 0, 0  # tokens that start before since are counted
        begin, end = 0, reach(self.chunk)
        if end == len(text):
            return len(self.model.encode(text))
        left = self.starts(text, begin, end)
        while end < len(text):
            width, cut, stop = 2 * self.overlap, None, reach(end + self.chunk)
            while cut is None:
                low = max(since + 1, end - width)
                right = self.starts(text, low, stop)
                both = set(left).intersection(right)
                # the first token of the right chunk carries the model's own leading space, so it proves nothing
                cut = next((p for p in sorted(both, reverse=True) if low < p < end and self.stable(text, p)), None)
                if cut is None:
                    if low == since + 1:  # nothing left to widen: both chunks become one, of twice the length at least
                        end = max(stop, reach(min(len(text), 2 * end - begin)))
                        left = self.starts(text, begin, end)
                        break
                    width *= 2
            if cut is not None:
                total += bisect.bisect_left(left, cut) - bisect.bisect_left(left, since)
                since, begin, end, left = cut, low, stop, right
        return total + len(left) - bisect.bisect_left(left, since)


def counter(model_path: str, chunk: int, overlap: int) -> ResyncCounter:
    """One loaded model a worker process."""
    key = (model_path, chunk, overlap)
    if key not in _MODELS:
        _MODELS[key] = ResyncCounter(*key)
    return _MODELS[key]


def count_tokens(
    docs: DataFrame,
    model_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 4096,
    chunk: int = 32_768,
    overlap: int = 256,
) -> DataFrame:
    """One row for each row of docs: id_col, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Texts of up to chunk characters are encoded as they are, longer ones in overlapping chunks.  No row moves between
    tasks.  A null text counts as empty: 0 bytes, 0 tokens.  Repeated rows and null ids give a row
    each; an empty table gives none.  Other columns of docs are not read, so their names can't clash.
    """

    def make():
        model = counter(model_path, chunk, overlap)

        def work(texts):
            values = ["" if text is None else text for text in texts.to_pylist()]
            short = [text for text in values if len(text) <= chunk]
            ids = iter(model.model.encode(short, num_threads=1)) if short else iter(())
            counts = [len(next(ids)) if len(text) <= chunk else model.count(text) for text in values]
            return [pc.binary_length(texts).fill_null(0).cast(pa.int64()), pa.array(counts, pa.int64())]

        return work

    counted = map_texts(docs, id_col, text_col, "n_bytes bigint, n_tokens bigint", make)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
