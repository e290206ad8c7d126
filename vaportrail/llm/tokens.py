"""Token counts of whole texts for a public tokenizer, in Arrow batches that return lengths only."""

import functools
import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BATCH_BYTES = 1 << 20  # text handed to the tokenizer at once
CACHE_BYTES = 24 << 20  # of pieces whose length is remembered in a worker
# One blank between two visible characters: byte-level pre-tokenizers always start a new token there, whatever the
# neighbours are, and neither side's tokens depend on the other side.
_SAFE = re.compile(r"(?<=\S) (?=\S)")


@functools.cache
def _tokenizer(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallelism
    from tokenizers import Tokenizer

    if os.sep not in name:
        import public_tokenizers

        name = public_tokenizers.path(name)
    tokenizer = Tokenizer.from_file(name)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class PieceCounts:
    """Token counts of pieces cut at safe boundaries; only pieces not seen before are encoded."""

    def __init__(self, name: str):
        self.tokenizer = _tokenizer(name)
        self.known: dict[str, int] = {}
        self.held = 0

    def _encode(self, pieces: list[str]) -> None:
        for piece, encoded in zip(pieces, self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False), strict=True):
            self.known[piece] = len(encoded)

    def learn(self, pieces: set[str]) -> None:
        batch, size = [], 0
        for piece in pieces - self.known.keys():
            batch.append(piece)
            size += len(piece)
            self.held += len(piece) + 80
            if size >= BATCH_BYTES:
                self._encode(batch)
                batch, size = [], 0
        self._encode(batch)

    def count(self, texts: list[str]) -> list[int]:
        if self.held > CACHE_BYTES:
            self.known.clear()
            self.held = 0
        cut = []
        for text in texts:
            first, *rest = _SAFE.split(text)
            cut.append([first, *map(" ".__add__, rest)])
        self.learn({piece for pieces in cut for piece in pieces})
        return [sum(map(self.known.__getitem__, pieces)) for pieces in cut]


def _balanced(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of about BATCH_BYTES characters each; a longer text comes alone."""
    batch, size = [], 0
    for text in texts:
        if batch and size + len(text) > BATCH_BYTES:
            yield batch
            batch, size = [], 0
        batch.append(text)
        size += len(text)
    if batch:
        yield batch


def token_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", limit: int = 512
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row, in its place: no shuffle.

    ``tokenizer`` is a file of the ``tokenizers`` library with a byte-level pre-tokenizer: a name of the public set
    or a path that executors reach. Special strings inside texts count as that library counts them.

    A null text counts as empty (0 bytes, 0 tokens), null ids and repeated rows come out as they came in, other columns
    are ignored. A text of any length is cut at single blanks, where token counts add up exactly, and encoded in batches
    of bounded bytes.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = PieceCounts(tokenizer)
        for batch in batches:
            text = pc.fill_null(batch.column(1), "")
            n_bytes = pc.cast(pc.binary_length(text), pa.int64())
            n_tokens: list[int] = []
            for group in _balanced(text.to_pylist()):
                n_tokens += counts.count(group)
            n = pa.array(n_tokens, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, n, pc.greater(n, limit)], names=names)

    names = [id_col, "n_bytes", "n_tokens", "over_limit"]
    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("over_limit", T.BooleanType()),
        ]
    )
    return rows.mapInArrow(count, schema)
