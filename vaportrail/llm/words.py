"""Words and hashes shared by the text operators."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# a word is a run of anything but these ASCII blanks
WORD = r"[^\x20\x09-\x0D]+"
ROWS = 250  # of a batch that are made into Python objects at a time
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def word_count(text: Column) -> Column:
    """Words of a text as a long; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_words(text: str) -> list[bytes]:
    """Words in UTF-8 with A-Z lowered; ``bytes`` methods know ASCII letters and blanks only, which is the definition."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash, remembered for the words of a task; forgotten when too many."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def texts(column: pa.Array):
    """Python strings of an Arrow column one at a time; null is empty."""
    for value in column:
        yield value.as_py() or ""


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``: a worker keeps the room it once took for what it makes of a batch."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def as_long(unsigned: np.ndarray) -> np.ndarray:
    return unsigned.view(np.int64)
