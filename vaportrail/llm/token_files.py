"""Token ids in Simple-8b files: whole texts encoded, packed into 64-bit words, written in order and read back.

A word has a selector in its top four bits and as many ids of equal width as its other sixty bits hold. An id of more than
sixty bits is an escape: its word holds a place in the file's list of escapes. Ids are packed in blocks that belong to one
document and start at a word; the file lists the word offset and the number of ids of each, so any block, or all at once, is
decoded by array operations.

A file, in little-endian 64-bit words: magic; writing task and number of the file in it; ids of the task before this file;
numbers of documents, blocks, words and escapes; document ids; for each document 1 if its id is null; for each block
(document place << 32 | ids) and its word offset; the escapes; the packed words; the end mark.
"""

import functools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaportrail.session import new_stage_path, stage

# fixed values: ids in a word for selectors 1 to 14; each takes 60 // count bits
COUNTS = [1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60]
MAGIC, END = b"S8B-IDS\n", "s8b-end\n"
BLOCK_IDS = 1 << 16
FILE_WORDS = 1 << 20  # 8 MB; a file ends with the document that fills it
BATCH_BYTES = 4 << 20  # of text, encoded at once
RUN_IDS = 1 << 18  # packed or unpacked at once, but for a longer block or document
CACHE_PIECES = 400_000  # and as many as fit in CACHE_BYTES, remembered by a worker
CACHE_BYTES = 24 << 20

_PAD = max(COUNTS) - 1
# what no longer fits in the width of selectors 14 to 1
_LIMITS = np.array([1 << (60 // c) for c in reversed(COUNTS)], np.uint64)


def _selectors(ids: np.ndarray) -> np.ndarray:
    """The narrowest selector that holds each id; 0 = escape."""
    return (len(COUNTS) - np.searchsorted(_LIMITS, ids, "right")).astype(np.uint8)


_SMALL = _selectors(np.arange(1 << 16, dtype=np.uint64))


# --- ids of texts


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


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[*range(9, 14), 32]] = True
# first bytes of the characters beyond ASCII among which there are blanks
_WIDE = np.zeros(256, bool)
_WIDE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,:;!?()[]\"-"]] = True


def safe_cuts(data: np.ndarray, specials: list[bytes] = ()) -> np.ndarray:
    """Places where the byte-level pre-tokenizer starts a new token whatever the neighbours are, and neither side's tokens
    depend on the other: before a single blank or line end between two visible characters, after such a line end, and between
    a letter and a punctuation mark. Nothing inside a special string is cut.

    A neighbour that might be a blank beyond ASCII (by its first byte) is taken for one, and of the letters beyond ASCII only those of
    Latin-1 for letters: no cut is better than a wrong one.
    """
    n = len(data)
    if n < 3:
        return np.zeros(0, np.int64)
    visible = ~_BLANK[data]
    # the next character is visible; the one before ends in this byte and is visible
    next_visible = visible & ~_WIDE[data]
    last_visible = visible.copy()
    late = np.flatnonzero(data >= 0x80)
    last_visible[late] = ~(_WIDE[data[np.maximum(late - 1, 0)]] | _WIDE[data[np.maximum(late - 2, 0)]])
    letter = _LETTER[data]
    latin = late[late > 0]
    latin = latin[(data[latin - 1] == 0xC3) & (data[latin] != 0x97) & (data[latin] != 0xB7)]
    letter[latin] = True
    gap = np.zeros(n, bool)
    gap[1:-1] = last_visible[:-2] & next_visible[2:]
    line = gap & (data == 10)
    cut = gap & (data == 32) | line
    cut[1:] |= line[:-1] | (letter[:-1] & _MARK[data[1:]])
    if specials:
        text = data.tobytes()
        for special in specials:
            at = text.find(special)
            while at >= 0:
                cut[at + 1 : at + len(special)] = False
                at = text.find(special, at + 1)
    return np.flatnonzero(cut)


class PieceIds:
    """Ids of pieces between safe cuts. Equal pieces of a batch are found at once; only unknown ones are encoded.

    What is known is held as plain arrays: the pieces, how often each was seen, and the place and number of its ids. Beyond
    CACHE_PIECES, or CACHE_BYTES of them, the more frequent half stays.
    """

    def __init__(self, name: str, end_id: int | None):
        self.tokenizer = _tokenizer(name)
        shape = json.loads(self.tokenizer.to_str())
        split = shape.get("pre_tokenizer") or {}
        # others are encoded whole
        self.cuts = (
            split.get("type") == "ByteLevel"
            and split.get("use_regex", True)
            and not split.get("add_prefix_space")
            and shape.get("normalizer") is None
        )
        self.specials = [t["content"].encode() for t in shape.get("added_tokens", [])]
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line_id = line[0] if self.cuts and len(line) == 1 else None
        # piece 0 is the end of a document
        self.pieces = pa.array([b"\n\n end of a document \n\n"], pa.binary())
        self.ids = np.array([] if end_id is None else [end_id], np.uint32)
        self.lengths, self.seen = np.array([len(self.ids)]), np.array([1 << 60])

    def _alone(self, texts: list[bytes]) -> list[list[int]]:
        texts = [t.decode("utf-8", "replace") for t in texts]
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _simple(self, pieces: pa.Array) -> np.ndarray:
        """Pieces of visible characters behind at most one blank: line ends between them are tokens of their own."""
        offsets = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1]
        data = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)[: offsets[-1]]
        bad = _BLANK[data] | _WIDE[data]
        starts, stops = offsets[:-1], offsets[1:]
        first = starts[starts < stops]
        bad[first] &= data[first] != 32
        count = np.concatenate([[0], np.cumsum(bad)])
        blank_only = (stops - starts == 1) & (data[np.minimum(starts, max(0, len(data) - 1))] == 32) if len(data) else True
        return (count[stops] == count[starts]) & (stops > starts) & ~blank_only

    def _encode_new(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number for each piece)."""
        simple = self._simple(pieces) if self.line_id is not None else np.zeros(len(pieces), bool)
        lengths = np.zeros(len(pieces), np.int64)
        parts: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(pieces) if not simple.any() else []
        many = np.flatnonzero(simple)
        runs, breaks = [], []
        joined = pieces.take(pa.array(many)).to_pylist()
        texts = [b"\n".join(joined[i : i + 200]) for i in range(0, len(joined), 200)]
        for e in self._alone(texts):
            run = np.array(e, np.uint32)
            ends = np.append(np.flatnonzero(run == self.line_id), len(run))
            breaks.append(np.diff(ends, prepend=-1) - 1)
            runs.append(run[run != self.line_id])
        one = np.concatenate([np.zeros(0, np.uint32), *runs])
        lengths[many] = np.concatenate([np.zeros(0, np.int64), *breaks])
        few = np.flatnonzero(~simple)
        parts = self._alone(pieces.take(pa.array(few)).to_pylist())
        lengths[few] = [len(p) for p in parts]
        other = np.array([i for p in parts for i in p], np.uint32)
        # simple and other pieces' ids, each in order of their pieces
        stops = np.cumsum(lengths)
        owner = np.repeat(simple, lengths)
        ids = np.zeros(stops[-1] if len(stops) else 0, np.uint32)
        ids[owner], ids[~owner] = one, other
        return ids, lengths

    def _forget(self) -> None:
        if len(self.pieces) <= CACHE_PIECES and self.pieces.nbytes + self.ids.nbytes <= CACHE_BYTES:
            return
        keep = np.sort(np.argsort(-self.seen, kind="stable")[: len(self.seen) // 2])
        starts = np.cumsum(self.lengths) - self.lengths
        lengths = self.lengths[keep]
        at = np.repeat(starts[keep] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        self.ids, self.lengths, self.seen = self.ids[at], lengths, self.seen[keep]
        self.pieces = self.pieces.take(pa.array(keep))

    def _numbers(self, pieces: pa.Array, counts: np.ndarray) -> np.ndarray:
        found = pc.fill_null(pc.index_in(pieces, value_set=self.pieces), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(found < 0)
        if len(new):
            unknown = pa.concat_arrays([pieces.take(pa.array(new))])
            ids, lengths = self._encode_new(unknown)
            found[new] = len(self.pieces) + np.arange(len(new))
            self.pieces = pa.concat_arrays([self.pieces, unknown])
            self.ids, self.lengths = np.concatenate([self.ids, ids]), np.concatenate([self.lengths, lengths])
            self.seen = np.concatenate([self.seen, np.zeros(len(new), np.int64)])
        self.seen[found] += counts
        return found

    def encode(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts at ``offsets`` of ``data``, one after the other, and the number of each."""
        self._forget()
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        if self.cuts:
            edge[safe_cuts(data, self.specials)] = True
        edges = np.flatnonzero(edge)
        buffers = [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data)]
        coded = pa.Array.from_buffers(pa.binary(), len(edges) - 1, buffers).dictionary_encode()
        coded, pieces = coded.indices.to_numpy(), coded.dictionary
        numbers = self._numbers(pieces, np.bincount(coded, minlength=len(pieces)))[coded]
        last = np.searchsorted(edges, offsets[1:])  # pieces before the end of each text
        numbers = np.insert(numbers, last, 0)
        places = np.cumsum(self.lengths) - self.lengths
        n = self.lengths[numbers]
        done = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.repeat(places[numbers] - done[:-1], n) + np.arange(done[-1])]
        ends = done[last + np.arange(1, len(last) + 1)]
        return ids, np.diff(ends, prepend=0)


@functools.cache
def _worker_pieces(name: str, end_id: int | None) -> PieceIds:
    """One for all tasks of a worker."""
    return PieceIds(name, end_id)


# --- Simple-8b


def pack(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, words of each run, escapes) of runs of ids; a run starts at a word. Greedy: a word takes as many as it holds.

    The last word of a run may have room left: it is filled with zeros, and the run's length tells them from ids.
    """
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    padded = lengths + _PAD
    at = np.cumsum(padded) - padded
    spread = np.zeros(int(padded.sum()) + _PAD, np.uint64)
    spread[np.repeat(at - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)] = ids
    # selectors up to this one hold the id
    fits = _SMALL[spread.astype(np.int64)] if total and ids.max() < len(_SMALL) else _selectors(spread)
    # the narrowest selector whose whole window fits, by minima over windows of growing length
    least, chosen, window = fits, np.minimum(fits, 1), 1
    for selector, count in enumerate(COUNTS[1:], 2):
        while window < count:
            by = min(window, count - window)
            shifted = np.full_like(least, len(COUNTS))
            shifted[: len(least) - by] = least[by:]
            least, window = np.minimum(least, shifted), window + by
        np.copyto(chosen, np.uint8(selector), where=least >= selector)
    step = np.array([1, *COUNTS], np.int64)[chosen]
    onward = (np.arange(len(step)) + step).tolist()
    starts, n_words = [], []
    for start, n in zip(at.tolist(), lengths.tolist(), strict=True):
        stop, before = start + n, len(starts)
        while start < stop:
            starts.append(start)
            start = onward[start]
        n_words.append(len(starts) - before)
    starts = np.array(starts, np.int64)
    selectors = chosen[starts]
    words = selectors.astype(np.uint64) << np.uint64(60)
    for selector, count in enumerate(COUNTS, 1):
        mine = np.flatnonzero(selectors == selector)
        for k in range(count):
            words[mine] |= spread[starts[mine] + k] << np.uint64(k * (60 // count))
    escaped = np.flatnonzero(selectors == 0)
    words[escaped] = np.arange(len(escaped), dtype=np.uint64)
    return words, np.array(n_words, np.int64), spread[starts[escaped]]


def unpack(words: np.ndarray, n_words: np.ndarray, lengths: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The ids of runs packed one after the other."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    n = np.array([1, *COUNTS], np.int64)[selectors]
    # the last word of a run holds what the others leave
    done = np.concatenate([[0], np.cumsum(n)])
    ends = np.cumsum(n_words)
    some = n_words > 0
    n[ends[some] - 1] -= (done[ends] - done[ends - n_words] - lengths)[some]
    at = np.cumsum(n) - n
    ids = np.zeros(int(n.sum()), np.uint64)
    for selector, count in enumerate(COUNTS, 1):
        mine = np.flatnonzero(selectors == selector)
        mask = np.uint64((1 << (60 // count)) - 1)
        for k in range(count):
            held = mine[n[mine] > k]
            ids[at[held] + k] = (words[held] >> np.uint64(k * (60 // count))) & mask
    mine = np.flatnonzero(selectors == 0)
    ids[at[mine]] = escapes[words[mine].astype(np.int64)]
    return ids


def spans(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of places whose sizes sum to ``most`` at most, or that are one place."""
    done = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(done, done[at] + most, "right")) - 1)
        yield at, stop
        at = stop


class FileWriter:
    """Documents of one task in, whole files out."""

    def __init__(self, task: int, file_words: int = FILE_WORDS, block_ids: int = BLOCK_IDS):
        self.file_words, self.block_ids = file_words, block_ids
        self.task, self.number, self.before = task, 0, 0
        self._begin()

    def _begin(self) -> None:
        self.ids, self.blocks, self.words, self.escapes = [], [], [], []
        self.documents = self.n_words = self.n_ids = self.n_escapes = 0

    def add(self, doc_ids: list, ids: np.ndarray, lengths: np.ndarray) -> Iterator[bytes]:
        """Takes documents whose ids follow each other; a longer document than ``block_ids`` has several blocks."""
        per_doc = -(-lengths // self.block_ids)
        place = np.repeat(np.arange(len(lengths)), per_doc)
        nth = np.arange(len(place)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
        sizes = np.minimum(lengths[place] - nth * self.block_ids, self.block_ids)
        self.ids += doc_ids
        done = np.cumsum(sizes)
        for first, last in spans(sizes, RUN_IDS):
            base = int(done[first] - sizes[first])
            words, n_words, escapes = pack(ids[base : base + int(sizes[first:last].sum())], sizes[first:last])
            if len(escapes):
                words[words >> np.uint64(60) == 0] += np.uint64(self.n_escapes)
            offsets = self.n_words + np.cumsum(n_words) - n_words
            index = np.column_stack([(place[first:last] + self.documents) << 32 | sizes[first:last], offsets])
            self.blocks.append(index.astype(np.uint64))
            self.words.append(words)
            self.escapes.append(escapes)
            self.n_words += len(words)
            self.n_escapes += len(escapes)
        self.documents += len(doc_ids)
        self.n_ids += len(ids)
        if self.n_words >= self.file_words:
            yield self.file()

    def file(self) -> bytes:
        join = lambda parts: np.concatenate([np.zeros(0, np.uint64), *parts])
        blocks = join([b.reshape(-1) for b in self.blocks])
        escapes, words = join(self.escapes), join(self.words)
        place = self.task << 32 | self.number
        counts = [place, self.before, self.documents, len(blocks) // 2, len(words), len(escapes)]
        ids = np.array([i or 0 for i in self.ids], np.int64)
        nulls = np.array([i is None for i in self.ids], np.int64)
        parts = [np.array(counts, np.uint64), ids, nulls, blocks, escapes, words]
        out = MAGIC + b"".join(p.astype(p.dtype.newbyteorder("<")).tobytes() for p in parts)
        self.before, self.number = self.before + self.n_ids, self.number + 1
        self._begin()
        return out


def parse_file(content: bytes) -> Iterator[tuple[int, int, list, np.ndarray, np.ndarray]]:
    """(writing task, ids of the task before, document ids, ids of each, all ids) of runs of a file's documents.

    Broken files raise ValueError.
    """
    if len(content) < 64 or len(content) % 8 or content[:8] != MAGIC or content[-8:] != END.encode():
        raise ValueError("no whole Simple-8b file")
    all_words = np.frombuffer(content, "<u8")
    place, before, n_docs, n_blocks, n_words, n_escapes = (int(x) for x in all_words[1:7])
    sizes = [n_docs, n_docs, 2 * n_blocks, n_escapes, n_words]
    if len(all_words) != 8 + sum(sizes):
        raise ValueError("sizes and length of a Simple-8b file disagree")
    ids, nulls, blocks, escapes, words = np.split(all_words[7:-1], np.cumsum(sizes)[:-1])
    blocks = blocks.reshape(-1, 2).astype(np.int64)
    owner, lengths, offsets = blocks[:, 0] >> 32, blocks[:, 0] & 0xFFFFFFFF, np.append(blocks[:, 1], n_words)
    per_doc = np.bincount(owner, weights=lengths, minlength=n_docs).astype(np.int64)
    doc_ids = [None if null else i for i, null in zip(ids.astype(np.int64).tolist(), nulls.tolist(), strict=True)]
    for first, last in spans(per_doc, RUN_IDS):
        a, b = np.searchsorted(owner, [first, last])
        tokens = unpack(words[offsets[a] : offsets[b]], np.diff(offsets[a : b + 1]), lengths[a:b], escapes)
        yield place >> 32, before, doc_ids[first:last], per_doc[first:last], tokens
        before += len(tokens)


# --- tables


def write_tokens(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = "byte_bpe_50k.json",
    end_id: int | None = 2,
    file_words: int = FILE_WORDS,
    block_ids: int = BLOCK_IDS,
    batch_bytes: int = BATCH_BYTES,
) -> None:
    """Writes the ids of every whole text under ``path``, in ascending order of the document id, ``end_id`` after each.

    Texts move once, by ranges of their id, and are encoded where they are written. Null ids come first; rows of one id
    follow in order of a hash of their text, so a frequent id is dealt over several ranges; equal rows follow in any order.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    rows = rows.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    ordered = rows.repartitionByRange(F.col("id").asc_nulls_first(), "tie", "row")
    ordered = ordered.sortWithinPartitions(F.col("id").asc_nulls_first(), "tie", "row").select("id", F.col("text").cast("binary"))

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer = _worker_pieces(tokenizer, end_id), FileWriter(TaskContext.get().partitionId(), file_words, block_ids)
        row = lambda content: pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], names=["value"])
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            sizes = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))]).astype(np.int64)
            for at, stop in spans(np.diff(sizes), batch_bytes):
                data = np.frombuffer(b"".join(texts[at:stop].to_pylist()), np.uint8)
                tokens, lengths = encoder.encode(sizes[at : stop + 1] - sizes[at], data)
                for content in writer.add(ids[at:stop], tokens, lengths):
                    yield row(content)
        if writer.documents:
            yield row(writer.file())

    contents = ordered.mapInArrow(files, "value binary").select(F.col("value").cast("string"))
    contents.write.option("maxRecordsPerFile", 1).option("lineSep", END).text(path)


def read_tokens(spark: SparkSession, path: str, width: int = 4) -> DataFrame:
    """(doc_id, task, task_start, n_tokens, ids) of every document in the files under ``path``.

    ``ids`` are little-endian unsigned integers of ``width`` bytes (4, or 8 for ids of more than 32 bits); ``task_start`` counts
    the ids that the writing task wrote before. Files that are cut short or garbled raise ValueError.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for task, before, doc_ids, lengths, ids in parse_file(content.as_py()):
                    data = ids.astype(f"<u{width}").tobytes()
                    stops = np.cumsum(lengths)
                    payload = [data[width * a : width * b] for a, b in zip((stops - lengths).tolist(), stops.tolist(), strict=True)]
                    columns = [
                        pa.array(doc_ids, pa.int64()),
                        pa.array([task] * len(doc_ids), pa.int64()),
                        pa.array(before + stops - lengths, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array(payload, pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "task", "task_start", "n_tokens", "ids"])

    fields = "doc_id long, task long, task_start long, n_tokens long, ids binary"
    return found.where("length > 0").select("content").mapInArrow(documents, fields)


def with_starts(documents: DataFrame) -> DataFrame:
    """``documents`` with ``start``: the ids of all documents before. Needs (task, task_start, n_tokens), read twice."""
    spark = documents.sparkSession
    # one row for each task that wrote
    totals = documents.groupBy("task").agg(F.sum("n_tokens").alias("n")).orderBy("task").collect()
    before = np.cumsum([0] + [r["n"] for r in totals]).tolist()
    rows = [(r["task"], b) for r, b in zip(totals, before, strict=False)]
    bases = F.broadcast(spark.createDataFrame(rows, "task long, base long"))
    return documents.join(bases, "task").withColumn("start", F.col("base") + F.col("task_start")).drop("base")


def token_round_trip(
    docs: DataFrame,
    path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = "byte_bpe_50k.json",
    end_id: int | None = 2,
) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every row, from files written under ``path`` (a new shared folder if none).

    A null text is empty and still gets its end id. Null ids come first in the files; rows that repeat an id each count and
    follow each other. Texts of any length are whole: each is one document of one file. An empty table gives no row. Other
    columns are ignored. Ids are longs.
    """
    spark = docs.sparkSession
    path = path or new_stage_path(spark, "token-files")
    write_tokens(docs, path, id_col, text_col, tokenizer, end_id)
    read = read_tokens(spark, path).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return with_starts(stage(read, "token-index")).select(F.col("doc_id").alias(id_col), "start", "n_tokens", "ids_crc32")
