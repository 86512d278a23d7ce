"""Token ids as Parquet list columns, in document order, with row groups and pages of a controlled size.

A file holds a range of documents: their ids as a list column (dictionary encoded where a page's ids repeat, else delta
encoded, as version 2 of the format allows), and beside it the number of ids and the place in the file, so a reader
of metadata doesn't touch the ids and a reader of some documents is led by the page index. Where a document starts in
the whole sequence follows from the files' totals, of which there is one for each file.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodepath.llm.session import bounded_batches, new_path, stored, trimmed

END_ID = 2
FORMAT = {
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "true",
    "parquet.block.size": str(64 << 20),
    "parquet.page.size": str(1 << 20),
    "parquet.page.row.count.limit": "1000",
    "compression": "zstd",
}
#: Words of Latin letters with ASCII marks after them: the library's own rules split them there, lower the letters and keep
#: marks together (none is an apostrophe). All other words go to the library whole.
PLAIN = r"^(?P<letters>[A-Za-zÀ-ÖØ-Þß-öø-ÿ]+)(?P<marks>[.,;:!?%#$&*|]*)$"


def gathered(flat: np.ndarray, size: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The segments of flat (of the given sizes, one after another) in a given order, and where each ends."""
    first = np.cumsum(size) - size
    lengths = size[order]
    stop = np.cumsum(lengths)
    return flat[np.repeat(first[order] - (stop - lengths), lengths) + np.arange(stop[-1] if len(stop) else 0)], stop


class WordIds:
    """Ids of words between ASCII white spaces, from the tokenizers library; what it found for a word is kept.

    The vocabulary ends its pieces at word ends and drops white space, so a text's ids are its words' ids in a row. Arrow
    splits the texts and the words; Python sees each different piece of a batch once. The store has a young and an old
    half of at most `most` pieces in all; when the young one is full it takes the old one's place. One of these lives as
    long as its Python worker.
    """

    def __init__(self, path: str, most: int = 300_000) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.most = most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        #: Bytes as the printable characters that byte-level vocabularies write them with.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}

    def piece(self, lower: str) -> bytes:
        got = self.young.get(lower)
        if got is None:
            got = self.old.get(lower)
            if got is None:
                text = lower if lower.isascii() else "".join(map(self.letters.__getitem__, lower.encode()))
                got = array("i", [t.id for t in self.model.tokenize(text)]).tobytes()
            if len(self.young) >= self.most // 2:
                self.old, self.young = self.young, {}
            self.young[lower] = got
        return got

    def word(self, word: str) -> bytes:
        return array("i", self.whole.encode(word, add_special_tokens=False).ids).tobytes()

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different words, one after another, and how many each has."""
        parts = pc.extract_regex(words, PLAIN)
        plain = pc.is_valid(parts).to_numpy(zero_copy_only=False)
        fits = parts.filter(pa.array(plain))
        letters = pc.utf8_lower(fits.field("letters")).dictionary_encode()
        marks = fits.field("marks").dictionary_encode()
        other = words.filter(pa.array(~plain)).to_pylist()
        known = [*map(self.piece, letters.dictionary.to_pylist()), *map(self.piece, marks.dictionary.to_pylist()), *map(self.word, other), b""]
        size = np.array([len(x) >> 2 for x in known], np.int64)
        n_letters, n_marks = len(letters.dictionary), len(marks.dictionary)
        # two segments for each word: its letters and its marks, or all of it and nothing
        order = np.full((len(words), 2), len(known) - 1)
        order[plain, 0] = letters.indices.to_numpy()
        order[plain, 1] = marks.indices.to_numpy() + n_letters
        order[~plain, 0] = np.arange(len(other)) + n_letters + n_marks
        flat, _ = gathered(np.frombuffer(b"".join(known), np.int32), size, order.ravel())
        return flat, size[order].sum(axis=1)

    def batch(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each text: its ids with the end id, one after another, and how many they are."""
        if not len(texts):
            return np.empty(0, np.int32), np.empty(0, np.int64)
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))  # at the six ASCII white spaces; empty words have no ids
        coded = lists.flatten().dictionary_encode()
        flat, size = self.words(coded.dictionary)
        flat, size = np.append(flat, np.int32(end_id)), np.append(size, 1)
        ends = np.cumsum(np.diff(np.asarray(lists.offsets)) + 1)
        order = np.full(int(ends[-1]), len(size) - 1)  # an end id after each text's words
        inside = np.ones(len(order), bool)
        inside[ends - 1] = False
        order[inside] = coded.indices.to_numpy()
        ids, stop = gathered(flat, size, order)
        return ids, np.diff(stop[ends - 1], prepend=0)


_words: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _words:
        _words[path] = WordIds(path)
    return _words[path]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, files: int | None = None) -> None:
    """Write docs' (doc_id, text) as token files below path: a range of ascending doc_id for each file.

    Null texts are empty (the end id only); null ids come first; rows of equal id go by a hash of their text. A third of all
    rows may share an id: ranges are over id and hash. tokenizer: path of the vocabulary on each worker (None: the
    installed word_bpe_49k.json). No rows: files without rows.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, words = TaskContext.get().partitionId(), 0, word_ids(tokenizer or tokenizer_path())
        for b in batches:
            ids, n = words.batch(b.column(1), end_id)
            ends = np.cumsum(n)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.full(len(n), part)), pa.array(at + ends - n), pa.array(n), lists], names=["doc_id", "part", "part_start", "n_tokens", "ids"]
            )
            at += int(ends[-1]) if len(ends) else 0

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    key = [F.col("doc_id"), F.xxhash64("text")]
    spread = rows.repartitionByRange(files, *key) if files else rows.repartitionByRange(*key)
    ordered = spread.sortWithinPartitions(*key)
    made = ordered.mapInArrow(trimmed(run), "doc_id long, part long, part_start long, n_tokens long, ids array<int>")
    made.write.options(**FORMAT).parquet(path)


def read_tokens(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens[, ids]) of token files; without ids only metadata is read."""
    schema = "doc_id long, part long, part_start long, n_tokens long" + ", ids array<int>" * ids
    rows = spark.read.schema(schema).parquet(path)
    # one row for each file: a running sum over those is small however many documents there are
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = stored(totals.select(F.col("part").alias("part_"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")), "bases")
    out = rows.join(base, F.col("part") == F.col("part_"))
    return out.select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", *["ids"] * ids)


def with_crc(tokens: DataFrame) -> DataFrame:
    """Replace ids by ids_crc32: the CRC-32 of a document's ids as little-endian unsigned 32-bit integers."""
    bounded_batches(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            flat, at = memoryview(lists.values.to_numpy().astype("<u4", copy=False)).cast("B"), lists.offsets.to_pylist()
            crc = [zlib.crc32(flat[4 * x : 4 * y]) for x, y in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(trimmed(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def encoded(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the token files of docs to the shared folder and read them back: doc_id, start, n_tokens, ids_crc32."""
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return with_crc(read_tokens(docs.sparkSession, path))
