"""Harmonic packing of tokenized documents into fixed-length training sequences.

A document is cut at reciprocals of the capacity: pieces of capacity // j tokens, for j = 1 .. classes, the largest that
still fits first. A bin of class j takes exactly j such pieces, so each class fills its bins by count alone and no bin
depends on another class or another worker. What is left of a document (less than capacity // classes tokens) goes to
the class of small pieces, whose bins are filled one after the other and cut at the bin's end. Every worker packs the
rows of its own partition as they stream by; at the end it puts the pieces of unfinished bins into the small class and
cuts the last bin at powers of two, so that padding is at most classes tokens a bin however many workers there are.

Texts become ids some megabytes at a time: the distinct words are found first, only those not met lately go through the
tokenizer, many in one call, and each text's ids are then gathered from those of its words.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, table

CAPACITY, CLASSES, END_ID = 2048, 8, 1
TOKENIZER = "word_bpe_49k.json"
#: Bytes of text that are worked on together.
TOGETHER = 8 << 20
#: Words whose ids a Python worker remembers, besides those of the texts at hand: about 20 MB.
REMEMBERED = 400_000
#: Words in one text that is given to the tokenizer, and how many such texts it gets at once: it holds some hundred bytes a token.
CALL, CALLS = 2_000, 8
#: Bytes of ids that a worker sends back together, about. Spark's own memory holds such a batch whole, too.
SENT = 2 << 20
#: A token of the tokenizer that no text without SPECIAL can give; it stands between the words of a call.
MARK, SPECIAL = "<|endoftext|>", "<|"
#: Punctuation at a word's end that is a token of its own after a letter or digit, whatever the word.
TAIL = r"([0-9a-z])([.,;:!?|#$%&*]+)(\s|$)"

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_length long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def gathered(ids: np.ndarray, sizes: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The ids of the words at these places, one after the other; sizes: of all words in ids."""
    starts, mine = np.cumsum(sizes, dtype=np.int32) - sizes, sizes[place]
    shift = starts[place] - (np.cumsum(mine, dtype=np.int32) - mine)
    return ids[np.repeat(shift, mine) + np.arange(mine.sum(), dtype=np.int32)]


def slices(text: str, size: int) -> list[str]:
    """A text cut at white space into parts of about `size` characters."""
    out, at = [], 0
    while len(text) - at > size:
        cut = max(text.rfind(c, at, at + size) for c in " \n")
        if cut <= at:
            cut = min((x for x in (text.find(c, at + size) for c in " \n") if x > 0), default=len(text))
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


class WordIds:
    """The ids of texts as little-endian bytes. The tokenizer drops white space and never joins across it, so a text's
    ids are those of its words in a row. It lower-cases, and never joins an ASCII letter or digit to punctuation after
    it, so words are told apart in lower case and without the punctuation at their end."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self.tokenizer.token_to_id(MARK)
        #: The words met lately, the latest first, with how many ids each has, and all these ids.
        self.words, self.sizes, self.ids = pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def encoded(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def called(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and the ids, by the tokenizer; the words have no SPECIAL."""
        found = [np.zeros(0, np.uint32)]
        for first in range(0, len(words), CALL * CALLS):
            some = words[first : first + CALL * CALLS]
            texts = [MARK.join([*some[at : at + CALL], ""]) for at in range(0, len(some), CALL)]  # a mark after each word
            found.extend(np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))
        ids = np.concatenate(found)
        ends = np.flatnonzero(ids == self.mark)
        return np.diff(ends, prepend=-1).astype(np.int32) - 1, np.delete(ids, ends)

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of the distinct words has, and the ids. They are the words met lately from then on."""
        place = pc.index_in(words, self.words)
        new = np.asarray(place.is_null())
        place = np.array(place.fill_null(0))
        new_sizes, new_ids = self.called(words.filter(pa.array(new)).to_pylist())
        sizes, both = np.concatenate([self.sizes, new_sizes]), np.concatenate([self.ids, new_ids])
        place[new] = len(self.sizes) + np.arange(new.sum())
        got = sizes[place], gathered(both, sizes, place)
        rest = np.ones(len(self.words), bool)
        rest[place[~new]] = False
        rest = np.flatnonzero(rest)[: max(0, REMEMBERED - len(words))]
        self.words = pa.concat_arrays([words, self.words.take(pa.array(rest))])
        self.ids, self.sizes = np.concatenate([got[1], gathered(self.ids, self.sizes, rest)]), np.concatenate([got[0], self.sizes[rest]])
        return got

    def texts(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text, for texts of some megabytes together."""
        words = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.ascii_lower(texts), TAIL, r"\1 \2\3"))
        coded = words.flatten().dictionary_encode()
        sizes, ids = self.of(coded.dictionary)
        codes = coded.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes[codes], dtype=np.int64)])
        raw = gathered(ids, sizes, codes).tobytes()
        bounds = (4 * ends[words.offsets.to_numpy() - words.offsets[0].as_py()]).tolist()
        return [raw[a:b] for a, b in zip(bounds, bounds[1:])]

    def all(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text, in order, TOGETHER bytes at a time."""
        plain = pc.invert(pc.match_substring(texts, SPECIAL)).to_pylist()
        sizes = pc.binary_length(texts).to_pylist()
        at = 0
        while at < len(texts):
            if not plain[at]:
                yield self.encoded(texts[at].as_py())
                at += 1
            elif sizes[at] > TOGETHER:
                yield b"".join(self.texts(pa.array([part]))[0] for part in slices(texts[at].as_py(), TOGETHER))
                at += 1
            else:
                size, stop = 0, at
                while stop < len(texts) and plain[stop] and (size := size + sizes[stop]) <= TOGETHER:
                    stop += 1
                yield from self.texts(texts[at:stop])
                at = stop


@cache
def word_ids() -> WordIds:
    """One for each Python worker, kept between its tasks; REMEMBERED bounds it."""
    return WordIds(tokenizer_path())


class HarmonicPacker:
    """Packs the documents of one worker; add() and finish() yield rows of SCHEMA."""

    def __init__(self, worker: int, capacity: int, classes: int):
        self.capacity, self.next_id = capacity, worker << 40
        self.sizes = [capacity // j for j in range(1, classes + 1)]
        self.open: list[list[tuple]] = [[] for _ in self.sizes]
        self.small: list[tuple] = []
        self.filled = 0

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[tuple]:
        total = len(ids) // 4
        at = 0
        for j, size in enumerate(self.sizes, 1):
            while total - at >= size:
                self.open[j - 1].append((doc_id, at, ids[at * 4 : (at + size) * 4], total))
                at += size
                if len(self.open[j - 1]) == j:
                    yield from self.close(self.open[j - 1], self.capacity)
                    self.open[j - 1] = []
        if at < total:
            yield from self.pour((doc_id, at, ids[at * 4 :], total))

    def pour(self, piece: tuple) -> Iterator[tuple]:
        """Into the small class, cut where its bin ends."""
        doc_id, at, ids, total = piece
        while ids:
            part = ids[: (self.capacity - self.filled) * 4]
            self.small.append((doc_id, at, part, total))
            at, ids, self.filled = at + len(part) // 4, ids[len(part) :], self.filled + len(part) // 4
            if self.filled == self.capacity:
                yield from self.close(self.small, self.capacity)
                self.small, self.filled = [], 0

    def close(self, pieces: Iterable[tuple], length: int) -> Iterator[tuple]:
        offset = 0
        for doc_id, at, ids, total in pieces:
            yield doc_id, at, len(ids) // 4, ids, total, self.next_id, offset, length
            offset += len(ids) // 4
        self.next_id += 1

    def finish(self) -> Iterator[tuple]:
        for pieces in self.open:
            for piece in pieces:
                yield from self.pour(piece)
        room, rest = self.filled, self.small
        while room:
            size = 1 << room.bit_length() - 1
            room, left, taken = room - size, size, []
            while left:
                doc_id, at, ids, total = rest[0]
                part = ids[: left * 4]
                taken.append((doc_id, at, part, total))
                left -= len(part) // 4
                rest = ([(doc_id, at + len(part) // 4, ids[len(part) :], total)] if len(part) < len(ids) else []) + rest[1:]
            yield from self.close(taken, size)


def packed(batches: Iterator[pa.RecordBatch], packer: HarmonicPacker, end: bytes) -> Iterator[pa.RecordBatch]:
    """Batches of (doc_id, text) to batches of SCHEMA, each sent once its ids are SENT bytes or more. Then Arrow gives back what
    it keeps of freed memory, as the worker lives on beside Spark's own memory, idle or in other tasks."""
    names, kinds = zip(*(x.split() for x in SCHEMA.split(", ")))
    types = [pa.binary() if kind == "binary" else pa.int64() for kind in kinds]
    out = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * len(names), types)], list(names))
    ids = word_ids()

    def found() -> Iterator[tuple]:
        for batch in batches:
            for key, own in zip(batch.column(0).to_pylist(), ids.all(batch.column(1))):
                yield from packer.add(key, own + end)
        yield from packer.finish()

    rows, size = [], 0
    for row in found():
        rows.append(row)
        size += len(row[3])
        if size >= SENT:
            yield out(rows)
            rows, size = [], 0
            pa.default_memory_pool().release_unused()
    yield out(rows)
    pa.default_memory_pool().release_unused()


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, classes: int = CLASSES, end_id: int = END_ID) -> DataFrame:
    """docs packed into sequences of at most `capacity` tokens: one row a piece (SCHEMA). One pass, no shuffle.

    A document's ids are its text's, then end_id; a null or empty text is end_id alone. A null doc_id stays null.
    Repeated rows are packed once each, as documents of their own, so each token of each row lies in just one piece.
    An empty table gives no rows; other columns are ignored. sequence_length is the length to pad to: the capacity, or
    a power of two for the at most log2(capacity) sequences that end a worker's part, which need no padding. ids are
    the piece's token ids as little-endian unsigned 32-bit numbers.
    A very long text is tokenized some megabytes at a time, cut at white space, and packed whole. Texts of equal length
    are packed in the order in which they come.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return packed(batches, HarmonicPacker(TaskContext.get().partitionId(), capacity, classes), end)

    slim = columns(docs, doc_id=F.col(doc_id).cast("long"), text=F.coalesce(F.col(text), F.lit("")))
    return slim.mapInArrow(run, SCHEMA)


def op9_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
