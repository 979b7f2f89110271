"""Token ids as wavelet matrices, a compressed file for each shard (operator 12).

Documents are dealt by ranges of their id and sorted; a task tokenises its range in order and cuts it into shards of about
SHARD_TOKENS ids, at ends of documents. A shard is one file:

    8 bytes  MAGIC
    8 bytes  length of the compressed header
    header   zstd: HEAD numbers (part, shard, tokens, documents, levels, bits a chunk, chunks a level), the zeros of each level,
             for each chunk the ones before it in its level, the chunks' places, and for each document its id, whether it has
             one, and where it starts
    planes   level by level, from the highest bit: zstd chunks of CHUNK bits

The plane of a level holds one bit of every token, in the order in which the levels above left them: zeros before ones, stably.
So a token is read by as many ranks as there are levels, a token is counted without reading any other, and its k-th occurrence is
found by selects from the lowest level up. All three decompress the chunks they touch only. `parts` and shards number the files in the
order of ids; files are written by Spark's own writer, so a lost executor or a repeated task leaves no half file, and on any
storage Spark can write. A line break that the writer adds after a file's last byte belongs to no chunk.

Null text has no tokens; every document has at least the end id. Null ids come last. Rows of equal ids are ordered by a hash of
their text, equal rows stay equal. A document of more than SHARD_TOKENS tokens has a shard for itself, which must fit in a task's
memory (about 40 bytes a token). An empty table gives no files, and no rows. Columns other than those named are not read.

Tokens of a text are those of its words: the vocabulary's normaliser and splitter never look across white space, nor, at the end
of a word, from a letter to an ASCII sign. Words are therefore tokenised once for each worker, in a table of at most CACHE words,
and `tokens` gives what the library gives for the whole text (tested on all texts of a table). For a vocabulary of another kind
`by_words` is to be False; each text then goes to the library as it is.
"""

from __future__ import annotations

import os
import re
import string
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.llm.common import shared_dir, written

MAGIC = b"RLWAVE01"
CHUNK = 1 << 15
SHARD_TOKENS = 1 << 22
#: A range of documents has about so many bytes of text, and there are at most so many ranges.
RANGE_BYTES, RANGES = 32 << 20, 20_000
CACHE = 1 << 20
SLICE_BYTES = 8 << 20
HEAD = 7
SIGNS = string.punctuation.replace("'", "")


# --- tokens -------------------------------------------------------------------------------------------------------------


class WordTokens:
    """Token ids of texts, by way of their distinct words. For vocabularies whose words end with the sign `</w>`."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tool = Tokenizer.from_file(path)
        # For words that need no normaliser and no splitter but at white space. A word comes once, so the model's own cache only costs.
        self.bare = Tokenizer(self.tool.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.bare.model._resize_cache(0)
        self.known: dict[str, bytes] = {}
        words = self.tool.get_vocab(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if max(words.values(), default=0) < 1 << 16 else "<u4")
        self.last = np.zeros(max(words.values(), default=0) + 1, bool)
        self.last[[i for w, i in words.items() if w.endswith("</w>")]] = True

    def ids(self, text: str) -> bytes:
        return np.array(self.tool.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    @staticmethod
    def parts(words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Words as (stems, signs after them); tokens never span the two. ASCII letters are lower-cased, which the vocabulary does
        anyway. Words with marks of special tokens stay whole, as they are."""
        marked, bare = pc.match_substring(words, "<|"), pc.utf8_rtrim(words, SIGNS)
        ends = pc.and_(pc.invert(marked), pc.match_substring_regex(bare, "[0-9A-Za-zÀ-ÖØ-öø-ɏ]$"))
        stems = pc.if_else(marked, words, pc.ascii_lower(pc.if_else(ends, bare, words)))
        return stems, pc.if_else(ends, pc.replace_substring_regex(words, f"(?s)^.*[^{re.escape(SIGNS)}]", ""), "")

    def learn(self, new: list[str]) -> None:
        """Words of letters are one piece each, which ends where a token with the sign does; they go to the library many at a time. Those
        of small ASCII letters are what the normaliser makes of them already."""
        for tool, some in ((self.bare, [w for w in new if w.isascii() and w.isalpha()]), (self.tool, [w for w in new if not w.isascii() and w.isalpha() and max(w) < "ɐ"])):
            for lo in range(0, len(some), 4096):
                part = some[lo : lo + 4096]
                found = np.array(tool.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.dtype)
                ends = (np.flatnonzero(self.last[found]) + 1) * self.dtype.itemsize
                if len(ends) == len(part):
                    raw, at = found.tobytes(), 0
                    for word, end in zip(part, ends.tolist()):
                        self.known[word] = raw[at:end]
                        at = end
        for word in new:
            if word not in self.known:
                self.known[word] = self.ids(word)

    def of_words(self, words: list[str]) -> list[bytes]:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = words
        self.learn(new)
        return [self.known[w] for w in words]

    def batch(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts, one after the other; how many each has). Null is empty."""
        lists = pc.ascii_split_whitespace(column.fill_null(""))
        coded = lists.flatten().dictionary_encode()
        stems, signs = (x.dictionary_encode() for x in self.parts(coded.dictionary))
        ids = self.of_words(stems.dictionary.to_pylist())
        ids += self.of_words(signs.dictionary.to_pylist())
        sizes = np.array([len(x) for x in ids], np.int32) // self.dtype.itemsize
        flat, first = np.frombuffer(b"".join(ids), self.dtype), np.cumsum(sizes, dtype=np.int32) - sizes
        # A word is two pieces, its stem and its signs.
        pieces = np.empty((len(coded.dictionary), 2), np.int32)
        pieces[:, 0], pieces[:, 1] = stems.indices.to_numpy(zero_copy_only=False), signs.indices.to_numpy(zero_copy_only=False) + np.int32(len(stems.dictionary))
        which = pieces[coded.indices.to_numpy(zero_copy_only=False)].ravel()
        many = sizes[which]
        ends = np.cumsum(many, dtype=np.int64)
        # The places of a piece's ids run from its first one.
        place = np.repeat((first[which] - (ends - many)).astype(np.int32), many)
        place += np.arange(len(place), dtype=np.int32)
        words = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
        return flat[place], np.diff(np.concatenate([[0], ends])[2 * words])


class TextTokens(WordTokens):
    """Token ids of texts as the library gives them, for any vocabulary."""

    def batch(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = [self.ids(t or "") for t in column.to_pylist()]
        return np.frombuffer(b"".join(ids), self.dtype), np.array([len(x) for x in ids], np.int64) // self.dtype.itemsize


_TOOLS: dict[tuple[str, bool], WordTokens] = {}


def tokenizer(path: str, by_words: bool = True) -> WordTokens:
    """One for each worker process, so that the table of words lasts from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (path, by_words) not in _TOOLS:
        _TOOLS[path, by_words] = (WordTokens if by_words else TextTokens)(path)
    return _TOOLS[path, by_words]


# --- the file -----------------------------------------------------------------------------------------------------------


def packed(part: int, shard: int, tokens: np.ndarray, ids: list[int | None], starts: np.ndarray) -> bytes:
    """The file of a shard: its tokens as a wavelet matrix, and its documents' ids and starts."""
    n, levels = len(tokens), max(1, int(tokens.max(initial=0)).bit_length())
    chunks = -(-n // CHUNK)
    pack = zstandard.ZstdCompressor(level=3).compress
    zeros, ranks, sizes, planes, a = [], [], [], [], tokens
    for level in range(levels - 1, -1, -1):
        bit = ((a >> level) & 1).astype("u1").view(bool)
        raw = np.packbits(bit, bitorder="little")
        ones = np.add.reduceat(np.bitwise_count(raw), np.arange(0, len(raw), CHUNK // 8), dtype=np.int64) if n else np.zeros(0, np.int64)
        ranks.append(np.cumsum(ones) - ones)
        raw = raw.tobytes()
        for lo in range(0, len(raw), CHUNK // 8):
            planes.append(pack(raw[lo : lo + CHUNK // 8]))
            sizes.append(len(planes[-1]))
        zeros.append(n - int(ones.sum()))
        a = np.concatenate([a[~bit], a[bit]])
    numbers = [[part, shard, n, len(ids), levels, CHUNK, chunks], zeros, *ranks, np.cumsum([0, *sizes])]
    head = b"".join(np.asarray(x, "<i8").tobytes() for x in numbers)
    head += np.array([i or 0 for i in ids], "<i8").tobytes() + np.array([i is not None for i in ids], "u1").tobytes() + np.asarray(starts, "<i8").tobytes()
    head = pack(head)
    return b"".join([MAGIC, struct.pack("<q", len(head)), head, *planes])


def unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, "u1"), bitorder="little", count=n).view(bool)


class Shard:
    """A shard's file, as bytes or anything that slices like them (a memory map). Positions are from 0 within the shard.

    Chunks are decompressed when they are first touched; `touched` counts them."""

    def __init__(self, data):
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a file of this format")
        (size,) = struct.unpack("<q", data[8:16])
        self.data, self.unpack = data, zstandard.ZstdDecompressor().decompress
        head = self.unpack(bytes(data[16 : 16 + size]))
        self.part, self.shard, self.n, self.documents, self.levels, self.width, self.chunks = map(int, np.frombuffer(head, "<i8", HEAD))
        at = 8 * HEAD

        def take(n: int, kind: str = "<i8") -> np.ndarray:
            nonlocal at
            out = np.frombuffer(head, kind, n, at)
            at += out.nbytes
            return out

        self.zeros = take(self.levels)
        self.ones_before = take(self.levels * self.chunks).reshape(self.levels, self.chunks)
        self.places = take(self.levels * self.chunks + 1) + 16 + size
        ids, has = take(self.documents), take(self.documents, "u1")
        self.ids = [int(i) if h else None for i, h in zip(ids, has)]
        self.starts = take(self.documents)
        self.kept: dict[tuple[int, int], np.ndarray] = {}

    @property
    def touched(self) -> int:
        return len(self.kept)

    def raw(self, level: int, chunk: int) -> bytes:
        k = level * self.chunks + chunk
        return self.unpack(bytes(self.data[self.places[k] : self.places[k + 1]]))

    def bits(self, level: int, chunk: int) -> np.ndarray:
        found = self.kept.get((level, chunk))
        if found is None:
            found = self.kept[level, chunk] = unpacked(self.raw(level, chunk), min(self.width, self.n - chunk * self.width))
        return found

    def rank(self, level: int, i: int) -> int:
        """Ones among the first i bits of a level."""
        if i <= 0 or not self.n:
            return 0
        chunk = min(i, self.n - 1) // self.width
        return int(self.ones_before[level, chunk]) + int(np.count_nonzero(self.bits(level, chunk)[: i - chunk * self.width]))

    def select(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) one or zero of a level."""
        before = self.ones_before[level] if bit else np.arange(self.chunks) * self.width - self.ones_before[level]
        chunk = int(np.searchsorted(before, k, side="right")) - 1
        return chunk * self.width + int(np.flatnonzero(self.bits(level, chunk) == bool(bit))[k - int(before[chunk])])

    def access(self, i: int) -> int:
        """The token at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level in range(self.levels):
            bit = int(self.bits(level, i // self.width)[i % self.width])
            out = out << 1 | bit
            i = int(self.zeros[level]) + self.rank(level, i) if bit else i - self.rank(level, i)
        return out

    def span(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        """Where a token's occurrences in [lo, hi) are in the order below the last level."""
        if token >> self.levels or token < 0:
            return 0, 0
        for level in range(self.levels):
            a, b = self.rank(level, lo), self.rank(level, hi)
            one = token >> (self.levels - 1 - level) & 1
            lo, hi = (int(self.zeros[level]) + a, int(self.zeros[level]) + b) if one else (lo - a, hi - b)
            if lo >= hi:
                return 0, 0
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        a, b = self.span(token, lo, self.n if hi is None else hi)
        return b - a

    def find(self, token: int, k: int) -> int:
        """The place of the token's k-th occurrence, from 0."""
        a, b = self.span(token, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        at = a + k
        for level in range(self.levels - 1, -1, -1):
            one = token >> (self.levels - 1 - level) & 1
            at = self.select(level, one, at - int(self.zeros[level]) * one)
        return at

    def occurrences(self, token: int) -> np.ndarray:
        """The places of all occurrences of a token, rising: selects of a whole range a level, chunk by chunk."""
        a, b = self.span(token, 0, self.n)
        at = np.arange(a, b)
        for level in range(self.levels - 1, -1, -1):
            one = token >> (self.levels - 1 - level) & 1
            k = at - int(self.zeros[level]) * one
            before = self.ones_before[level] if one else np.arange(self.chunks) * self.width - self.ones_before[level]
            chunk = np.searchsorted(before, k, side="right") - 1
            at = np.empty_like(k)
            for c in np.unique(chunk):
                mine = chunk == c
                at[mine] = c * self.width + np.flatnonzero(self.bits(level, int(c)) == bool(one))[k[mine] - int(before[c])]
        return np.sort(at)

    def tokens(self) -> np.ndarray:
        """All tokens in order, from the lowest level up: a level's bits say which tokens go back to which place."""
        out = np.zeros(self.n, "<u2" if self.levels <= 16 else "<u4")
        for level in range(self.levels - 1, -1, -1):
            bit = unpacked(b"".join(self.raw(level, c) for c in range(self.chunks)), self.n)
            above, zeros = np.empty_like(out), int(self.zeros[level])
            above[~bit] = out[:zeros]
            above[bit] = out[zeros:] | out.dtype.type(1 << (self.levels - 1 - level))
            out = above
        return out

    def places_of(self, at: np.ndarray) -> tuple[list, np.ndarray]:
        """(the document of each place, the place within it)."""
        doc = np.searchsorted(self.starts, at, side="right") - 1
        return [self.ids[d] for d in doc], at - self.starts[doc]


# --- on Spark -----------------------------------------------------------------------------------------------------------


def slices(batches: Iterable[pa.RecordBatch], size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of batches (part, id, text) in pieces of about `size` bytes of text, of one row at the least."""
    for batch in batches:
        upto = np.cumsum(pc.binary_length(batch.column(2)).fill_null(0).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + size, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def write(docs: DataFrame, vocabulary: str, end: int, doc_id: str = "doc_id", text: str = "text", path: str | None = None, by_words: bool = True, shard_tokens: int = SHARD_TOKENS) -> str:
    """Writes the token ids of docs, each document's with the id `end` after them, in the order of doc_id (an integer column); returns the folder.

    vocabulary: the path of a tokenizer's file, the same on all machines. path: a folder that does not exist yet; by default a new
    one in the shared folder."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark).rstrip('/')}/rankloom/tokens-{uuid.uuid4().hex}"
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    keys = [F.asc_nulls_last("id"), F.asc("_text"), F.asc("_row")]
    rows = rows.withColumn("_text", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(max(1, min(RANGES, -(-size // RANGE_BYTES))), *keys).sortWithinPartitions(*keys).select(F.spark_partition_id().alias("part"), "id", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = tokenizer(vocabulary, by_words)
        part, shard, total, ids, held, sizes = 0, 0, 0, [], [], []

        def done() -> pa.RecordBatch:
            out = packed(part, shard, np.concatenate(held), ids, np.cumsum([0, *sizes[:-1]]))
            return pa.RecordBatch.from_arrays([pa.array([out], pa.binary())], names=["content"])

        for batch in slices(batches):
            part = batch.column(0)[0].as_py()
            flat, many = tool.batch(batch.column(2))
            flat, at = np.insert(flat, np.cumsum(many), end).astype(tool.dtype), 0
            for i, n in zip(batch.column(1).to_pylist(), (many + 1).tolist()):
                if ids and total + n > shard_tokens:
                    yield done()
                    shard, total, ids, held, sizes = shard + 1, 0, [], [], []
                ids.append(i)
                held.append(flat[at : at + n])
                sizes.append(n)
                at, total = at + n, total + n
        if ids:
            yield done()

    # A row is a file: the text writer puts its bytes as they are.
    files = dealt.mapInArrow(run, "content binary").select(F.col("content").cast("string").alias("value"))
    files.write.option("maxRecordsPerFile", 1).option("compression", "none").text(path)
    return path


def files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of every shard."""
    return spark.read.format("binaryFile").load(path).filter("length > 0").select("path", "content")


def documents(spark: SparkSession, path: str, tokens: bool = True) -> DataFrame:
    """Read back from the files: doc_id, part, shard, at (its first token in the shard), shard_tokens, n_tokens, ids_crc32 (of its ids
    as little-endian unsigned 32-bit integers) and, if asked for, tokens of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                shard = Shard(memoryview(data.as_buffer()))
                flat = shard.tokens()
                ends = np.append(shard.starts[1:], shard.n)
                each = [flat[a:b] for a, b in zip(shard.starts, ends)]
                columns = {
                    "doc_id": pa.array(shard.ids, pa.int64()), "part": pa.array([shard.part] * shard.documents, pa.int64()), "shard": pa.array([shard.shard] * shard.documents, pa.int64()),
                    "at": pa.array(shard.starts, pa.int64()), "shard_tokens": pa.array([shard.n] * shard.documents, pa.int64()), "n_tokens": pa.array(ends - shard.starts, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in each], pa.int64()),
                }
                if tokens:
                    columns["tokens"] = pa.array([x.tolist() for x in each], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, part long, shard long, at long, shard_tokens long, n_tokens long, ids_crc32 long" + (", tokens array<int>" if tokens else "")
    return files(spark, path).select("content").mapInArrow(run, schema)


def placed(docs: DataFrame) -> DataFrame:
    """docs (a table of `documents`) with start: the number of tokens of all documents before it.

    Starts are summed up within a part and over the parts, of which there are at most RANGES."""
    shards = docs.filter("at = 0 and n_tokens > 0").select("part", "shard", "shard_tokens")
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    parts = shards.groupBy("part").agg(F.sum("shard_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), zero).alias("of_part"))
    starts = shards.select("part", "shard", F.coalesce(F.sum("shard_tokens").over(within), zero).alias("of_shard")).join(parts, "part")
    return docs.join(starts, ["part", "shard"]).withColumn("start", F.col("of_part") + F.col("of_shard") + F.col("at")).drop("of_part", "of_shard")


def counts(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """token and n, its occurrences in all files, of each token asked for: two ranks a level and file, no token is decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                shard = Shard(memoryview(data.as_buffer()))
                yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([shard.count(t) for t in tokens], pa.int64())], names=["token", "n"])

    asked = spark.createDataFrame([(t,) for t in tokens], "token long").distinct()
    found = files(spark, path).select("content").mapInArrow(run, "token long, n long")
    return asked.join(found, "token", "left").groupBy("token").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def occurrences(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """token, doc_id and place (from 0, within the document) of every occurrence of the tokens asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                shard = Shard(memoryview(data.as_buffer()))
                for t in sorted(set(tokens)):
                    ids, place = shard.places_of(shard.occurrences(t))
                    yield pa.RecordBatch.from_arrays([pa.array([t] * len(ids), pa.int64()), pa.array(ids, pa.int64()), pa.array(place, pa.int64())], names=["token", "doc_id", "place"])

    return files(spark, path).select("content").mapInArrow(run, "token long, doc_id long, place long")


def digests(docs: DataFrame, vocabulary: str, end: int, **options) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from files that are written and read back."""
    path = write(docs, vocabulary, end, **options)
    found = written(documents(docs.sparkSession, path, tokens=False), "token-digests")
    return placed(found).select("doc_id", "start", "n_tokens", "ids_crc32")
