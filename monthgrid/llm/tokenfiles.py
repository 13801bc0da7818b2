"""Token ids as binary files of patched frame-of-reference blocks.

A file holds the ids of consecutive documents. A block of ``BLOCK`` ids stores its smallest id and
the differences to it, packed at the width that ``PERCENTILE`` of them fit in; the higher bits of
the others stand in a list of exceptions behind the packed bits. The file starts with the starts of
its blocks, so any range of ids can be read without the rest.

Layout, little-endian: ``PFR1``; ids u8, documents u8, blocks u8 (64-bit); block starts (64-bit,
counted from the first block); document ids (64-bit), whether they are known (8-bit), lengths
(32-bit); blocks. Block: smallest id (32-bit), width (8-bit), exceptions (16-bit), packed
differences, exception places (16-bit), their higher bits (32-bit). The last block is padded.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from monthgrid.llm import wordhash as wh
from monthgrid.llm.common import materialize, scratch_path, shuffle_width, text_or_empty
from monthgrid.llm.patterns import Pieces

BLOCK = 256
PERCENTILE = 90
MAGIC = b"PFR1"
#: Ids after which a file is closed.
FILE_IDS = 1 << 22
_ROWS = 2048  # blocks handled at once
MANIFEST = "part int, number int, path string, n_docs bigint, n_ids bigint"


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, np.floor(np.log2(np.maximum(x, 1).astype(np.float64))).astype(np.int64) + 1, 0)


def pack_blocks(ids: np.ndarray) -> list[bytes]:
    """Blocks of ``ids`` (uint32); a short last block is padded with its last id."""
    if not len(ids):
        return []
    ids = np.concatenate([ids, np.repeat(ids[-1:], -len(ids) % BLOCK)])
    out: list[bytes] = []
    for at in range(0, len(ids), BLOCK * _ROWS):
        block = ids[at : at + BLOCK * _ROWS].reshape(-1, BLOCK)
        least = block.min(1)
        rest = (block - least[:, None]).astype(np.int64)
        cut = -(-BLOCK * PERCENTILE // 100) - 1
        widths = _bit_length(np.partition(rest, cut, axis=1)[:, cut])
        packed: list[bytes] = [b""] * len(block)
        for width in np.unique(widths).tolist():
            rows = np.flatnonzero(widths == width)
            low = np.unpackbits(rest[rows].astype("<u4").view(np.uint8), axis=1, bitorder="little").reshape(len(rows), BLOCK, 32)
            lines = np.packbits(low[:, :, :width].reshape(len(rows), -1), axis=1, bitorder="little")
            for r, line in zip(rows.tolist(), lines, strict=True):
                packed[r] = line.tobytes()
        over = rest >> widths[:, None]
        for r in range(len(block)):
            places = np.flatnonzero(over[r])
            head = np.uint32(least[r]).tobytes() + bytes([int(widths[r])]) + np.uint16(len(places)).tobytes()
            out.append(head + packed[r] + places.astype("<u2").tobytes() + over[r][places].astype("<u4").tobytes())
    return out


def unpack_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """Ids of the blocks that begin at ``starts`` in ``data``, padding included."""
    out = np.zeros((len(starts), BLOCK), np.int64)
    raw = np.frombuffer(data, np.uint8)
    heads = raw[starts[:, None] + np.arange(7)] if len(starts) else np.zeros((0, 7), np.uint8)
    least = heads[:, :4].copy().view("<u4").ravel()
    widths, counts = heads[:, 4].astype(np.int64), heads[:, 5:7].copy().view("<u2").ravel()
    for width in np.unique(widths).tolist():
        of_width = np.flatnonzero(widths == width)
        for at in range(0, len(of_width), _ROWS):
            rows = of_width[at : at + _ROWS]
            size = BLOCK * width // 8
            if size:
                lines = raw[starts[rows][:, None] + 7 + np.arange(size)]
                bits = np.zeros((len(rows), BLOCK, 32), np.uint8)
                bits[:, :, :width] = np.unpackbits(lines, axis=1, bitorder="little").reshape(len(rows), BLOCK, width)
                out[rows] = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little").view("<u4")
    for r in np.flatnonzero(counts).tolist():
        n, at = int(counts[r]), int(starts[r]) + 7 + BLOCK * int(widths[r]) // 8
        places = np.frombuffer(data, "<u2", n, at)
        out[r, places] |= np.frombuffer(data, "<u4", n, at + 2 * n).astype(np.int64) << int(widths[r])
    return (out + least[:, None].astype(np.int64)).astype(np.uint32).ravel()


def write_file(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    blocks = pack_blocks(ids)
    starts = np.concatenate([[0], np.cumsum([len(b) for b in blocks])])[: len(blocks)]
    return b"".join(
        [
            MAGIC, np.array([len(ids), len(doc_ids), len(blocks)], "<u8").tobytes(), starts.astype("<u8").tobytes(),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is not None for d in doc_ids], np.uint8).tobytes(),
            lengths.astype("<u4").tobytes(), *blocks,
        ]
    )


class TokenFile:
    """A file's documents, and any range of its ids."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not a token file")
        self.n_ids, docs, blocks = (int(x) for x in np.frombuffer(data, "<u8", 3, 4))
        at = 28
        self.starts = np.frombuffer(data, "<u8", blocks, at).astype(np.int64)
        at += 8 * blocks
        known = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(np.frombuffer(data, "<i8", docs, at), known, strict=True)]
        self.lengths = np.frombuffer(data, "<u4", docs, at + 9 * docs).astype(np.int64)
        self.data, self.base = data, at + 13 * docs

    def read(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, -(-stop // BLOCK)
        return unpack_blocks(self.data, self.starts[first:last] + self.base)[start - first * BLOCK : stop - first * BLOCK]


class _Memory:
    """What ``make`` gives for a list of strings, kept in two generations of bounded size."""

    def __init__(self, make: Callable[[list[str]], list[bytes]]) -> None:
        self.make = make
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __len__(self) -> int:
        return len(self.new)

    def values(self, keys: Iterable[str]) -> dict[str, bytes]:
        """Values by key, those of ``keys`` among them, which are distinct."""
        if len(self.new) > MAX_WORDS:
            self.old, self.new = self.new, {}
        fresh = []
        for key in keys:
            if key not in self.new:
                value = self.old.get(key)
                if value is None:
                    fresh.append(key)
                else:
                    self.new[key] = value
        self.new.update(zip(fresh, self.make(fresh), strict=True))
        return self.new


class WordTokenizer:
    """Ids of whole texts by a tokenizer that drops white space and never joins words across it.

    Words between white space of ASCII are remembered. Texts of the first Latin blocks are put in lower case first,
    as the tokenizer would do, so that a word counts as one however it is written. If the tokenizer's
    settings name a pattern that cuts such words into pieces, each encoded alone, a new word is cut
    by it and the pieces are remembered, too; what is new then is encoded by the library, once. Strings of
    the tokenizer's added tokens in a text become these tokens, as is the library's default.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # A text with an added token's string, in any case, is left to the library as a whole.
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added), re.IGNORECASE) if added else None
        self.lowers = self.tokenizer.encode("Aa", add_special_tokens=False).ids == self.tokenizer.encode("aa", add_special_tokens=False).ids
        pattern = _cutting_pattern(json.loads(self.tokenizer.to_str())) if self.lowers else None
        self.pattern, self.model = Pieces(pattern) if pattern else None, self.tokenizer.model
        self.known, self.pieces = _Memory(self._of_words), _Memory(self._of_pieces)

    def _of_words(self, words: list[str]) -> list[bytes]:
        if self.pattern is None:
            return self._by_library(words)
        others = [w for w in words if _OTHER.search(w)]
        out = dict(zip(others, self._by_library(others), strict=True))
        cut = {w: self.pattern.findall(w.lower()) for w in words if w not in out}
        known = self.pieces.values(set().union(*cut.values()))
        return [out[w] if w in out else b"".join([known[p] for p in cut[w]]) for w in words]

    def _of_pieces(self, pieces: list[str]) -> list[bytes]:
        """By the library's model alone: a piece is as the steps before the model would leave it, but for the names of its bytes."""
        tokens = self.model.tokenize
        named = (p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(_BYTE_NAMES) for p in pieces)
        return [array("I", [t.id for t in tokens(p)]).tobytes() for p in named]

    def _by_library(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def encode(self, texts: list[str], end: bytes) -> list[bytes]:
        """Ids of each text as 32-bit integers, then ``end``."""
        whole = {i for i, t in enumerate(texts) if self.added is not None and self.added.search(t)}
        plain = ["" if i in whole else t.lower() if self.lowers and not _OTHER.search(t) else t for i, t in enumerate(texts)]
        # Other white space than that of ASCII stays inside words, where the tokenizer drops it.
        split = pc.ascii_split_whitespace(pa.array(plain, pa.large_string()))
        words, offsets = split.flatten().dictionary_encode(), split.offsets.to_numpy()
        distinct = words.dictionary.to_pylist()
        known = self.known.values(distinct)
        ids = [known[w] for w in distinct]
        # Places of the ids of all words, one after the other, among those of the distinct words.
        which = words.indices.to_numpy()
        sizes = np.array([len(x) // 4 for x in ids], np.int64)
        starts, own = np.cumsum(sizes) - sizes, sizes[which]
        ends = np.concatenate([[0], np.cumsum(own)])
        places = np.repeat(starts[which] - ends[:-1], own) + np.arange(ends[-1])
        data = np.frombuffer(b"".join(ids), np.uint32)[places].tobytes()
        bounds = (4 * ends[offsets - offsets[0]]).tolist()
        out = [data[a:b] + end for a, b in pairwise(bounds)]
        for i in whole:
            out[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32).tobytes() + end
        return out


def _cutting_pattern(settings: dict) -> str | None:
    """The pattern whose matches in a lower-case Latin text are encoded each alone, if the settings say so.

    That is when the text as such is cut by one pattern without a look at what stands around a match.
    """
    def steps(part: dict | None, name: str) -> list[dict]:
        return [] if part is None else part[name] if part["type"] == "Sequence" else [part]

    for step in steps(settings["normalizer"], "normalizers"):
        spaces = step["type"] == "Replace" and step["pattern"] == {"Regex": "\\s+"} and step["content"] == " "
        if not spaces and step["type"] not in ("NFC", "Lowercase"):
            return None
    first, *others = steps(settings["pre_tokenizer"], "pretokenizers") or [None]
    if first is None or first["type"] != "Split" or first["behavior"] != "Removed" or not first["invert"]:
        return None
    if len(others) != 1 or others[0]["type"] != "ByteLevel" or others[0]["add_prefix_space"] or others[0]["use_regex"]:
        return None
    pattern = first["pattern"].get("Regex")
    return pattern if pattern and not re.search(r"\(\?|[\^$](?!\\)|\\[bBAzZG]", pattern.replace("[^", "[")) else None


@lru_cache(maxsize=1)
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


#: How byte-level tokenizers write the bytes that are no printable characters.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_NAMES = {byte: chr(256 + i) for i, byte in enumerate(sorted({*range(256)} - _PRINTABLE))}
MAX_WORDS = 300_000
_OTHER = re.compile("[^\x00-\u012f\u0131-\u017f]")  # beyond these, lower case may depend on the library


def write_ids(docs: DataFrame, tokenizer_path: str, root: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes files below ``root``, a shared folder, and returns their manifest with the first id's place of each.

    Documents are range-partitioned by id and each task writes the files of its range; a task that runs
    again replaces its files by the same bytes. NULL ids come first, rows that share an id are ordered by
    their text's hash, NULL texts hold the end id only. An empty table writes no file.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text_or_empty(text_col).alias("text")).withColumn("row_key", F.xxhash64("text"))
    ordered = rows.repartitionByRange(shuffle_width(spark), "id").sortWithinPartitions("id", "row_key").select("id", "text")
    end = np.uint32(end_id).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_path)
        fs, folder = pa.fs.FileSystem.from_uri(root)
        fs.create_dir(folder, recursive=True)
        part, number, docs_held, held, size = TaskContext.get().partitionId(), 0, [], [], 0

        def close() -> pa.RecordBatch:
            path = f"{folder}/part-{part:06d}-{number:05d}.pfr"
            lengths = np.array([len(x) // 4 for x in held])
            ids = np.frombuffer(b"".join(held), np.uint32)
            draft = f"{path}.{TaskContext.get().taskAttemptId()}"
            with fs.open_output_stream(draft) as out:
                out.write(write_file(docs_held, lengths, ids))
            fs.move(draft, path)
            return pa.RecordBatch.from_pylist(
                [{"part": part, "number": number, "path": path, "n_docs": len(held), "n_ids": len(ids)}],
                pa.schema([("part", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]),
            )

        for batch in batches:
            for piece in wh.slices(batch, "text"):
                for doc, ids in zip(piece.column("id").to_pylist(), tokenizer.encode(piece.column("text").to_pylist(), end), strict=True):
                    docs_held.append(doc)
                    held.append(ids)
                    size += len(ids) // 4
                    if size >= FILE_IDS:
                        yield close()
                        number, docs_held, held, size = number + 1, [], [], 0
        if held:
            yield close()

    return with_starts(materialize(ordered.mapInArrow(run, MANIFEST), "manifest"))


def with_starts(manifest: DataFrame) -> DataFrame:
    """Adds ``start``, the ids in all files before; sums run over partitions first, then inside each."""
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.join(offsets, "part").withColumn("start", F.col("offset") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).drop("offset")


def read_ids(manifest: DataFrame, root: str, id_col: str = "doc_id") -> DataFrame:
    """id, start (ids of all documents before), n_tokens and ``ids`` (bytes, 32-bit little-endian) of each document in the files."""
    files = manifest.select("path", "start").repartition(shuffle_width(manifest.sparkSession), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pa.fs.FileSystem.from_uri(root)
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with fs.open_input_stream(path) as source:
                    file = TokenFile(source.read())
                ids = file.read()
                ends = np.cumsum(file.lengths)
                begins = ends - file.lengths
                for at in range(0, len(ends), 1024):
                    own = slice(at, at + 1024)
                    payload = [ids[b:e].astype("<u4").tobytes() for b, e in zip(begins[own].tolist(), ends[own].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(file.doc_ids[own], pa.int64()), pa.array(begins[own] + start), pa.array(file.lengths[own]), pa.array(payload, pa.binary())],
                        ["id", "start", "n_tokens", "ids"],
                    )

    return files.mapInArrow(run, "id bigint, start bigint, n_tokens bigint, ids binary").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all documents to a fresh folder and reads them back from the files."""
    root = scratch_path(docs.sparkSession, "ids")
    return read_ids(write_ids(docs, tokenizer_path, root, end_id, id_col, text_col), root, id_col)
