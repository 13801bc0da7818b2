"""Substring dedup over super-k-mers.

A window is ``WINDOW`` consecutive words. Its minimiser is the smallest hash of the word pairs in it.
Consecutive windows of a document mostly share their minimiser; such a run travels as one packed
string of words to the bucket of the minimiser, so equal windows meet although no window is sent on
its own. In a bucket the windows are sorted by hash, equal neighbours are compared byte by byte, and
the smallest document of each decides which occurrences go.

Before anything travels, equal runs of one piece of input are reduced to those of the smallest
document: the others lose all their windows in any case. A passage or a text that very many
documents share is thus sent about once per piece, not once per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthgrid.llm import wordhash as wh
from monthgrid.llm.common import materialize, shuffle_width, text_or_empty

WINDOW = 13
MINIMISER_WORDS = 2
#: Text whose runs are reduced and packed together in a task.
PIECE_BYTES = 24 << 20
BUCKETS_PER_PARTITION = 16
PACKED = "bucket int, payload binary"
SPANS = "id bigint, row_key bigint, start int, stop int"


def _pack(ids: np.ndarray, keys: np.ndarray, pos: np.ndarray, counts: np.ndarray, texts: list[bytes]) -> bytes:
    """Columns of runs, then their strings, one to a line; words hold no line ends."""
    head = [np.array([len(ids)], "<u4"), np.diff(ids, prepend=0).astype("<i8"), keys.astype("<u4"), pos.astype("<u4"), counts.astype("<u4")]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(x.tobytes() for x in head) + b"\n".join(texts))


def _unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ids = np.cumsum(np.frombuffer(raw, "<i8", n, 4))
    rest = [np.frombuffer(raw, "<u4", n, 4 + 8 * n + 4 * n * i).astype(np.int64) for i in range(3)]
    return ids, *rest, raw[4 + 20 * n :]


def _squeeze(words: wh.Words) -> tuple[bytes, np.ndarray]:
    """All words with one space after each, and the place of each word."""
    lengths = words.ends - words.starts
    places = np.concatenate([[0], np.cumsum(lengths + 1)])
    out = np.full(places[-1], 0x20, np.uint8)
    letters = np.ones(places[-1], bool)
    letters[places[1:] - 1] = False
    source = np.zeros(len(words.data) + 1, np.int8)
    np.add.at(source, words.starts, 1)
    np.add.at(source, words.ends, -1)
    out[letters] = words.data[np.cumsum(source[:-1], dtype=np.int8).astype(bool)]
    return out.tobytes(), places


def _runs(part: pa.RecordBatch, window: int) -> tuple[np.ndarray, ...]:
    """Minimiser, row, first word, windows and string of each run of windows."""
    words = wh.Words(*wh.text_buffer(part.column("text")), lower=False)
    first, offsets = words.windows(window)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), []
    pairs = words.window_hashes(MINIMISER_WORDS, np.arange(len(words.starts) - MINIMISER_WORDS + 1), seed=5)
    least = sliding_window_view(pairs, window - MINIMISER_WORDS + 1).min(1)[first]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    new = np.ones(len(first), bool)
    new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    counts = np.diff(np.append(begin, len(first)))
    packed, places = _squeeze(words)
    at, to = places[first[begin]], places[first[begin] + counts + window - 1] - 1
    texts = [packed[i:j] for i, j in zip(at.tolist(), to.tolist(), strict=True)]
    return least[begin], row[begin], first[begin] - words.offsets[row[begin]], counts, texts


def _send(window: int, buckets: int):
    def flush(held: list) -> Iterator[pa.RecordBatch]:
        least, ids, keys, pos, counts = (np.concatenate([h[i] for h in held]) for i in range(5))
        texts = [t for h in held for t in h[5]]
        keep, gone, owner = [], [], {}
        for i in np.argsort(ids, kind="stable").tolist():
            # Ascending ids: whoever repeats a run of a smaller document loses it here and now.
            if owner.setdefault(texts[i], ids[i]) == ids[i]:
                keep.append(i)
            else:
                gone.append(i)
        keep = np.array(keep, np.int64)
        bucket = (least[keep] % wh.U64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        keep, bucket = keep[order], bucket[order]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist() + [len(keep)]
        to, payloads = [], []
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = keep[a:b]
            to.append(int(bucket[a]))
            payloads.append(_pack(ids[own], keys[own], pos[own], counts[own], [texts[i] for i in own.tolist()]))
        if gone:
            # Already decided: packed without strings, under a negative bucket.
            to.append(-1 - int(least[gone[0]] % wh.U64(buckets)))
            payloads.append(_pack(ids[gone], keys[gone], pos[gone], counts[gone], []))
        yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(payloads, pa.binary())], ["bucket", "payload"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in wh.slices(batch, "text"):
                least, row, pos, counts, texts = _runs(part, window)
                size += part.get_total_buffer_size() if len(texts) == 0 else sum(map(len, texts)) // 3
                if texts:
                    ids = part.column("id").to_numpy()[row]
                    held.append((least, ids, part.column("row_key").to_numpy()[row], pos, counts, texts))
                if size >= PIECE_BYTES and held:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return send


def _spans(ids: np.ndarray, keys: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(start, pa.int32()), pa.array(stop, pa.int32())],
        ["id", "row_key", "start", "stop"],
    )


def _sort_bucket(payloads: list[bytes], window: int) -> pa.RecordBatch:
    """Word spans of all windows that also start in a smaller document."""
    parts = [_unpack(p) for p in payloads]
    ids, keys, pos, counts = (np.concatenate([p[i] for p in parts]) for i in range(4))
    text = b"\n".join(p[4] for p in parts)
    line_ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 0x0A)
    offsets = np.concatenate([[0], line_ends + 1, [len(text)]])
    words = wh.Words(np.frombuffer(text, np.uint8), offsets, lower=False)
    first, _ = words.windows(window)
    run = np.repeat(np.arange(len(ids)), counts)
    hashes = words.window_hashes(window, first)
    order = np.lexsort((ids[run], hashes))
    new = np.ones(len(order), bool)
    new[1:] = hashes[order[1:]] != hashes[order[:-1]]
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(order)))
    smallest = np.repeat(ids[run[order[begin]]], size)
    lost = np.zeros(len(order), bool)
    lost[order] = ids[run[order]] > smallest
    # Equal hashes are checked on the bytes, each window against its group's first.
    checked = np.flatnonzero(ids[run[order]] > smallest)
    head = np.repeat(begin, size)[checked]
    a, b = words.starts[first[order[checked]]], words.ends[first[order[checked]] + window - 1]
    c, d = words.starts[first[order[head]]], words.ends[first[order[head]] + window - 1]
    same = [text[w:x] == text[y:z] for w, x, y, z in zip(a.tolist(), b.tolist(), c.tolist(), d.tolist(), strict=True)]
    if not all(same):
        _by_bytes(text, words, first, ids[run], order, begin, size, lost, window)
    # Neighbouring lost windows of one run make one span.
    opens = lost.copy()
    opens[1:] &= ~lost[:-1] | (run[1:] != run[:-1])
    closes = lost.copy()
    closes[:-1] &= ~lost[1:] | (run[1:] != run[:-1])
    o, c = np.flatnonzero(opens), np.flatnonzero(closes)
    within = np.arange(len(first)) - np.repeat(np.cumsum(counts) - counts, counts)
    return _spans(ids[run[o]], keys[run[o]], pos[run[o]] + within[o], pos[run[c]] + within[c] + window)


def _by_bytes(text, words, first, ids, order, begin, size, lost, window) -> None:
    """Decide groups in which different windows share a hash by the words themselves."""
    for at, n in zip(begin.tolist(), size.tolist(), strict=True):
        if n > 1:
            least: dict[bytes, int] = {}
            own = order[at : at + n]
            cut = [text[words.starts[first[i]] : words.ends[first[i] + window - 1]] for i in own]
            for i, t in zip(own, cut, strict=True):
                least[t] = min(ids[i], least.get(t, ids[i]))
            lost[own] = [ids[i] > least[t] for i, t in zip(own, cut, strict=True)]


def _receive(window: int):
    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for batch in batches:
            for b, payload in zip(batch.column("bucket").to_pylist(), batch.column("payload"), strict=True):
                if b < 0:
                    ids, keys, pos, counts, _ = _unpack(payload.as_py())
                    yield _spans(ids, keys, pos, pos + counts + window - 1)
                    continue
                if b != bucket and held:
                    yield _sort_bucket(held, window)
                    held = []
                bucket = b
                held.append(payload.as_py())
        if held:
            yield _sort_bucket(held, window)

    return receive


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in wh.slices(batch, "text"):
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                words = text.encode().split()  # at exactly the bytes 0x20 and 0x09-0x0D
                n_words.append(len(words))
                if spans:
                    stay, at = [], 0
                    for s in sorted((x["start"], x["stop"]) for x in spans):
                        stay += words[at : s[0]]
                        at = max(at, s[1])
                    words = stay + words[at:]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                ["id", "n_words", "n_removed", "kept_text"],
            )


def repeated_spans(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """``rows``: id (bigint, not NULL), row_key, text. Word spans (start, stop) to remove; they may overlap."""
    width = shuffle_width(rows.sparkSession)
    packed = rows.mapInArrow(_send(window, width * BUCKETS_PER_PARTITION), PACKED)
    dealt = packed.repartition(width, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(_receive(window), SPANS)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """id, n_words, n_removed and kept_text (the words left, joined by one space), one row per input row.

    A word goes if a window of ``window`` words over it also starts in a row with a smaller id; all
    windows are judged on the input. NULL, empty and blank texts have no words. Rows with a NULL id
    stand outside the order: they neither lose words nor make others lose any. Rows that repeat an id
    are equals, so they do not remove from each other, and each is judged by its own text. Other
    columns are not read; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text_or_empty(text_col).alias("text"))
    rows = rows.withColumn("row_key", F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF)))
    spans = repeated_spans(rows.where("id IS NOT NULL"), window)
    spans = materialize(spans.groupBy("id", "row_key").agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "spans")
    cut = rows.join(spans, ["id", "row_key"], "left").select("id", "text", "spans")
    out = cut.mapInArrow(_cut, "id bigint, n_words bigint, n_removed bigint, kept_text string")
    return out.withColumnRenamed("id", id_col)
