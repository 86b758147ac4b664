"""Substring dedup (4): sliding sentence spans.

A text is cut into sentences at ``. ! ?`` before white space, at full-width stops
and at line ends. One longer than ``max_words`` counts as several, cut after the
word of the smallest checksum in every window of ``cut_within`` words: no more
than that many words lie between cuts, and a passage is cut alike wherever it
stands, but for a window at its ends. Where a script writes no spaces between
words (Han, Kana, Thai, Lao) each character is a unit that counts as half a word.
From every sentence starts one span, the shortest run of at least ``run``
sentences and ``min_words`` words. Its 128-bit hash is two polynomials
over the hashes of its sentences (lower-cased words), so all spans of a text
come from two running sums.

Spans are joined on the hash over all documents. The occurrence with the
smallest (doc_id, place) is the first; sentences covered by any other occurrence
go. Each task first settles its own repeats: what is not the first there cannot
be the first anywhere, and goes on under a key of its own. So a passage that a
third of all documents share is one entry a task and chunk when the spans are
sorted by hash, once, and neighbours are compared.

Defined results: null text counts as empty; a text shorter than a span keeps all
its sentences; a kept sentence keeps the white space that follows it; rows that
repeat id and text count as one document and all get its result; other rows of
one id, or of none, are told apart by a 64-bit hash of id and text; a null id
orders after all others; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import row_keys

RUN = 3
MIN_WORDS = 15
MAX_WORDS = 12
CUT_WITHIN = 11  # cuts lie as close as (this + 1) / 2 on average
ROWS_AT_ONCE = 1 << 19
NO_ID = (1 << 63) - 1
LENGTH_BITS = 8  # a place packs sentence number and the span's length

BOUNDARY = re.compile(rb"(?:[.!?](?=[\x09-\x0d\x20])|\n|\xe3\x80\x82|\xef\xbc[\x81\x9f])[\x09-\x0d\x20]*")
# UTF-8 of U+3000-U+9FFF and U+0E00-U+0EFF
UNSPACED = re.compile(rb"[\xe3-\xe9][\x80-\xbf]{2}|\xe0[\xb8-\xbb][\x80-\xbf]")
UNIT = re.compile(rb"(?:[\xe3-\xe9][\x80-\xbf]{2}|\xe0[\xb8-\xbb][\x80-\xbf]|(?:(?!\xe0[\xb8-\xbb])[^\x09-\x0d\x20\xe3-\xe9])+)[\x09-\x0d\x20]*")
WORD = re.compile(rb"[^\x09-\x0d\x20]+[\x09-\x0d\x20]*")
BASES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)  # odd, so they have inverses modulo 2**64
INVERSES = np.array([pow(int(b), -1, 1 << 64) for b in BASES], dtype=np.uint64)

_POWERS: list[np.ndarray] = []


def _cuts(sizes: list[int], checksums: list[int], within: int) -> np.ndarray:
    """Which words of long sentences (their checksums, end to end) are cut after: the least of every window inside a sentence."""
    c = np.array(checksums, dtype=np.int64)
    flags = np.zeros(len(c), dtype=bool)
    if len(c) >= within:
        at = np.arange(len(c) - within + 1)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        inside = owner[at] == owner[at + within - 1]
        flags[(np.lib.stride_tricks.sliding_window_view(c, within).argmin(axis=1) + at)[inside]] = True
        flags[1:] &= (c[1:] != c[:-1]) | (owner[1:] != owner[:-1])  # one word over and over is not cut at each
    return flags


def sentences(text: bytes, max_words: int = MAX_WORDS, cut_within: int = CUT_WITHIN) -> tuple[list[int], list[list[bytes]]]:
    """(ends, lower-cased words) of the sentences of a UTF-8 text; each ends where the next begins."""
    low = text.lower()
    plain = UNSPACED.search(low) is None
    found: list[list] = []
    start = 0
    for end in [*(m.end() for m in BOUNDARY.finditer(text)), len(text)]:
        own = low[start:end].split() if plain else [w.rstrip() for w in UNIT.findall(low, start, end)]
        if own:
            found.append([start, end, own])
            start = end
        elif found:  # white space only
            found[-1][1] = start = end
    long = [own for _, _, own in found if len(own) > max_words]
    flags = iter(_cuts([len(own) for own in long], [crc32(w) for own in long for w in own], cut_within).tolist())
    ends, words = [], []
    for start, end, own in found:
        if len(own) > max_words:
            first = 0
            for at, m in enumerate((WORD if plain else UNIT).finditer(text, start, end), 1):
                if next(flags) and at < len(own):
                    ends.append(m.end())
                    words.append(own[first:at])
                    first = at
            own = own[first:]
        ends.append(end)
        words.append(own)
    return ends, words


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of both bases and of their inverses, (2, n) each."""
    if not _POWERS or _POWERS[0].shape[1] < n:
        size = max(1024, 1 << n.bit_length())
        out = []
        for b in (BASES, INVERSES):
            p = np.empty((2, size), dtype=np.uint64)
            p[:, 0] = 1
            p[:, 1:] = b[:, None]
            out.append(np.multiply.accumulate(p, axis=1))
        _POWERS[:] = out
    return _POWERS[0][:, :n], _POWERS[1][:, :n]


def spans(words: list[list[bytes]], run: int = RUN, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of sentences, (2, n) hashes) of the spans that start at sentences 0, 1, 2, ..."""
    from xxhash import xxh3_128_digest
    n = len(words)
    whole = [b" ".join(w) for w in words]
    size = [float(len(w)) for w in words]
    if UNSPACED.search(b" ".join(whole)):  # a character without spaces around it is half a word
        size = [k - len(UNSPACED.findall(w)) / 2 for k, w in zip(size, whole, strict=True)]
    upto = np.zeros(n + 1)
    np.cumsum(size, out=upto[1:])
    first = np.arange(n)
    end = np.maximum(first + run, np.searchsorted(upto, upto[:-1] + min_words))
    end = end[end <= n]  # ends rise with their starts
    first = first[:len(end)]
    if not len(end):
        return end, np.empty((2, 0), dtype=np.uint64)
    own = np.frombuffer(b"".join([xxh3_128_digest(w) for w in whole]), dtype="<u8").reshape(-1, 2).T
    power, inverse = _powers(n)
    sums = np.zeros((2, n + 1), dtype=np.uint64)
    np.cumsum(own * power, axis=1, out=sums[:, 1:])
    return end - first, (sums[:, end] - sums[:, first]) * inverse[:, first]


def _settled(h: np.ndarray, doc: np.ndarray, row: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """A chunk of spans as rows: the first of each hash as it is; the others, marked, under keys that spread."""
    by = np.lexsort((row, place, doc, h[1], h[0]))
    h, doc, row, place = h[:, by], doc[by], row[by], place[by]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (h[0, 1:] != h[0, :-1]) | (h[1, 1:] != h[1, :-1])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))
    same = ~new & (doc == doc[lead]) & (row == row[lead]) & (place == place[lead])  # a repeated row's span is the same occurrence
    h1, h2 = np.where(new, h[0], (place + doc + row).astype(np.uint64) * BASES[0]), np.where(new, h[1], np.uint64(0))
    place = np.where(new, place, ~place)
    keep = ~same
    return pa.RecordBatch.from_arrays([pa.array(a[keep].view(np.int64)) for a in (h1, h2, doc, row, place)],
                                      names=["h1", "h2", "doc", "row", "place"])


def _hash_spans(run: int, min_words: int, max_words: int, cut_within: int):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, docs, rows, places, waiting = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            out = _settled(np.concatenate(hashes, axis=1), np.concatenate(docs), np.concatenate(rows), np.concatenate(places))
            hashes.clear(), docs.clear(), rows.clear(), places.clear()
            return out

        for b in batches:
            for doc, row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                n, h = spans(sentences(text.as_py().encode(), max_words, cut_within)[1], run, min_words)
                if len(n):
                    hashes.append(h)
                    docs.append(np.full(len(n), doc))
                    rows.append(np.full(len(n), row))
                    places.append((np.arange(len(n)) << LENGTH_BITS) | n)
                    waiting += len(n)
                if waiting >= ROWS_AT_ONCE:
                    yield flush()
                    waiting = 0
        if waiting:
            yield flush()
    return walk


def _not_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h1, h2, doc, place, row): the occurrences that are not the first of their hash."""
    last = None  # hash and first occurrence of the run that the batch before ended in
    for b in batches:
        h1, h2, doc, row, place = (c.to_numpy() for c in b.columns)
        marked = place < 0
        out_doc, out_row, out_place = [doc[marked]], [row[marked]], [~place[marked]]
        h1, h2, doc, row, place = (a[~marked] for a in (h1, h2, doc, row, place))
        if len(doc):
            if last is not None:
                h1, h2, doc, row, place = (np.insert(a, 0, v) for a, v in zip((h1, h2, doc, row, place), last, strict=True))
            new = np.ones(len(doc), dtype=bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            lead = np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))
            gone = (doc != doc[lead]) | (row != row[lead]) | (place != place[lead])
            out_doc.append(doc[gone])
            out_row.append(row[gone])
            out_place.append(place[gone])
            last = [a[lead[-1]] for a in (h1, h2, doc, row, place)]
        doc, row, place = (np.concatenate(x) for x in (out_doc, out_row, out_place))
        if len(doc):
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc), pa.array(row), pa.array(place >> LENGTH_BITS), pa.array(place & ((1 << LENGTH_BITS) - 1))],
                names=["__doc", "__row", "at", "n"])


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    own = F.col(f"`{id_col}`").cast("bigint")
    return docs.select(own.alias("doc_id"), F.coalesce(own, F.lit(NO_ID)).alias("__doc"), row_keys(id_col, text_col)[0].alias("__row"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, min_words: int = MIN_WORDS,
                   max_words: int = MAX_WORDS, cut_within: int = CUT_WITHIN) -> DataFrame:
    """(__doc, __row, at, n): first sentence and length of every span occurrence that is not the first."""
    if max(run, min_words) >= 1 << LENGTH_BITS:
        raise ValueError(f"run and min_words must be under {1 << LENGTH_BITS}")
    every = _source(docs, id_col, text_col).select("__doc", "__row", "text").mapInArrow(
        _hash_spans(run, min_words, max_words, cut_within), "h1 bigint, h2 bigint, doc bigint, row bigint, place bigint")
    return (every.repartition("h1", "h2").sortWithinPartitions("h1", "h2", "doc", "place", "row")
            .mapInArrow(_not_first, "__doc bigint, __row bigint, at bigint, n bigint"))


def _remove(max_words: int, cut_within: int):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, gone = [], []
            for text, covered in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                drop: set[int] = set()
                for c in covered or ():
                    drop.update(range(c["at"], c["at"] + c["n"]))
                if drop:
                    raw = text.encode()
                    ends, _ = sentences(raw, max_words, cut_within)
                    text = b"".join(raw[a:e] for i, (a, e) in enumerate(zip([0, *ends], ends, strict=False)) if i not in drop).decode()
                texts.append(text)
                gone.append(len(drop))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(gone, pa.int64()), pa.array(texts, pa.string())],
                                             names=["doc_id", "n_removed", "text"])
    return walk


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, min_words: int = MIN_WORDS,
                   max_words: int = MAX_WORDS, cut_within: int = CUT_WITHIN) -> DataFrame:
    """One row per input row: doc_id, n_removed, text without the removed sentences."""
    gone = (repeated_spans(docs, id_col, text_col, run, min_words, max_words, cut_within)
            .groupBy("__doc", "__row").agg(F.collect_set(F.struct("at", "n")).alias("covered")))
    return (_source(docs, id_col, text_col).join(gone, ["__doc", "__row"], "left").select("doc_id", "text", "covered")
            .mapInArrow(_remove(max_words, cut_within), "doc_id bigint, n_removed bigint, text string"))
