"""Benchmark decontamination by edit distance.

The CGK embedding reads a string with a random walk: at step j it puts out the
symbol under its pointer and moves on or stays, by a random bit of that step
and symbol. Strings at a small edit distance get embeddings at a small Hamming
distance, as walks that an edit has parted meet again. Here symbols are words.
Samples of a few embedding positions are the keys of several hash tables. A
walk starts at every second word of a text and at every word of an item, so a
passage with edits is tried once for each alignment, walk and table, and one
agreement is enough. Walks are too long for items of a few words: these are cut
into one piece more than the edits that they may have, so that some piece is
found as it is, from every word of a text on. Each candidate is then checked by exact edit distance of
the whole item to the best passage of the text around it.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm.common import mix64, prepare
from lamella.llm.ngram_jaccard import WordHashes

#: ASCII letters in lower case, digits, and all bytes of other characters; everything else parts words.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Most independent walks; tables of each as (steps, positions sampled); words from one start in a text to the next.
MOST_WALKS, TABLES, STRIDE = 8, ((14, 4), (18, 5), (24, 6)), 2
STEPS = max(s for s, _ in TABLES)
#: Share of planted items that the tables of one walk find at least (15 words with 3 edits, where it is least).
ONE_WALK = 0.7
_SEEDS = mix64(np.arange(701, 701 + MOST_WALKS, dtype=np.uint64))
_ODD = mix64(np.arange(801, 833, dtype=np.uint64)) | np.uint64(1)
_FILTER_BITS = 20
#: Items of fewer words are searched by pieces, which finds all of them, and not by walks.
SHORT = 15


def words_for_edit(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_WORDS).split() if text else []


def sampled_steps() -> list[list[tuple[int, ...]]]:
    """For each walk and table, the sampled steps; drawn once from a fixed seed, the same on every machine.

    One is drawn from each of equal stretches, as a walk stands still at every
    second step and neighbouring positions often hold the same word.
    """
    rng = np.random.default_rng(20240229)
    return [[tuple(int(steps * (i + 0.2 + 0.6 * rng.random()) / k) for i in range(k)) for steps, k in TABLES] for _ in range(MOST_WALKS)]


SAMPLES = sampled_steps()


def walks_for(recall: float) -> int:
    """Independent walks after which an item has been missed by all with a chance of 1 - ``recall`` at most."""
    return max(1, min(MOST_WALKS, math.ceil(math.log(max(1 - recall, 1e-9)) / math.log(1 - ONE_WALK) - 1e-9)))


def walk_keys(symbols: np.ndarray, starts: np.ndarray, walk: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per table, the key of every start and the last place that it read.

    ``symbols`` must go on for STEPS places after the last start.
    """
    bits = mix64(symbols ^ _SEEDS[walk])
    at = starts.copy()
    keys = [np.zeros(len(starts), np.uint64) for _ in TABLES]
    last = [starts] * len(TABLES)
    for j in range(STEPS):
        users = [t for t, s in enumerate(SAMPLES[walk]) if j in s]
        if users:
            read = symbols[at]
            for t in users:
                keys[t] = keys[t] * _ODD[t] + read
                if j == SAMPLES[walk][t][-1]:
                    last[t] = at.copy()
        at += (bits[at] >> np.uint64(j) & np.uint64(1)).astype(at.dtype)
    return [mix64(k + _ODD[t + 8]) for t, k in enumerate(keys)], last


def window_keys(symbols: np.ndarray, starts: np.ndarray, widths: Sequence[int]) -> dict[int, np.ndarray]:
    """For each width, the key of so many words from every start on; SHORT places must follow the last start."""
    keys, key = {}, np.zeros(len(starts), np.uint64)
    for j in range(max(widths, default=0)):
        key = mix64(key * _ODD[16] + symbols[starts + j])
        if j + 1 in widths:
            keys[j + 1] = key
    return keys


def best_passage(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Least edit distance of the item to any stretch of the passage, and where that stretch ends."""
    ramp = np.arange(len(passage) + 1)
    row = np.zeros(len(passage) + 1, np.int64)
    for i, w in enumerate(item):
        step = row + 1
        np.minimum(step[1:], row[:-1] + (passage != w), out=step[1:])
        step[0] = i + 1
        row = np.minimum.accumulate(step - ramp) + ramp
    end = int(row.argmin())
    return int(row[end]), end


class ItemIndex:
    """Keys of all walk starts of a bounded set of items, and of the pieces of the short ones."""

    def __init__(self, ids: Sequence, words: Sequence[np.ndarray], percent: int = 80, least_words: int = 6, recall: float = 0.9) -> None:
        self.walks = walks_for(recall)
        self.ids, self.words = list(ids), list(words)
        #: Most edits of each item; none where it has fewer than ``least_words`` words.
        self.slack = np.array([len(w) * (100 - percent) // 100 if len(w) >= least_words else 0 for w in words], np.int64)
        self.pieces = self._pieces()
        gap = np.zeros(STEPS + 1, np.uint64)
        symbols = np.concatenate([x for w in words for x in (w, gap)] or [gap])
        sizes = np.array([len(w) for w in words], np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes + len(gap))])[:-1]
        item = np.repeat(np.arange(len(sizes)), sizes)
        offset = np.arange(len(item)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        walks = sizes[item] >= SHORT
        item, offset = item[walks], offset[walks]
        starts = begin[item] + offset
        self.tables = []
        for walk in range(self.walks):
            keys, last = walk_keys(symbols, starts, walk)
            for k, end in zip(keys, last, strict=True):
                inside = end < (begin + sizes)[item]
                order = np.argsort(k[inside], kind="stable")
                sorted_keys = k[inside][order]
                seen = np.zeros(1 << _FILTER_BITS, bool)
                seen[sorted_keys >> np.uint64(64 - _FILTER_BITS)] = True
                self.tables.append((sorted_keys, item[inside][order], offset[inside][order], seen))

    def _pieces(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By width, the table of all pieces of short items: an item of k edits at most has k + 1 of them."""
        rows: dict[int, list[tuple[int, int, int]]] = {}
        for i, w in enumerate(self.words):
            if 0 < len(w) < SHORT:
                parts = min(int(self.slack[i]) + 1, len(w))
                cuts = [len(w) * p // parts for p in range(parts + 1)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    rows.setdefault(b - a, []).append((int(window_keys(w[a:b], np.zeros(1, np.int64), [b - a])[b - a][0]), i, a))
        tables = {}
        for width, found in rows.items():
            found.sort()
            known = np.array([x[0] for x in found], np.uint64)
            seen = np.zeros(1 << _FILTER_BITS, bool)
            seen[known >> np.uint64(64 - _FILTER_BITS)] = True
            tables[width] = (known, *(np.array([x[c] for x in found], np.int64) for c in (1, 2)), seen)
        return tables

    def candidates(self, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Rows (item, place of its first word in ``symbols``) that some walk's table agrees on."""
        found = [np.empty((0, 2), np.int64)]
        for walk in range(self.walks):
            keys, _ = walk_keys(symbols, starts, walk)
            found += [_agreeing(self.tables[walk * len(TABLES) + t], k, starts) for t, k in enumerate(keys)]
        return np.concatenate(found)

    def short_candidates(self, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The same by pieces of short items."""
        keys = window_keys(symbols, starts, list(self.pieces))
        return np.concatenate([np.empty((0, 2), np.int64), *(_agreeing(self.pieces[width], k, starts) for width, k in keys.items())])


def _agreeing(table: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], k: np.ndarray, starts: np.ndarray) -> np.ndarray:
    known, item, offset, seen = table
    maybe = np.flatnonzero(seen[k >> np.uint64(64 - _FILTER_BITS)])
    lo, hi = np.searchsorted(known, k[maybe], "left"), np.searchsorted(known, k[maybe], "right")
    times = hi - lo
    which = np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    return np.column_stack([item[which], np.repeat(starts[maybe], times) - offset[which]])


def scan(texts: Sequence[str | None], index: ItemIndex, hashes: WordHashes) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, first word, end word, distance): the best passage of each text and item that are close enough."""
    gap = np.zeros(STEPS + 1, np.uint64)
    docs = [np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w)) for w in map(words_for_edit, texts)]
    symbols = np.concatenate([x for d in docs for x in (d, gap)] or [gap])
    sizes = np.array([len(d) for d in docs], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes + len(gap))])[:-1]
    starts = np.concatenate([np.arange(b, b + n, STRIDE) for b, n in zip(begin, sizes, strict=True)] or [np.empty(0, np.int64)])
    # Pieces of the starts that stay in the processor's cache while they walk.
    parts = [index.candidates(symbols, starts[i : i + (1 << 17)]) for i in range(0, len(starts), 1 << 17)]
    if index.pieces and len(starts):
        every = np.concatenate([np.arange(b, b + n) for b, n in zip(begin, sizes, strict=True)])
        parts += [index.short_candidates(symbols, every[i : i + (1 << 17)]) for i in range(0, len(every), 1 << 17)]
    if not parts or not (cand := np.concatenate(parts)).size:
        return
    slack = index.slack
    # The first word may be before the text's start by as many words as can be missing.
    text = np.searchsorted(begin, cand[:, 1] + slack[cand[:, 0]], "right") - 1
    order = np.lexsort((cand[:, 1], cand[:, 0], text))
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    done: tuple[int, int, int] | None = None
    for d, i, at in zip(text[order].tolist(), cand[order, 0].tolist(), cand[order, 1].tolist(), strict=True):
        most, item = int(slack[i]), index.words[i]
        # A candidate within the slack of the one before has the same stretch of text, which is searched once.
        if done is not None and done[:2] == (d, i) and at - done[2] <= max(1, most // 2):
            continue
        # Nothing is closer than an exact copy.
        if best.get((d, i), (1,))[0] == 0:
            continue
        done = (d, i, at)
        a = max(int(begin[d]), at - 2 * most - 2)
        passage = symbols[a : min(int(begin[d] + sizes[d]), at + len(item) + 2 * most + 2)]
        # Every word of the item without an equal in the passage costs an edit.
        if np.isin(item, passage).sum() < len(item) - most:
            continue
        distance, end = best_passage(item, passage)
        if distance <= most and (d, i) not in best or distance < best.get((d, i), (0,))[0]:
            back, length = best_passage(item[::-1], passage[:end][::-1])
            best[d, i] = (distance, a - int(begin[d]) + end - length, a - int(begin[d]) + end)
    for (d, i), (distance, first, end) in best.items():
        yield d, i, first, end, distance


def _indexes(wanted: DataFrame, percent: int, least_words: int, most_words: int, recall: float) -> Iterator[tuple[Broadcast, pa.DataType]]:
    """Broadcast indexes of about ``most_words`` words each, and the items' Arrow type."""
    size = wanted.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    passes = max(1, -(-size // (5 * most_words)))
    for k in range(passes):
        part = wanted.filter(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == k).toArrow()
        hashes = WordHashes()
        pairs = [(i, np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w))) for i, t in zip(part.column("item").to_pylist(), part.column("text").to_pylist(), strict=True) if (w := words_for_edit(t))]
        index = ItemIndex([i for i, _ in pairs], [w for _, w in pairs], percent, least_words, recall)
        yield wanted.sparkSession.sparkContext.broadcast(index), part.column("item").type


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    percent: int = 80,
    least_words: int = 6,
    most_words: int = 1_000_000,
    recall: float = 0.9,
) -> DataFrame:
    """(id, item, first_word, end_word, distance, item_words) of each document and benchmark item that it holds.

    A document holds an item if some stretch of its words is within
    (100 - ``percent``) % of the item's words by edit distance; words are
    compared without case and punctuation. Of several stretches, the closest
    is named. Items of fewer than ``least_words`` words are held by documents
    with an exact copy only, so an item of one word by all that have the word;
    null and empty texts hold nothing and items without words aren't searched. The items
    are searched in as many passes over the documents as keep each pass's
    index to about ``most_words`` words, of 150 bytes each, so what is broadcast
    doesn't grow with the benchmark. ``recall`` is the share of held items to
    be found (see ``walks_for``); short items are all found. Repeated rows give repeated results; items with equal
    texts are each named.
    """
    spark: SparkSession = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    wanted = items.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("text")).filter("text is not null")
    id_type, item_type = rows.schema["id"].dataType.simpleString(), wanted.schema["item"].dataType.simpleString()
    found = None
    for index, arrow in _indexes(wanted, percent, least_words, most_words, recall):

        def run(batches: Iterable[pa.RecordBatch], index=index, arrow=arrow) -> Iterator[pa.RecordBatch]:
            known, names = WordHashes(), ["id", "item", "first_word", "end_word", "distance", "item_words"]
            for batch in batches:
                hits = list(scan(batch.column("text").to_pylist(), index.value, known))
                ids = batch.column("id").take(pa.array([h[0] for h in hits], pa.int64()))
                which = [h[1] for h in hits]
                numbers = [pa.array([h[c] for h in hits], pa.int32()) for c in (2, 3, 4)]
                sizes = pa.array([len(index.value.words[i]) for i in which], pa.int32())
                yield pa.RecordBatch.from_arrays([ids, pa.array([index.value.ids[i] for i in which], arrow), *numbers, sizes], names)

        one = rows.mapInArrow(run, f"id {id_type}, item {item_type}, first_word int, end_word int, distance int, item_words int")
        found = one if found is None else found.unionByName(one)
    return found.withColumnsRenamed({"id": id_col, "item": item_col})


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    percent: int = 80,
    least_words: int = 6,
    most_words: int = 1_000_000,
    recall: float = 0.9,
) -> DataFrame:
    """The rows of ``docs`` whose texts hold no benchmark item (see ``contaminated``), with all columns.

    Each row is judged by its own text, in the task that reads it: nothing is shuffled.
    """
    prepare(docs.sparkSession)
    wanted = items.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("text")).filter("text is not null")
    kept = docs
    for index, _ in _indexes(wanted, percent, least_words, most_words, recall):

        def clean(batches: Iterable[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            known = WordHashes()
            for batch in batches:
                mask = np.ones(batch.num_rows, bool)
                mask[[h[0] for h in scan(batch.column(text_col).to_pylist(), index.value, known)]] = False
                yield batch.filter(pa.array(mask))

        kept = kept.mapInArrow(clean, docs.schema)
    return kept


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items, word edit similarity of 80 % or more."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs, items)
