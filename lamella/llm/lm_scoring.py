"""Language-model scoring with a weighted backoff automaton.

The model is a smoothed n-gram model over words and one end mark. Its states
are the n-grams seen in training up to order - 1 words, the empty one included.
A state has an arc for each word seen after it, weighted with the word's
smoothed probability there, and a failure arc to the state without its first
word, weighted with the mass left for words not seen. A text is scored in one
pass from left to right: the state is carried along, each word follows an arc
or, failing that, failure arcs to a shorter state, and weights are added up.

The corpus is read as packed blocks of documents. Each block asks for the
n-grams that it holds, shards of the n-gram space count them over the whole
corpus, and each block gets back the part of the automaton that its texts can
reach. So no task holds the model, and what is gathered grows with the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm.common import lower_words_of, materialise, mix64, parts_for, prepare
from lamella.llm.packed import pack_sorted, shard_slices, unpack_sorted

#: Bytes of text in one block (a longer text is a block of its own), and bytes of stored blocks per shard.
BLOCK_BYTES, SHARD_BYTES = 6 << 20, 8 << 20
#: Stored blocks of a row group, and n-grams that a shard counts at once.
GROUP_ROWS, COUNTED = 2, 1 << 19
#: Blocks that a task walks, one after the other.
BLOCKS_A_TASK = 2
_ODD = mix64(np.arange(101, 133, dtype=np.uint64)) | np.uint64(1)
END, START = 1, 2  # ids of the marks in a block; words follow
DISCOUNT = 0.75


class Block:
    """Tokens of a block's documents, and its distinct n-grams of each order as sorted 64-bit keys."""

    def __init__(self, texts: list[bytes], held_out: np.ndarray, order: int) -> None:
        known: dict[bytes, int] = {}
        words = [lower_words_of(t.decode("utf-8", "surrogatepass")) for t in texts]
        self.lengths = np.array([len(w) + 1 for w in words], np.int64)
        total = int(self.lengths.sum())
        ids = np.empty(total, np.int64)
        at = 0
        for w in words:
            ids[at : at + len(w)] = np.fromiter((known.setdefault(x, len(known) + 3) for x in w), np.int64, len(w))
            at += len(w) + 1
            ids[at - 1] = END
        names = np.zeros(len(known) + 3, np.uint64)
        names[END], names[START] = 0x9AD1, 0x57A7
        names[3:] = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in known), np.uint64, len(known))
        self.training = np.repeat(~held_out, self.lengths)
        self.ends = np.cumsum(self.lengths)
        self.ids, self.names = ids, names
        word = names[ids]
        self.place = place = np.arange(total) - np.repeat(self.ends - self.lengths, self.lengths)
        #: For each order: the distinct keys, each token's n-gram among them, a token that each ends at, and training counts.
        self.keys: list[np.ndarray] = []
        self.at: list[np.ndarray] = []
        self.first: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        key = mix64(word * _ODD[0])
        for n in range(1, order + 1):
            if n > 1:
                # The word n - 1 places back; before a text's start, start marks.
                back = np.where(place >= n - 1, np.roll(word, n - 1), names[START])
                key = mix64(key + back * _ODD[n])
            distinct, first, at_key = np.unique(key, return_index=True, return_inverse=True)
            self.keys.append(distinct)
            self.at.append(at_key)
            self.first.append(first)
            self.counts.append(np.bincount(at_key[self.training], minlength=len(distinct)))


def _blocks(docs: DataFrame) -> DataFrame:
    """Documents packed into rows of about BLOCK_BYTES of text; a row never spans tasks."""

    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def row() -> pa.RecordBatch:
            ids = pa.array([x[0] for x in held], type=id_arrow)
            flags = pa.array([x[1] for x in held], pa.bool_())
            texts = pa.array([x[2] for x in held], pa.binary())
            offsets = pa.array([0, len(held)], pa.int32())
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, c) for c in (ids, flags, texts)], ["ids", "held_out", "texts"])

        for batch in batches:
            id_arrow = batch.column("id").type
            for i, flag, text in zip(batch.column("id").to_pylist(), batch.column("held_out").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass") if text else b""
                if held and size + len(raw) > BLOCK_BYTES:
                    yield row()
                    held, size = [], 0
                held.append((i, flag, raw))
                size += len(raw)
        if held:
            yield row()

    packed = docs.mapInArrow(run, f"ids array<{id_type}>, held_out array<boolean>, texts array<binary>")
    return packed.withColumn("block", F.monotonically_increasing_id())


def _asked(blocks: DataFrame, order: int, shards: int) -> DataFrame:
    """Rows (block, shard, order, keys, counts): a block's n-grams with their training counts in it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row["texts"], np.array(row["held_out"], bool), order)
                rows = [
                    (row["block"], shard, n + 1, pack_sorted(b.keys[n][i:j]), b.counts[n][i:j].astype(np.uint32).tobytes())
                    for n in range(order)
                    for shard, i, j in shard_slices(b.keys[n], shards)
                ]
                types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["block", "shard", "n", "keys", "counts"])

    return blocks.select("block", "held_out", "texts").mapInArrow(run, "block long, shard int, n int, keys binary, counts binary")


def corpus_counts(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[tuple[np.ndarray, np.ndarray]], int, int]:
    """For each array of sorted keys, what all arrays count of them; and all training tokens and kinds of n-grams.

    Most counts are small: a byte each, and those of 255 and more after them.
    About COUNTED keys are taken at once, a range of the key space after the
    other, so that what is held besides the keys doesn't grow with their number.
    """
    total = sum(map(len, keys))
    if not total:
        return [(np.empty(0, np.uint8), np.empty(0, np.int64)) for _ in keys], 0, 0
    low, high = (int(f(int(k[i]) for k in keys if len(k))) for f, i in ((min, 0), (max, -1)))
    pieces = -(-total // COUNTED)
    borders = np.array([low + (high - low) * i // pieces for i in range(1, pieces)], np.uint64)
    cuts = [[0, *np.searchsorted(k, borders).tolist(), len(k)] for k in keys]
    small, large = [np.empty(len(k), np.uint8) for k in keys], [[np.empty(0, np.int64)] for _ in keys]
    tokens = kinds = 0
    for i in range(pieces):
        distinct, at = np.unique(np.concatenate([k[c[i] : c[i + 1]] for k, c in zip(keys, cuts, strict=True)]), return_inverse=True)
        times = np.bincount(at, weights=np.concatenate([x[c[i] : c[i + 1]] for x, c in zip(counts, cuts, strict=True)]), minlength=len(distinct)).astype(np.int64)
        tokens, kinds = tokens + int(times.sum()), kinds + int((times > 0).sum())
        given, begin = times[at], 0
        for s, rest, c in zip(small, large, cuts, strict=True):
            part = given[begin : (begin := begin + c[i + 1] - c[i])]
            s[c[i] : c[i + 1]] = np.minimum(part, 255)
            rest.append(part[part >= 255])
    return [(s, np.concatenate(rest)) for s, rest in zip(small, large, strict=True)], tokens, kinds


def _answered(asked: DataFrame, order: int, shards: int) -> DataFrame:
    """Rows (block, shard, n, counts, tokens, kinds): corpus counts in the order asked for.

    ``tokens`` and ``kinds`` are the training tokens and distinct n-grams of the
    shard, given once per shard and order.
    """

    def count(key: tuple, table: pa.Table) -> pa.Table:
        views = [[np.frombuffer(x.as_buffer(), np.uint8) for x in table.column(c)] for c in ("keys", "counts")]
        given, tokens, kinds = corpus_counts([unpack_sorted(x) for x in views[0]], [x.view(np.uint32) for x in views[1]])
        first = np.arange(len(given)) == 0
        columns = [*(table.column(c) for c in ("block", "shard", "n")), *([x.tobytes() for x in c] for c in zip(*given, strict=True)), first * tokens, first * kinds]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        names = ["block", "shard", "n", "small", "large", "tokens", "kinds"]
        return pa.table({k: c if isinstance(c, pa.ChunkedArray) else pa.array(c, t) for k, c, t in zip(names, columns, types, strict=True)})

    # As many tasks as shards, so that a task's part doesn't grow with the corpus.
    return asked.repartition(order * shards, "n", "shard").groupBy("n", "shard").applyInArrow(count, "block long, shard int, n int, small binary, large binary, tokens long, kinds long")


class Automaton:
    """The part of the weighted backoff automaton that a block's texts can reach.

    State 0 is the empty context, ``base[m] + i`` the block's i-th distinct
    n-gram of m words and ``base[m]`` itself the context of m start marks (so
    n-grams begin at ``base[m] + 1``). Only n-grams seen in training are
    entered. An arc is found by state and word; where there is none, the
    state's failure arc leads to the context without its first word. The empty
    state takes words without an arc by one of their own, with the mass of all
    unseen words.
    """

    def __init__(self, block: Block, counts: list[np.ndarray], tokens: int, kinds: int, starts: int, strength: tuple[float, ...]) -> None:
        order = len(counts)
        base = np.cumsum([1, *(len(k) + 1 for k in block.keys[: order - 1])])  # base[m - 1]: contexts of m words
        self.start = int(base[order - 2]) if order > 1 else 0
        self.failure = np.zeros(base[-1] if order > 1 else 1, np.int64)
        self.penalty = np.zeros(len(self.failure))
        self.words = len(block.names)
        self.unseen = math.log10(DISCOUNT * kinds / tokens) if tokens else 0.0
        keys, weights, targets = [], [], []
        shorter = np.empty(0)  # smoothed probabilities of the block's n-grams one word shorter
        for n in range(1, order + 1):
            seen, at, first = counts[n - 1], block.at[n - 1], block.first[n - 1]
            if n == 1:
                state = np.zeros(len(seen), np.int64)
                p = np.where(seen > 0, (seen - DISCOUNT) / max(tokens, 1), DISCOUNT * kinds / tokens if tokens else 1.0)
            else:
                mu, before = strength[n - 2], block.at[n - 2]
                context = np.where(block.place[first] > 0, before[first - 1] + 1, 0)
                state = base[n - 2] + context
                times = np.append(starts, counts[n - 2])[context] if len(first) else np.empty(0)
                p = (seen + mu * shorter[before[first]]) / (times + mu)
                # The contexts of n - 1 words: their failure arcs, whose weight is the mass left for words not seen there.
                own = np.append(starts, counts[n - 2])
                self.penalty[base[n - 2] : base[n - 2] + len(own)] = np.log10(mu / (own + mu))
                if n > 2:
                    back = block.at[n - 3][block.first[n - 2]]
                    self.failure[base[n - 2] : base[n - 2] + len(own)] = base[n - 3] + np.append(0, back + 1)
            arcs = np.flatnonzero(seen > 0)
            keys.append(state[arcs] * self.words + block.ids[first[arcs]])
            weights.append(np.log10(p[arcs]))
            # On from there with the n-gram itself as context, or with its last order - 1 words.
            m = min(n, order - 1)
            targets.append(base[m - 1] + 1 + block.at[m - 1][first[arcs]] if m else np.zeros(len(arcs), np.int64))
            shorter = p
        sort = np.argsort(np.concatenate(keys), kind="stable")
        self.keys, self.weights, self.targets = (np.concatenate(x)[sort] for x in (keys, weights, targets))

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From each state by each word: log10 of the probability, and the state reached."""
        gained, reached = np.zeros(len(state)), np.zeros(len(state), np.int64)
        left = np.arange(len(state))
        while len(left):
            key = state * self.words + word
            at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
            hit = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
            gained[left[hit]] += self.weights[at[hit]]
            reached[left[hit]] = self.targets[at[hit]]
            lost = ~hit & (state == 0)
            gained[left[lost]] += self.unseen
            on = ~hit & ~lost
            left, state, word = left[on], state[on], word[on]
            gained[left] += self.penalty[state]
            state = self.failure[state]
        return gained, reached

    def walk(self, block: Block) -> np.ndarray:
        """log10 probability of each text: all texts are read from left to right in step, each with its own state."""
        longest = np.argsort(-block.lengths, kind="stable")
        lengths, begin = block.lengths[longest], (block.ends - block.lengths)[longest]
        state, total = np.full(len(longest), self.start, np.int64), np.zeros(len(longest))
        reading = len(lengths)
        for t in range(int(lengths[0]) if reading else 0):
            while lengths[reading - 1] <= t:
                reading -= 1
            gained, state = self.step(state[:reading], block.ids[begin[:reading] + t])
            total[:reading] += gained
        out = np.empty(len(total))
        out[longest] = total
        return out


def score_block(block: Block, counts: list[np.ndarray], tokens: int, kinds: int, starts: int, strength: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document: known tokens, base score and model score."""
    seen = counts[0][block.at[0]]
    base = np.log10((seen + 1.0) / (tokens + kinds + 1.0))
    known, plain = (np.add.reduceat(x, block.ends - block.lengths) for x in ((seen > 0).astype(np.int64), base))
    return known, plain, Automaton(block, counts, tokens, kinds, starts, strength).walk(block)


def score(
    docs: DataFrame,
    held_out: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = 2,
    strength: tuple[float, ...] = (60.0, 20.0, 10.0),
) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    The model learns from the rows where ``held_out`` is false. Order n states
    are smoothed towards order n - 1 with a Dirichlet prior of weight
    ``strength[n - 2]``; the empty state is discounted, and its mass for
    unseen words is that of one more word, as in the base score. A null text
    is an empty one: just an end mark. Without training rows every score is
    that of a model that knows nothing (0 for the model, as all mass is on
    the unseen). Repeated rows count and are scored each by itself; null ids
    are kept.
    """
    spark: SparkSession = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(True)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    blocks = materialise(_blocks(rows), "lm-blocks", GROUP_ROWS)
    shards = parts_for(blocks, SHARD_BYTES, least=24)
    answers = materialise(_answered(_asked(blocks, order, shards), order, shards), "lm-counts")
    totals = answers.filter("n = 1").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    tokens, kinds = int(totals[0]), int(totals[1])
    starts, n_blocks = blocks.agg(F.coalesce(F.sum(F.size(F.filter("held_out", lambda x: ~x))), F.lit(0)), F.count("*")).first()
    tasks = max(8, -(-n_blocks // BLOCKS_A_TASK))
    id_type = rows.schema["id"].dataType.simpleString()

    def walk(table: pa.Table, given: pa.Table) -> pa.Table:
        parts: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(order)]
        for r in given.to_pylist():
            c = np.frombuffer(r["small"], np.uint8).astype(np.int64)
            c[c == 255] = np.frombuffer(r["large"], np.int64)
            parts[r["n"] - 1].append((r["shard"], c))
        counts = [np.concatenate([c for _, c in sorted(p, key=lambda x: x[0])]) for p in parts]
        flags = np.array(table.column("held_out")[0].as_py(), bool)
        block = Block(table.column("texts")[0].as_py(), flags, order)
        known, base, model = score_block(block, counts, tokens, kinds, starts, strength)
        ids = table.column("ids").chunk(0).flatten()
        n = len(flags)
        columns = [ids, flags, block.lengths, known, np.full(n, tokens), base, model]
        return pa.table({k: pa.array(c) for k, c in zip(["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"], columns, strict=True)})

    walked = blocks.repartition(tasks, "block").groupBy("block").cogroup(answers.repartition(tasks, "block").groupBy("block"))
    out = walked.applyInArrow(walk, f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by a word bigram automaton, every seventh (by crc32 of the id) held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2)


ORACLE_SQL = r"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t
), texts AS (
  SELECT doc_id, row_number() OVER () AS r,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                         lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 7 = 2 AS held_out,
         list_append(list_transform(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), lambda x: 'w' || x), 'end') AS w
  FROM documents, crc_table
), tokens AS (
  SELECT r, held_out, i, w[i] AS w, CASE WHEN i = 1 THEN 'start' ELSE w[i - 1] END AS b FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM texts)
), one AS (SELECT w, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY w),
two AS (SELECT b, w, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY b, w),
facts AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM one),
contexts AS (SELECT b, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY b),
weighed AS (
  SELECT t.r, o.c IS NOT NULL AS known, log10((coalesce(o.c, 0) + 1) / (n + v + 1)) AS base,
         log10((coalesce(x.c, 0) + 60 * CASE WHEN o.c IS NULL THEN 0.75::DOUBLE * v / n ELSE (o.c - 0.75::DOUBLE) / n END) / (coalesce(k.c, 0) + 60)) AS score
  FROM tokens t CROSS JOIN facts LEFT JOIN one o ON o.w = t.w LEFT JOIN two x ON x.b = t.b AND x.w = t.w LEFT JOIN contexts k ON k.b = t.b
)
SELECT doc_id, any_value(s.held_out) AS held_out, count(*) AS n_tokens, count(*) FILTER (WHERE known) AS n_known, any_value(n) AS train_tokens,
       sum(base) AS base_score, sum(score) AS score
FROM weighed JOIN texts s USING (r) CROSS JOIN facts GROUP BY r, doc_id
"""
