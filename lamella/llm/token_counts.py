"""Token counts without token ids.

A tokenizer cuts a text into pre-tokens and encodes each by itself, so a
text's count is the sum of its pre-tokens' counts. Pieces are counted once per
distinct pre-token and joined to the per-document frequencies. Frequent
pre-tokens are joined on the map side from a dictionary of bounded size; all
others go through a shuffled join, so the dictionary's contents change the
plan's cost and never a result.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lamella.llm.common import materialise, prepare

#: Texts of these characters normalise and split alike in the library and in ``regex``: no controls, no
#: combining marks, no letter whose lower case depends on its neighbours.
PLAIN = regex.compile(r"[\t-\r\x20-\x7e\xa0-įı-ɏ]*")


class PreTokens:
    """The pre-tokens of a text and the pieces of a pre-token, as the tokenizer file has them."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        if any(x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"] for x in spec["added_tokens"]):
            raise ValueError("only added tokens that are matched literally are known here")
        names = sorted((x["content"] for x in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.special_marks = names
        self.quick = self._quick_split(spec)

    @staticmethod
    def _quick_split(spec: dict) -> Callable[[str], list[str]] | None:
        """``findall`` on lower-cased text, where the file says just that; else None."""
        norm = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        if norm != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in steps] != ["Split", "ByteLevel"]:
            return None
        split, byte_level = steps
        if not (split["invert"] and split["behavior"] == "Removed" and not byte_level["use_regex"] and not byte_level["add_prefix_space"]):
            return None
        return regex.compile(split["pattern"]["Regex"]).findall

    def count(self, text: str) -> tuple[int, Counter[str]]:
        """Special tokens found in the text, and the frequencies of its pre-tokens."""
        if self.special and any(x in text for x in self.special_marks):
            parts = self.special.split(text)
            return len(parts) - 1, sum((self.plain(x) for x in parts), Counter())
        return 0, self.plain(text)

    def plain(self, text: str) -> Counter[str]:
        if self.quick and PLAIN.fullmatch(text):
            return Counter(self.quick(text.lower()))
        t = self.library
        text = t.normalizer.normalize_str(text) if t.normalizer else text
        return Counter(text[a:b] for _, (a, b) in t.pre_tokenizer.pre_tokenize_str(text)) if t.pre_tokenizer else Counter([text])

    def pieces(self, pre_token: str) -> int:
        """A pre-token that the splitter would cut again counts as its parts do."""
        t = self.library
        parts = [x for x, _ in t.pre_tokenizer.pre_tokenize_str(pre_token)] if t.pre_tokenizer else [pre_token]
        return sum(len(t.model.tokenize(x)) for x in parts)


@lru_cache(maxsize=2)
def pre_tokens(path: str) -> PreTokens:
    return PreTokens(path)


def _frequent(docs: DataFrame, path: str, most: int, sample_rows: int) -> dict[str, int]:
    """Up to ``most`` frequent pre-tokens of a sample and their pieces, for the map-side join."""
    n = docs.count()
    part = docs.sample(min(1.0, sample_rows / max(1, n)), seed=7)

    def tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(pre_tokens(path).count(text or "")[1])
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["p", "f"])

    top = part.mapInArrow(tally, "p string, f long").groupBy("p").agg(F.sum("f").alias("f")).filter("f > 1").orderBy(F.desc("f"), "p").limit(most)
    found = _with_pieces(top.select("p"), path).toArrow()
    return dict(zip(found.column("p").to_pylist(), found.column("k").to_pylist(), strict=True))


def _with_pieces(distinct: DataFrame, path: str) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = pre_tokens(path).pieces
        for batch in batches:
            p = batch.column("p")
            yield pa.RecordBatch.from_arrays([p, pa.array(map(count, p.to_pylist()), pa.int32())], ["p", "k"])

    return distinct.mapInArrow(run, "p string, k int")


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 2048,
    dictionary_size: int = 200_000,
    dictionary_rows: int = 10_000,
) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit for every row.

    ``tokenizer_path`` is a ``tokenizers`` file that every worker can open.
    Counts are those of the library's ``encode`` without begin, end or added
    special tokens; special strings inside a text count as the one token they
    are by default. ``dictionary_size`` bounds the broadcast dictionary, which
    is filled from about ``dictionary_rows`` documents. Null texts count as
    empty: 0 bytes, 0 tokens. Repeated rows and null ids are counted row by
    row. A very long text is one row throughout; only its own distinct
    pre-tokens are held.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    known = spark.sparkContext.broadcast(_frequent(rows, tokenizer_path, dictionary_size, dictionary_rows))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, split = known.value, pre_tokens(tokenizer_path)
        tail_type = pa.list_(pa.struct([("p", pa.string()), ("f", pa.int64())]))
        for batch in batches:
            sizes, sums, tails = [], [], []
            for text in batch.column("text").to_pylist():
                total, seen = split.count(text or "")
                tail = []
                for p, f in seen.items():
                    k = pieces.get(p)
                    if k is None:
                        tail.append((p, f))
                    else:
                        total += k * f
                sizes.append(len(text.encode("utf-8", "surrogatepass")) if text else 0)
                sums.append(total)
                tails.append(tail)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(tails, tail_type)], ["id", "n_bytes", "n_known", "tail"])

    id_type = rows.schema["id"].dataType.simpleString()
    counted = rows.mapInArrow(run, f"id {id_type}, n_bytes long, n_known long, tail array<struct<p string, f long>>")
    counted = materialise(counted.withColumn("row", F.monotonically_increasing_id()), "token-rows")
    tail = counted.select("row", F.inline("tail"))
    pieces = _with_pieces(tail.select("p").distinct(), tokenizer_path)
    sums = tail.join(pieces, "p").groupBy("row").agg(F.sum(F.col("f") * F.col("k")).alias("rest"))
    total = F.col("n_known") + F.coalesce("rest", F.lit(0).cast("long"))
    return counted.join(sums, "row", "left").select(F.col("id").alias(id_col), "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents by the word BPE vocabulary of 49 thousand."""
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
