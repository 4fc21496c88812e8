"""LM scoring, quality rules, token counts and mixing against plain Python."""

from __future__ import annotations

import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.llm import lm_scoring, mixing, quality_rules, token_counts
from lamella.llm.common import materialise
from lamella.sources import metadata
from tests.llm.helpers import lower, prose, words

ODD = [
    (900, None, "x", None), (901, "", "x", "s"), (902, " \t\n", None, "s"), (903, "One", "x", "s"), (904, "a\u00a0b c\x1cd É é", "x", "s"),
    (905, "word " * 30000, "x", "s"), (906, "same row", "x", "s"), (906, "same row", "x", "s"), (None, "no id here", "x", "s"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randrange(1, 120)), rng.choice(["en", "de"]), rng.choice("pqr")) for i in range(150)]
    rows += [(i, rows[i % 7][1], "en", "p") for i in range(150, 165)]
    df = spark.createDataFrame([*rows, *ODD], "doc_id long, text string, lang string, source string")
    return df.withColumns({"id": F.lit("clash"), "n": F.lit(1), "key": F.lit(2), "held_out": F.lit(3), "word": F.lit(4), "block": F.lit(5)})


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_scores_are_those_of_the_walk(docs, order):
    strength = (60.0, 20.0)
    rows = docs.select("doc_id", "text").collect()
    held = [r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in rows]
    tokens = [["<s>"] * (order - 1) + words(lower(r.text)) + ["</s>"] for r in rows]
    counts, context = [Counter() for _ in range(order + 1)], [Counter() for _ in range(order + 1)]
    for t, h, r in zip(tokens, held, rows, strict=True):
        if not h and r.doc_id is not None:
            for i in range(order - 1, len(t)):
                for n in range(1, order + 1):
                    counts[n][tuple(t[i - n + 1 : i + 1])] += 1
                    context[n][tuple(t[i - n + 1 : i])] += 1
    total, kinds = sum(counts[1].values()), len(counts[1])

    def p(t, i, n):
        c = counts[n][tuple(t[i - n + 1 : i + 1])]
        if n == 1:
            return (c - lm_scoring.DISCOUNT) / total if c else lm_scoring.DISCOUNT * kinds / total
        return (c + strength[n - 2] * p(t, i, n - 1)) / (context[n][tuple(t[i - n + 1 : i])] + strength[n - 2])

    want = []
    for t, h, r in zip(tokens, held, rows, strict=True):
        own = t[order - 1 :]
        base = sum(math.log10((counts[1][(w,)] + 1) / (total + kinds + 1)) for w in own)
        score = sum(math.log10(p(t, i, order)) for i in range(order - 1, len(t)))
        want.append((r.doc_id is None, r.doc_id or 0, len(own), sum(counts[1][(w,)] > 0 for w in own), total, round(base, 5), round(score, 5)))
    # A null id has no checksum, so the row is held out.
    got = lm_scoring.score(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2, order=order, strength=strength).collect()
    assert sorted(want) == sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in got)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_lm_probabilities_sum_to_one(order):
    rng = random.Random(order)
    texts = [prose(rng, rng.randrange(0, 30)).encode() for _ in range(60)] + [b"", b"zzz never seen"]
    held_out = np.arange(len(texts)) >= 55
    block = lm_scoring.Block(texts, held_out, order)
    tokens, kinds, starts = int(block.counts[0].sum()), int((block.counts[0] > 0).sum()), int((~held_out).sum())
    machine = lm_scoring.Automaton(block, block.counts, tokens, kinds, starts, (60.0, 20.0, 10.0))
    ids = block.ids[block.first[0]]
    known, unknown = ids[block.counts[0] > 0], ids[block.counts[0] == 0]
    assert len(unknown) and lm_scoring.END in known
    # The states that the walks go through.
    seen = {machine.start}
    for d in range(len(texts)):
        state = np.array([machine.start])
        for w in block.ids[block.ends[d] - block.lengths[d] : block.ends[d] - 1]:
            _, state = machine.step(state, np.array([w]))
            seen.add(int(state[0]))
    assert 0 in seen and (order == 1 or len(seen) > 50)
    for state in seen:
        gained, _ = machine.step(np.full(len(known), state), known)
        lost, reached = machine.step(np.array([state]), unknown[:1])
        assert abs((10**gained).sum() + 10 ** lost[0] - 1) < 1e-9 and reached[0] == 0


def test_lm_without_rows_or_training(spark, docs):
    assert lm_scoring.score(docs.limit(0), F.lit(False)).count() == 0
    rows = lm_scoring.score(docs.limit(3), F.lit(True)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.score == 0 for r in rows)


def measures(text):
    w, raw = words(text), text or ""
    lines = [x for x in raw.split("\n") if words(x)]
    windows = defaultdict(list)
    for i in range(len(w) - 7):
        windows[tuple(w[i : i + 8])].append(i)
    covered = {j for places in windows.values() if len(places) > 1 for i in places for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(raw.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_lm_blocks_are_stored_in_small_row_groups(spark):
    text = "word " * (lm_scoring.BLOCK_BYTES // 5)
    docs = spark.range(6).coalesce(1).selectExpr("id", "false as held_out", f"concat('{text}', id) as text")
    blocks = materialise(lm_scoring._blocks(docs), "lm-blocks", lm_scoring.GROUP_ROWS)
    groups = [g.rows for f in blocks.inputFiles() for g in metadata.footer(spark, f).row_groups]
    assert sum(groups) == 6 and max(groups) <= 2


def test_corpus_counts_of_many_pieces_in_little_memory():
    rng = np.random.default_rng(5)
    keys = [np.unique(rng.integers(0, 1 << 21, 100_000, np.uint64) << np.uint64(30)) for _ in range(40)]
    counts = [rng.integers(0, 40, len(k)).astype(np.uint32) for k in keys]
    tracemalloc.start()
    given, tokens, kinds = lm_scoring.corpus_counts(keys, counts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2.5 * sum(x.nbytes for x in keys)
    want = np.zeros(1 << 21, np.int64)
    for k, c in zip(keys, counts, strict=True):
        want[(k >> np.uint64(30)).astype(np.int64)] += c
    assert tokens == want.sum() and kinds == (want > 0).sum() and want.max() >= 255
    for k, (small, large) in zip(keys, given, strict=True):
        out = small.astype(np.int64)
        out[out == 255] = large
        assert (out == want[(k >> np.uint64(30)).astype(np.int64)]).all()
    assert [len(x) for x in lm_scoring.corpus_counts([np.empty(0, np.uint64)], [np.empty(0, np.uint32)])[0][0]] == [0, 0]



def test_quality_measures(docs, spark):
    rng = random.Random(2)
    extra = [(2000 + i, " ".join(rng.choice("ab") for _ in range(n)) + "\n#x <|>\n\nx\nx", "en", "s") for i, n in enumerate([3, 8, 9, 20, 60])]
    df = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([e[:3] for e in extra], "doc_id long, text string, lang string"))
    labels = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    got = quality_rules.judge(df, labels).collect()
    texts = Counter((r.doc_id, *measures(r.text)) for r in df.collect())
    assert texts == Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed and not r.broken_rules)


def test_binomial_tail_is_exact():
    for n, p in ((1, 0.3), (30, 0.01), (400, 0.05)):
        for x in range(0, min(n, 40)):
            want = math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(x + 1))
            assert abs(quality_rules.binomial_cdf(x, n, p) - want) < 1e-12


def test_quality_cutoffs_keep_their_promise(spark):
    rng = random.Random(9)
    rows = []
    for i in range(6000):
        junk = i % 6 == 0
        text = " ".join(w + ("###" if junk else "") for w in prose(rng, 30).split())
        rows.append((i, text, "en" if i % 3 else "de", 0 if junk else 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    labels = df.filter("doc_id % 5 < 3").select("doc_id", "quality")
    found = quality_rules.judge(df, labels).join(df.select("doc_id", F.col("quality").alias("q"), "lang"), "doc_id")
    assert found.filter("q = 0 and kept").count() == 0
    for r in found.filter("q = 1").groupBy("lang").agg(F.avg((~F.col("kept")).cast("int")).alias("x")).collect():
        assert r.x <= 0.05
    kept = quality_rules.keep(df, labels)
    assert kept.columns == df.columns and kept.count() == found.filter("kept").count()
    few = quality_rules.judge(df, labels.limit(20))
    assert few.filter("not kept and not base_failed").count() == 0  # nothing can be certified from 20 labels


def test_few_labels_certify_rules_jointly(spark):
    good, bad = (" ".join(f"{mark}w{i}" for i in range(30)) for mark in ("", "####"))
    rows = [(i, good, lang, 1) for lang, a, n in (("de", 0, 90), ("fr", 1000, 60)) for i in range(a, a + n)] + [(2000, bad, "de", 0), (2001, bad, "fr", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    for delta, judged in ((0.05, {2000: False, 2001: True}), (1e-6, {2000: True, 2001: True})):
        found = quality_rules.judge(df, df, joint=True, delta=delta).collect()
        assert {r.doc_id: r.kept for r in found if r.doc_id >= 2000} == judged
        assert all(r.kept for r in found if r.doc_id < 2000)
        kept = quality_rules.keep(df, df, joint=True, delta=delta).select("doc_id").collect()
        assert {r.doc_id for r in kept} == {r.doc_id for r in found if r.kept}


def test_a_document_that_repeats_is_one_trial(spark):
    rows = [(i, "word " * 25, "en") for i in range(100)] + [(0, "word !! " * 25, "en")] * 400
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"id": F.lit(1), "stratum": F.lit("s"), "n": F.lit(2), "kept": F.lit(False), "label_id": F.lit(7)})
    labels = spark.createDataFrame([(i, 1) for i in range(100)] * 2, "doc_id long, quality int")
    found = quality_rules.measured(df, "doc_id", "text", "lang")
    good = labels.selectExpr("doc_id as id", "quality = 1 as good")
    for certify in (quality_rules.certified_cutoffs, quality_rules.certified_jointly):
        got = certify(found, good, quality_rules.RULES, 0.4, 0.05).collect()
        assert got and all(r.n_good == 100 and r.n_rejected <= 1 for r in got)
    assert quality_rules.judge(df, labels).count() == len(rows)


def test_quality_of_nothing(docs, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules.judge(docs.limit(0), labels).count() == 0
    assert quality_rules.keep(docs, labels).filter("text is null").count() == 0


def test_token_counts_equal_the_library(docs, spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    strange = ["a<|endoftext|>B'S I'll <|startoftext|><|endoftext|> ΣΑΣ", "日本語 ① ½ ẞ İst", "don't 12345 !!!??\r\n_a", "<|ENDOFTEXT|> <|endoftext", "e\u0301 \u212b x\x1cz\x85q \ud7ff", "x" * 5000]
    clash = {"id": F.lit("clash"), "n": F.lit(1), "n_tokens": F.lit(2), "piece": F.lit(3), "n_bytes": F.lit(4)}
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(3000 + i, t) for i, t in enumerate(strange)], "doc_id long, text string")).withColumns(clash)
    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    want = Counter((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in df.collect())
    for size in (0, 50, 200_000):
        got = token_counts.count_tokens(df, path, dictionary_size=size, limit=100).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 100) for r in got)
    assert token_counts.count_tokens(df.limit(0), path).count() == 0
    other = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(other)
    small = df.limit(30)
    want = Counter((r.doc_id, len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in small.collect())
    assert Counter((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(small, other).collect()) == want


def test_mixing_keeps_budget_and_limits(docs):
    rows = mixing.mix(docs, budget=1.5, repetition=3.0, entropy=0.9, block_tokens=50).collect()
    sizes = {(r.doc_id, r.source): len(words(r.text)) for r in docs.collect()}
    assert all(r.n_tokens == sizes[r.doc_id, r.source] > 0 for r in rows)
    by_source = defaultdict(list)
    for r in rows:
        by_source[r.source].append(r)
    for part in by_source.values():
        quota, total = part[0].quota, part[0].source_tokens
        taken = sum(r.n_tokens for r in part)
        assert taken <= quota <= 3 * total and quota - taken <= max(r.n_tokens for r in part)
        whole = quota // total
        per_epoch = Counter()
        for r in part:
            per_epoch[r.epoch] += r.n_tokens
        assert all(per_epoch[e] == total for e in range(whole)) and set(per_epoch) <= set(range(whole + 1))
    assert sum(part[0].quota for part in by_source.values()) == math.floor(1.5 * sum(sizes[k] * n for k, n in Counter((r.doc_id, r.source) for r in docs.collect()).items()))
    assert None in by_source or not any(r.source is None and r.text for r in docs.collect())
    with pytest.raises(ValueError, match="repetition"):
        mixing.mix(docs, budget=5.0, repetition=4.0)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mix(docs.filter("text is null")).count() == 0


def test_mixing_exponent_meets_the_entropy(spark):
    totals = spark.createDataFrame([("a", 1000), ("b", 100), ("c", 10)], "key string, total long")
    alpha = mixing.solve_exponent(totals, 100.0, 0.9, 100.0)
    shares = [t**alpha for t in (1000, 100, 10)]
    shares = [s / sum(shares) for s in shares]
    assert abs(-sum(s * math.log(s) for s in shares) - 0.9 * math.log(3)) < 1e-6
    limited = mixing.solve_exponent(totals, 1110.0, 1.0, 2.0)
    assert abs(1110 * 10**limited / sum(t**limited for t in (1000, 100, 10)) / 10 - 2) < 1e-6


def test_mixing_sharpens_shares_that_are_too_even(spark):
    totals = spark.createDataFrame([(k, 1000 + i) for i, k in enumerate("abcdefgh")] + [("z", 1500)], "key string, total long")
    alpha = mixing.solve_exponent(totals, 100.0, 0.9, 100.0)
    shares = [t**alpha for t in [*range(1000, 1008), 1500]]
    shares = [s / sum(shares) for s in shares]
    assert alpha > 1 and abs(-sum(s * math.log(s) for s in shares) - 0.9 * math.log(9)) < 1e-6
    # The largest source is repeated most there.
    limited = mixing.solve_exponent(totals, 9528.0, 0.9, 2.0)
    assert 1 < limited < alpha and abs(9528 / sum((t / 1500) ** limited for t in [*range(1000, 1008), 1500]) / 1500 - 2) < 1e-6
    equal = totals.filter("key <> 'z'").withColumn("total", F.lit(50).cast("long"))
    assert mixing.solve_exponent(equal, 100.0, 0.9, 100.0) == 1.0
    ties = equal.unionByName(equal.limit(1).selectExpr("'y' as key", "3L as total"))
    assert mixing.solve_exponent(ties, 100.0, 0.5, 100.0) == 1.0


def test_mixing_quotas_are_whole_tokens_of_the_budget(spark):
    # Equal and near-equal sources, rows without ids, repeated rows and columns with the operator's own names.
    rows = [(i, f"s{i % 7}", "w " * 11) for i in range(70)] + [(None, "s0", f"a b {i}") for i in range(30)] + [(5, "s5", "w " * 11)] * 3 + [(200, "s1", "one")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({"key": F.lit("k"), "n": F.lit(0), "block": F.lit(1), "name": F.lit("x"), "total": F.lit(1)})
    whole = sum(len(t.split()) for _, _, t in rows)
    seen = []
    for partitions in (1, 5):
        got = mixing.mix(df.repartition(partitions), entropy=0.99, block_tokens=20).collect()
        quota = {r.source: r.quota for r in got}
        assert sum(quota.values()) == whole
        assert len({r.block for r in got if r.doc_id is None}) > 3
        seen.append(sorted((r.doc_id or -1, r.source, r.epoch, r.block, r.block_rank, r.n_tokens, r.quota, r.exponent) for r in got))
    assert seen[0] == seen[1]
