"""Jaccard join, line dedup and decontamination against comparisons of all pairs."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lamella.llm import decontamination, line_dedup, ngram_jaccard
from lamella.llm.components import connected_components
from lamella.llm.packed import pack_sorted, shard_slices, unpack_sorted
from tests.llm.helpers import components, edited, lower, prose, words


def family_rows(seed):
    """Copies, chains of edits, a large family of near copies, short texts and odd rows."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.choice([1, 2, 3, 4, 5, 8, 12, 20, 60, 150])) for _ in range(60)]
    texts += [texts[i % 20] for i in range(25)]
    for i in range(40):
        texts.append(edited(rng, texts[rng.randrange(len(texts))], rng.randrange(1, 5)))
    base = prose(rng, 90)
    texts += [edited(rng, base, rng.randrange(0, 7)) for _ in range(80)]
    texts += [None, "", "  \n", "ONE TWO", "one two", base.upper()]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))


def shingles(text, k):
    w = words(lower(text))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.mark.parametrize(("seed", "k", "percent", "direct"), [(1, 4, 85, 16), (2, 5, 80, 0), (3, 3, 60, 0), (4, 3, 70, 4)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, seed, k, percent, direct):
    monkeypatch.setattr(ngram_jaccard, "DIRECT", direct)
    rows = family_rows(seed)
    sets = {i: shingles(t, k) for i, t in rows}
    want = components(sets, lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"node": F.lit(1), "n": F.lit(2), "id": F.lit(3), "label": F.lit(4)})
    got = ngram_jaccard.join_components(df.repartition(5), shingle_words=k, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(s), want[i]) for i, s in sets.items()}


@pytest.mark.parametrize("direct", [0, 16])
def test_links_across_tasks_with_pivots_of_their_own(spark, monkeypatch, direct):
    monkeypatch.setattr(ngram_jaccard, "DIRECT", direct)
    monkeypatch.setattr(ngram_jaccard, "FLUSH", 100)
    rng = random.Random(21)
    # Variants of a few texts, most of them less alike than the limit, and a passage that many texts have.
    bases, passage = [prose(rng, 60) for _ in range(4)], prose(rng, 40)
    texts = [edited(rng, rng.choice(bases), rng.randrange(1, 9)) for _ in range(150)]
    texts += [f"{prose(rng, 12)} {passage} {prose(rng, 12)}" for _ in range(50)] + [edited(rng, passage, rng.randrange(0, 6)) for _ in range(30)]
    rows = list(enumerate(texts))
    sets = {i: shingles(t, 3) for i, t in rows}
    want = components(sets, lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)
    got = {r.doc_id: r.component_id for r in ngram_jaccard.join_components(df, shingle_words=3, percent=75).collect()}
    assert got == want and 20 < len(set(want.values())) < 200


def test_a_family_is_searched_once_and_only_for_pairs_that_can_be_similar(spark, monkeypatch):
    rng, made = random.Random(22), {}

    def write(df, label, materialise=ngram_jaccard.materialise):
        made[label] = materialise(df, label)
        return made[label]

    monkeypatch.setattr(ngram_jaccard, "FLUSH", 2000)
    monkeypatch.setattr(ngram_jaccard, "DIRECT", 0)
    monkeypatch.setattr(ngram_jaccard, "materialise", write)
    # Near copies of one text, most of them less alike than the limit: tasks have pivots of their own.
    base = prose(rng, 120)
    texts = [edited(rng, base, rng.randrange(1, 12)) for _ in range(300)]
    sets = {i: shingles(t, 4) for i, t in enumerate(texts)}
    links = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    want = components(sets, lambda a, b: (a, b) in links)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(12)
    got = {r.doc_id: r.component_id for r in ngram_jaccard.join_components(df, shingle_words=4, percent=85).collect()}
    assert got == want and len(set(want.values())) > 100
    open_ = made["jaccard-open"]
    assert open_.select("pivot").distinct().count() > 4
    counts = (made["jaccard-differences"].count(), open_.select("node").distinct().count(), made["jaccard-cross"].count(), len(links))
    assert counts[0] <= 1.2 * counts[1] and counts[2] <= 2 * counts[3] + 300, counts


def test_sketches_differ_no_more_than_sets():
    rng = np.random.default_rng(5)
    for n in [1, 10, 100, 3000]:
        a, b = (np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for _ in range(2))
        b = np.union1d(a[n // 5 :], b[: n // 5])
        bits = int(np.bitwise_count((ngram_jaccard.sketch(a) ^ ngram_jaccard.sketch(b)).view(np.uint64)).sum())
        assert bits <= len(np.setxor1d(a, b)) and (bits > 0) == (n > 5) and len(ngram_jaccard.sketch(a)) * 64 == ngram_jaccard.SKETCH


def test_every_near_pair_shares_a_signature():
    rng = np.random.default_rng(4)
    bands = ngram_jaccard.Bands(85)
    for n in [7, 8, 11, 20, 33, 64, 150, 700]:
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            change = rng.integers(1, max(2, int(n * 0.15)))
            b = np.unique(np.concatenate([rng.permutation(a)[change // 2 :], rng.integers(0, 2**63, change - change // 2, dtype=np.uint64)]))
            if ngram_jaccard.similar(a, b, 85):
                sigs, owner = ngram_jaccard.signatures([a, b], bands)
                assert set(sigs[owner == 0].tolist()) & set(sigs[owner == 1].tolist())


def test_jaccard_odd_rows(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, "A b C d e"), (None, "a b c d e"), (3, None), (4, ""), (5, "x " * 20000 + "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in ngram_jaccard.join_components(df).collect())
    assert got == [(-1, 1, None), (1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 0, 4), (5, 2, 5)]
    assert ngram_jaccard.join_components(df.limit(0)).count() == 0


def test_connected_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (30, 30)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: 1 for n in (2, 3, 7, 8, 9)} | {21: 20} | {n: 100 for n in range(101, 141)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_packed_keys():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**64, 5000, dtype=np.uint64))
    assert (unpack_sorted(pack_sorted(keys)) == keys).all() and len(unpack_sorted(pack_sorted(keys[:0]))) == 0
    parts = list(shard_slices(keys, 7))
    assert [a for _, a, _ in parts][1:] == [b for _, _, b in parts][:-1] and parts[-1][2] == len(keys)


def line_signature(norm):
    """Number of features, SimHash and block keys of a line, as ``line_dedup`` says them."""
    feats = [w for w in norm.split(" ") if len(w) >= line_dedup.FEATURE] or norm.split(" ")
    n, blocks, sums = len(feats), [0] * line_dedup.BLOCKS, [0] * 60
    for w in feats:
        h = xxhash.xxh64_intdigest(w.encode(), seed=42)
        blocks[h % line_dedup.BLOCKS] ^= h
        for b in range(60):
            sums[b] += h >> 4 >> b & 1
    coarse = [blocks[i] ^ blocks[i + line_dedup.COARSE] for i in range(line_dedup.COARSE)]
    keys = set()
    if n < line_dedup.PAIRS_BELOW:
        keys.add(("whole", *blocks))
        keys |= {(i, j, x, y) for i, x in enumerate(coarse) for j, y in enumerate(coarse[:i]) if x and y}
    if line_dedup.COARSE_FROM <= n < line_dedup.COARSE_BELOW:
        keys |= {("coarse", i, x) for i, x in enumerate(coarse) if x}
    if n >= line_dedup.BLOCKS_FROM:
        keys |= {("fine", i, x) for i, x in enumerate(blocks) if x}
    return n, sum((2 * s > n) << b for b, s in enumerate(sums)), keys


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def text_distance(a, b):
    """``edit_distance`` by rows of numpy."""
    b = np.frombuffer(b.encode("utf-32-le"), np.uint32)
    ramp, row = np.arange(len(b) + 1), np.arange(len(b) + 1)
    for i, x in enumerate(a, 1):
        step = row + 1
        step[1:] = np.minimum(step[1:], row[:-1] + (b != ord(x)))
        step[0] = i
        row = np.minimum.accumulate(step - ramp) + ramp
    return int(row[-1])


def groups_of_lines(rows, by_blocks, percent=80, least_words=5):
    """The places of each group of similar lines, by comparing all pairs; ``by_blocks``: only those that share a key and have near SimHashes."""
    places = defaultdict(list)
    for i, t in rows:
        if i is not None:
            for p, line in enumerate((t or "").lower().split("\n") if t is not None else []):
                norm = line.strip(" ")
                if norm.count(" ") >= least_words - 1:
                    places[norm].append((i, p))
    signatures = {x: line_signature(x) for x in places}
    threes = {x: {x[i : i + 3] for i in range(len(x) - 2)} for x in places}

    def linked(a, b):
        most = max(len(a), len(b)) * (100 - percent) // 100
        # An edit takes three runs of three characters at most.
        if abs(len(a) - len(b)) > most or len(threes[a] - threes[b]) > 3 * most:
            return False
        if by_blocks:
            (_, sa, ka), (_, sb, kb) = signatures[a], signatures[b]
            reach = line_dedup.SHORT_REACH if max(len(a), len(b)) < line_dedup.SHORT_SIZE else line_dedup.REACH
            if not ka & kb or max(len(a), len(b)) <= line_dedup.MOST_SIZE and bin(sa ^ sb).count("1") > reach:
                return False
        return text_distance(a, b) <= most

    group = components(sorted(places), linked)
    occurrences = defaultdict(list)
    for x, where in places.items():
        occurrences[group[x]] += where
    return list(occurrences.values())


def removed_of(groups):
    return {(i, p) for where in groups for i, p in where if (i, p) != min(where)}


def line_rows(seed):
    rng = random.Random(seed)
    pool = [prose(rng, rng.randrange(3, 40)) for _ in range(30)]
    pool += [edited(rng, rng.choice(pool), 1) for _ in range(30)] + [p.upper() + " " for p in pool[:5]]
    long = prose(rng, 120)
    pool += [edited(rng, long, 1) for _ in range(25)]
    pool += [" ".join(rng.sample(pool[3].split(), len(pool[3].split()))) for _ in range(3)] + ["the the the the the the the", "a b c d e f g", ""]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 5)))) for i in range(70)]
    return rows + [(100, None), (101, ""), (102, "\n\n"), (None, pool[0])]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_line_dedup_is_that_of_all_pairs(spark, seed):
    rows = line_rows(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit(1), "pos": F.lit(2), "key": F.lit(3), "norm": F.lit("x"), "label": F.lit(4)})
    want = removed_of(groups_of_lines(rows, by_blocks=True))
    got = {(r.doc_id, p) for r in line_dedup.removed_lines(df).collect() for p in r.removed}
    assert got == want and want
    kept = line_dedup.dedup_lines(df)
    assert kept.columns == df.columns
    texts = {r.doc_id: r.text for r in kept.collect()}
    for i, t in rows:
        if i is None or not any(d == i for d, _ in want):
            assert texts[i] == t
        else:
            left = "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in want)
            assert texts.get(i, "").strip() == left.strip()


def test_line_dedup_odd_tables(spark):
    df = spark.createDataFrame([(1, "one two three four five"), (1, "one two three four five"), (2, "One two three four five\nx " + "long " * 30000)], "doc_id long, text string")
    got = {r.doc_id: (r.removed, r.kept_in) for r in line_dedup.removed_lines(df).collect()}
    assert got == {2: ([0], [1])}
    assert line_dedup.removed_lines(df.limit(0)).count() == 0 and line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_lines_are_equal_without_punctuation_and_blanks(spark):
    line = "one two three four five six"
    same = ["One two, three four five six.", line + "\r", "one\ttwo  three \x0b four\x0cfive six", " - one two three - four five six!", "\u201cone two three four five six\u201d"]
    other = ["one two three four five sixe\u0301", "a - b - c - d", "1 2 3 4 5", "1 2 3 4 6"]
    texts = [line, *same, *other, "1, 2, 3, 4, 5"]
    df = spark.createDataFrame([("\n".join(x.replace("\n", " ") for x in texts),)], "raw string")
    got = df.select(line_dedup.normal_lines(F.col("raw"))).first()[0]
    assert [x.strip() for x in got[:6]] == [line] * 6 and got[6:] == ["one two three four five sixe\u0301", "a b c d", "1 2 3 4 5", "1 2 3 4 6", "1 2 3 4 5"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([line, *same])], "doc_id long, text string")
    assert {r.doc_id: (r.removed, r.kept_in) for r in line_dedup.removed_lines(rows).collect()} == {i: ([0], [0]) for i in range(1, 6)}


def line_variants(seed, n):
    """Lines of 5 to 150 words and, for each, one with a few words or a character changed."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeilmnorst") for _ in range(rng.choice([1, 2, 3, 3, 4, 5, 6, 7, 8, 9]))) for _ in range(3000)]
    for _ in range(n):
        line = [rng.choice(vocabulary) for _ in range(rng.choice([rng.randrange(5, 13), rng.randrange(13, 60), rng.randrange(60, 150)]))]
        other = list(line)
        if rng.random() < 0.25:
            at = rng.randrange(len(other))
            other[at] = other[at][:1] + "x" + other[at][2:]
        for _ in range(rng.randrange(1, 2 + len(line) // 12)):
            at = rng.randrange(len(other))
            other[at : at + 1] = rng.choice([[], [rng.choice(vocabulary)], [other[at], rng.choice(vocabulary)]])
        yield " ".join(line), " ".join(other)


def test_line_dedup_finds_lines_of_near_edit_distance(spark):
    rows = [(2 * i + k, text) for i, pair in enumerate(line_variants(4, 200)) for k, text in enumerate(pair)]
    groups = groups_of_lines(rows, by_blocks=False)
    want = removed_of(groups)
    got = {(r.doc_id, p) for r in line_dedup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect() for p in r.removed}
    assert len(want) > 170 and got <= want and len(got) >= 0.95 * len(want)


def test_a_family_of_lines_is_one_group(spark):
    rng = random.Random(6)
    base = prose(rng, 50)
    far = edited(rng, base, 16)
    rows = [(i, edited(rng, base if i % 3 else far, rng.randrange(0, 4))) for i in range(400)]
    want = removed_of(groups_of_lines(rows, by_blocks=True))
    got = {(r.doc_id, p) for r in line_dedup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect() for p in r.removed}
    assert got == want and len(got) > 390


def test_texts_of_lines_are_filtered_before_their_shuffle(spark, monkeypatch):
    plans = []

    def write(df, label, materialise=line_dedup.materialise):
        if label == "line-texts":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return materialise(df, label)

    def scans(session, filter_scans=line_dedup.filter_scans):
        filter_scans(session)
        session.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "1b")

    monkeypatch.setattr(line_dedup, "materialise", write)
    monkeypatch.setattr(line_dedup, "filter_scans", scans)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = line_rows(7)
        got = {(r.doc_id, p) for r in line_dedup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect() for p in r.removed}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == removed_of(groups_of_lines(rows, by_blocks=True))
    assert plans and all("might_contain" in x or "bloomfilter" in x.lower() for x in plans)


def test_edit_check_is_plain_edit_distance_either_way(spark):
    rng = random.Random(8)
    pairs = [(x, y) for n in (3, 12, 60, 120) for _ in range(12) for x in [prose(rng, n)] for y in [edited(rng, x, n // 8), edited(rng, x, n // 4), prose(rng, n), f"{prose(rng, n // 6)} {x}", f"{x} {prose(rng, n // 6)}", x[n // 2 :]]]
    pairs += [(y, x) for x, y in pairs] + [("", ""), ("", "a"), ("\u00e9" * 500, "e" * 500)]
    want = [text_distance(x, y) <= max(len(x), len(y)) * 20 // 100 for x, y in pairs]
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(pairs)], "i int, x string, y string")
    for likely in (True, False):
        got = df.select("i", line_dedup.similar_lines(F.col("x"), F.col("y"), 80, likely).alias("ok")).orderBy("i").collect()
        assert [r.ok for r in got] == want
    assert 100 < sum(want) < len(want) - 100


def test_letters_and_pieces_bound_edit_distances(spark, monkeypatch):
    """On short lines with low limits, as plain edit distances of long ones take too long here."""
    rng = random.Random(9)
    pairs = [(x, y) for n in (6, 25, 60) for _ in range(8) for x in [prose(rng, n)] for y in [edited(rng, x, n // 8), edited(rng, x, n // 4), prose(rng, n), f"{x} {prose(rng, n // 6)}", x.replace("e", "\u00e9"), "that " * n]]
    pairs += [(y, x) for x, y in pairs] + [("", ""), ("", "a"), ("\u00e9" * 90, "e" * 90), ("in " * 900, "that " * 600)]
    most = [max(len(x), len(y)) * 20 // 100 for x, y in pairs]
    far = [text_distance(x, y) for x, y in pairs[:-1]] + [2400]
    for name, low in (("LONGER", 0), ("PIECES_OVER", 0), ("PIECE", 24)):
        monkeypatch.setattr(line_dedup, name, low)
    df = spark.createDataFrame([(i, *p, k) for i, (p, k) in enumerate(zip(pairs, most))], "i int, x string, y string, most int")
    x, y = F.col("x"), F.col("y")
    costs = [line_dedup._pieces_cost(x, y, in_step).alias(f"c{in_step:d}") for in_step in (False, True)]
    likely = [line_dedup.similar_lines(x, y, 80, likely).alias(f"s{likely:d}") for likely in (False, True)]
    got = df.select("i", line_dedup._letters_apart(x, y, F.col("most")).alias("apart"), *costs, *likely).orderBy("i").collect()
    for r, d, k in zip(got, far, most, strict=True):
        assert min(r.c0, r.c1) >= d and not (r.apart and d <= k) and r.s0 == r.s1 == (d <= k)
    # The bounds decide: lines of a repeated word are told from all others by letters, most edited lines are passed by pieces.
    assert got[-1].apart and sum(r.apart for r in got) > 40
    assert sum(min(r.c0, r.c1) <= k for r, k in zip(got, most)) > 0.7 * sum(d <= k for d, k in zip(far, most))


def test_later_links_merge_components(spark):
    roots = spark.createDataFrame([(5, 1), (6, 1), (7, 2), (9, 3)], "node long, root long")
    more = spark.createDataFrame([(6, 7), (4, 9), (10, 11)], "a long, b long")
    got = {(r.node, r.root) for r in line_dedup._merged(roots, more).collect()}
    assert got == {(5, 1), (6, 1), (7, 1), (2, 1), (9, 3), (4, 3), (11, 10)}


def test_line_dedup_drops_shuffles_as_it_goes(spark, monkeypatch):
    left, name = [], "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)

    def shuffles():
        files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString(",").split(",")
        return {x for x in files if x.rsplit("/", 1)[-1].startswith("shuffle_")}

    def write(df, label, materialise=line_dedup.materialise):
        began = shuffles()
        out = materialise(df, label)
        left.append(len(shuffles() - began))
        return out

    monkeypatch.setattr(line_dedup, "materialise", write)
    gone = line_dedup.removed_lines(spark.createDataFrame(line_rows(1), "doc_id long, text string"))
    assert left and not any(left) and spark.conf.get(name) == before
    assert gone.collect() == gone.collect() != []


def test_best_passage_is_the_least_edit_distance():
    rng = np.random.default_rng(2)
    for _ in range(60):
        item, text = rng.integers(0, 4, rng.integers(1, 8)).astype(np.uint64), rng.integers(0, 4, rng.integers(0, 14)).astype(np.uint64)
        want = min(edit_distance(item.tolist(), text[i:j].tolist()) for i in range(len(text) + 1) for j in range(i, len(text) + 1))
        assert decontamination.best_passage(item, text)[0] == want


@pytest.fixture(scope="module")
def items():
    rng = random.Random(11)
    return [(i, prose(rng, rng.randrange(10, 60)).capitalize() + ".") for i in range(40)]


def hits_by_brute_force(docs, items, percent=80):
    out = set()
    for d, text in docs:
        w = np.array([hash(x) for x in decontamination.words_for_edit(text)])
        for i, t in items:
            v = np.array([hash(x) for x in decontamination.words_for_edit(t)])
            if len(v) >= 6 and decontamination.best_passage(v, w)[0] <= len(v) * (100 - percent) // 100:
                out.add((d, i))
    return out


def test_decontamination_recall_and_precision(spark, items):
    rng = random.Random(12)
    docs = []
    for d in range(300):
        text = prose(rng, rng.randrange(20, 200)).split()
        at = rng.randrange(len(text))
        if d % 3:
            passage = rng.choice(items)[1]
            passage = edited(rng, passage, int(len(passage.split()) * rng.choice([0, 0, 0.05, 0.1, 0.15, 0.2])))
            text[at:at] = (passage.upper() if d % 2 else passage).split()
        docs.append((d, " ".join(text)))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = hits_by_brute_force(docs, items)
    rows = decontamination.contaminated(df, bench).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 150
    parts = decontamination.contaminated(df, bench, most_words=300)
    assert {(r.doc_id, r.item_id) for r in parts.collect()} == got
    for r in rows:
        stretch = decontamination.words_for_edit(docs[r.doc_id][1])[r.first_word : r.end_word]
        assert edit_distance(decontamination.words_for_edit(items[r.item_id][1]), stretch) == r.distance
    clean = decontamination.decontaminate(df, bench)
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in got}


def test_decontamination_recall_by_item_length():
    rng, hashes = random.Random(13), ngram_jaccard.WordHashes()
    for n in range(1, 21):
        items = [prose(rng, n) for _ in range(12)]
        texts = []
        for d in range(48):
            text, copy = prose(rng, 30).split(), items[d % 12]
            if n >= 6 and d % 4:
                copy = edited(rng, copy, n // 5)
            text[d % 31 : d % 31] = copy.split()
            texts.append(" ".join(text))
        coded = [np.array([hashes[w] for w in decontamination.words_for_edit(x)], np.uint64) for x in items]
        index = decontamination.ItemIndex(range(12), coded)
        got = {(d, i): distance for d, i, _, _, distance in decontamination.scan(texts, index, hashes)}
        plain = [np.array([hashes[w] for w in decontamination.words_for_edit(x)], np.uint64) for x in texts]
        best = {(d, i): decontamination.best_passage(v, w)[0] for d, w in enumerate(plain) for i, v in enumerate(coded)}
        want = {k: x for k, x in best.items() if x <= (n // 5 if n >= 6 else 0)}
        assert len(want) >= 48 and got.keys() <= want.keys(), n
        assert (got == want if n < decontamination.SHORT else len(got) >= 0.9 * len(want)), (n, len(got), len(want))


def test_short_items_are_found_as_they_are(spark):
    df = spark.createDataFrame([(1, "pad What is two plus two? pad"), (2, "what is two minus two"), (3, "Yes."), (4, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "What is two plus two"), (2, "yes"), (3, "?"), (4, None)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.first_word, r.end_word, r.distance) for r in decontamination.contaminated(df, bench).collect())
    assert got == [(1, 1, 1, 6, 0), (3, 2, 0, 1, 0)]


def test_decontamination_odd_rows(spark, items):
    text = items[0][1]
    rows = [(1, None), (2, ""), (3, text), (3, text), (None, "x " + text), (4, "pad " * 40000 + text + " pad" * 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit(0), "item": F.lit(0)})
    bench = spark.createDataFrame([(1, text), (2, text), (3, None), (4, "too short"), (5, "")], "item_id long, text string")
    got = sorted((r.doc_id or -1, r.item_id, r.distance) for r in decontamination.contaminated(df, bench).collect())
    assert got == sorted((d, i, 0) for d in (3, 3, -1, 4) for i in (1, 2))
    assert decontamination.contaminated(df.limit(0), bench).count() == 0
    assert decontamination.contaminated(df, bench.limit(0)).count() == 0
    clean = decontamination.decontaminate(df, bench)
    assert clean.schema == df.schema and sorted(r.doc_id for r in clean.collect()) == [1, 2]
    assert decontamination.decontaminate(df.limit(0), bench).count() == 0 and decontamination.decontaminate(df, bench.limit(0)).count() == len(rows)
    assert [decontamination.walks_for(x) for x in (0.0, 0.7, 0.9, 0.97, 1.0)] == [1, 1, 2, 3, 8]
