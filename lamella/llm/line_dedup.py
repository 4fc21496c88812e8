"""Fuzzy line deduplication with SQL expressions only.

Lines are normalised and made distinct. A line's features are its longer
words. They vote on its SimHash, and each belongs by its hash to one of
``BLOCKS`` blocks, which are compared as a whole: an edited word changes one
block, and no more than one for the word in its place, so by the pigeonhole
principle lines with few edits agree on the others. (Blocks of the SimHash's
own bits would not do: similar lines differ in five of 60 bits at the median
and in ten quite often, all over the blocks.) Lines of few words are joined on
each two blocks, longer ones on single blocks; pairs whose SimHashes are near
are compared by edit distance, and of each connected group of lines the first
occurrence stays.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm.common import filter_scans, materialise, shuffles_dropped
from lamella.llm.components import connected_components

#: Words of at least so many characters are a line's features; all words, where it has none.
FEATURE = 4
#: Blocks of a line; block i and block i + COARSE together are one of its coarse blocks.
BLOCKS, COARSE = 16, 8
#: Lines of fewer features than the first are joined on pairs of coarse blocks, from the second to the third on coarse
#: ones, from the last on blocks. As the ranges overlap, lines of somewhat different length are in one of them together.
PAIRS_BELOW, COARSE_FROM, COARSE_BELOW, BLOCKS_FROM = 20, 16, 96, 72
#: A SimHash has 60 bits: bits j, j + 12, ... of a word's hash are summed in five parts of one long.
LANES, LANE = 5, 12
_ONES = sum(1 << LANE * i for i in range(LANES))
#: Most differing bits of SimHashes whose lines are compared; most features that a part of a long can count, and a length
#: that has no more, as two words have a space between them. Longer lines are compared whatever their SimHashes.
#: A word is a large part of a short line, whose reach is wider.
REACH, SHORT_REACH, SHORT_SIZE, MOST_VOTES = 15, 22, 100, (1 << (LANE - 1)) - 1
MOST_SIZE = 2 * MOST_VOTES
#: Beginnings of so many allowances are compared before whole lines: those of unrelated lines already differ by more.
BEGINNINGS = (1.5, 2.25)
#: Allowances over which lines that are likely to be similar have their beginnings compared, too, and over which letters are
#: counted, as whole lines' edit distances take time with the square of the length.
LONG, LONGER = 80, 200
#: The characters that are counted one by one.
LETTERS = "etaonrishdlfcmugypwbvkjxqz "
#: Allowances over which pieces of so many characters are compared.
PIECES_OVER, PIECE = 800, 256
#: Words that an alignment of words looks ahead.
AHEAD = 4


def normal_lines(text: Column) -> Column:
    """The lines of a text in lower case, of letters, marks, digits and single spaces; any run of other ASCII blanks is a space."""
    known = F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}\x20\x09-\x0D]+", "")
    return F.split(F.regexp_replace(known, r"[\x09\x0B-\x0D][\x20\x09\x0B-\x0D]*| [\x20\x09\x0B-\x0D]+", " "), "\n", -1)


def _occurrences(docs: DataFrame, least_words: int) -> DataFrame:
    """(id, pos, key, norm) of the lines that take part."""
    lines = docs.filter("id is not null").select("id", F.posexplode(normal_lines(F.col("text"))).alias("pos", "raw"))
    norm = lines.select("id", "pos", F.trim("raw").alias("norm"))
    # A normal line of n words has n - 1 spaces.
    taken = norm.filter(F.octet_length("norm") - F.octet_length(F.replace("norm", F.lit(" "), F.lit(""))) >= least_words - 1)
    return taken.select("id", "pos", F.xxhash64("norm").alias("key"), "norm")


def _block_keys(n: Column, blocks: list[Column]) -> Column:
    """The keys on which a line of ``n`` features is joined; an empty block is 0 and in no key but a short line's of all blocks."""
    coarse = [blocks[i].bitwiseXOR(blocks[i + COARSE]) for i in range(COARSE)]
    whole = F.array(F.xxhash64(F.lit(0), *blocks))
    pairs = F.array(*(F.when((coarse[i] != 0) & (coarse[j] != 0), F.xxhash64(F.lit(1), F.lit(i), F.lit(j), coarse[i], coarse[j])) for i, j in combinations(range(COARSE), 2)))
    single = F.array(*(F.when(b != 0, F.xxhash64(F.lit(2), F.lit(i), b)) for i, b in enumerate(coarse)))
    fine = F.array(*(F.when(b != 0, F.xxhash64(F.lit(3), F.lit(i), b)) for i, b in enumerate(blocks)))
    keys = (
        F.when(n < COARSE_FROM, F.concat(whole, pairs))
        .when(n < PAIRS_BELOW, F.concat(whole, pairs, single))
        .when(n < BLOCKS_FROM, single)
        .when(n < COARSE_BELOW, F.concat(single, fine))
        .otherwise(fine)
    )
    return F.array_compact(keys)


def _signatures(lines: DataFrame) -> DataFrame:
    """(key, size, simhash, keys) of distinct lines that are dealt out by ``key``; nothing is shuffled.

    ``size`` is a line's characters. A block is the exclusive or of its features' hashes, so a word that occurs twice is in
    none.
    """
    # One use of each expression: the optimizer would work a shared one out again for every use.
    words = F.when(F.col("norm").rlike(f"[^ ]{{{FEATURE}}}"), F.regexp_extract_all("norm", F.lit(f"[^ ]{{{FEATURE},}}"), F.lit(0))).otherwise(F.split("norm", " "))
    hashed = lines.select("key", F.length("norm").alias("size"), F.explode(words).alias("w")).select("key", "size", F.xxhash64("w").alias("h"))
    counted = hashed.withColumn("v", F.when(F.col("size") <= MOST_SIZE, F.shiftrightunsigned("h", 4)).otherwise(F.lit(0).cast("long")))
    sums = [F.sum(F.shiftrightunsigned("v", j).bitwiseAND(F.lit(_ONES))).alias(f"s{j}") for j in range(LANE)]
    blocks = [F.bit_xor(F.when(F.col("h").bitwiseAND(F.lit(BLOCKS - 1)) == i, F.col("h")).otherwise(F.lit(0).cast("long"))).alias(f"b{i}") for i in range(BLOCKS)]
    summed = counted.groupBy("key").agg(F.max("size").alias("size"), F.count("*").alias("n"), *sums, *blocks)
    # In each part of a long, the top bit of sum + (2047 - n div 2) says whether more than half of the features voted for it.
    half = (F.lit(MOST_VOTES) - F.shiftright(F.least("n", F.lit(MOST_VOTES)), 1)) * F.lit(_ONES)
    ones = [F.shiftleft(F.shiftrightunsigned(F.col(f"s{j}") + half, LANE - 1).bitwiseAND(F.lit(_ONES)), j) for j in range(LANE)]
    simhash = reduce(lambda x, y: x.bitwiseOR(y), ones).alias("simhash")
    return summed.select("key", "size", simhash, _block_keys(F.col("n"), [F.col(f"b{i}") for i in range(BLOCKS)]).alias("keys"))


def near_enough(a: str, b: str, percent: int) -> str:
    """Condition that lines of two signatures can be similar: by length, and by their SimHashes."""
    lengths = f"least({a}.size, {b}.size) * 100 >= greatest({a}.size, {b}.size) * {percent}"
    reach = f"CASE WHEN greatest({a}.size, {b}.size) < {SHORT_SIZE} THEN {SHORT_REACH} WHEN greatest({a}.size, {b}.size) <= {MOST_SIZE} THEN {REACH} ELSE 64 END"
    return f"{lengths} and bit_count({a}.simhash ^ {b}.simhash) <= {reach}"


def _given(fn: Callable[[Column], Column], **values: Column) -> Column:
    """``fn`` of a struct of values that are worked out once, however often it uses them."""
    return F.get(F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), fn), F.lit(0))


def _aligned_cost(a: Column, b: Column) -> Column:
    """At least the edit distance of two arrays of words, joined by spaces.

    Each word of ``a`` is matched with the next equal one of ``b``, up to
    AHEAD words on; what is between two matches costs the longer one's length.
    """

    def length_of(words: Column) -> Column:
        return F.aggregate(words, F.lit(0), lambda n, w: n + F.length(w) + 1)

    def step(state: Column, word: Column) -> Column:
        def matched(x: Column) -> Column:
            skipped = length_of(F.slice(b, state["next"], F.greatest(x["at"] - 1, F.lit(0))))
            hit = F.struct((state["next"] + x["at"]).alias("next"), F.lit(0).alias("gap"), (state["cost"] + F.greatest(state["gap"], skipped)).alias("cost"))
            miss = F.struct(state["next"].alias("next"), (state["gap"] + F.length(word) + 1).alias("gap"), state["cost"].alias("cost"))
            return F.when(x["at"] > 0, hit).otherwise(miss)

        return _given(matched, at=F.array_position(F.slice(b, state["next"], F.lit(AHEAD)), word).cast("int"))

    first = F.struct(F.lit(1).alias("next"), F.lit(0).alias("gap"), F.lit(0).alias("cost"))
    return F.aggregate(a, first, step, lambda s: s["cost"] + F.greatest(s["gap"], length_of(F.slice(b, s["next"], F.size(b)))))


def _letters_apart(a: Column, b: Column, most: Column) -> Column:
    """Whether the counts of letters show an edit distance over ``most``; characters but LETTERS count together.

    An edit takes away one character at most, and adds one at most. So the
    distance is no less than the characters that one line has in excess of the
    other, which are half of all differences of counts and of the lengths.
    """
    longer = F.length(a) - F.length(b)

    def step(state: Column, letter: Column) -> Column:
        def left(s: Column) -> Column:
            return F.octet_length(s) - F.octet_length(F.replace(s, letter, F.lit("")))

        return _given(lambda x: F.struct((state["rest"] - x["d"]).alias("rest"), (state["apart"] + F.abs(x["d"])).alias("apart")), d=left(a) - left(b))

    first = F.struct(longer.alias("rest"), F.lit(0).alias("apart"))
    return F.aggregate(F.array(*(F.lit(c) for c in LETTERS)), first, step, lambda s: s["apart"] + F.abs(s["rest"]) + F.abs(longer) > most * 2)


def _pieces_cost(a: Column, b: Column, in_step: bool) -> Column:
    """At least the edit distance of two lines: the sum of those of their pieces, which are cut at the same places, or in proportion if ``in_step``."""
    n = F.ceil(F.greatest(F.length(a), F.length(b), F.lit(1)) / PIECE).cast("int")

    def part(s: Column, i: Column) -> Column:
        def cut(i: Column) -> Column:
            return F.floor(F.length(s).cast("long") * i / n).cast("int") if in_step else i * PIECE

        return F.substring(s, cut(i) + 1, cut(i + 1) - cut(i))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda sum_, i: sum_ + F.levenshtein(part(a, i), part(b, i)))


def _begin_apart(a: Column, b: Column, most: Column, allowances: float) -> Column:
    """Whether the beginnings of two lines show an edit distance over ``most``.

    Both are cut where equal lengths are left. Edits that leave the longer line
    cut d characters from there cost at least d after the cut, so they cost no
    more in all than those that end at the cut on both sides.
    """
    first = F.length(a) <= F.length(b)
    short, long = F.when(first, a).otherwise(b), F.when(first, b).otherwise(a)
    upto = F.ceil(most * allowances).cast("int")
    return F.call_function("levenshtein", F.substring(short, F.lit(1), upto), F.substring(long, F.lit(1), upto + F.length(long) - F.length(short)), most) < 0


def similar_lines(a: Column, b: Column, percent: int, likely: bool = True) -> Column:
    """Edit distance at most (100 - percent) % of the longer line, for lines with words parted by single spaces.

    Of lines that are ``likely`` similar, alignments of words, from either side,
    bound the distance and mostly settle it. Of others, the beginnings mostly
    do, and of long lines counts of letters and distances of pieces. Else the
    distance is worked out.
    """
    most = F.floor(F.greatest(F.length(a), F.length(b)) * (100 - percent) / 100).cast("int")

    def bound(x: Column, y: Column) -> Column:
        return _given(lambda s: _aligned_cost(s["x"], s["y"]), x=F.split(x, " "), y=F.split(y, " "))

    out = F.when((most > LONGER) & _letters_apart(a, b, most), False)
    if likely:
        out = out.when(bound(a, b) <= most, True).when(bound(b, a) <= most, True).when((most > LONG) & _begin_apart(a, b, most, BEGINNINGS[0]), False)
    else:
        for allowances in BEGINNINGS:
            out = out.when(_begin_apart(a, b, most, allowances), False)
    for in_step in (False, True):
        out = out.when((most > PIECES_OVER) & (_pieces_cost(a, b, in_step) <= most), True)
    return out.otherwise(F.call_function("levenshtein", a, b, most) >= 0)


def _links(pairs: DataFrame, found: DataFrame, percent: int, likely: bool = True) -> DataFrame:
    """Those of the pairs (a, b) of line keys that pass the edit check, as most do if ``likely``; ``found`` has the lines' texts, several times if they repeat."""
    wanted = materialise(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "line-wanted")
    # The comparison is always true; it lets the optimizer filter the scan of the lines by the wanted keys.
    texts = found.select("key", "norm").join(wanted.filter(F.col("key") >= F.lit(-(1 << 63))), "key", "left_semi").groupBy("key").agg(F.max("norm").alias("norm"))
    texts = materialise(texts, "line-texts")
    joined = pairs.join(texts.select(F.col("key").alias("a"), F.col("norm").alias("na")), "a").join(texts.select(F.col("key").alias("b"), F.col("norm").alias("nb")), "b")
    return materialise(joined.filter(similar_lines(F.col("na"), F.col("nb"), percent, likely)).select("a", "b"), "line-links")


def line_groups(found: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """(node, root) for each distinct line that is linked and not its group's least key.

    Lines that share a block key are a bucket. Each is compared with the
    bucket's least line, its pivot, which makes no more pairs than keys however
    large the bucket is. Where the links so found leave a bucket's other lines
    in several groups, one line of each group is compared with one of each
    other, and then lines of groups that are still apart with each other. So no
    link of a bucket is lost, and a family of variants isn't listed pair by pair.
    """
    facts = signatures.select("key", "size", "simhash")
    keyed = signatures.select(F.explode("keys").alias("bucket"), "key")
    heads = materialise(keyed.groupBy("bucket").agg(F.min("key").alias("pivot"), F.count("*").alias("lines")).filter("lines > 1"), "line-heads")
    members = materialise(keyed.join(heads.filter("lines > 1").select("bucket", "pivot"), "bucket").filter("key <> pivot"), "line-members")
    star = members.select(F.col("pivot").alias("a"), F.col("key").alias("b")).distinct()
    sides = star.join(facts.select(F.col("key").alias("a"), F.struct("size", "simhash").alias("x")), "a").join(facts.select(F.col("key").alias("b"), F.struct("size", "simhash").alias("y")), "b")
    tried = materialise(sides.filter(near_enough("x", "y", percent)).select("a", "b"), "line-pairs")
    roots = connected_components(_links(tried, found, percent))
    several = members.groupBy("bucket").agg(F.count("*").alias("others")).filter("others > 1").select("bucket")
    others = materialise(members.select("bucket", "key").join(several, "bucket"), "line-others")
    for last in (False, True):
        label = F.coalesce("root", "key").alias("label")
        named = others.join(roots, F.col("key") == F.col("node"), "left").select("bucket", "key", label)
        mixed = named.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("bucket")
        open_ = materialise(named.join(mixed, "bucket"), "line-open")
        chosen = open_ if last else open_.groupBy("bucket", "label").agg(F.min("key").alias("key"))
        rows = materialise(chosen.join(facts, "key"), "line-round")
        both = rows.alias("l").join(rows.alias("r"), F.expr(f"l.bucket = r.bucket and l.label < r.label and {near_enough('l', 'r', percent)}"))
        pairs = both.select(F.least("l.key", "r.key").alias("a"), F.greatest("l.key", "r.key").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
        pairs = materialise(pairs, "line-pairs")
        tried = tried.unionByName(pairs)
        more = _links(pairs, found, percent, likely=False)
        if not more.isEmpty():
            roots = _merged(roots, more)
    return roots


def _merged(roots: DataFrame, more: DataFrame) -> DataFrame:
    """(node, root) of the components that ``more`` links join; only the roots of those are searched again."""
    ends = more
    for side in ("a", "b"):
        ends = ends.join(roots, F.col(side) == F.col("node"), "left").withColumn(side, F.coalesce("root", side)).select("a", "b")
    moved = connected_components(ends)
    now = moved.select(F.col("node").alias("root"), F.col("root").alias("least"))
    return materialise(roots.join(now, "root", "left").select("node", F.coalesce("least", "root").alias("root")).unionByName(moved), "line-roots")


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, least_words: int = 5) -> DataFrame:
    """(id, removed, kept_in): for each document that loses lines, their places and the documents that keep them.

    A line takes part if it has ``least_words`` words; shorter ones always
    stay. Lines are compared in lower case, without anything but letters, marks
    and digits, and with single spaces for blanks. Two lines are linked when
    they share a block key, their SimHashes differ in at most ``REACH`` bits
    (``SHORT_REACH`` in short lines) and their edit distance is at most 100 - ``percent`` % of the longer one.
    Of a connected group, the occurrence with the least id, then place, stays.
    Null and empty texts and rows with a null id lose nothing. Rows that share an id are one document: they lose the same
    places. Lines may have any length; equal ones are joined by a 64-bit hash.
    """
    filter_scans(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    with shuffles_dropped(docs.sparkSession):
        found = materialise(_occurrences(rows, least_words), "lines")
        lines = found.groupBy("key").agg(F.max("norm").alias("norm"))
        groups = line_groups(found, materialise(_signatures(lines), "line-signatures"), percent)
        placed = found.select("id", "pos", "key").join(groups, F.col("key") == F.col("node"), "left").select("id", "pos", F.coalesce("root", "key").alias("label"))
        placed = materialise(placed, "line-places")
    several = placed.groupBy("label").agg(F.min(F.struct("id", "pos")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("label", "first")
    gone = placed.join(several, "label").filter("id <> first.id or pos <> first.pos").select("id", "pos", F.col("first.id").alias("kept"))
    return gone.groupBy("id").agg(F.sort_array(F.collect_set("pos")).alias("removed"), F.sort_array(F.collect_set("kept")).alias("kept_in")).withColumnRenamed("id", id_col)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, least_words: int = 5) -> DataFrame:
    """``docs`` with the lines of ``removed_lines`` taken out of the texts; a document that loses all its words goes.

    All columns stay as they are but the text.
    """
    gone = removed_lines(docs, id_col, text_col, percent, least_words).select(F.col(id_col).alias("_id"), F.col("removed").alias("_removed"))
    lines = F.split(F.col(text_col), "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_removed"))
    text = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    joined = docs.join(gone, docs[id_col] == F.col("_id"), "left").withColumn(text_col, F.when(F.col("_removed").isNull(), F.col(text_col)).otherwise(text))
    return joined.filter(F.col("_removed").isNull() | F.col(text_col).rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, n_lines, n_removed, removed (places), kept_in (ids of documents that keep the lines)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    gone = removed_lines(docs).withColumnRenamed("doc_id", "id")
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    counted = docs.select("doc_id", F.coalesce(breaks + 1, F.lit(0)).cast("int").alias("n_lines"))
    none = F.array().cast("array<int>")
    return counted.join(gone, F.col("doc_id") == F.col("id"), "left").select(
        "doc_id",
        "n_lines",
        F.size(F.coalesce("removed", none)).alias("n_removed"),
        F.coalesce("removed", none).alias("removed"),
        F.coalesce("kept_in", F.array().cast("array<bigint>")).alias("kept_in"),
    )
