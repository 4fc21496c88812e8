"""URL filters, WARC archives, chat formatting and the pipeline."""

from __future__ import annotations

import gzip
import hashlib
import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lamella.llm import bloom, chat_format, url_filter, warc
from lamella.llm.url_filter import Rule
from tests.llm.helpers import prose

URLS = [
    "http://www.Bad.example.org/a/?x=1", "https://bad.example.org/a#f", "https://bad.example.org/b", "http://a.example.com/en/1", "http://example.com/en/", "https://x.www.example.com/en/2",
    "http://notexample.com/en/", "http://q.net/fr/1", "http://net/es/", "no scheme", "", None, "http://", "mailto:a://b.net/es/c", "http://only.host.com", "HTTP://UP.NET/fr/x?y://z",
]


def judged(url, rules, listed):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, rest = rest[:end], rest[end:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host) + len(r.path), default=None)
    key = host.removeprefix("www.") + path.rstrip("/")
    if best:
        return host, path, best.host + best.path, best.verdict
    return host, path, None, "block" if key and key in listed else "allow"


@pytest.mark.parametrize("most_bytes", [64, 1 << 20])
def test_url_verdicts(spark, most_bytes):
    rows = list(enumerate(URLS)) + [(0, URLS[0]), (None, URLS[1])]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({"key": F.lit(1), "host": F.lit(2), "hit": F.lit(3), "id": F.lit(4)})
    listed = spark.createDataFrame([("https://bad.example.org/a/",), (None,), ("x://y/z",), ("x://y/z/",)], "url string")
    got = url_filter.judge(df, listed, url_filter.RULES, most_bytes=most_bytes).collect()
    want = [(i, *judged(u, url_filter.RULES, {"bad.example.org/a", "y/z"})) for i, u in rows]
    assert sorted(map(str, want)) == sorted(str((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in got)
    none = url_filter.judge(df, listed.limit(0), [Rule("block", "net", "/")])
    assert none.filter("verdict = 'block' and rule is null").count() == 0
    assert url_filter.judge(df.limit(0), listed).count() == 0


def test_bloom_filter_misses_nothing(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    others = spark.range(5000).select(F.concat(F.lit("o"), "id").alias("key"))
    for size in (256, 1 << 20):
        table = bloom.bloom_filter(keys, "key", 5000, most_bytes=size)
        assert table.nbytes <= size and bloom.probe(keys, "key", table).filter("not maybe").count() == 0
    assert bloom.probe(others, "key", table, keep_all=False).count() < 100


def test_archive_round_trip(spark):
    rng = random.Random(3)
    big = [prose(rng, 300) + " é<ß>" for _ in range(20)]
    rows = [(i, f"http://h{i % 5}.example.org/p/{i % 9}?q={i % 3}", rng.choice(big) if i % 2 else f"short {i % 4}") for i in range(400)]
    rows += [(1000, None, None), (1001, "", ""), (1002, "no scheme\r\nX: 1", "x" * 2_000_000), (1003, "http://h/ü é", "y"), (1004, rows[3][1], "x" * 2_000_000), (1004, rows[3][1], "x" * 2_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"id": F.lit(1), "key": F.lit(2), "digest": F.lit(3), "payload": F.lit(4), "file": F.lit(5)})
    captures, parts, root = warc.archive(pages.repartition(6))
    asked = captures.select("key", "capture").distinct()
    got = warc.read_captures(asked, parts, root, 3).collect()
    owner = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000:
            owner[h] = max(i, owner.get(h, i))
    want = []
    for i, _, h in rows:
        raw, o = (h or "").encode(), owner.get(h)
        revisit = o is not None and o != i
        want.append((str(i), "revisit" if revisit else "response", str(o) if revisit else None, hashlib.sha1(raw).hexdigest(), len(raw), b"" if revisit else raw))
    assert sorted(map(str, want)) == sorted(str((r.capture, r.kind, r.refers_to, r.digest, r.length, bytes(r.payload))) for r in got)
    files = {r.file for r in captures.collect()}
    folder = Path(root.removeprefix("file://").removeprefix("file:"))
    whole = b"".join(gzip.decompress((folder / f).read_bytes()) for f in files)
    assert whole.count(b"WARC/1.1\r\n") == len(rows) and b"\r\nX: 1\r\n" not in whole
    missing = spark.createDataFrame([("zzz", "1"), ("", "none")], "key string, capture string")
    assert warc.read_captures(missing, parts, root, 2).count() == 0


def test_rows_that_share_an_id_are_records_of_their_own(spark):
    a, b = "a" * 1200, "b" * 1500
    rows = [(5, "http://x/1", a), (9, "http://x/2", a), (5, "http://x/3", b), (12, "http://x/4", b), (7, "http://x/5", "short")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"id": F.lit(0), "digest": F.lit("d"), "owner": F.lit(1), "key": F.lit("k")})
    captures, parts, root = warc.archive(df)
    asked = captures.select("key", "capture").distinct()
    got = sorted((r.capture, r.kind, r.refers_to, r.length) for r in warc.read_captures(asked, parts, root, 3).collect())
    assert got == [("12", "response", None, 1500), ("5", "revisit", "12", 1500), ("5", "revisit", "9", 1200), ("7", "response", None, 5), ("9", "response", None, 1200)]


def test_index_search_crosses_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    rows = [("k%03d" % (i // 7), str(i // 7), f"f{i}", i, 1) for i in range(100)]
    captures = spark.createDataFrame(rows, "key string, capture string, file string, offset long, length long")
    root = warc.scratch_path(spark, "test-index")
    warc._store(root)[0].create_dir(warc._store(root)[1], recursive=True)
    parts = sorted((r.key.encode(), r.capture.encode(), r.part) for r in warc.build_index(captures, root, 4).collect())
    index = warc.Index(root, parts)
    for k in range(15):
        assert sorted(p[1] for p in index.find("k%03d" % k, str(k))) == [i for i in range(100) if i // 7 == k]
    assert list(index.find("k000", "1")) == [] and list(index.find("a", "")) == []


def test_archive_of_nothing(spark):
    captures, parts, root = warc.archive(spark.createDataFrame([], "page_id long, url string, html string"))
    assert captures.count() == 0 and warc.read_captures(captures.select("key", "capture"), parts, root, 2).count() == 0


def test_damaged_records_are_noticed():
    good = warc.record_bytes("1", "http://a/", b"payload", hashlib.sha1(b"payload").hexdigest(), None, "2000-01-01T00:00:00Z")
    assert warc.parse_record(good).payload == b"payload"
    bad = warc.record_bytes("1", "http://a/", b"payload", hashlib.sha1(b"other").hexdigest(), None, "2000-01-01T00:00:00Z")
    with pytest.raises(ValueError, match="damaged"):
        warc.parse_record(bad)


TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "one"), (1, 2, "user", "more"), (1, 3, "assistant", "yes"),
    (2, 0, "user", "hi"), (2, 1, "assistant", "one"), (2, 2, "user", "else"), (2, 3, "assistant", "no"),
    (3, 0, "user", "hi"), (3, 1, "assistant", "one"), (4, 0, None, None), (4, 1, "assistant", ""), (5, 0, "user", "hi"), (5, 0, "user", "hi"), (None, 0, "user", "lost"),
]


def test_preference_formatting(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumns({"conv": F.lit(1), "n": F.lit(2), "c": F.lit(3), "turns": F.lit(4)})
    pairs = spark.createDataFrame([(1, 2), (1, 3), (3, 3), (4, 1), (5, 3), (1, 99), (None, 1), (1, 2)], "chosen_id long, rejected_id long")
    got = [r for r in chat_format.format_preferences(turns.repartition(3), pairs).collect()]
    assert sorted((r.chosen_id, r.rejected_id, r.n_prompt_turns) for r in got) == [(1, 2, 2), (1, 2, 2), (1, 3, 2), (3, 3, 2), (4, 1, 0), (5, 3, 1)]
    by = {(r.chosen_id, r.rejected_id): r for r in got}
    one = by[1, 2]
    assert one.prompt == "<|user|>\nhi<|end|>\n<|assistant|>\none<|end|>\n" and one.chosen == "<|user|>\nmore<|end|>\n<|assistant|>\nyes<|end|>\n"
    for r in got:
        for text, mask in ((r.chosen, r.chosen_mask), (r.rejected, r.rejected_mask)):
            assert all(text[: s.start].endswith("<|assistant|>\n") and text[s.start : s.start + s.length].endswith("<|end|>\n") for s in mask)
            assert len(mask) == text.count("<|assistant|>")
    assert by[1, 3].rejected == "" and by[1, 3].rejected_mask == [] and by[3, 3].chosen == ""
    assert chat_format.format_preferences(turns.limit(0), pairs).count() == 0 and chat_format.format_preferences(turns, pairs.limit(0)).count() == 0


def test_each_conversation_is_paired_with_another_answer(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumns({"conv": F.lit(1), "last": F.lit(2), "r": F.lit(3), "answer": F.lit("x")})
    whole = chat_format.conversations_of(turns, "conv_id", "turn", "role", "text")
    got = {r.c: r for r in chat_format.format_turns(chat_format.with_other_answers(whole)).collect()}
    assert {c: (r.r, r.n_prompt_turns) for c, r in got.items()} == {1: (None, 3), 2: (3, 3), 3: (2, 1), 4: (5, 2), 5: (4, 2)}
    assert got[2].chosen == "<|assistant|>\nno<|end|>\n" and got[2].rejected == "<|assistant|>\none<|end|>\n" and got[1].rejected == "<|assistant|>\n<|end|>\n"
    assert got[3].rejected_mask[0].length == len("no<|end|>\n") and got[5].chosen == got[5].rejected == ""


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables here")
def test_pipeline_stages_work_on_what_is_left(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns
        path = warc.scratch_path(spark, f"test-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        after = [r.doc_id for r in docs.select("doc_id").collect()]
        assert set(after) <= before and len(after) == len(set(after))
        before = set(after)
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    # Nulls, empty and repeated rows, and columns with the operators' own names.
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "w " * 50, "en", "s", 5), (2, "", "en", "s", 0), (3, "same words here " * 20, "en", "s", 1), (3, "same words here " * 20, "en", "s", 1)], spark.read.parquet(f"{SF}/documents.parquet").schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
        odd = odd.unionByName(docs.limit(30).select(*docs.columns)) if _ == "quality_rules" else odd
        if _ != "mixing":
            odd = spark.createDataFrame(stage(spark, odd.withColumns({"id": F.lit(0), "key": F.lit(1), "norm": F.lit("x"), "stratum": F.lit("y"), "label": F.lit(2)}), SF).select(*docs.columns).collect(), docs.schema)
    assert {r.doc_id for r in mixed.collect()} <= before
    assert corpus_pipeline.run(spark, SF).count() == mixed.count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables here")
def test_queries_with_sql_match_it(spark):
    import duckdb

    from lamella.llm import registry

    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    plain = lambda v: f"{v:.8g}" if isinstance(v, float) else str(v)
    for name, sql in registry.oracle_sql().items():
        got, want = registry.queries()[name](spark, SF), con.sql(sql)
        assert sorted(got.columns) == sorted(want.columns), name
        order = [list(want.columns).index(c) for c in got.columns]
        assert sorted([plain(v) for v in r] for r in got.collect()) == sorted([plain(r[i]) for i in order] for r in want.fetchall()), name


def test_scratch_tables_can_be_dropped(spark):
    from lamella.llm import common

    path = common.scratch_path(spark, "test-drop")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    assert common.drop_scratch(spark) >= 1 and not os.path.exists(path.removeprefix("file://").removeprefix("file:"))
    assert common.scratch_root(spark) == common.scratch_root(spark)


def test_records_read_back_are_held_a_few_at_once():
    taken = []

    def records():
        for i in range(10):
            taken.append(i)
            yield warc.Record(str(i), "response", None, "", 6 << 20, b"x" * (6 << 20))

    runs = []
    for held in warc.by_bytes(records()):
        runs.append([r.capture for r in held])
        assert len(taken) == sum(map(len, runs)) and len(held) <= 3
    assert sum(runs, []) == [str(i) for i in range(10)] and list(warc.by_bytes([])) == []
