"""Scans, positions, batches, footers and Arrow results on generated files, against plain Python."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lamella import cli
from lamella.errors import BackwardRead, BridgeTypeError, ColumnNotFound, NotParquet
from lamella.functions.predicates import BoolEq, FloatRange, IntRange
from lamella.operators import arrow_io, position, ranges, zonemap
from lamella.operators.ranges import RowRange, RowRangeSet
from lamella.plans import inspect
from lamella.sources import metadata
from lamella.sources.parquet import FILE, ROW, scan, with_position
from lamella.streaming.file_stream import stream_scan

ROWS, GROUP = 5000, 1500
LADDER = {"boolean": BoolEq(True), "int": IntRange(100, 900_000, True), "float": FloatRange(200.0, 800_000.0), "bigint": IntRange(300, 700_000, True), "double": FloatRange(400.0, 600_000.0)}


def is_null(i, nulls):
    return nulls and (i % 5 == 0 or i % 17 == 0)


def row(i, dictionary, nulls):
    v = i % 1000 if dictionary else i
    values = {"boolean": i % 4 == 0, "int": v, "bigint": v, "float": float(v), "double": float(v), "string": str(v).encode()}
    return {k: None if is_null(i, nulls) else x for k, x in values.items()}


@pytest.fixture(scope="session")
def make(tmp_path_factory):
    made = {}
    kinds = {"boolean": pa.bool_(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64(), "string": pa.binary()}

    def build(dictionary=False, nulls=False, codec="snappy"):
        key = (dictionary, nulls, codec)
        if key not in made:
            rows = [row(i, dictionary, nulls) for i in range(ROWS)]
            table = pa.table({k: pa.array([r[k] for r in rows], t) for k, t in kinds.items()})
            path = str(tmp_path_factory.mktemp("f") / "t.parquet")
            pq.write_table(table, path, row_group_size=GROUP, use_dictionary=dictionary, compression=codec, data_page_size=4096)
            made[key] = path
        return made[key]

    return build


def expected(filters, dictionary, nulls):
    def passes(i):
        r = row(i, dictionary, nulls)
        for c, f in filters.items():
            v = r[c]
            ok = f.null_allowed if v is None else v == f.value if isinstance(f, BoolEq) else f.lower <= v <= f.upper if isinstance(f, IntRange) else f.lower < v < f.upper
            if not ok:
                return False
        return True

    return [i for i in range(ROWS) if passes(i)]


@pytest.mark.parametrize("codec", ["none", "snappy", "gzip"])
@pytest.mark.parametrize("nulls", [False, True])
@pytest.mark.parametrize("dictionary", [False, True])
def test_filter_ladder_is_sound_and_complete(spark, make, dictionary, nulls, codec):
    path = make(dictionary, nulls, codec)
    for n in range(len(LADDER) + 1):
        filters = dict(list(LADDER.items())[:n])
        got = sorted(scan(spark, path, ["int", "string"], filters, position=True).collect(), key=lambda r: r[ROW])
        want = expected(filters, dictionary, nulls)
        assert [r[ROW] for r in got] == want
        for r in got:
            v = row(r[ROW], dictionary, nulls)
            assert (r["int"], r["string"]) == (v["int"], None if v["string"] is None else bytearray(v["string"]))


def test_projection_and_names(spark, make):
    path = make()
    assert scan(spark, path, ["string", "int"]).columns == ["string", "int"]
    assert scan(spark, path, {"double": None, "int": IntRange(1, 3)}).count() == 3
    assert scan(spark, path, []).columns == [] and scan(spark, path, []).count() == ROWS
    for bad in ("INT", "nothing"):
        with pytest.raises(ColumnNotFound):
            scan(spark, path, [bad])
    with pytest.raises(NotImplementedError):
        scan(spark, path, {"string": IntRange(0, 1)})


def test_only_what_is_asked_for_is_read(spark, make):
    path = make()
    df = scan(spark, path, ["int"], {"bigint": IntRange(3100, 3150)})
    assert "bigint:bigint" in inspect.read_schema(df) and "string" not in inspect.read_schema(df)
    assert "GreaterThanOrEqual(bigint,3100)" in inspect.pushed_filters(df)
    assert inspect.exchanges(df) == 0
    assert inspect.scan_output_rows(df) < ROWS - GROUP  # row groups out of range are not read
    nan_safe = scan(spark, path, ["double"], {"double": FloatRange(4000.0, upper_bounded=False, null_allowed=True)})
    assert "Infinity" in inspect.pushed_filters(nan_safe) and "IsNull(double)" in inspect.pushed_filters(nan_safe)


def test_positions(spark, make):
    df = scan(spark, make(), ["int"], position=True)
    assert [r["int"] for r in position.skip(df, ROWS - 2).orderBy(ROW).collect()] == [ROWS - 2, ROWS - 1]
    assert position.skip(df, ROWS + 1).count() == 0
    assert [r["int"] for r in position.row_range(df, 10, 13).orderBy(ROW).collect()] == [10, 11, 12]
    some = scan(spark, make(), ["int"], {"boolean": BoolEq(True)}, position=True)
    assert sorted(r["int"] for r in position.point_query(some, 5, 3).collect()) == [8, 12, 16]
    assert position.remaining(df, 4990).first()["remaining"] == 10
    for bad in (0, -1):
        with pytest.raises(ValueError, match="positive"):
            position.batch_number(bad)
    with pytest.raises(ValueError, match="negative"):
        position.skip(df, -1)


def test_point_query_is_per_file(spark, make):
    df = scan(spark, [make(), make(True)], ["int"], position=True)
    assert position.point_query(df, 10, 4).count() == 8


def test_batches_begin_anew_in_row_groups(spark, make):
    df = position.with_row_group_batches(spark, scan(spark, make(), ["int"], position=True), 1000)
    got = {(r["_row_group"], r["_batch"]): r["count"] for r in df.groupBy("_row_group", "_batch").count().collect()}
    assert got == {(0, 0): 1000, (0, 1): 500, (1, 0): 1000, (1, 1): 500, (2, 0): 1000, (2, 1): 500, (3, 0): 500}


def test_islands_match_the_generator(spark, make):
    df = scan(spark, make(nulls=True), ["int"], {"boolean": BoolEq(True, True)}, position=True)
    got = sorted((r["begin"], r["end"]) for r in ranges.islands(df).collect())
    matches = [is_null(i, True) or i % 4 == 0 for i in range(ROWS)]
    assert got == [(r.begin, r.end) for r in RowRangeSet.of_matches(matches).ranges]


def test_range_algebra_examples(spark):
    r = RowRange(1, 10)
    assert (r.covered(5, 7, 10), r.left_of(5, 7, 10), r.right_of(5, 7, 10)) == (RowRange(2, 5), RowRange(1, 2), RowRange(5, 10))
    assert r.covered(0, 20, 30) is None and r.left_of(0, 20, 30) == r and r.right_of(0, 20, 30) is None
    assert r.right_of(20, 1, 5) == r and r.length() == 9
    for f in (r.covered, r.left_of, r.right_of):
        with pytest.raises(ValueError, match="bounds"):
            f(0, 5, 5)
    runs = RowRangeSet.of_matches([c == "T" for c in "FTFFTTFTT"])
    assert [(x.begin, x.end) for x in runs.ranges] == [(1, 2), (4, 6), (7, 9)] and list(runs) == [1, 4, 5, 7, 8]
    with pytest.raises(ValueError, match="order"):
        runs.add(RowRange(8, 12))
    df = spark.createDataFrame([(1, 10), (20, 30)], "b long, e long")
    cells = df.select(ranges.covered(F.col("b"), F.col("e"), F.lit(5), F.lit(8)), ranges.left_of(F.col("b"), F.col("e"), F.lit(5)), ranges.right_of(F.col("b"), F.col("e"), F.lit(8))).collect()
    assert [[None if x is None else tuple(x) for x in c] for c in cells] == [[(5, 8), (1, 5), (8, 10)], [None, None, (20, 30)]]


def test_transfer_and_lookup(spark, make):
    df = scan(spark, make(nulls=True), ["int"], position=True)
    few = df.filter(ranges.rows_in([RowRange(3, 5), RowRange(9, 10)]))
    assert sorted(r[ROW] for r in ranges.transfer(df, few).collect()) == [3, 4, 9]
    assert tuple(ranges.lookup(df, "int", 3, F.lit(0)).first()) == (True, 3)
    assert tuple(ranges.lookup(df, "int", 5, F.lit(0)).first()) == (False, 0)
    assert ranges.lookup(few, "int", 5, F.lit(0)).count() == 0


def test_zone_maps_and_dictionaries(spark, make):
    df = scan(spark, make(True, True), ["int"], position=True)
    zones = zonemap.zone_map(df, "int", 250, IntRange(0, 10)).collect()
    assert {r["batch"] for r in zones if r["may_match"]} == {b for b in range(20) if any(not is_null(i, True) and i % 1000 <= 10 for i in range(b * 250, b * 250 + 250))}
    verdicts = {r["value"]: (r["selected"], r["rows"]) for r in zonemap.dictionary_selectivity(df, "int", IntRange(1, 2, True)).collect()}
    assert verdicts[None][0] and verdicts[1][0] and not verdicts[3][0] and sum(n for _, n in verdicts.values()) == ROWS


def test_footer(spark, make, tmp_path):
    f = metadata.footer(spark, make(True, True, "gzip"))
    assert [g.rows for g in f.row_groups] == [1500, 1500, 1500, 500] and [g.first_row for g in f.row_groups] == [0, 1500, 3000, 4500]
    by_name = {c.path[0]: c for c in f.columns}
    assert by_name["int"].physical_type == "INT32" and by_name["string"].physical_type == "BINARY" and by_name["int"].max_def == 1
    chunk = f.row_groups[0].columns[by_name["bigint"].index]
    assert (chunk.codec, chunk.least, chunk.greatest, chunk.dictionary_page is not None) == ("GZIP", "1", "999", True)
    with pytest.raises(FileNotFoundError):
        metadata.footer(spark, str(tmp_path / "none.parquet"))
    (tmp_path / "text").write_text("this is not a parquet file at all")
    with pytest.raises(NotParquet):
        metadata.footer(spark, str(tmp_path / "text"))


def test_levels_of_nested_columns(spark, tmp_path):
    path = str(tmp_path / "n.parquet")
    t = pa.struct([pa.field("x", pa.int32(), nullable=False)])
    table = pa.table({"l": pa.array([[1], None], pa.list_(pa.int64())), "m": pa.array([[("a", 1)], []], pa.map_(pa.string(), pa.int32())), "s": pa.array([{"x": 1}, None], t)})
    pq.write_table(table, path)
    got = {c.path[0] + ("." + c.path[-1] if len(c.path) > 1 else ""): (c.max_def, c.max_rep) for c in metadata.footer(spark, path).columns}
    assert got == {"l.element": (3, 1), "m.key": (2, 1), "m.value": (3, 1), "s.x": (1, 0)}
    tree = metadata.schema_tree(spark.read.parquet(path).schema)
    assert tree["l.element"] == (3, 1) and tree["m.value"] == (3, 1) and tree["s.x"] == (2, 0)


def test_readable_encodings(spark, tmp_path):
    table = pa.table({"a": pa.array([1, None, 3], pa.int64()), "s": pa.array(["", None, "x"]), "n": pa.array([None] * 3, pa.int32())})
    for i, options in enumerate([{"data_page_version": "2.0"}, {"use_dictionary": False, "column_encoding": {"a": "DELTA_BINARY_PACKED"}}, {"compression": "zstd"}, {"compression": "lz4"}]):
        path = str(tmp_path / f"{i}.parquet")
        pq.write_table(table, path, **options)
        assert [tuple(r) for r in scan(spark, path).collect()] == [(1, "", None), (None, None, None), (3, "x", None)]


def test_empty_file(spark, tmp_path):
    path = str(tmp_path / "e.parquet")
    pq.write_table(pa.table({"a": pa.array([], pa.int32())}), path)
    df = scan(spark, path, ["a"], {"a": IntRange(0, 9)}, position=True)
    assert df.count() == 0 and ranges.islands(df).count() == 0 and metadata.footer(spark, path).rows == 0
    assert arrow_io.BatchReader(df, 0).finished


def test_batch_reader(spark, make):
    reader = arrow_io.BatchReader(scan(spark, make(), ["int"], {"boolean": BoolEq(True)}, position=True), ROWS)
    assert reader.read(10).column("int").to_pylist() == [0, 4, 8]
    assert not reader.skip(1990) and reader.remaining() == 3000
    tables = list(reader.batches(2000))
    assert [t.num_rows for t in tables] == [500, 250] and reader.finished and reader.skip(1)
    with pytest.raises(ValueError, match="positive"):
        reader.read(0)
    with pytest.raises(BackwardRead):
        reader.skip(-1)


def test_typed_columns(spark, make):
    c = arrow_io.columns_of(position.row_range(scan(spark, make(nulls=True), ["int", "string"], position=True), 0, 20).orderBy(ROW).drop(FILE, ROW))
    ints = c["int"]
    assert len(ints) == 20 and ints.may_have_null and ints.value_at(1) == (True, 1) and ints.value_at(0, 0) == (False, 0)
    assert ints.arrow(pa.int32()).to_pylist()[1:4] == [1, 2, 3] and c["string"].arrow(pa.binary())[1].as_py() == b"1"
    assert ints.at_rows([1, 4, 7]).values.to_pylist() == [1, 4, 7]
    with pytest.raises(BridgeTypeError):
        ints.arrow(pa.int64())
    with pytest.raises(BridgeTypeError):
        ints.as_nullable()
    with pytest.raises(IndexError):
        ints.value_at(20)
    full = arrow_io.TypedColumn("x", pa.array([1, 2], pa.int32()))
    assert not full.may_have_null and full.as_nullable().append([None]).values.null_count == 1
    with pytest.raises(BridgeTypeError):
        full.append([None])
    assert str(arrow_io.TypedColumn("x", pa.array(range(12)))).endswith("9, ...]") and arrow_io.TypedColumn("x", pa.array([])).is_empty()


def test_map_arrow(spark, make):
    def double(batch):
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(batch.column("int")) * 2)], ["twice"])

    assert arrow_io.map_arrow(scan(spark, make(), ["int"]), double, "twice int").agg(F.sum("twice")).first()[0] == ROWS * (ROWS - 1)


def test_stream_of_files(spark, make, tmp_path):
    for i, part in enumerate((make(), make(True))):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.parquet").write_bytes(open(part, "rb").read())
    schema = spark.read.parquet(make()).schema
    q = stream_scan(spark, str(tmp_path / "in"), schema, ["int"], {"int": IntRange(0, 9)}).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("seen").count() == 10 + 50 and len([p for p in q.recentProgress if p["numInputRows"]]) == 2


def test_command_line(spark, make, capsys):
    assert cli.parse_list(";a;;b;") == ["a", "b"]
    cli.main(["-f", f"{make()};{make(True)}", "-c", "int;double"], spark)
    assert capsys.readouterr().out.count("Time: ") == 3
    cli.main(["-p", "-s", "7", "-l", "2", "-f", make(), "-c", "int"], spark)
    out = capsys.readouterr().out
    assert "|7  |" in out and "|8  |" in out and "|9  |" not in out
    with pytest.raises(SystemExit):
        cli.main(["-f", make(), "-l", "0"], spark)


def test_positions_agree_with_row_numbers(spark, make):
    assert with_position(spark.read.parquet(make())).filter(F.col("int") != F.col(ROW)).count() == 0


def test_row_groups_outside_the_range_are_not_read(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from lamella.sources import row_groups

    for name, n in (("a", 1000), ("b", 130)):
        table = pa.table({"i": pa.array(range(n), pa.int64()), "s": [None if i % 5 == 0 else f"v{i}" for i in range(n)], "t": pa.array([i * 1000 for i in range(n)], pa.timestamp("us"))})
        pq.write_table(table, tmp_path / f"{name}.parquet", row_group_size=100)
    paths = [f"file://{tmp_path}/{x}.parquet" for x in "ab"]
    assert len(row_groups.row_groups(spark, paths)) == 12
    df = row_groups.scan_rows(spark, paths, 120, 305, ["t", "i", "s"])
    want = scan(spark, paths, ["t", "i", "s"], position=True).filter("_row >= 120 and _row < 305")
    assert df.columns == want.columns and sorted(map(str, df.collect())) == sorted(map(str, want.collect()))
    # Damage in row groups outside the range isn't met.
    data = bytearray((tmp_path / "a.parquet").read_bytes())
    start = metadata.footer(spark, paths[0]).row_groups[7].offset
    data[start : start + 200] = b"\0" * 200
    (tmp_path / "c.parquet").write_bytes(bytes(data))
    assert row_groups.scan_rows(spark, f"file://{tmp_path}/c.parquet", 0, 250, ["i"]).count() == 250
    assert row_groups.scan_rows(spark, paths, 5000, 6000).count() == 0 and row_groups.scan_rows(spark, paths, 10, 10).count() == 0
    batches = position.with_row_group_batches(spark, scan(spark, paths, ["i"], position=True), 64)
    got = {(r["_row_group"], r["_batch"]): r["n"] for r in batches.groupBy("_row_group", "_batch").agg(F.count("*").alias("n")).collect()}
    assert got[0, 0] == 128 and got[0, 1] == 72 and got[1, 0] == 64 + 30 and got[9, 1] == 36


def test_runs_across_chunks(spark):
    hits = [i for i in range(500) if not (i % 37 == 0 or 120 <= i < 260)]
    df = spark.createDataFrame([("f", i) for i in hits] + [("g", i) for i in range(0, 40)], "`_file` string, `_row` long")
    want = {("f", r.begin, r.end) for r in ranges.RowRangeSet.of_matches([i in set(hits) for i in range(500)]).ranges} | {("g", 0, 40)}
    for chunk in (1, 7, 64, 1 << 20):
        assert {(r["_file"], r.begin, r.end) for r in ranges.islands(df, chunk).collect()} == want


def test_zone_maps_of_another_kind_match_nothing():
    from pyspark.sql import types as T

    assert not IntRange(0, 5, null_allowed=True).may_match(1.0, 2.0, True, T.DoubleType())
    assert not FloatRange(0.0, 5.0, null_allowed=True).may_match(1, 2, True, T.LongType())
    assert not BoolEq(True, True).may_match(1, 2, True, T.LongType())
    assert BoolEq(True).may_match(False, True, False, T.BooleanType()) and not BoolEq(True).may_match(False, False, True, T.BooleanType())
    assert BoolEq(True, True).may_match(None, None, True, T.BooleanType())


def test_footers_name_the_indexes(spark, tmp_path):
    table = pa.table({"i": pa.array(range(500), pa.int64())})
    found = {}
    for name in (True, False):
        pq.write_table(table, tmp_path / f"{name}.parquet", write_page_index=name)
        found[name] = metadata.footer(spark, f"{tmp_path}/{name}.parquet").row_groups[0].columns[0]
    spark.range(500).write.option("parquet.bloom.filter.enabled#id", "true").option("parquet.enable.dictionary", "false").parquet(f"{tmp_path}/bloom")
    files = spark.read.parquet(f"{tmp_path}/bloom").inputFiles()
    bloomed = [c.bloom_filter for f in files for g in metadata.footer(spark, f).row_groups for c in g.columns]
    assert found[True].column_index > 0 and found[True].offset_index > 0 and found[True].bloom_filter is None
    assert found[False].column_index is None and found[False].offset_index is None
    assert bloomed and all(x > 0 for x in bloomed)
