"""Every query of the matrix engine against its SQL in DuckDB."""

import os

import duckdb
import pytest

from linkspan.operators import ingest, query
from linkspan.operators.matrix import dense_cells
from linkspan.queries import ORACLES, QUERIES, _stored

DATA = "/root/testdata/sf0.001"


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda x: repr(round(x, 9)) if isinstance(x, float) else str(x)
    return sorted(columns), sorted(tuple(show(r[i]) for i in order) for r in values)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, duck, name):
    frame = QUERIES[name](spark, DATA)
    found = duck.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    assert rows(frame.columns, [tuple(r) for r in frame.collect()]) == rows(columns, found.fetchall())


@pytest.mark.parametrize(("name", "column"), [("square_bad_variants", "idx"), ("square_min_filter", "row"), ("ingest_square", "row"), ("pairwise_multi", "row"), ("concat_overlap_entries", "row"), ("concat_variants", "idx"), ("overlap_boundaries", "place_end")])
def test_queries_reach_the_last_variants(spark, duck, name, column):
    n = duck.execute("SELECT count(*) FROM embeddings").fetchone()[0]
    got = {r[column] for r in QUERIES[name](spark, DATA).collect()}
    bad = len(range(0, n, 37))  # of a square, every 37th variant
    if name == "overlap_boundaries":
        assert max(got) == n
    else:
        want = {"square_bad_variants": {i for i in range(n) if i % 37}, "ingest_square": set(range(n - bad))}
        assert got == want.get(name, set(range(n)))


def test_small_requests_reach_the_scan(spark):
    """Predicates on columns and rows are pushed down, and no entry is shuffled before it was asked for."""
    m = _stored(spark, DATA)
    asked = spark.createDataFrame([(0, 8, 3), (1, 3, 5)], "ord long, row long, col long")
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    try:
        plan = query.pairwise_at(m, asked, ["D"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    scan = next(x for x in plan.split("\n") if "FileScan" in x)
    assert "In(col, [3,5])" in scan and "GreaterThanOrEqual(row,3)" in scan and "LessThanOrEqual(row,8)" in scan
    assert scan.split("ReadSchema: ")[1].startswith("struct<col:bigint,row:bigint,D:") and "LeftSemi, BuildRight" in plan


def _shuffled(spark, frame):
    """Rows that the stages of a run of frame write for a shuffle."""
    context = spark.sparkContext
    jvm, store = context._jvm, context._jsc.sc().statusStore()

    def stages():
        context._jsc.sc().listenerBus().waitUntilEmpty()
        found = store.stageList(None, False, False, context._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {found.apply(k).stageId(): found.apply(k).shuffleWriteRecords() for k in range(found.size())}

    last = max(stages(), default=-1)
    frame.write.format("noop").mode("overwrite").save()
    return sum(n for k, n in stages().items() if k > last)


@pytest.mark.parametrize("name", ["densify_square", "square_bad_variants", "square_min_filter", "ingest_square"])
def test_no_disk_holds_all_cells(spark, duck, name):
    """Stored entries are shuffled, not the n * n cells."""
    n = duck.execute("SELECT count(*) FROM embeddings").fetchone()[0]
    assert 0 < _shuffled(spark, QUERIES[name](spark, DATA)) < n * n / 4


@pytest.mark.parametrize("name", ["densify_square", "square_bad_variants", "square_min_filter", "ingest_square"])
def test_squares_of_odd_vectors_equal_sql(spark, name, tmp_path):
    """Vectors without variance among the first and last ones and one of its like, so that correlations are not numbers."""
    con = duckdb.connect()
    con.execute(f"CREATE TABLE embeddings AS SELECT vec_id, CASE WHEN vec_id IN (0, 1, 2, 38, 39, 89) THEN [0::FLOAT for x in embedding] WHEN vec_id IN (50, 51) THEN (SELECT embedding FROM read_parquet('{DATA}/embeddings.parquet') WHERE vec_id = 7) ELSE embedding END AS embedding FROM read_parquet('{DATA}/embeddings.parquet') WHERE vec_id < 90")
    con.execute(f"COPY embeddings TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    frame, found = QUERIES[name](spark, str(tmp_path)), con.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    assert rows(frame.columns, [tuple(r) for r in frame.collect()]) == rows(columns, found.fetchall())


@pytest.mark.parametrize("bad", [0, 1, 2, 3, 5, 6])
def test_reference_column_beyond_the_leading_ones(spark, monkeypatch, bad):
    """A square of 6 whose first columns are not numbers: the first column with a number, wherever it is."""
    monkeypatch.setattr(ingest, "LEADING", 2)
    cells = spark.createDataFrame([(c, r, float("nan") if min(c, r) < bad else 0.5) for c in range(6) for r in range(6)], "col long, row long, D float")
    assert ingest.reference_column(cells, "D") == (bad if bad < 6 else None)


def test_dense_cells_at_the_ends(spark):
    """Empty columns, first and last rows, cells that are not numbers, one cell, no cell."""
    frame = lambda cells: spark.createDataFrame(cells, "col long, row long, D float")
    got = lambda cells, n: sorted((r["col"], r["row"], str(r["D"])) for r in dense_cells(frame(cells), n, "D").collect())
    stored = [(0, 0, 0.5), (0, 3, -1.0), (2, 1, float("nan")), (2, 2, 0.25), (3, 3, 1.0)]
    want = {(c, r): "0.0" for c in range(4) for r in range(4)} | {(c, r): str(v) for c, r, v in stored}
    assert got(stored, 4) == sorted((c, r, v) for (c, r), v in want.items())
    assert got([(0, 0, 0.5)], 1) == [(0, 0, "0.5")] and got([], 1) == [(0, 0, "0.0")] and got([], 0) == []
