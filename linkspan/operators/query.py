"""Point, column, submatrix, pairwise and neighbour queries.

The core takes requests as a DataFrame and returns a long DataFrame. A request without a stored entry
reads 0; a stored value that is not a number stays. Places are 0-based in the core (``*_at``
functions) and 1-based in ``fetch`` and ``neighbors``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import check_available
from . import index as ix
from .matrix import LDMatrix

#: Requests (16 bytes each) up to which they are broadcast to the entries, and places up to which a
#: list of them is a scan predicate.
BROADCAST_REQUEST, PREDICATE_PLACES = 200_000, 1000


def asked_entries(requests: DataFrame, matrix: LDMatrix) -> DataFrame:
    """Entries that requests (row, col) can meet. The request's size is looked up first; up to
    BROADCAST_REQUEST it goes to the scan as a predicate on columns and rows and as a broadcast
    semi-join, so that only entries that are asked for are ever shuffled."""
    keys = requests.select("row", "col")
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("row", "col") for f in (F.min, F.max)]
    size = keys.agg(F.count("*").alias("n"), *ends).first()
    entries = matrix.both_triangles()
    if size["n"] > BROADCAST_REQUEST or not size["n"]:
        return entries
    if size["n"] <= PREDICATE_PLACES:
        near = _predicate("col", sorted({r["col"] for r in keys.select("col").distinct().collect()})) & F.col("row").between(size["min_row"], size["max_row"])
    else:
        near = F.col("col").between(size["min_col"], size["max_col"]) & F.col("row").between(size["min_row"], size["max_row"])
    return entries.where(near).join(F.broadcast(keys.distinct()), ["row", "col"], "left_semi")


def read(requests: DataFrame, matrix: LDMatrix, types: list[str], entries: DataFrame | None = None) -> DataFrame:
    """requests (row, col, ...) with a double column for each statistic."""
    source = asked_entries(requests, matrix) if entries is None else entries
    values = source.select("row", "col", *types, F.lit(True).alias("_hit"))
    joined = requests.join(values, ["row", "col"], "left")
    return joined.select(*requests.columns, *(F.when(F.col("_hit"), F.col(s).cast("double")).otherwise(F.lit(0.0)).alias(s) for s in types))


def _predicate(name: str, places: list[int]):
    """Scan predicate for places: a range if they are one, else a list if it's short."""
    if not places:
        return F.lit(False)
    if places[-1] - places[0] + 1 == len(places):
        return F.col(name).between(places[0], places[-1])
    if len(places) <= PREDICATE_PLACES:
        return F.col(name).isin(places)
    return F.col(name).between(places[0], places[-1])


def check_places(places: list[int], n: int, what: str) -> list[int]:
    if any(p < 0 or p >= n for p in places):
        raise IndexError(f"{what} out of bounds: the matrix has {n}")
    return places


def submatrix_at(matrix: LDMatrix, rows: list[int], cols: list[int], types: list[str]) -> DataFrame:
    """(row, col, statistics) of all rows x cols. The grid is as large as the answer; it's built from
    the rows' list, each row with the whole list of columns."""
    spark = matrix.entries.sparkSession
    for t in types:
        check_available(matrix.stats, t)
    check_places(rows, matrix.n, "row")
    check_places(cols, matrix.n, "column")
    low, high = sorted(set(rows)), sorted(set(cols))
    entries = matrix.both_triangles().where(_predicate("row", low) & _predicate("col", high))
    grid = spark.createDataFrame([(r,) for r in rows], "row long").withColumn("col", F.explode(F.lit(cols).cast("array<bigint>")))
    return read(grid, matrix, types, entries)


def value_at(matrix: LDMatrix, row: int, col: int, stat: str) -> DataFrame:
    return submatrix_at(matrix, [row], [col], [stat])


def column_at(matrix: LDMatrix, col: int, types: list[str], start: int | None = None, end: int | None = None) -> DataFrame:
    """A column, or its rows start..end (inclusive): the column's entries are read by predicate."""
    start, end = 0 if start is None else start, matrix.n - 1 if end is None else end
    for t in types:
        check_available(matrix.stats, t)
    check_places([col], matrix.n, "column")
    check_places([start, end], matrix.n, "row")
    rows = matrix.entries.sparkSession.range(start, end + 1).select(F.col("id").alias("row"), F.lit(col).cast("long").alias("col"))
    entries = matrix.both_triangles().where((F.col("col") == col) & F.col("row").between(start, end))
    return read(rows, matrix, types, entries)


def stored_rows(matrix: LDMatrix, col: int) -> DataFrame:
    """Rows that a column stores."""
    check_places([col], matrix.n, "column")
    return matrix.both_triangles().where(F.col("col") == col).select("row")


def pairwise_at(matrix: LDMatrix, pairs: DataFrame, types: list[str]) -> DataFrame:
    """pairs (ord, row, col), repeats and any order allowed, with the statistics."""
    for t in types:
        check_available(matrix.stats, t)
    return read(pairs, matrix, types)


def _kind(values: list) -> str:
    if all(isinstance(v, str) for v in values):
        return "ids"
    if all(isinstance(v, int) and not isinstance(v, bool) for v in values):
        return "places"
    raise TypeError("places must be positive integers, identifiers character")


def check_inputs(rows: list, cols: list, pairwise: bool) -> str:
    """Kind of the two lists (ids or places). Both must have members of one kind; places count from 1;
    pairs need as many rows as columns, a grid has each row and each column once."""
    kinds = {_kind(axis) if axis else None for axis in (rows, cols)}
    repeats = any(len(set(axis)) < len(axis) for axis in (rows, cols))
    rules = (
        (None in kinds, ValueError, "rows and columns must be non-empty"),
        (len(kinds) > 1, TypeError, "rows and columns must be of the same type"),
        (pairwise and len(rows) != len(cols), ValueError, "pairwise queries need rows and columns of equal length"),
        (not pairwise and repeats, ValueError, "rows and columns must not have duplicate entries"),
        (kinds == {"places"} and min([*rows, *cols]) < 1, ValueError, "places must be positive integers"),
    )
    for broken, error, what in rules:
        if broken:
            raise error(what)
    return kinds.pop()


def resolve(matrix: LDMatrix, names: list[str]) -> list[int]:
    """Places of identifiers, in the order asked for; unknown ones are an error."""
    spark = matrix.variants.sparkSession
    wanted = ix.request(spark, names)
    found = wanted.join(matrix.variants.select("id", "idx"), "id").select("ord", "idx").collect()  # as many as asked for
    place = {r["ord"]: r["idx"] for r in found}
    lost = [n for i, n in enumerate(names) if i not in place]
    if lost:
        raise KeyError(f"Missing variants: {', '.join(lost[:5])}")
    return [place[i] for i in range(len(names))]


def fetch(matrix: LDMatrix, rows, cols, types=("UNPHASED_R",), pairwise: bool = False, shape: str = "long", strict: bool = False):
    """Values of rows x cols (1-based places or identifiers), or of pairs of them.

    Without pairwise, results are ordered by place on both axes; pairwise keeps the order asked for
    (also by identifier, and for unsorted input; strict raises where a column's rows are not
    ascending). shape: ``long`` (DataFrame), ``matrix`` (DataFrame with a column for each column, for
    one statistic), or ``simple``: scalar, dict, or dict of dicts, as small as the answer allows.
    """
    rows, cols = [rows] if isinstance(rows, (int, str)) else list(rows), [cols] if isinstance(cols, (int, str)) else list(cols)
    types = [types] if isinstance(types, str) else list(types)
    kind = check_inputs(rows, cols, pairwise)
    r = resolve(matrix, rows) if kind == "ids" else [x - 1 for x in rows]
    c = resolve(matrix, cols) if kind == "ids" else [x - 1 for x in cols]
    check_places(r, matrix.n, "row")
    check_places(c, matrix.n, "column")
    for t in types:
        check_available(matrix.stats, t)
    spark = matrix.entries.sparkSession
    if pairwise:
        if strict and any(c[i] == c[i + 1] and r[i] > r[i + 1] for i in range(len(r) - 1)):
            raise ValueError("rows of a column must be sorted")
        asked = spark.createDataFrame([(i, *x) for i, x in enumerate(zip(r, c, map(str, rows), map(str, cols)))], "ord long, row long, col long, var1 string, var2 string")
        out = pairwise_at(matrix, asked, types).orderBy("ord").select(*types, "var1", "var2")
        return out if shape != "simple" else [x.asDict() for x in out.collect()]
    names_r, names_c = dict(zip(r, rows)), dict(zip(c, cols))
    long = submatrix_at(matrix, sorted(r), sorted(c), types).orderBy("row", "col")
    if shape == "long":
        return long
    if shape == "matrix":
        if len(types) != 1:
            raise ValueError("a matrix shows one statistic")
        return as_matrix(long, sorted(c), types[0])
    got = {(x["row"], x["col"]): x for x in long.collect()}  # the caller asked for local values

    def of(stat: str):
        if len(r) == 1 and len(c) == 1:
            return got[r[0], c[0]][stat]
        if len(r) == 1:
            return {names_c[j]: got[r[0], j][stat] for j in sorted(c)}
        if len(c) == 1:
            return {names_r[i]: got[i, c[0]][stat] for i in sorted(r)}
        return {names_r[i]: {names_c[j]: got[i, j][stat] for j in sorted(c)} for i in sorted(r)}

    return of(types[0]) if len(types) == 1 else {t: of(t) for t in types}


def as_matrix(long: DataFrame, cols: list[int], stat: str) -> DataFrame:
    """One row for each row, a column for each place in cols (given, so the pivot needs no scan)."""
    return long.groupBy("row").pivot("col", cols).agg(F.first(stat)).orderBy("row")


def neighbours_at(matrix: LDMatrix, col: int, stat: str, threshold: float) -> DataFrame:
    """(row, value) of stored entries of a column with |value| >= threshold; never not-a-number (which
    compares as the largest value)."""
    value = F.col(stat).cast("double")
    return matrix.both_triangles().where((F.col("col") == col) & ~F.isnan(stat) & (F.abs(value) >= threshold)).select("row", value.alias("value"))


def neighbors(matrix: LDMatrix, variant, type: str = "UNPHASED_R2", abs_threshold: float = 0.8, genomic_length: int = 100_000) -> DataFrame:
    """Variants in LD with a variant (1-based place or identifier) and at most genomic_length away on
    its chromosome, ordered by place: (idx 1-based, id, value). The variant itself is among them
    unless its own value is not a number."""
    check_available(matrix.stats, type)
    place = resolve(matrix, [variant])[0] if isinstance(variant, str) else check_places([variant - 1], matrix.n, "variant")[0]
    own = matrix.variants.where(F.col("idx") == place).select("chrom", "pos").first()
    if own is None:
        raise KeyError(f"variant {variant} is not in the index")
    near = ix.region(matrix.variants, own["chrom"], own["pos"] - genomic_length, own["pos"] + genomic_length)
    found = neighbours_at(matrix, place, type, abs_threshold)
    return found.join(near, found["row"] == near["idx"]).select((F.col("idx") + 1).alias("idx"), "id", "value").orderBy("idx")
