"""Queries over the derived LD inputs, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures
from .functions import codec, ids
from .operators import chunks, export, index, ingest, metrics, query, transform
from .operators.matrix import LDMatrix, column_pointers, delta_decode, delta_encode, dense_cells, open_matrix, quantised, read_meta, save
from .plans import genome
from .session import fresh_path
from .sources import text
from .sources.archive import open_archive, write_archive
from .sources.text import dense_index

STATS = ("PHASED_R", "UNPHASED_R", "D", "DPRIME")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# SQL for the inputs that every query starts from.
_VARIANTS = """vars AS (
  SELECT vec_id AS idx, (['20','21','22','Y'])[CAST(floor(vec_id * 4 / (SELECT count(*) FROM embeddings)) AS INT) + 1] AS chrom,
         CAST(10000 + 1000 * vec_id AS INT) AS pos, 'rs' || (vec_id + 1000) AS id, 'A' AS ref, 'C' AS alt FROM embeddings)"""
_PAIRS = (
    _VARIANTS
    + """, comp AS (
  SELECT vec_id, k, CASE WHEN v < -0.1 THEN 0 WHEN v < 0.1 THEN 1 ELSE 2 END AS g, CASE WHEN v > 0 THEN 1 ELSE 0 END AS h
  FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS k FROM embeddings)),
near AS (SELECT a.idx AS a, b.idx AS b FROM vars a JOIN vars b ON a.chrom = b.chrom AND a.idx < b.idx AND b.pos - a.pos <= 60000),
sums AS (SELECT a, b, count(*) AS n, sum(x.g) AS sx, sum(y.g) AS sy, sum(x.g*x.g) AS sxx, sum(y.g*y.g) AS syy, sum(x.g*y.g) AS sxy, sum(x.h) AS na, sum(y.h) AS nb, sum(x.h*y.h) AS nab
  FROM near JOIN comp x ON x.vec_id = a JOIN comp y ON y.vec_id = b AND y.k = x.k GROUP BY a, b),
whole AS (SELECT a, b, n::BIGINT AS n, sx::BIGINT AS sx, sy::BIGINT AS sy, sxx::BIGINT AS sxx, syy::BIGINT AS syy, sxy::BIGINT AS sxy, na::BIGINT AS na, nb::BIGINT AS nb, nab::BIGINT AS nab, (n*nab - na*nb)::BIGINT AS d FROM sums),
ld AS (SELECT a, b, CAST(d / sqrt((na*(n-na)*nb*(n-nb))::DOUBLE) AS FLOAT) AS PHASED_R, (n*sxy - sx*sy)::DOUBLE / sqrt(((n*sxx - sx*sx)*(n*syy - sy*sy))::DOUBLE) AS r,
  CAST(d::DOUBLE / (n*n)::DOUBLE AS FLOAT) AS D, CAST(d::DOUBLE / (CASE WHEN d >= 0 THEN least(na*(n-nb), (n-na)*nb) ELSE least(na*nb, (n-na)*(n-nb)) END)::DOUBLE AS FLOAT) AS DPRIME FROM whole),
vcor AS (SELECT a, b, PHASED_R, CAST(r AS FLOAT) AS UNPHASED_R, D, DPRIME FROM ld WHERE abs(r) >= 0.1)"""
)


def _q(x: str, bits: int) -> str:
    scale = float(2 ** (bits - 1) - 1)
    v = f"(CASE WHEN isnan({x}) THEN {x} WHEN {x} > 1 THEN 1 WHEN {x} < -1 THEN -1 ELSE {x} END)"
    return f"CASE WHEN isnan({x}) THEN -{2 ** (bits - 1)} ELSE CAST(sign({v}::DOUBLE * {scale!r}) * floor(abs({v}::DOUBLE * {scale!r}) + 0.5) AS BIGINT) END"


def _d(q: str, bits: int) -> str:
    return f"CASE WHEN ({q}) = -{2 ** (bits - 1)} THEN 'nan'::FLOAT ELSE CAST(CAST({q} AS FLOAT)::DOUBLE / CAST({2 ** (bits - 1) - 1} AS FLOAT)::DOUBLE AS FLOAT) END"


#: The matrix at 16 bits, |UNPHASED_R| >= 0.2, both triangles and the diagonal.
_MATRIX = _PAIRS + ", cells AS (SELECT a, b, " + ", ".join(f"{_d(_q(s, 16), 16)} AS {s}" for s in STATS) + """ FROM vcor WHERE NOT abs(UNPHASED_R) < 0.2::FLOAT::DOUBLE),
m AS (SELECT a AS col, b AS row, PHASED_R, UNPHASED_R, D, DPRIME FROM cells UNION ALL SELECT b, a, PHASED_R, UNPHASED_R, D, DPRIME FROM cells
  UNION ALL SELECT idx, idx, 1.0::FLOAT, 1.0::FLOAT, 'nan'::FLOAT, 1.0::FLOAT FROM vars)"""


def _register(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = "WITH " + sql
        return f

    return add


def matrix(spark: SparkSession, sf_dir: str) -> LDMatrix:
    return ingest.from_pairs(fixtures.pairs(spark, sf_dir), fixtures.variants(spark, sf_dir), bits=16, min_abs=0.2, min_col="UNPHASED_R", check=False)


def _shown(frame: DataFrame, stats=STATS) -> DataFrame:
    """Values as doubles, with not-a-number as null and flagged where D is shown."""
    out = []
    for c in frame.columns:
        if c in stats:
            out.append(F.when(~F.isnan(c), F.col(c).cast("double")).alias(c))
        else:
            out.append(F.col(c))
    return frame.select(*out)


def _show(stats=STATS, prefix="") -> str:
    return ", ".join(f"CASE WHEN isnan({prefix}{s}) THEN NULL ELSE {prefix}{s}::DOUBLE END AS {s}" for s in stats)


# --- variants and identifiers ---


@_register("variant_index", _VARIANTS + " SELECT idx::BIGINT AS idx, chrom, pos, id, ref, alt, (row_number() OVER (ORDER BY idx) - 1)::BIGINT AS place FROM vars")
def variant_index(spark: SparkSession, d: str) -> DataFrame:
    return dense_index(fixtures.variants(spark, d), "idx", "place")


_FORMS = "forms AS (SELECT idx, unnest([id, 'chr' || chrom || ':' || pos || ':A:C', 'x_' || id || '_A_T', CAST(idx AS VARCHAR)]) AS id FROM vars)"


def _forms(spark: SparkSession, d: str) -> DataFrame:
    forms = F.array("id", F.concat(F.lit("chr"), "chrom", F.lit(":"), F.col("pos").cast("string"), F.lit(":A:C")), F.concat(F.lit("x_"), "id", F.lit("_A_T")), F.col("idx").cast("string"))
    return fixtures.variants(spark, d).select("idx", F.explode(forms).alias("id"))


@_register(
    "id_parse_join",
    _VARIANTS + ", " + _FORMS + r""" SELECT idx::BIGINT AS idx, id, CASE WHEN regexp_full_match(id, '[0-9]+') THEN id::BIGINT ELSE regexp_extract(id, '[^0-9]([0-9]+)[^0-9]*$', 1)::BIGINT END AS id_number,
    CASE WHEN regexp_full_match(id, '[0-9]+') THEN id ELSE regexp_replace(id, '([^0-9])[0-9]+([^0-9]*)$', '\1%\2') END AS id_template, id AS rejoined FROM forms""",
)
def id_parse_join(spark: SparkSession, d: str) -> DataFrame:
    f = _forms(spark, d).withColumns({"id_number": ids.id_number(F.col("id")), "id_template": ids.id_template(F.col("id"))})
    return f.withColumn("rejoined", ids.join_id(F.col("id_number"), F.col("id_template")))


def _wanted(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.variants(spark, d).where("idx % 3 = 0").select(F.col("idx").alias("ord"), F.concat(F.lit("rs"), (F.col("idx") * 2 + 1000).cast("string")).alias("id"))


_WANTED = "wanted AS (SELECT idx AS ord, 'rs' || (idx * 2 + 1000) AS id FROM vars WHERE idx % 3 = 0)"


@_register("id_lookup", _VARIANTS + ", " + _WANTED + " SELECT ord::BIGINT AS ord, w.id, idx::BIGINT AS idx, chrom, pos FROM wanted w JOIN vars v ON v.id = w.id")
def id_lookup(spark: SparkSession, d: str) -> DataFrame:
    return index.lookup(index.build_index(fixtures.variants(spark, d)), _wanted(spark, d))


@_register("id_missing", _VARIANTS + ", " + _WANTED + " SELECT DISTINCT id FROM wanted WHERE id NOT IN (SELECT id FROM vars)")
def id_missing(spark: SparkSession, d: str) -> DataFrame:
    return index.missing(index.build_index(fixtures.variants(spark, d)), _wanted(spark, d))


@_register("region_lookup", _VARIANTS + " SELECT idx::BIGINT AS idx, id, pos FROM vars WHERE chrom = '21' AND pos BETWEEN 150000 AND 220000 ORDER BY idx")
def region_lookup(spark: SparkSession, d: str) -> DataFrame:
    return index.region(fixtures.variants(spark, d), "21", 150000, 220000).select("idx", "id", "pos").orderBy("idx")


@_register("cpra_from_index", _VARIANTS + " SELECT idx::BIGINT AS idx, chrom, pos, id, ref, alt FROM vars WHERE idx % 7 = 0")
def cpra_from_index(spark: SparkSession, d: str) -> DataFrame:
    v = fixtures.variants(spark, d)
    return index.by_place(v, v.where("idx % 7 = 0"))


def _copies(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.variants(spark, d).withColumn("id", F.when(F.col("idx") % 5 == 0, F.concat(F.lit("rs"), (F.col("idx") % 100).cast("string"))).otherwise(F.col("id")))


_COPIES = "copies AS (SELECT idx, chrom, pos, CASE WHEN idx % 5 = 0 THEN 'rs' || (idx % 100) ELSE id END AS id FROM vars)"


@_register("duplicate_ids", _VARIANTS + ", " + _COPIES + " SELECT id, count(*)::BIGINT AS n, min(idx + 1)::BIGINT AS first_line FROM copies GROUP BY id HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    return ingest.duplicate_ids(_copies(spark, d)).select("id", "n", F.element_at("lines", 1).alias("first_line"))


@_register("rm_dup_exclude_all", _VARIANTS + ", " + _COPIES + " SELECT idx::BIGINT AS idx, id FROM copies WHERE id IN (SELECT id FROM copies GROUP BY id HAVING count(*) = 1)")
def rm_dup_exclude_all(spark: SparkSession, d: str) -> DataFrame:
    return index.remove_all_copies(_copies(spark, d)).select("idx", "id")


@_register("extract_variants", _VARIANTS + ", " + _WANTED + " SELECT idx::BIGINT AS idx, id FROM vars WHERE id IN (SELECT id FROM wanted)")
def extract_variants(spark: SparkSession, d: str) -> DataFrame:
    return index.extract(fixtures.variants(spark, d), _wanted(spark, d)).select("idx", "id")


@_register("exclude_variants", _VARIANTS + ", " + _WANTED + " SELECT idx::BIGINT AS idx, id FROM vars WHERE id NOT IN (SELECT id FROM wanted)")
def exclude_variants(spark: SparkSession, d: str) -> DataFrame:
    return index.exclude(fixtures.variants(spark, d), _wanted(spark, d)).select("idx", "id")


@_register("keep_both_endpoints", _PAIRS + ", " + _WANTED + " SELECT 'rs' || (a + 1000) AS ID_A, 'rs' || (b + 1000) AS ID_B FROM vcor WHERE 'rs' || (a + 1000) IN (SELECT id FROM wanted) AND 'rs' || (b + 1000) IN (SELECT id FROM wanted)")
def keep_both_endpoints(spark: SparkSession, d: str) -> DataFrame:
    return index.keep_both_ends(fixtures.pairs(spark, d), _wanted(spark, d)).select("ID_A", "ID_B")


# --- ingest and codec ---


@_register("window_pair_ld", _PAIRS + " SELECT a::BIGINT AS a, b::BIGINT AS b, " + ", ".join(f"{s}::DOUBLE AS {s}" for s in STATS) + " FROM vcor")
def window_pair_ld(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.pairs(spark, d).select("a", "b", *(F.col(s).cast("double").alias(s) for s in STATS))


@_register("ingest_tabular", _MATRIX + f" SELECT col::BIGINT AS col, row::BIGINT AS row, {_show()} FROM m")
def ingest_tabular(spark: SparkSession, d: str) -> DataFrame:
    return _shown(matrix(spark, d).entries)


@_register("ingest_min_filter_multi_stat", _PAIRS + " SELECT a::BIGINT AS a, b::BIGINT AS b, " + ", ".join(f"{s}::DOUBLE AS {s}" for s in STATS) + " FROM vcor WHERE NOT abs(DPRIME) < 0.3::DOUBLE")
def ingest_min_filter_multi_stat(spark: SparkSession, d: str) -> DataFrame:
    return ingest.min_filter(fixtures.pairs(spark, d), 0.3, "DPRIME").select("a", "b", *(F.col(s).cast("double").alias(s) for s in STATS))


@_register("symmetrise_diagonal", _PAIRS + " SELECT a::BIGINT AS col, b::BIGINT AS row, UNPHASED_R::DOUBLE AS UNPHASED_R FROM vcor UNION ALL SELECT b, a, UNPHASED_R FROM vcor UNION ALL SELECT idx, idx, 1.0 FROM vars")
def symmetrise_diagonal(spark: SparkSession, d: str) -> DataFrame:
    v = fixtures.variants(spark, d)
    cells = ingest.index_pairs(fixtures.pairs(spark, d).select("ID_A", "ID_B", "UNPHASED_R"), v, v.count())
    return _shown(ingest.symmetrise(cells).unionByName(ingest.diagonal(v, ["UNPHASED_R"])))


@_register("upper_layout", _MATRIX + f" SELECT col::BIGINT AS col, row::BIGINT AS row, {_show(('UNPHASED_R',))} FROM m")
def upper_layout(spark: SparkSession, d: str) -> DataFrame:
    m = ingest.from_pairs(fixtures.pairs(spark, d), fixtures.variants(spark, d), 16, 0.2, "UNPHASED_R", None, "upper", check=False)
    return _shown(m.both_triangles().select("col", "row", "UNPHASED_R"))


def _codes(bits: int):
    def run(spark: SparkSession, d: str) -> DataFrame:
        p = fixtures.pairs(spark, d).select("a", "b", "UNPHASED_R")
        # Stretched past [-1, 1], and not a number at every 37th place, so that every branch is met.
        v = F.when(F.col("b") % 37 == 0, F.lit(float("nan"))).otherwise(F.col("UNPHASED_R").cast("double") * 3).cast("float")
        code = codec.quantise(v, bits)
        value = codec.dequantise(code, bits)
        shown = code.cast("double") if bits == 99 else code.cast("long")
        return p.select("a", "b", F.when(~F.isnan(shown.cast("double")), shown).alias("code"), F.when(~F.isnan(value), value.cast("double")).alias("value"))

    return run


for _bits in (8, 16, 32, 99):
    _v = "CAST(CASE WHEN b % 37 = 0 THEN 'nan'::DOUBLE ELSE UNPHASED_R::DOUBLE * 3 END AS FLOAT)"
    _base = _PAIRS + f", x AS (SELECT a, b, {_v} AS v FROM vcor)"
    if _bits == 99:
        _c = "CASE WHEN isnan(v) THEN NULL WHEN v > 1 THEN 1 WHEN v < -1 THEN -1 ELSE v::DOUBLE END"
        _sql = _base + f" SELECT a::BIGINT AS a, b::BIGINT AS b, ({_c})::DOUBLE AS code, ({_c})::DOUBLE AS value FROM x"
    else:
        _sql = _base + f", y AS (SELECT a, b, {_q('v', _bits)} AS q FROM x) SELECT a::BIGINT AS a, b::BIGINT AS b, q::BIGINT AS code, CASE WHEN isnan({_d('q', _bits)}) THEN NULL ELSE ({_d('q', _bits)})::DOUBLE END AS value FROM y"
    _register(f"quantise_{_bits}", _sql)(_codes(_bits))


@_register(
    "roundtrip_error",
    _PAIRS + f", x AS (SELECT UNPHASED_R::DOUBLE AS a, ({_d(_q('UNPHASED_R', 8), 8)})::DOUBLE AS b FROM vcor) SELECT count(*) FILTER (a <> 0)::BIGINT AS nonzero_original, count(*) FILTER (b <> 0)::BIGINT AS nonzero_decoded, max(abs(a - b)) AS max_diff, round(corr(a, b), 9) AS corr_all FROM x",
)
def roundtrip_error(spark: SparkSession, d: str) -> DataFrame:
    p = fixtures.pairs(spark, d).select(F.col("UNPHASED_R").alias("x"), codec.dequantise(codec.quantise(F.col("UNPHASED_R"), 8), 8).alias("y"))
    return metrics.roundtrip_metrics(p, "x", "y").select("nonzero_original", "nonzero_decoded", "max_diff", F.round("corr_all", 9).alias("corr_all"))


#: A square matrix: UNPHASED_R of all cells; every 37th variant is bad.
_SQUARE = _PAIRS + """, sq AS (SELECT x.idx AS col, y.idx AS row, CASE WHEN x.idx % 37 = 0 OR y.idx % 37 = 0 THEN 'nan'::FLOAT WHEN x.idx = y.idx THEN 1.0::FLOAT ELSE coalesce(v.UNPHASED_R, 0.0::FLOAT) END AS r
  FROM vars x CROSS JOIN vars y LEFT JOIN vcor v ON v.a = least(x.idx, y.idx) AND v.b = greatest(x.idx, y.idx))"""


def _square(spark: SparkSession, d: str) -> DataFrame:
    """All cells, made where they are used: only the pairs are shuffled."""
    p = fixtures.pairs(spark, d).select(F.col("a").alias("col"), F.col("b").alias("row"), "UNPHASED_R")
    cells = dense_cells(ingest.symmetrise(p), fixtures.variants(spark, d).count(), "UNPHASED_R")
    nan = F.lit(float("nan")).cast("float")
    r = F.when((F.col("col") % 37 == 0) | (F.col("row") % 37 == 0), nan).when(F.col("col") == F.col("row"), F.lit(1.0).cast("float")).otherwise(F.col("UNPHASED_R"))
    return cells.select("col", "row", r.alias("UNPHASED_R"))


@_register("square_bad_variants", _SQUARE + ", first AS (SELECT min(col) AS c FROM sq WHERE NOT isnan(r)) SELECT row::BIGINT AS idx, (row_number() OVER (ORDER BY row) - 1)::BIGINT AS new FROM sq, first WHERE col = c AND NOT isnan(r)")
def square_bad_variants(spark: SparkSession, d: str) -> DataFrame:
    return dense_index(ingest.good_variants(_square(spark, d), "UNPHASED_R"), "idx", "new")


@_register("square_min_filter", _SQUARE + " SELECT col::BIGINT AS col, row::BIGINT AS row, CASE WHEN isnan(r) THEN NULL ELSE r::DOUBLE END AS UNPHASED_R FROM sq WHERE isnan(r) OR NOT abs(r) < 0.15::DOUBLE")
def square_min_filter(spark: SparkSession, d: str) -> DataFrame:
    return _shown(ingest.min_filter(_square(spark, d), 0.15, "UNPHASED_R"))


@_register(
    "ingest_square",
    _SQUARE + f""", first AS (SELECT min(col) AS c FROM sq WHERE NOT isnan(r)), k AS (SELECT row AS idx, row_number() OVER (ORDER BY row) - 1 AS new FROM sq, first WHERE col = c AND NOT isnan(r))
  SELECT x.new::BIGINT AS col, y.new::BIGINT AS row, ({_d(_q('r', 8), 8)})::DOUBLE AS UNPHASED_R FROM sq JOIN k x ON x.idx = col JOIN k y ON y.idx = row WHERE NOT abs(r) < 0.15::DOUBLE""",
)
def ingest_square(spark: SparkSession, d: str) -> DataFrame:
    m = ingest.from_square(_square(spark, d), fixtures.variants(spark, d), 8, 0.15, "UNPHASED_R")
    return m.entries.select("col", "row", F.col("UNPHASED_R").cast("double").alias("UNPHASED_R"))


# --- reading ---

_GET = "CASE WHEN m.col IS NULL THEN 0.0 WHEN isnan(m.{s}) THEN NULL ELSE m.{s}::DOUBLE END AS {s}"


def _get(stats) -> str:
    return ", ".join(_GET.format(s=s) for s in stats)


@_register("point_value", _MATRIX + f" SELECT r.row::BIGINT AS row, r.col::BIGINT AS col, {_get(('UNPHASED_R',))} FROM (SELECT 3 AS row, 5 AS col) r LEFT JOIN m ON m.col = r.col AND m.row = r.row")
def point_value(spark: SparkSession, d: str) -> DataFrame:
    return _shown(query.value_at(matrix(spark, d), 3, 5, "UNPHASED_R"))


@_register("column_full", _MATRIX + f" SELECT v.idx::BIGINT AS row, 10::BIGINT AS col, {_get(STATS)} FROM vars v LEFT JOIN m ON m.col = 10 AND m.row = v.idx")
def column_full(spark: SparkSession, d: str) -> DataFrame:
    return _shown(query.column_at(matrix(spark, d), 10, list(STATS)))


@_register("column_range", _MATRIX + f" SELECT v.idx::BIGINT AS row, 40::BIGINT AS col, {_get(('D',))} FROM vars v LEFT JOIN m ON m.col = 40 AND m.row = v.idx WHERE v.idx BETWEEN 20 AND 80")
def column_range(spark: SparkSession, d: str) -> DataFrame:
    return _shown(query.column_at(matrix(spark, d), 40, ["D"], 20, 80))


_SOME, _OTHER = [1, 4, 9, 16, 25, 36, 49, 64, 81, 100], [2, 3, 5, 8, 13, 21, 34, 55, 89]


@_register("column_list", _MATRIX + f" SELECT r.row::BIGINT AS row, 25::BIGINT AS col, {_get(('PHASED_R',))} FROM (SELECT unnest({_SOME}) AS row) r LEFT JOIN m ON m.col = 25 AND m.row = r.row")
def column_list(spark: SparkSession, d: str) -> DataFrame:
    return _shown(query.submatrix_at(matrix(spark, d), _SOME, [25], ["PHASED_R"]))


@_register("submatrix_range", _MATRIX + f" SELECT r.row::BIGINT AS row, c.col::BIGINT AS col, {_get(('UNPHASED_R', 'DPRIME'))} FROM (SELECT unnest(range(10, 40)) AS row) r CROSS JOIN (SELECT unnest(range(20, 60)) AS col) c LEFT JOIN m ON m.col = c.col AND m.row = r.row")
def submatrix_range(spark: SparkSession, d: str) -> DataFrame:
    return _shown(query.submatrix_at(matrix(spark, d), list(range(10, 40)), list(range(20, 60)), ["UNPHASED_R", "DPRIME"]))


_LIST = f" SELECT r.row::BIGINT AS row, c.col::BIGINT AS col, {_get(('UNPHASED_R',))} FROM (SELECT unnest({_SOME}) AS row) r CROSS JOIN (SELECT unnest({_OTHER}) AS col) c LEFT JOIN m ON m.col = c.col AND m.row = r.row"


@_register("submatrix_list", _MATRIX + _LIST)
def submatrix_list(spark: SparkSession, d: str) -> DataFrame:
    return _shown(query.submatrix_at(matrix(spark, d), _SOME, _OTHER, ["UNPHASED_R"]))


@_register("submatrix_by_id", _MATRIX + _LIST)
def submatrix_by_id(spark: SparkSession, d: str) -> DataFrame:
    name = lambda places: [f"rs{p + 1000}" for p in reversed(places)]
    return _shown(query.fetch(matrix(spark, d), name(_SOME), name(_OTHER), "UNPHASED_R"))


@_register("pairwise_multi", _MATRIX + f" SELECT r.ord::BIGINT AS ord, r.row::BIGINT AS row, r.col::BIGINT AS col, {_get(STATS)} FROM (SELECT idx AS ord, idx AS row, least(idx + idx % 60, (SELECT count(*) FROM vars) - 1) AS col FROM vars) r LEFT JOIN m ON m.col = r.col AND m.row = r.row")
def pairwise_multi(spark: SparkSession, d: str) -> DataFrame:
    m = matrix(spark, d)
    asked = m.variants.select(F.col("idx").alias("ord"), F.col("idx").alias("row"), F.least(F.col("idx") + F.col("idx") % 60, F.lit(m.n - 1)).alias("col"))
    return _shown(query.pairwise_at(m, asked, list(STATS)))


_PAIR_ROWS, _PAIR_COLS = [9, 4, 49, 4, 36], [8, 3, 55, 3, 34]


@_register("pairwise_id", _MATRIX + f" SELECT {_get(('UNPHASED_R',))}, 'rs' || (r.row + 1000) AS var1, 'rs' || (r.col + 1000) AS var2 FROM (SELECT unnest({_PAIR_ROWS}) AS row, unnest({_PAIR_COLS}) AS col) r LEFT JOIN m ON m.col = r.col AND m.row = r.row")
def pairwise_id(spark: SparkSession, d: str) -> DataFrame:
    return _shown(query.fetch(matrix(spark, d), [f"rs{p + 1000}" for p in _PAIR_ROWS], [f"rs{p + 1000}" for p in _PAIR_COLS], "UNPHASED_R", pairwise=True))


@_register("matrix_pivot", _MATRIX + ", s AS (" + _LIST.strip() + ") SELECT row, " + ", ".join(f'max(CASE WHEN col = {c} THEN UNPHASED_R END) AS "{c}"' for c in _OTHER) + " FROM s GROUP BY row")
def matrix_pivot(spark: SparkSession, d: str) -> DataFrame:
    return query.as_matrix(query.submatrix_at(matrix(spark, d), _SOME, _OTHER, ["UNPHASED_R"]), _OTHER, "UNPHASED_R")


_NEAR = " SELECT (v.idx + 1)::BIGINT AS idx, v.id, m.{s}::DOUBLE AS value FROM m JOIN vars v ON v.idx = m.row JOIN vars o ON o.idx = m.col WHERE m.col = {c} AND NOT isnan(m.{s}) AND abs(m.{s}::DOUBLE) >= {t} AND v.chrom = o.chrom AND abs(v.pos - o.pos) <= {w}"


@_register("neighbors_index", _MATRIX + _NEAR.format(s="UNPHASED_R", c=50, t=0.25, w=40000))
def neighbors_index(spark: SparkSession, d: str) -> DataFrame:
    return query.neighbors(matrix(spark, d), 51, "UNPHASED_R", 0.25, 40000)


@_register("neighbors_id", _MATRIX + _NEAR.format(s="DPRIME", c=77, t=0.3, w=100000))
def neighbors_id(spark: SparkSession, d: str) -> DataFrame:
    return query.neighbors(matrix(spark, d), "rs1077", "DPRIME", 0.3, 100000)


@_register("neighbors_d_nan", _MATRIX + _NEAR.format(s="D", c=60, t=0.02, w=100000))
def neighbors_d_nan(spark: SparkSession, d: str) -> DataFrame:
    return query.neighbors(matrix(spark, d), 61, "D", 0.02, 100000)


@_register("neighbors_all", _MATRIX + " SELECT m.col::BIGINT AS col, count(*)::BIGINT AS n, max(abs(m.UNPHASED_R::DOUBLE)) FILTER (m.row <> m.col) AS strongest FROM m JOIN vars v ON v.idx = m.row JOIN vars o ON o.idx = m.col WHERE abs(m.UNPHASED_R::DOUBLE) >= 0.3 AND v.chrom = o.chrom AND abs(v.pos - o.pos) <= 50000 GROUP BY m.col")
def neighbors_all(spark: SparkSession, d: str) -> DataFrame:
    """The neighbour query for every variant at once."""
    m = matrix(spark, d)
    place = m.variants.select("idx", "chrom", F.col("pos").cast("long").alias("pos"))
    a, b = place.toDF("col", "c1", "p1"), place.toDF("row", "c2", "p2")
    near = m.entries.where(~F.isnan("UNPHASED_R") & (F.abs(F.col("UNPHASED_R").cast("double")) >= 0.3)).join(ingest.sized(a, m.n), "col").join(ingest.sized(b, m.n), "row").where((F.col("c1") == F.col("c2")) & (F.abs(F.col("p1") - F.col("p2")) <= 50000))
    return near.groupBy("col").agg(F.count("*").alias("n"), F.max(F.when(F.col("row") != F.col("col"), F.abs(F.col("UNPHASED_R").cast("double")))).alias("strongest"))


@_register("column_rows", _MATRIX + " SELECT row::BIGINT AS row FROM m WHERE col = 33")
def column_rows(spark: SparkSession, d: str) -> DataFrame:
    return query.stored_rows(matrix(spark, d), 33)


@_register("meta_summary", _MATRIX + " SELECT (SELECT count(*) FROM vars)::BIGINT AS n, count(*)::BIGINT AS nnz, 16::BIGINT AS bits, 'full' AS layout, 'PHASED_R,UNPHASED_R,D,DPRIME' AS stats FROM m")
def meta_summary(spark: SparkSession, d: str) -> DataFrame:
    m = matrix(spark, d)
    return m.entries.agg(F.lit(m.n).cast("long").alias("n"), F.count("*").alias("nnz"), F.lit(m.bits).cast("long").alias("bits"), F.lit(m.layout).alias("layout"), F.lit(",".join(m.stats)).alias("stats"))


# --- encodings and counts ---


@_register("column_pointers", _MATRIX + ", k AS (SELECT col, count(*) AS n FROM m GROUP BY col), c AS (SELECT unnest(range(0, (SELECT count(*) + 1 FROM vars))) AS col) SELECT c.col::BIGINT AS col, coalesce(n, 0)::BIGINT AS n_entries, coalesce(sum(n) OVER (ORDER BY c.col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pointer FROM c LEFT JOIN k ON k.col = c.col")
def pointers(spark: SparkSession, d: str) -> DataFrame:
    m = matrix(spark, d)
    return column_pointers(m.entries.select("col", "row"), m.n)


_DELTA = _MATRIX + ", dl AS (SELECT col, row_number() OVER (PARTITION BY col ORDER BY row) - 1 AS k, row, row - coalesce(lag(row) OVER (PARTITION BY col ORDER BY row), col) AS delta FROM m)"


@_register("delta_encode", _DELTA + " SELECT col::BIGINT AS col, k::BIGINT AS k, delta::BIGINT AS delta, (delta >= 32767 OR delta < -32768) AS overflow FROM dl")
def delta_encoded(spark: SparkSession, d: str) -> DataFrame:
    return delta_encode(matrix(spark, d).entries)


@_register("delta_decode", _DELTA + " SELECT col::BIGINT AS col, k::BIGINT AS k, row::BIGINT AS row FROM dl")
def delta_decoded(spark: SparkSession, d: str) -> DataFrame:
    return delta_decode(delta_encode(matrix(spark, d).entries))


@_register("nnz_per_column", _MATRIX + " SELECT col::BIGINT AS col, count(*)::BIGINT AS n_entries FROM m GROUP BY col")
def nnz_per_column(spark: SparkSession, d: str) -> DataFrame:
    return metrics.nnz_per_column(matrix(spark, d).entries)


@_register("stored_codes", _MATRIX + f" SELECT col::BIGINT AS col, row::BIGINT AS row, ({_q('UNPHASED_R', 16)})::BIGINT AS code FROM m")
def stored_codes(spark: SparkSession, d: str) -> DataFrame:
    return quantised(matrix(spark, d).entries, 16).select("col", "row", F.col("UNPHASED_R").cast("long").alias("code"))


@_register("chrom_bounds", _VARIANTS + " SELECT chrom, min(pos) AS min_pos, max(pos) AS max_pos, count(*)::BIGINT AS n_variants FROM vars GROUP BY chrom")
def chrom_bounds(spark: SparkSession, d: str) -> DataFrame:
    return metrics.chrom_bounds(fixtures.variants(spark, d))


_CHUNKS = _VARIANTS + ", b AS (SELECT chrom, min(pos) AS lo, max(pos) AS hi FROM vars GROUP BY chrom), s AS (SELECT chrom, hi, unnest(range(lo::BIGINT, hi::BIGINT + 1, 30000)) AS start, lo FROM b), ch AS (SELECT chrom, ((start - lo) / 30000)::BIGINT + 1 AS chunk_id, start::BIGINT AS start, least(start + 59999, hi)::BIGINT AS stop FROM s)"


@_register("genomic_chunks", _CHUNKS + ' SELECT chrom, chunk_id, start, stop AS "end" FROM ch')
def genomic_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunks.genomic_chunks(metrics.chrom_bounds(fixtures.variants(spark, d)), 30000)


@_register("nonempty_chunks", _CHUNKS + ' SELECT ch.chrom, chunk_id, start, stop AS "end", count(*)::BIGINT AS n_variants FROM ch JOIN vars v ON v.chrom = ch.chrom AND v.pos BETWEEN start AND stop GROUP BY ALL')
def nonempty_chunks(spark: SparkSession, d: str) -> DataFrame:
    v = fixtures.variants(spark, d)
    return chunks.nonempty_chunks(chunks.genomic_chunks(metrics.chrom_bounds(v), 30000), v)


@_register("natural_chunk_order", _CHUNKS + " SELECT 'chr' || chrom || '_' || chunk_id AS name, row_number() OVER (ORDER BY CASE WHEN chrom = 'Y' THEN 1 ELSE 0 END, CASE WHEN chrom = 'Y' THEN 0 ELSE chrom::INT END, chunk_id)::BIGINT AS place FROM ch")
def natural_chunk_order(spark: SparkSession, d: str) -> DataFrame:
    names = genomic_chunks(spark, d).select(F.concat(F.lit("chr"), "chrom", F.lit("_"), F.col("chunk_id").cast("string")).alias("name"))
    from pyspark.sql import Window as W

    return names.select("name", F.row_number().over(W.orderBy(ids.natural_key(F.col("name")))).cast("long").alias("place"))


# --- transforms ---


@_register("filter_range", _MATRIX + f" SELECT (col - 30)::BIGINT AS col, (row - 30)::BIGINT AS row, {_show()} FROM m WHERE col BETWEEN 30 AND 150 AND row BETWEEN 30 AND 150")
def filter_range(spark: SparkSession, d: str) -> DataFrame:
    return _shown(transform.filter_matrix(matrix(spark, d), between=(30, 150)).entries)


@_register("filter_keep", _MATRIX + f", k AS (SELECT idx, row_number() OVER (ORDER BY idx) - 1 AS new FROM vars WHERE idx % 3 <> 1) SELECT x.new::BIGINT AS col, y.new::BIGINT AS row, {_show()} FROM m JOIN k x ON x.idx = m.col JOIN k y ON y.idx = m.row")
def filter_keep(spark: SparkSession, d: str) -> DataFrame:
    m = matrix(spark, d)
    return _shown(transform.filter_matrix(m, keep=m.variants.where("idx % 3 <> 1")).entries)


def _by_chrom(spark: SparkSession, d: str) -> list[LDMatrix]:
    m, out = matrix(spark, d), []
    for r in metrics.chrom_bounds(m.variants).withColumn("first", (F.col("min_pos") - 10000) / 1000).orderBy(ids.chrom_rank(F.col("chrom"))).collect():
        out.append(transform.filter_matrix(m, between=(int(r["first"]), int(r["first"]) + r["n_variants"] - 1)))
    return out


@_register("concat_block_diagonal", _MATRIX + f" SELECT col::BIGINT AS col, row::BIGINT AS row, {_show()} FROM m")
def concat_block_diagonal(spark: SparkSession, d: str) -> DataFrame:
    return _shown(transform.concat(_by_chrom(spark, d)).entries)


def _tagged(parts: list[DataFrame]) -> DataFrame:
    out = None
    for i, part in enumerate(parts):
        part = part.withColumn("chunk", F.lit(i).cast("long"))
        out = part if out is None else out.unionByName(part)
    return out


def _cuts(n: int) -> list[tuple[int, int]]:
    """Chunks of all n places, each sharing half with the next and more than the 60 places of the LD window."""
    step = max(n // 4, 61)
    return [(a, min(a + 2 * step, n) - 1) for a in range(0, max(n - step, 1), step)]


_CUTS = _VARIANTS + """, s AS (SELECT count(*) AS n, greatest(count(*) // 4, 61) AS step FROM vars),
c AS (SELECT i // step AS chunk, i AS a, least(i + 2 * step, n) - 1 AS b FROM (SELECT n, step, unnest(range(0, greatest(n - step, 1), step)) AS i FROM s))"""


def _tagged_chunks(spark: SparkSession, d: str) -> DataFrame:
    v = fixtures.variants(spark, d)
    return _tagged([v.where(F.col("idx").between(a, b)).withColumn("idx", F.col("idx") - a) for a, b in _cuts(v.count())])


@_register("overlap_boundaries", _CUTS + " SELECT chunk::BIGINT AS chunk, (b - a + 1)::BIGINT AS n_variants, coalesce(lag(b) OVER w - a + 1, 0)::BIGINT AS shared_before, coalesce(lead(a) OVER w, b + 1)::BIGINT - a AS shared_from, a::BIGINT AS place_start, (b + 1)::BIGINT AS place_end, TRUE AS matched FROM c WINDOW w AS (ORDER BY chunk)")
def overlap_boundaries(spark: SparkSession, d: str) -> DataFrame:
    return transform.boundaries(_tagged_chunks(spark, d))


@_register("concat_overlap_entries", _MATRIX + f" SELECT col::BIGINT AS col, row::BIGINT AS row, {_show()} FROM m")
def concat_overlap_entries(spark: SparkSession, d: str) -> DataFrame:
    m = matrix(spark, d)
    return _shown(transform.concat([transform.filter_matrix(m, between=c) for c in _cuts(m.n)], overlapping=True).entries)


@_register("concat_variants", _VARIANTS + " SELECT idx::BIGINT AS idx, chrom, pos, id, ref, alt FROM vars")
def concat_variants(spark: SparkSession, d: str) -> DataFrame:
    tagged = _tagged_chunks(spark, d)
    return transform.concat_variants(tagged, transform.boundaries(tagged))


# --- export ---


@_register("decompress_tabular", _MATRIX + " SELECT 'rs' || (col + 1000) AS ID_A, 'A' AS REF_A, 'C' AS ALT_A, 'rs' || (row + 1000) AS ID_B, 'A' AS REF_B, 'C' AS ALT_B, " + ", ".join(f"{s}::DOUBLE AS {s}" for s in STATS) + " FROM m WHERE row > col")
def decompress_tabular(spark: SparkSession, d: str) -> DataFrame:
    return _shown(export.tabular(matrix(spark, d)).drop("col", "row"))


@_register("densify_square", _MATRIX + f" SELECT c.idx::BIGINT AS col, r.idx::BIGINT AS row, {_get(('UNPHASED_R',))} FROM vars c CROSS JOIN vars r LEFT JOIN m ON m.col = c.idx AND m.row = r.idx")
def densify_square(spark: SparkSession, d: str) -> DataFrame:
    """All cells of the square export, zeros between what is stored."""
    return _shown(export.dense(matrix(spark, d), "UNPHASED_R"))


@_register("printed_values", _PAIRS + " SELECT a::BIGINT AS a, b::BIGINT AS b, regexp_replace(regexp_replace(printf(CASE WHEN abs(UNPHASED_R) >= 1 THEN '%.5f' ELSE '%.6f' END, UNPHASED_R::DOUBLE), '0+$', ''), '\\.$', '') AS text FROM vcor")
def printed_values(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.pairs(spark, d).select("a", "b", export.six_digits(F.col("UNPHASED_R")).alias("text"))


# --- files and stored matrices ---

_STORED: dict[tuple[str, str, str], str] = {}


def _kept(spark: SparkSession, d: str, name: str, write: Callable[[str], None]) -> str:
    """Path of what write stores, once for an application and an input."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _STORED:
        path = fresh_path(spark)
        write(path)
        _STORED[key] = path
    return _STORED[key]


def _stored(spark: SparkSession, d: str) -> LDMatrix:
    return open_matrix(spark, _kept(spark, d, "matrix", lambda path: save(matrix(spark, d), path)))


def _variant_file(spark: SparkSession, d: str) -> str:
    return _kept(spark, d, "variants", lambda path: export.write_variants(fixtures.variants(spark, d), path))


def _pair_file(spark: SparkSession, d: str) -> str:
    def write(path: str) -> None:
        p = fixtures.pairs(spark, d).orderBy("a", "b")
        export.write_lines(p.select(F.col("ID_A").alias("#ID_A"), "REF_A", "ALT_A", "ID_B", "REF_B", "ALT_B", *STATS), path)

    return _kept(spark, d, "pairs", write)


_ROWS = " SELECT idx::BIGINT AS idx, chrom, pos, id, ref, alt FROM vars"


@_register("vars_roundtrip", _VARIANTS + _ROWS)
def vars_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The variant list through its text form, with places by file order."""
    return text.read_variants(spark, _variant_file(spark, d))


@_register("file_order", _VARIANTS + " SELECT idx::BIGINT AS idx, id FROM vars")
def file_order(spark: SparkSession, d: str) -> DataFrame:
    """Places over parts of rising length, which a scan deals to tasks longest first."""

    def write(path: str) -> None:
        v = fixtures.variants(spark, d)
        part = F.floor(F.sqrt(F.col("idx") / v.count()) * 7).cast("int")
        for k in range(7):
            v.where(part == k).coalesce(1).sortWithinPartitions("idx").select(F.col("id").alias("value")).write.text(f"{path}/part{k + 5}.txt")

    path = _kept(spark, d, "parts", write)
    return text.read_ids(spark, [f"{path}/part{k}.txt" for k in range(5, 12)])


@_register("vars_whitespace_scan", _VARIANTS + _ROWS)
def vars_whitespace_scan(spark: SparkSession, d: str) -> DataFrame:
    def write(path: str) -> None:
        export.write_variants(fixtures.variants(spark, d).withColumn("chrom", F.concat(F.lit("  "), "chrom", F.lit("  "))), path)

    return text.read_variants(spark, _kept(spark, d, "spaced", write), whitespace=True)


@_register("text_counts", _PAIRS + " SELECT 5::BIGINT AS variant_fields, (SELECT count(*) FROM vars)::BIGINT AS variant_rows, 'PHASED_R,UNPHASED_R,D,DPRIME' AS stats, (SELECT count(*) FROM vcor)::BIGINT AS pair_rows")
def text_counts(spark: SparkSession, d: str) -> DataFrame:
    v, p = _variant_file(spark, d), _pair_file(spark, d)
    row = (text.count_fields(spark, v), text.count_rows(spark, v), ",".join(text.stat_columns(text.header_fields(spark, p))), text.count_rows(spark, p))
    return spark.createDataFrame([row], "variant_fields long, variant_rows long, stats string, pair_rows long")


@_register("read_pair_table", _PAIRS + " SELECT (row_number() OVER (ORDER BY a, b) - 1)::BIGINT AS line, 'rs' || (a + 1000) AS ID_A, 'A' AS REF_A, 'C' AS ALT_A, 'rs' || (b + 1000) AS ID_B, 'A' AS REF_B, 'C' AS ALT_B, " + _show() + " FROM vcor")
def read_pair_table(spark: SparkSession, d: str) -> DataFrame:
    """The pair table from text, each pair with its line."""
    return _shown(text.read_pairs(spark, _pair_file(spark, d), "line"))


@_register("ingest_files", _MATRIX + f" SELECT col::BIGINT AS col, row::BIGINT AS row, {_show()} FROM m")
def ingest_files(spark: SparkSession, d: str) -> DataFrame:
    """Pair table and variant list from text, checked and in strict order."""
    pairs = text.read_pairs(spark, _pair_file(spark, d), "line")
    return _shown(ingest.from_pairs(pairs, text.read_variants(spark, _variant_file(spark, d)), 16, 0.2, "UNPHASED_R", strict=True).entries)


@_register("keep_list_file", _VARIANTS + " SELECT (row_number() OVER (ORDER BY idx) - 1)::BIGINT AS idx, chrom, pos, id, ref, alt FROM vars WHERE idx % 5 <> 2")
def keep_list_file(spark: SparkSession, d: str) -> DataFrame:
    """A list of places from text, and the variants it keeps as text again."""
    v = fixtures.variants(spark, d)
    listed = _kept(spark, d, "keep", lambda path: v.where("idx % 5 <> 2").select(F.col("idx").cast("string").alias("value")).write.text(path))
    subset = _kept(spark, d, "subset", lambda path: export.write_variants(v, path, text.read_keep(spark, listed)))
    return text.read_variants(spark, subset)


@_register("tabular_file", _MATRIX + " SELECT (row_number() OVER (ORDER BY col, row) - 1)::BIGINT AS line, 'rs' || (col + 1000) AS ID_A, 'A' AS REF_A, 'C' AS ALT_A, 'rs' || (row + 1000) AS ID_B, 'A' AS REF_B, 'C' AS ALT_B, printf('%.6f', UNPHASED_R::DOUBLE)::DOUBLE AS UNPHASED_R FROM m WHERE row > col")
def tabular_file(spark: SparkSession, d: str) -> DataFrame:
    """The matrix as a pair table in text, read back; values are printed with six digits."""
    path = _kept(spark, d, "tabular", lambda path: export.write_tabular(_stored(spark, d), path))
    back = text.read_pairs(spark, path, "line")
    return back.select("line", *text.PAIR_COLUMNS, F.round(F.col("UNPHASED_R").cast("double"), 6).alias("UNPHASED_R"))


@_register("stored_entries", _MATRIX + f" SELECT col::BIGINT AS col, row::BIGINT AS row, {_show()} FROM m")
def stored_entries(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_stored(spark, d).entries)


@_register("archive_entries", _MATRIX + f" SELECT col::BIGINT AS col, row::BIGINT AS row, {_show()} FROM m")
def archive_entries(spark: SparkSession, d: str) -> DataFrame:
    """The matrix through its archive form: distances of rows and quantised values."""
    path = _kept(spark, d, "archive", lambda path: write_archive(_stored(spark, d), path))
    return _shown(open_archive(spark, path).entries)


@_register("archive_variants", _VARIANTS + " SELECT idx::BIGINT AS idx, chrom, pos, id, ref, alt FROM vars")
def archive_variants(spark: SparkSession, d: str) -> DataFrame:
    path = _kept(spark, d, "archive", lambda path: write_archive(_stored(spark, d), path))
    return open_archive(spark, path, ["D"]).variants


@_register("stored_meta", _MATRIX + " SELECT (SELECT count(*) FROM vars)::BIGINT AS n_rows, (SELECT count(*) FROM vars)::BIGINT AS n_cols, count(*)::BIGINT AS nnz, 16::BIGINT AS bits, 'full' AS layout, '2.1' AS version, 'PHASED_R,UNPHASED_R,D,DPRIME' AS stats FROM m")
def stored_meta(spark: SparkSession, d: str) -> DataFrame:
    _stored(spark, d)
    meta = read_meta(spark, _kept(spark, d, "matrix", lambda path: None))
    row = (*meta["dim"].values(), meta["nnz"], meta["bits"], meta["format"], meta["version"], ",".join(meta["stats"]))
    return spark.createDataFrame([row], "n_rows long, n_cols long, nnz long, bits long, layout string, version string, stats string")


@_register("stored_column", _MATRIX + f" SELECT v.idx::BIGINT AS row, 10::BIGINT AS col, {_get(STATS)} FROM vars v LEFT JOIN m ON m.col = 10 AND m.row = v.idx")
def stored_column(spark: SparkSession, d: str) -> DataFrame:
    return _shown(query.column_at(_stored(spark, d), 10, list(STATS)))


@_register("stored_submatrix", _MATRIX + _LIST)
def stored_submatrix(spark: SparkSession, d: str) -> DataFrame:
    return _shown(query.submatrix_at(_stored(spark, d), _SOME, _OTHER, ["UNPHASED_R"]))


@_register("stored_pairwise", _MATRIX + f" SELECT r.ord::BIGINT AS ord, r.row::BIGINT AS row, r.col::BIGINT AS col, {_get(STATS)} FROM (SELECT idx AS ord, idx AS row, least(idx + idx % 60, (SELECT count(*) FROM vars) - 1) AS col FROM vars) r LEFT JOIN m ON m.col = r.col AND m.row = r.row")
def stored_pairwise(spark: SparkSession, d: str) -> DataFrame:
    m = _stored(spark, d)
    asked = m.variants.select(F.col("idx").alias("ord"), F.col("idx").alias("row"), F.least(F.col("idx") + F.col("idx") % 60, F.lit(m.n - 1)).alias("col"))
    return _shown(query.pairwise_at(m, asked, list(STATS)))


@_register("pairwise_order", _MATRIX + f" SELECT r.place::BIGINT AS place, {_get(('UNPHASED_R',))}, 'rs' || (r.row + 1000) AS var1, 'rs' || (r.col + 1000) AS var2 FROM (SELECT unnest({_PAIR_ROWS}) AS row, unnest({_PAIR_COLS}) AS col, unnest({list(range(len(_PAIR_ROWS)))}) AS place) r LEFT JOIN m ON m.col = r.col AND m.row = r.row")
def pairwise_order(spark: SparkSession, d: str) -> DataFrame:
    """A pairwise query's rows with their place in the answer: the order asked for."""
    got = query.fetch(_stored(spark, d), [f"rs{p + 1000}" for p in _PAIR_ROWS], [f"rs{p + 1000}" for p in _PAIR_COLS], "UNPHASED_R", pairwise=True)
    rows = [(i, *r) for i, r in enumerate(_shown(got).collect())]  # as many as asked for
    return spark.createDataFrame(rows, "place long, UNPHASED_R double, var1 string, var2 string")


@_register("submatrix_order", _MATRIX + ", s AS (" + _LIST.strip() + ") SELECT (row_number() OVER (ORDER BY row, col) - 1)::BIGINT AS place, row, col, UNPHASED_R FROM s")
def submatrix_order(spark: SparkSession, d: str) -> DataFrame:
    """A grid's rows with their place in the answer: by place on both axes, whatever was asked."""
    name = lambda places: [f"rs{p + 1000}" for p in reversed(places)]
    rows = [(i, *r) for i, r in enumerate(_shown(query.fetch(_stored(spark, d), name(_SOME), name(_OTHER), "UNPHASED_R")).collect())]  # as many as asked for
    return spark.createDataFrame(rows, "place long, row long, col long, UNPHASED_R double")


@_register("stored_index_region", _VARIANTS + " SELECT idx::BIGINT AS idx, id, pos, CAST(regexp_extract(id, '[0-9]+') AS BIGINT) AS id_number, 'rs%' AS id_template FROM vars WHERE chrom = '21' AND pos BETWEEN 150000 AND 220000")
def stored_index_region(spark: SparkSession, d: str) -> DataFrame:
    path = _kept(spark, d, "index", lambda path: index.save_index(index.build_index(fixtures.variants(spark, d)), path))
    return index.region(spark.read.parquet(path), "21", 150000, 220000).select("idx", "id", "pos", "id_number", "id_template")


@_register("stored_filter_range", _MATRIX + f" SELECT (col - 30)::BIGINT AS col, (row - 30)::BIGINT AS row, {_show()} FROM m WHERE col BETWEEN 30 AND 150 AND row BETWEEN 30 AND 150")
def stored_filter_range(spark: SparkSession, d: str) -> DataFrame:
    """A range in its text form, of a stored matrix."""
    return _shown(transform.filter_matrix(_stored(spark, d), between=text.parse_range("30-150")).entries)


@_register("path_template", "t AS (SELECT unnest(['20', '21', 'Y']) AS c, unnest([0, 1, 2]) AS place) SELECT place::BIGINT AS place, 'ld/chr' || c || '.vcor' AS path FROM t")
def path_template(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(text.expand_template("ld/chr{CHR}.vcor", "20, 21,Y"))), "place long, path string")


@_register("genome_places", _VARIANTS + " SELECT id, (row_number() OVER (ORDER BY chrom, pos, id) - 1)::BIGINT AS idx FROM vars")
def genome_places(spark: SparkSession, d: str) -> DataFrame:
    """Places in the order of chromosomes and positions, of variants in no order."""
    return genome.place_variants(fixtures.variants(spark, d).drop("idx")).select("id", "idx")
