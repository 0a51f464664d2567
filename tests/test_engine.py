"""Sources, store, facade, transforms and errors on small inputs, against dense numpy matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkspan import cli, fixtures, session
from linkspan.functions import codec, ids
from linkspan.operators import chunks, export, index, ingest, metrics, query, transform
from linkspan.operators.matrix import LDMatrix, open_matrix, save
from linkspan.plans import genome
from linkspan.schema import MAX_ERROR
from linkspan.sources import archive, square, text
from linkspan.sources.vcf import read_vcf

N = 23


def dense(matrix: LDMatrix, stat: str) -> np.ndarray:
    out = np.zeros((matrix.n, matrix.n), np.float32)
    for r in matrix.both_triangles().collect():
        out[r["row"], r["col"]] = r[stat]
    return out


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d, rng = tmp_path_factory.mktemp("ld"), np.random.default_rng(5)
    (d / "v.pvar").write_text("##x\n#CHROM\tPOS\tID\tREF\tALT\tINFO\n" + "".join(f"{'Y' if i >= 12 else 7}\t{100 + 10 * i}\trs{i + 1}\tA\tC\t.\n" for i in range(N)))
    full = np.triu(rng.uniform(-1, 1, (N, N)), 1).astype(np.float32)
    lines = ["#ID_A\tREF_A\tALT_A\tID_B\tREF_B\tALT_B\tUNPHASED_R\tD\tother"]
    lines += [f"rs{i + 1}\tA\tC\trs{j + 1}\tA\tC\t{full[i, j]!s}\t{full[i, j] / 2!s}\tx" for i in range(N) for j in range(i + 1, N)]
    (d / "p.vcor").write_text("\n".join(lines) + "\n")
    sym = full + full.T + np.eye(N, dtype=np.float32)
    sym.T.astype("<f4").tofile(d / "s.bin")
    (d / "s.vars").write_text("".join(f"rs{i + 1}\n" for i in range(N)))
    return d, sym


@pytest.fixture(scope="module")
def matrix(spark, files):
    d, _ = files
    return ingest.from_pairs(text.read_pairs(spark, str(d / "p.vcor")), text.read_variants(spark, str(d / "v.pvar")), 99, 0.0, "UNPHASED_R")


def test_headers_and_counts(spark, files):
    d, _ = files
    assert text.header_fields(spark, str(d / "v.pvar"))[:5] == list(text.VARIANT_COLUMNS)
    assert text.count_fields(spark, str(d / "v.pvar")) == 6 and text.count_rows(spark, str(d / "v.pvar")) == N
    assert [r["id"] for r in text.read_variants(spark, str(d / "v.pvar")).orderBy("idx").collect()] == [f"rs{i + 1}" for i in range(N)]
    assert text.stat_columns(text.header_fields(spark, str(d / "p.vcor"))) == ["UNPHASED_R", "D"]
    with pytest.raises(ValueError, match="header"):
        text.read_variants(spark, str(d / "p.vcor"))


def test_keep_list_and_ranges(spark, tmp_path):
    (tmp_path / "k").write_text("3\n5\n8\n")
    assert [r[0] for r in text.read_keep(spark, str(tmp_path / "k")).collect()] == [3, 5, 8]
    (tmp_path / "b").write_text("3\nx\n8\n")
    with pytest.raises(ValueError, match="line 2"):
        text.read_keep(spark, str(tmp_path / "b"))
    assert text.parse_range("3-9") == (3, 9)
    with pytest.raises(ValueError):
        text.parse_range("9-3")
    assert text.expand_template("a{CHR}.x", "1,X") == ["a1.x", "aX.x"]


@pytest.mark.parametrize("bits", [8, 16, 32, 99])
def test_roundtrip_error_and_store(spark, files, matrix, bits, tmp_path):
    _, sym = files
    m = matrix.with_entries(matrix.entries, bits=bits)
    save(m, str(tmp_path / "m"), 3)
    back = open_matrix(spark, str(tmp_path / "m"))
    assert back.meta()["nnz"] == N * N and back.stats == ["UNPHASED_R", "D"] and back.bits == bits and back.dim == (N, N)
    assert np.abs(dense(back, "UNPHASED_R") - sym).max() <= MAX_ERROR[bits] + 1e-7
    assert np.isnan(np.diag(dense(back, "D"))).all()
    assert "statistics" in back.summary() and "16" in str(back) or bits != 16


def test_codec_traps(spark):
    values = [float("nan"), 2.0, -3.0, 0.5, -0.5, 0.0, 1.0, -1.0]
    frame = spark.createDataFrame([(v,) for v in values], "v float").select("v", codec.quantise(F.col("v"), 8).alias("q"))
    assert [r["q"] for r in frame.collect()] == [-128, 127, -127, 64, -64, 0, 127, -127]
    again = frame.select("q", codec.quantise(codec.dequantise(F.col("q"), 8), 8).alias("q2"))
    assert all(r["q"] == r["q2"] for r in again.collect())


def test_square_source_and_bad_variants(spark, files, tmp_path):
    d, sym = files
    bad = sym.copy()
    bad[[0, 7], :] = np.nan
    bad[:, [0, 7]] = np.nan
    bad.T.astype("<f4").tofile(tmp_path / "b.bin")
    cells = square.read_square(spark, str(tmp_path / "b.bin"), N)
    variants = text.read_variants(spark, str(d / "v.pvar"))
    m = ingest.from_square(cells, variants, 99, 0.0)
    keep = [i for i in range(N) if i not in (0, 7)]
    assert m.n == N - 2 and np.array_equal(dense(m, "PHASED_R"), sym[np.ix_(keep, keep)])
    export.write_square(m, "PHASED_R", str(tmp_path / "o"))
    assert np.array_equal(np.fromfile(tmp_path / "o.PHASED_R.bin", "<f4").reshape(N - 2, N - 2).T, sym[np.ix_(keep, keep)])
    bad[:] = np.nan
    bad.tofile(tmp_path / "n.bin")
    with pytest.raises(ValueError, match="not numbers"):
        ingest.from_square(square.read_square(spark, str(tmp_path / "n.bin"), N), variants)


def test_fetch_shapes_order_and_errors(spark, files, matrix):
    _, sym = files
    get = lambda *a, **k: query.fetch(matrix, *a, types="UNPHASED_R", **k)
    assert get(3, 5, shape="simple") == pytest.approx(sym[2, 4])
    assert get(3, [9, 2], shape="simple") == pytest.approx({2: sym[2, 1], 9: sym[2, 8]})
    assert get(["rs9", "rs2"], "rs4", shape="simple") == pytest.approx({"rs2": sym[1, 3], "rs9": sym[8, 3]})
    assert list(get(["rs9", "rs2"], ["rs4", "rs1"], shape="simple")) == ["rs2", "rs9"]
    pairs = get(["rs9", "rs2", "rs9"], ["rs4", "rs1", "rs4"], pairwise=True, shape="simple")
    assert [(p["var1"], p["var2"]) for p in pairs] == [("rs9", "rs4"), ("rs2", "rs1"), ("rs9", "rs4")]
    assert [p["UNPHASED_R"] for p in pairs] == pytest.approx([sym[8, 3], sym[1, 0], sym[8, 3]])
    assert get([1, 2], [3, 4], shape="matrix").columns == ["row", "2", "3"]
    for args, kind, word in [(([], [1]), ValueError, "non-empty"), (([1, 1], [2]), ValueError, "duplicate"), (([0], [2]), ValueError, "positive"), ((["rs1"], [2]), TypeError, "same type"), ((["zz9"], ["rs1"]), KeyError, "Missing"), (([99], [1]), IndexError, "bounds")]:
        with pytest.raises(kind, match=word):
            get(*args)
    with pytest.raises(ValueError, match="equal length"):
        get([1, 2], [3], pairwise=True)
    with pytest.raises(ValueError, match="sorted"):
        get([4, 2], [3, 3], pairwise=True, strict=True)
    with pytest.raises(ValueError, match="not available"):
        query.fetch(matrix, 1, 2, "DPRIME")


def test_neighbours(spark, files, matrix):
    _, sym = files
    got = [r["idx"] for r in query.neighbors(matrix, "rs5", "UNPHASED_R", 0.4, 50).collect()]
    assert got == [j + 1 for j in range(12) if abs(sym[4, j]) >= 0.4 and abs(j - 4) <= 5]
    # Values of D with itself are not numbers: they never pass a threshold.
    assert 5 not in [r["idx"] for r in query.neighbors(matrix, 5, "D", 0.0, 50).collect()]


def test_filter_and_composition(spark, files, matrix):
    _, sym = files
    once = transform.filter_matrix(matrix, keep=[20, 3, 4, 9, 11])
    keep = [3, 4, 9, 11, 20]
    assert np.array_equal(dense(once, "UNPHASED_R"), sym[np.ix_(keep, keep)])
    twice = transform.filter_matrix(once, keep=[0, 2, 4])
    assert np.array_equal(dense(twice, "UNPHASED_R"), sym[np.ix_([3, 9, 20], [3, 9, 20])])
    with pytest.raises(ValueError):
        transform.filter_matrix(matrix)
    with pytest.raises(IndexError):
        transform.filter_matrix(matrix, keep=[N])
    with pytest.raises(ValueError):
        transform.filter_matrix(matrix, keep=[4, 3], strict=True)


def test_concat_associative_and_overlapping(spark, files, matrix):
    part = lambda a, b: transform.filter_matrix(matrix, between=(a, b))
    a, b, c = part(0, 6), part(7, 12), part(13, 22)
    left, flat = transform.concat([transform.concat([a, b]), c]), transform.concat([a, b, c])
    assert np.array_equal(dense(left, "UNPHASED_R"), dense(flat, "UNPHASED_R")) and flat.n == N
    _, sym = files
    joined = transform.concat([part(0, 9), part(6, 16), part(14, 22)], overlapping=True)
    got, here = dense(joined, "UNPHASED_R"), np.zeros((N, N), bool)
    for x, y in ((0, 9), (6, 16), (14, 22)):
        here[x : y + 1, x : y + 1] = True
    assert np.array_equal(got, np.where(here, sym, 0)) and joined.nnz == here.sum()
    assert [r["id"] for r in joined.variants.orderBy("idx").collect()] == [f"rs{i + 1}" for i in range(N)]
    wrong = part(6, 16)
    wrong = wrong.with_entries(wrong.entries, variants=wrong.variants.withColumn("id", F.when(F.col("idx") == 2, "rs77").otherwise(F.col("id"))))
    with pytest.raises(ValueError, match="differ"):
        transform.concat([part(0, 9), wrong], overlapping=True)


def test_ids(spark):
    cases = {"rs12": (12, "rs%"), "chr17_1000_rs12_A_T": (12, "chr17_1000_rs%_A_T"), "123456789012": (123456789012, "123456789012"), "1:5:A:C": (5, "1:%:A:C")}
    frame = spark.createDataFrame([(k,) for k in cases], "id string").select("id", ids.id_number(F.col("id")).alias("n"), ids.id_template(F.col("id")).alias("t"))
    assert {r["id"]: (r["n"], r["t"]) for r in frame.collect()} == cases
    assert all(r["id"] == r["x"] for r in frame.select("id", ids.join_id(F.col("n"), F.col("t")).alias("x")).collect())
    with pytest.raises(ValueError, match="no digit"):
        index.build_index(spark.createDataFrame([(0, "abc")], "idx long, id string"))


def test_ingest_errors(spark, files):
    d, _ = files
    pairs, variants = text.read_pairs(spark, str(d / "p.vcor")), text.read_variants(spark, str(d / "v.pvar"))
    with pytest.raises(ValueError, match="not in the variant list"):
        ingest.from_pairs(pairs, variants.where("idx <> 3"), 8, 0.0, "UNPHASED_R")
    with pytest.raises(ValueError, match="duplicate variant rs1 in lines 1, 2"):
        ingest.from_pairs(pairs, variants.withColumn("id", F.when(F.col("idx") < 2, "rs1").otherwise(F.col("id"))), 8, 0.0, "UNPHASED_R")
    with pytest.raises(ValueError, match="not available"):
        ingest.from_pairs(pairs, variants, 8, 0.0, "PHASED_R")
    empty = ingest.from_pairs(pairs.limit(0), variants, 8, 0.0, "UNPHASED_R")
    assert np.array_equal(dense(empty, "UNPHASED_R"), np.eye(N))


def test_printed_like_streams(spark):
    cases = {0.5: "0.5", 1e-7: "1e-07", -0.123456789: "-0.123457", 1.0: "1", 0.0: "0", 123456.7: "123457", 1234567.0: "1.23457e+06", 0.0001: "0.0001", 0.00001234: "1.234e-05", float("nan"): "nan"}
    frame = spark.createDataFrame([(k,) for k in cases], "v double").select(export.six_digits(F.col("v")).alias("t"))
    assert [r["t"] for r in frame.collect()] == list(cases.values())


def test_command_line(spark, files, tmp_path):
    d, sym = files
    run = lambda *a: cli.main(list(map(str, a)), spark)
    run("compress", "plinkTabular", "-l", d / "p.vcor", "-s", d / "v.pvar", "-o", tmp_path / "m", "-b", 99, "-m", 0, "-k", "UNPHASED_R")
    run("filter", "-i", tmp_path / "m", "-o", tmp_path / "f", "-r", "2-9")
    run("decompress", "-i", tmp_path / "f", "-o", tmp_path / "x", "-t", "binary")
    assert np.array_equal(np.fromfile(tmp_path / "x.UNPHASED_R.bin", "<f4").reshape(8, 8), sym[2:10, 2:10])
    run("decompress", "-i", tmp_path / "f", "-o", tmp_path / "t", "-t", "tabular")
    again = text.read_pairs(spark, str(tmp_path / "t"))
    assert again.count() == 28
    run("concat", "-i", tmp_path / "f", tmp_path / "f", "-o", tmp_path / "c")
    assert open_matrix(spark, str(tmp_path / "c")).n == 16
    run("compress", "plinkSquare", "-l", d / "s.bin", "-s", d / "s.vars", "-o", tmp_path / "q", "-b", 99, "-m", 0, "-t", "PHASED_R")
    assert np.array_equal(dense(open_matrix(spark, str(tmp_path / "q")), "PHASED_R"), sym)


def test_genome_equals_chunks(spark):
    variants = fixtures.genotypes(spark, "/root/testdata/sf0.001").where("idx % 125 < 25").drop("idx")
    whole, parts = genome.build_genome(variants, 8000, 0.02, 16), genome.by_chunks(variants, 8000, 0.02, 16)
    shown = lambda m: sorted((r["col"], r["row"], repr(r["UNPHASED_R"])) for r in m.entries.collect())
    assert whole.n == parts.n == 100 and shown(whole) == shown(parts)
    with pytest.raises(ValueError):
        genome.check_parameters(vcf="a", pfile="b")


def test_places_follow_files_whatever_their_length(spark, tmp_path):
    names = [f"id{i}" for i in range(90)]
    cuts = [0, 3, 9, 18, 30, 48, 90]
    for k in range(6):
        (tmp_path / f"part-{k + 7}.txt").write_text("# note\n" + "".join(f"{x}\n\n" for x in names[cuts[k] : cuts[k + 1]]))
    assert [r["id"] for r in text.read_ids(spark, str(tmp_path)).orderBy("idx").collect()] == names
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64")  # several blocks a file
        assert [(r["idx"], r["id"]) for r in text.read_ids(spark, str(tmp_path)).orderBy("idx").collect()] == list(enumerate(names))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)


def test_own_variant_files_read_back_in_order(spark, tmp_path):
    rows = [(i, "1", 10 + i, f"rs{i}", "A", "C" * (1 + i // 4 % 50)) for i in range(400)]
    given = spark.createDataFrame(rows, "idx long, chrom string, pos int, id string, ref string, alt string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        export.write_variants(given, str(tmp_path / "v"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [tuple(r) for r in text.read_variants(spark, str(tmp_path / "v")).orderBy("idx").collect()] == rows


def test_strict_order_is_that_of_the_file(spark, files, tmp_path):
    d, _ = files
    variants = text.read_variants(spark, str(d / "v.pvar"))
    pairs = text.read_pairs(spark, str(d / "p.vcor"), "line")
    assert ingest.from_pairs(pairs, variants, 8, 0.0, "UNPHASED_R", strict=True).entries.count() == N * N
    lines = (d / "p.vcor").read_text().split("\n")
    lines[5], lines[40] = lines[40], lines[5]
    (tmp_path / "w.vcor").write_text("\n".join(lines))
    wrong = text.read_pairs(spark, str(tmp_path / "w.vcor"), "line")
    with pytest.raises(ValueError, match="not in order"):
        ingest.from_pairs(wrong, variants, 8, 0.0, "UNPHASED_R", strict=True)
    with pytest.raises(ValueError, match="line="):
        ingest.from_pairs(pairs.drop("line"), variants, 8, 0.0, "UNPHASED_R", strict=True)


def test_window_pairs_by_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, str(rng.integers(1, 3)), int(rng.integers(0, 200)), f"v{i}") for i in range(80)]  # places in no order of positions, equal positions
    got = chunks.window_pairs(spark.createDataFrame(rows, "idx long, chrom string, pos int, id string"), 17, [])
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and abs(a[2] - b[2]) <= 17)
    assert sorted((r["idx_a"], r["idx_b"]) for r in got.collect()) == want


@pytest.mark.parametrize(("chunk", "overlap"), [(None, None), (50, 13), (20, 0), (1000, 10)])
def test_variants_of_chunks_by_brute_force(spark, chunk, overlap):
    rng = np.random.default_rng(4)
    rows = [(str(rng.integers(1, 3)), int(x)) for x in rng.integers(5, 90, 40)] + [("X", 7), ("1", 400)]
    variants = spark.createDataFrame(rows, "chrom string, pos int")
    cut = chunks.genomic_chunks(metrics.chrom_bounds(variants), 15, chunk, overlap)
    want = sorted((c["chrom"], c["chunk_id"], n) for c in cut.collect() if (n := sum(x == c["chrom"] and c["start"] <= p <= c["end"] for x, p in rows)))
    assert sorted((r["chrom"], r["chunk_id"], r["n_variants"]) for r in chunks.nonempty_chunks(cut, variants).collect()) == want


def test_shared_folder_must_be_given_on_a_cluster(monkeypatch):
    class Elsewhere:
        applicationId, master = "app-elsewhere", "spark://somewhere:7077"  # noqa: N815

        def getConf(self):  # noqa: N802
            return {}

    with pytest.raises(ValueError, match="checkpoint"):
        session.run_folder(type("S", (), {"sparkContext": Elsewhere(), "conf": {}})())


def put_archive(prefix, columns, version, bits=8):
    """Bytes of an archive by hand: columns are lists of (row, code)."""
    put = lambda suffix, kind, values: np.array(values, kind).tofile(f"{prefix}{suffix}")
    stored, far, index = [], [], [0]
    for j, column in enumerate(columns):
        rows = [r for r, _ in column]
        for k, r in enumerate(rows):
            step = (r - rows[k - 1]) if k else (j - r)
            fits = 0 <= step < 32767
            stored.append(step if fits else 32767)
            far += [] if fits else [step % 2**32]
        index.append(len(far))
    put(".p.bin", "<u8", np.cumsum([0, *map(len, columns)]))
    if version == "1.1":
        put(".i.bin", "<u4", [r for c in columns for r, _ in c])
    else:
        put(".i.bin", "<i2", stored)
        put(".io.bin", "<u4", far)
        put(".io.index", "<u8", index)
    put(".x.D.bin", archive.WIDTHS[bits], [x for c in columns for _, x in c])
    n, known = len(columns), "" if version == "1.1" else f', "version": "{version}"'
    with open(f"{prefix}.meta.json", "w") as file:
        file.write(f'{{"dim": {{"rows": {n}, "cols": {n}}}, "nnz": {sum(map(len, columns))}, "bits": {bits}, "format": "full", "stats": ["D"]{known}}}')
    with open(f"{prefix}.vars.txt", "w") as file:
        file.write("".join(f"rs{i}\n" for i in range(n)))


@pytest.mark.parametrize("version", ["1.1", "2.1"])
@pytest.mark.parametrize("piece", [3, 1 << 18])
def test_archive_by_hand(spark, tmp_path, version, piece):
    """Empty columns, rows far apart, first rows beyond and far before their column, several stretches."""
    n, rng = 70_000, np.random.default_rng(7)
    columns = [[] for _ in range(n)]
    for j in [0, 1, 5, 4095, 4096, 9000, 69_999]:
        rows = sorted({j, 0, n - 1, *rng.integers(0, n, 6).tolist()}) if j != 5 else [69_000, 69_001]
        columns[j] = [(r, int(rng.integers(-128, 128))) for r in rows]
    put_archive(tmp_path / "a", columns, version)
    wanted = sorted((j, r, "nan" if x == -128 else str(np.float32(x) / np.float32(127))) for j, c in enumerate(columns) for r, x in c)
    if piece == 3:
        # In this process: pieces that cut columns.
        import pyarrow as pa

        before, archive.PIECE = archive.PIECE, piece
        try:
            batch = pa.RecordBatch.from_arrays([pa.array(range(-(-n // archive.STRETCH)))], names=["id"])
            out = archive._decoder(str(tmp_path / "a"), n, 8, version, ["D"])([batch])
            got = sorted((c, r) for b in out for c, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        finally:
            archive.PIECE = before
        assert got == [w[:2] for w in wanted]
        return
    m = archive.open_archive(spark, str(tmp_path / "a"))
    got = sorted((r["col"], r["row"], str(np.float32(r["D"]))) for r in m.entries.collect())
    assert got == wanted and m.n == n and m.nnz == len(wanted) and m.version == version
    assert m.variants.where("idx = 4096").first()["id"] == "rs4096"


@pytest.mark.parametrize("bits", [8, 16, 32, 99])
def test_archive_roundtrip(spark, matrix, bits, tmp_path):
    m = matrix.with_entries(matrix.entries, bits=bits)
    archive.write_archive(m, str(tmp_path / "a"))
    save(m, str(tmp_path / "m"))
    back, stored = archive.open_archive(spark, str(tmp_path / "a")), open_matrix(spark, str(tmp_path / "m"))
    assert back.meta() == stored.meta()
    for stat in m.stats:
        assert np.array_equal(dense(back, stat), dense(stored, stat), equal_nan=True)
    assert archive.open_archive(spark, str(tmp_path / "a"), ["D"]).entries.columns == ["col", "row", "D"]
    same = lambda v: [tuple(r) for r in v.select("idx", "chrom", "pos", "id", "ref", "alt").orderBy("idx").collect()]
    assert same(back.variants) == same(m.variants)


def test_archive_errors(spark, matrix, tmp_path):
    prefix = str(tmp_path / "a")
    with pytest.raises(FileNotFoundError, match="meta"):
        archive.open_archive(spark, prefix)
    archive.write_archive(matrix, prefix)
    with pytest.raises(ValueError, match="not available"):
        archive.open_archive(spark, prefix, ["N"])
    short = (tmp_path / "a.i.bin").read_bytes()
    (tmp_path / "a.i.bin").write_bytes(short[:-2])
    with pytest.raises(ValueError, match="too short"):
        archive.open_archive(spark, prefix)
    (tmp_path / "a.io.index").unlink()
    with pytest.raises(FileNotFoundError, match="index"):
        archive.open_archive(spark, prefix)
    with pytest.raises(ValueError, match="count"):
        archive.write_archive(matrix.with_entries(matrix.entries.withColumn("N", F.lit(3.0).cast("float"))), prefix)


def test_more_commands(spark, files, matrix, tmp_path, capsys):
    d, sym = files
    run = lambda *a: cli.main(list(map(str, a)), spark)
    save(matrix, str(tmp_path / "m"))
    run("decompress", "-i", tmp_path / "m", "-o", tmp_path / "a", "-t", "archive")
    run("import", "-i", tmp_path / "a", "-o", tmp_path / "again")
    assert np.array_equal(dense(open_matrix(spark, str(tmp_path / "again")), "UNPHASED_R"), sym)
    run("index", "-i", tmp_path / "a", "-o", tmp_path / "index")
    run("index", "-i", tmp_path / "a", "-o", tmp_path / "index2", "-s", d / "v.pvar")
    assert spark.read.parquet(str(tmp_path / "index")).count() == spark.read.parquet(str(tmp_path / "index2")).count() == N
    capsys.readouterr()
    run("fetch", "-i", tmp_path / "a", "-r", "rs3", "rs1", "-c", "rs2", "rs5", "--pairwise")
    lines = [x.split("\t") for x in capsys.readouterr().out.splitlines()]
    assert lines[0] == ["UNPHASED_R", "var1", "var2"] and [x[1:] for x in lines[1:]] == [["rs3", "rs2"], ["rs1", "rs5"]]
    assert np.isclose(float(lines[1][0]), sym[2, 1]) and np.isclose(float(lines[2][0]), sym[0, 4])
    run("fetch", "-i", tmp_path / "m", "-r", 1, 2, "-c", 3, "-t", "UNPHASED_R", "D", "-o", tmp_path / "rows")
    assert spark.read.text(str(tmp_path / "rows")).count() == 3
    run("neighbors", "-i", tmp_path / "m", "-v", "rs3", "-t", "UNPHASED_R", "-a", 0.3, "-g", 50)
    found = [x.split("\t")[1] for x in capsys.readouterr().out.splitlines()[1:]]
    assert found == [f"rs{i + 1}" for i in range(8) if abs(sym[i, 2]) >= 0.3]


def correlations(rows, window):
    """r of dosages and of haplotypes, D and D' of all pairs in the window, from their definitions."""
    out = {}
    for a in rows:
        for b in rows:
            if a[0] < b[0] and a[1] == b[1] and abs(a[2] - b[2]) <= window:
                (g1, h1), (g2, h2) = ((np.array(v[6], float), np.array(v[7], float)) for v in (a, b))
                with np.errstate(invalid="ignore", divide="ignore"):
                    p, q = h1.mean(), h2.mean()
                    d = (h1 * h2).mean() - p * q
                    most = min(p * (1 - q), q * (1 - p)) if d >= 0 else min(p * q, (1 - p) * (1 - q))
                    out[a[0], b[0]] = ((g1 * g2).mean() - g1.mean() * g2.mean()) / (g1.std() * g2.std()), d / np.sqrt(p * (1 - p) * q * (1 - q)), d, d / most
    return out


@pytest.mark.parametrize("tile", [3, 512])
def test_window_ld_by_brute_force(spark, tile, monkeypatch):
    monkeypatch.setattr(chunks, "TILE", tile)
    rng = np.random.default_rng(11)
    rows = []
    for i in range(70):
        h = (rng.random(24) < 0.4).astype(int)
        rows.append((i, str(rng.integers(1, 3)), int(rng.integers(0, 120)), f"v{i}", "A", "C", (h[::2] + h[1::2]).tolist(), h.tolist()))
    schema = "idx long, chrom string, pos int, id string, ref string, alt string, g array<tinyint>, h array<tinyint>"
    got = {(r["idx_a"], r["idx_b"]): r for r in chunks.window_ld(spark.createDataFrame(rows, schema), 17, ["ref", "alt"]).collect()}
    want = correlations(rows, 17)
    assert got.keys() == want.keys() and len(want) > 200
    for pair, values in want.items():
        r = got[pair]
        assert (r["id_a"], r["id_b"], r["pos_a"], r["alt_b"]) == (f"v{pair[0]}", f"v{pair[1]}", rows[pair[0]][2], "C")
        assert np.allclose([r[c] for c in ("UNPHASED_R", "PHASED_R", "D", "DPRIME")], values, equal_nan=True)
    assert chunks.window_ld(spark.createDataFrame([], schema), 17, []).count() == 0
    with pytest.raises(Exception, match="numbers of samples"):
        chunks.window_ld(spark.createDataFrame([rows[0], (99, *rows[0][1:6], [1], [0, 1])], schema), 17, []).collect()


def test_genome_from_calls(spark, tmp_path, capsys):
    rng = np.random.default_rng(2)
    rows = {}
    for chrom in ("2", "10"):
        lines = ["##fileformat=VCFv4.2", "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *(f"s{i}" for i in range(30))])]
        for i in range(25):
            h = (rng.random(60) < 0.5).astype(int)
            rows[f"rs{chrom}0{i}"] = (chrom, 1000 + 100 * i, h)
            calls = [f"{a}|{b}:9" if a != b or i % 2 else f"{a}/{b}:9" for a, b in zip(h[::2], h[1::2])]
            lines.append("\t".join([chrom, str(1000 + 100 * i), f"rs{chrom}0{i}", "A", "C", ".", ".", ".", "GT:DP", *calls]))
        (tmp_path / f"c{chrom}.vcf").write_text("\n".join(lines) + "\n")
    (tmp_path / "out.txt").write_text("rs204\n")
    cli.main(["genome", "--vcf_template", str(tmp_path / "c{CHR}.vcf"), "--chroms", "10,2", "-o", str(tmp_path / "m"), "-w", "1", "--ld_window_r2", "0", "-b", "99", "-m", "0", "--exclude", str(tmp_path / "out.txt"), "--stage", str(tmp_path / "s")], spark)
    assert "dimensions: 49 x 49" in capsys.readouterr().out
    m = open_matrix(spark, str(tmp_path / "m"))
    ids_in_order = [r["id"] for r in m.variants.orderBy("idx").collect()]
    assert ids_in_order == [k for k in rows if k != "rs204"]
    placed = [(i, *rows[k][:2], k, "A", "C", (rows[k][2][::2] + rows[k][2][1::2]).tolist(), rows[k][2].tolist()) for i, k in enumerate(ids_in_order)]
    want = correlations(placed, 1000)
    got = {(r["col"], r["row"]): r for r in m.entries.where("col < row").collect()}
    assert got.keys() == want.keys()
    assert all(np.allclose([got[k][c] for c in ("UNPHASED_R", "PHASED_R", "D", "DPRIME")], v, atol=1e-6) for k, v in want.items())
    assert spark.read.parquet(str(tmp_path / "m" / "index")).count() == spark.read.parquet(str(tmp_path / "s" / "variants")).count() == 49
    assert spark.read.parquet(str(tmp_path / "s" / "pairs")).count() == len(want)


@pytest.mark.parametrize("call", ["./.", "0/1", "0|2", "1", ".|1", ""])
def test_calls_that_cannot_be_used(spark, tmp_path, call):
    (tmp_path / "c.vcf").write_text("\t".join(["1", "5", ".", "A", "C", ".", ".", ".", "GT", "0|1", call]) + "\n")
    with pytest.raises(Exception, match="can't be used at 1:5:A:C"):
        read_vcf(spark, str(tmp_path / "c.vcf")).collect()
    (tmp_path / "d.vcf").write_text("\t".join(["1", "5", ".", "A", "C", ".", ".", ".", "GT", "0|1", "1/1"]) + "\n")
    row = read_vcf(spark, str(tmp_path / "d.vcf")).first()
    assert (row["idx"], row["id"], list(row["g"]), list(row["h"])) == (0, "1:5:A:C", [1, 2], [0, 1, 1, 1])
