"""Binary rasters: reduction and fingerprints, figures of frames and boxes, crops and detectors against plain code."""

import hashlib

import numpy as np
import pytest

from framesift.operators import crops, jobs, quality, rasters


def plain_reduced(image, side=16):
    """Pixel by pixel, in whole numbers."""
    h, w = image.shape
    out = bytearray()

    def taps(i, size):
        centre = min(max((i + 0.5) * size / side - 0.5, 0), size - 1)
        low = int(centre)
        return low, min(low + 1, size - 1), int(np.rint((centre - low) * 2048))

    for y in range(side):
        y0, y1, fy = taps(y, h)
        for x in range(side):
            x0, x1, fx = taps(x, w)
            a, b, c, d = (int(image[q, p]) for q, p in ((y0, x0), (y0, x1), (y1, x0), (y1, x1)))
            total = (2048 - fy) * ((2048 - fx) * a + fx * b) + fy * ((2048 - fx) * c + fx * d)
            out.append((total + (1 << 21)) >> 22)
    return bytes(out)


@pytest.fixture(scope="module")
def images():
    r = np.random.default_rng(2)
    out = [r.integers(0, 256, (h, w)).astype(np.uint8) for h, w in ((8, 8), (16, 16), (1, 1), (1, 40), (90, 3), (45, 80), (45, 80), (108, 192))]
    return [*out, out[5].copy()]


def frame_rows(spark, images):
    rows = [(1 if i % 2 else None, i, bytearray(x.tobytes()), x.shape[1], x.shape[0]) for i, x in enumerate(images)]
    rows += [(1, 100, None, 4, 4), (1, 101, bytearray(b"abc"), 4, 4), (1, 102, bytearray(b""), 0, 0), (1, 103, bytearray(b"a"), None, 1)]
    return spark.createDataFrame(rows, "video_id long, seq long, px binary, width int, height int")


def test_fingerprints_of_mixed_sizes(spark, images):
    got = {r["seq"]: r["fingerprint"] for r in rasters.with_fingerprint(frame_rows(spark, images)).collect()}
    assert got == {i: hashlib.md5(plain_reduced(x)).hexdigest() for i, x in enumerate(images)} | dict.fromkeys((100, 101, 102, 103))
    first = {}
    for i, x in enumerate(images):
        first.setdefault((1 if i % 2 else None, plain_reduced(x)), []).append(i)
    found = rasters.distinct_frames(frame_rows(spark, images), "video_id", "seq").collect()
    assert sorted((r["seq"], r["copies"]) for r in found) == sorted((min(v), len(v)) for v in first.values())
    assert rasters.distinct_frames(frame_rows(spark, images).where("seq < 0"), "video_id", "seq").isEmpty()


def test_bytes_and_values(spark):
    df = spark.createDataFrame([([0, 255, 16],), ([],), (None,)], "px array<int>")
    assert [r[0] for r in df.select(rasters.as_values(rasters.as_bytes(df["px"]))).collect()] == [[0, 255, 16], [], None]


def test_figures_of_mixed_sizes(spark, images):
    got = {r["seq"]: r for r in quality.raster_quality(frame_rows(spark, images)).collect()}
    for i, x in enumerate(images):
        want = quality.figures(x)
        assert np.allclose([got[i][n] for n in quality.FIGURES], want)
    assert got[100]["laplacian"] is None and got[101]["contrast"] is None


def test_boxes_by_tables_and_alone(images):
    r = np.random.default_rng(3)
    image = images[-2]
    by_table = quality.BoxFigures(image)
    for _ in range(200):
        x1, y1 = int(r.integers(0, 190)), int(r.integers(0, 106))
        x2, y2 = int(r.integers(x1 + 1, 193)), int(r.integers(y1 + 1, 109))
        assert np.allclose(by_table(x1, y1, x2, y2), quality.figures(image[y1:y2, x1:x2]), rtol=1e-9, atol=1e-6)
    flat = quality.BoxFigures(np.full((20, 20), 200, np.uint8))(2, 2, 15, 15)
    assert np.allclose(flat, (0, 0, 200, 0), atol=1e-6)


def test_crops_are_bytes(spark, images):
    plan = spark.createDataFrame([(5, 0, -2, -1, 6, 4), (5, 1, 3, 3, 3, 9), (7, 0, 190, 100, 200, 120)], "seq long, box_id long, cx1 int, cy1 int, cx2 int, cy2 int")
    got = {(r["seq"], r["box_id"]): r for r in crops.crop_pixels(frame_rows(spark, images), plan, "seq").collect()}
    cut = np.zeros((5, 8), np.uint8)
    cut[1:, 2:] = images[5][:4, :6]
    assert bytes(got[5, 0]["px"]) == cut.tobytes() and sum(map(bool, got[5, 0]["alpha"])) == 24 and (got[5, 0]["width"], got[5, 0]["height"]) == (8, 5)
    assert bytes(got[5, 1]["px"]) == b"" and got[5, 1]["width"] == 0
    assert np.frombuffer(bytes(got[7, 0]["px"]), np.uint8).sum() == images[7][100:, 190:].sum()


def test_detector_batches(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        import os
        import uuid

        def run(some):
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                f.write(f"{len(some)} {sum(x.nbytes for x in some)}")
            if any(len(x) == 13 for x in some):
                raise ValueError("unlucky")
            return [[{"n": len(x)}] for x in some]

        return run

    rows = spark.createDataFrame([(i, bytearray(b"x" * (i % 20))) for i in range(200)] + [(900, None)], "k long, payload binary").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        results = []
        for records in ("7", "10000"):  # what a detector gets does not depend on Arrow's batches
            for p in tmp_path.iterdir():
                p.unlink()
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
            got = jobs.apply_detector(rows, load, "n int", "k", "payload", batch_size=16, batch_bytes=40).collect()
            assert sorted(r["k"] for r in got) == list(range(200))
            assert all((r["error"] is None) == bool(r["found"]) for r in got) and all(r["found"][0]["n"] == r["k"] % 20 for r in got if r["found"])
            assert {r["error"] for r in got} == {None, "ValueError: unlucky"} and all(r["error"] for r in got if r["k"] % 20 == 13)
            seen = sorted(p.read_text() for p in tmp_path.iterdir())
            assert all(int(n) <= 16 and (int(size) <= 40 or n == "1") for n, size in map(str.split, seen))
            results.append((sorted(map(str, got)), seen))
        assert results[0] == results[1]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_detector_retries(spark):
    def load():
        left = [2]

        def run(some):
            left[0] -= 1
            if left[0] >= 0:
                raise OSError("busy")
            return [[] for _ in some]

        return run

    rows = spark.createDataFrame([(1, [1, 2])], "k long, payload array<int>").coalesce(1)
    assert jobs.apply_detector(rows, load, "n int", "k", "payload").first()["error"] == "OSError: busy"
    assert jobs.apply_detector(rows, load, "n int", "k", "payload", retries=2).first()["error"] is None


def test_a_figure_at_a_limit_is_that_of_the_sql():
    # sums in another order differ in the last bits, which a limit shows
    duckdb = pytest.importorskip("duckdb")
    rng = np.random.default_rng(11)
    images = rng.integers(0, 256, (500, 8, 8)).astype(np.uint8)
    got = quality.stack_figures(images)
    want = [duckdb.sql(f"select list_stddev_pop({image.ravel().tolist()})").fetchall()[0][0] for image in images]
    assert got[:, 3].tolist() == want
    large = np.zeros((1, 80, 80), np.uint8)
    large[:, :40] = 50
    assert abs(quality.stack_figures(large)[0, 3] - 25) < 1e-12
