import numpy as np
import pytest

from homestream.operators import match
from homestream.operators.match import nearest_match
from homestream.schemas import GALLERY

PLANS = [{}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "block_rows": 7, "probe_rows": 11}]


def frames(spark, probes, gallery):
    p = spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(probes)],
                              "probe_id long, encoding array<float>")
    g = spark.createDataFrame([(f"n{i}", i, [float(x) for x in v]) for i, v in enumerate(gallery)], GALLERY)
    return p, g


@pytest.mark.parametrize("plan", PLANS)
def test_brute_force(spark, plan):
    rnd = np.random.default_rng(7)
    centers = rnd.normal(size=(6, 16))
    gallery = (centers[rnd.integers(0, 6, 150)] + 0.1 * rnd.normal(size=(150, 16))).astype(np.float32)
    gallery[100:] = gallery[3]                                   # a third are copies of one vector
    probes = (centers[rnd.integers(0, 6, 90)] + 0.1 * rnd.normal(size=(90, 16))).astype(np.float32)
    probes[0] = gallery[120]                                     # exact hit on the copies: lowest index
    probes[1] = 50                                               # far away
    got = {r.probe_id: r for r in nearest_match(*frames(spark, probes, gallery), tolerance=0.55, **plan).collect()}
    assert len(got) == 90
    d = np.sqrt(((probes[:, None].astype(float) - gallery[None].astype(float)) ** 2).sum(2))
    for i in range(90):
        j = int(d[i].argmin())
        if d[i, j] <= 0.55:
            assert got[i].gallery_idx == j and got[i].name == f"n{j}" and abs(got[i].distance - d[i, j]) < 1e-12
            assert got[i].confidence == pytest.approx(1 - d[i, j])
        else:
            assert (got[i].name, got[i].gallery_idx, got[i].distance, got[i].confidence) == ("Unknown", None, None, 0.0)
    assert got[0].gallery_idx == 3 and got[1].name == "Unknown"


@pytest.mark.parametrize("plan", PLANS)
def test_edges(spark, plan):
    p, g = frames(spark, [[0, 0], [0, 3], None], [[0.5, 0], [-0.5, 0]])
    got = {r.probe_id: (r.name, r.distance, r.confidence) for r in nearest_match(p, g, tolerance=0.5, **plan).collect()}
    assert got == {0: ("n0", 0.5, 0.5), 1: ("Unknown", None, 0.0), 2: ("Unknown", None, 0.0)}   # tie, and exactly at tolerance
    empty = nearest_match(p, g.limit(0), **plan).collect()
    assert {(r.name, r.confidence) for r in empty} == {("Unknown", 0.0)} and len(empty) == 3


def test_gallery_travels_once(spark):
    """Shuffled gallery rows don't grow with the probes; only a block that very many visit gets copies."""
    rnd = np.random.default_rng(3)
    centers = rnd.normal(size=(8, 12)) * 5
    near = lambda n, pick: (centers[pick(n)] + 0.05 * rnd.normal(size=(n, 12))).astype(np.float32)
    spread, one = (lambda n: rnd.integers(0, 8, n)), (lambda n: np.zeros(n, int))
    gallery = near(200, spread)

    def met(probes, **options):
        p, g = frames(spark, probes, gallery)
        p, g = p.withColumnRenamed("encoding", "_vec"), g.withColumnRenamed("encoding", "_vec")
        visits, blocks = match._meetings(p, g, ["probe_id"], 0.5, 50, **options)
        return blocks.count(), visits.groupBy("_block", "_split", "_slot").count().agg({"count": "max"}).first()[0]

    plain = [met(near(n, spread), probe_rows=2000, sample=4)[0] for n in (50, 2000)]
    assert plain == [200, 200]
    rows, most = met(near(2000, one), probe_rows=200, sample=4)
    busy = 200 // 8 * 2                   # about the rows of one center
    assert 200 < rows <= 200 + 20 * busy and most < 2 * 200
    probes = near(600, one)
    p, g = frames(spark, probes, gallery)
    got = {r.probe_id: r.gallery_idx for r in nearest_match(p, g, tolerance=0.5, broadcast_bytes=0, block_rows=50, probe_rows=40, sample=3).collect()}
    d = ((probes[:, None].astype(float) - gallery[None].astype(float)) ** 2).sum(2)
    assert got == {i: int(d[i].argmin()) for i in range(600)}
