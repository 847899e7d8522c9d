"""Ready libraries, batches, pictures, free and per-allele mutation, frozen outputs, the record of several objectives."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import losses
from sparkloom.plans import program, search
from sparkloom.plans.program import Architecture, Input, call, decode, random_genome
from sparkloom.registry import LIBRARIES, REGISTRY
from sparkloom.sources import pictures, tables


@pytest.mark.parametrize("name", sorted(LIBRARIES))
def test_libraries(name):
    made, (kind, fallback, families, only, without) = REGISTRY.library(name), LIBRARIES[name]
    specs = [s for group in made.ops.values() for s in group]
    assert specs and all(s.returns == kind and s.family in families.split() for s in specs)
    assert set(only.split()) <= set(REGISTRY.ops) and set(without.split()) <= set(REGISTRY.ops) and not set(without.split()) & set(made.ops)
    assert fallback is None or all(s.fallback == fallback for s in specs)
    if name == "float_graph":
        assert len(made.ops) == 103


def test_a_library_runs(spark):
    arch = Architecture((("x", "float"),), ("float",), (0,), nodes=5, arity=2, registry=REGISTRY.library("float_regression"))
    df = spark.createDataFrame([(float(k),) for k in range(5)], "x double")
    for seed in range(5):
        node = decode(arch, random_genome(arch, random.Random(seed)))[0]
        assert program.project(df, {"y": node}, arch.registry).where("y is null").count() == 0


def test_batches(spark):
    df = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") % 10).cast("double").alias("x"), F.lit(1.0).alias("t"))
    cut = tables.batched(df, "k", 4, seed=1)
    sizes = {r["batch"]: r["count"] for r in cut.groupBy("batch").count().collect()}
    assert set(sizes) == set(range(4)) and min(sizes.values()) > 600 and "Exchange" not in cut._jdf.queryExecution().executedPlan().toString()
    x = Input("x", "float")
    per = losses.score_batches(cut, [x, call("number_sum", x, x)], "t")
    whole = losses.score(df, [x, call("number_sum", x, x)], "t")
    assert [sum(b[k] * sizes[k] for k in sizes) / 3000 for b in per] == pytest.approx(whole)
    with pytest.raises(ValueError):
        tables.batched(df, "k", 0)


def png(path, pixels):
    h, w = pixels.shape[:2]
    raw = b"".join(b"\0" + r.astype(np.uint8).tobytes() for r in pixels)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0 if pixels.ndim == 2 else 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))


def test_pictures(spark, tmp_path):
    rng = np.random.default_rng(1)
    grey, colour = rng.integers(0, 256, (4, 6)), rng.integers(0, 256, (5, 3, 3))
    png(tmp_path / "grey.png", grey)
    png(tmp_path / "colour.png", colour)
    (tmp_path / "other.png").write_text("not a picture")
    got = {r["origin"].rpartition("/")[2]: r["img"] for r in pictures.read_pictures(spark, str(tmp_path)).collect()}
    assert set(got) == {"grey.png", "colour.png"} and (got["grey.png"]["h"], got["grey.png"]["w"]) == (4, 6)
    assert got["grey.png"]["pixels"] == pytest.approx((grey / 255).T.ravel().tolist())
    assert got["colour.png"]["pixels"] == pytest.approx((colour @ np.array(pictures.GREY) / 255).T.ravel().tolist())
    assert pictures.read_pictures(spark, str(tmp_path), most_pixels=20).count() == 1


def test_free_and_allele_mutation():
    arch = Architecture((("x", "float"), ("y", "float")), ("float",), (0,), nodes=12, arity=2, registry=REGISTRY.library("float_regression"))
    genome = random_genome(arch, random.Random(1))
    for seed in range(20):
        free = program.free_mutate(arch, genome, random.Random(seed), 1.0)
        assert all(a != b for a, b in zip(free.nodes[0], genome.nodes[0], strict=True)) and free.outputs == genome.outputs
        for made in (free, program.mutate_alleles(arch, genome, random.Random(seed), 0.5, 0.5)):
            decode(arch, made)
            for p, node in enumerate(made.nodes[0]):
                assert 0 <= node[0] < len(arch.operators("float")) and all(0 <= at < 2 + p and c == 0 for at, c in node[1:])
    assert program.free_mutate(arch, genome, random.Random(1), 0.0) == genome == program.mutate_alleles(arch, genome, random.Random(1), 0.0, 0.0)
    share = np.mean([a != b for s in range(40) for a, b in zip(program.free_mutate(arch, genome, random.Random(s), 0.3).nodes[0], genome.nodes[0], strict=True)])
    assert 0.2 < share < 0.4


def test_frozen_outputs_stay():
    arch = Architecture((("x", "float"),), ("float",), (0, 0), nodes=5, arity=2, registry=REGISTRY.library("float_regression"), frozen=True)
    genome = random_genome(arch, random.Random(1))
    assert genome.outputs == (5, 4)
    for seed in range(20):
        assert program.mutate(arch, genome, random.Random(seed), output_rate=1.0).outputs == (5, 4) == program.mutate_alleles(arch, genome, random.Random(seed), 0.5, 1.0).outputs
    with pytest.raises(ValueError):
        random_genome(Architecture((("x", "float"),), ("float",), (0, 0), nodes=1, frozen=True), random.Random(1))


def test_history_of_several_objectives():
    h = search.ObjectiveHistory()
    h.add([(1.0, 5.0), (2.0, 4.0), (3.0, 4.0), (2.0, 4.0)])
    h.add([(0.0, 0.0)])
    assert h.best == [(1.0, 4.0), (0.0, 0.0)] and h.front == [3, 1]
