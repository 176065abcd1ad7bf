"""Edge cases of projects, selections, tile maps, ranks and polygons."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from framequarry.operators import describe, project, raster, selections, shapes, tilemap
from framequarry.sources.frames import ranked


def one_project(spark):
    return project.created(spark.createDataFrame([(1, "a"), (2, "b")], "project_id int, name string"), 2, 2)


def test_what_must_stay_stays(spark):
    p = one_project(spark)
    assert project.layer_removed(p, 0).layers.count() == 2  # the only layer
    assert project.layer_removed(p, 9).layers.count() == 2
    assert project.frame_deleted(p, 0).frames.count() == 2  # the only frame
    assert project.tag_set(p, "t", 0, 1).tags.count() == 0  # too few frames
    assert {r.active_layer for r in project.with_active(p, frame=3, layer=7).heads.collect()} == {0}
    assert {r.place for r in project.layer_moved(p, 0, 5).layers.collect()} == {0}
    with pytest.raises(ValueError):
        project.frame_timed(p, 0, 0)
    with pytest.raises(ValueError):
        project.tag_set(p, "t", 3, 1)


def test_edits_of_some_projects(spark):
    p = one_project(spark)
    two = project.layer_added(p.only(spark.createDataFrame([(2,)], "project_id int")), "ink")
    assert [(r.project_id, r.layer_id, r.place) for r in two.layers.orderBy("place").collect()] == [(2, 0, 0), (2, 1, 1)]
    assert two.heads.first().active_layer == 1
    assert project.layer_removed(two, 0).heads.first().active_layer == 1
    gone = project.layer_removed(two, 1)
    assert gone.heads.first().active_layer == 0 and gone.layers.first().place == 0
    pixels = spark.createDataFrame([(2, [-1, 0, 0, -1])], "project_id int, pixels array<int>")
    drawn = project.cel_put(two, 1, 0, pixels)
    assert project.composites(drawn).first().pixels == [-1, 0, 0, -1]
    locked = project.layer_edited(drawn, 1, locked=True)
    assert project.recoloured(locked, -1, -65536).cels.first().pixels == [-1, 0, 0, -1]
    assert project.recoloured(drawn, -1, -65536).cels.first().pixels == [-65536, 0, 0, -65536]
    assert project.picked(drawn, 5, 0).first().argb is None


def test_broken_documents(spark):
    texts = spark.createDataFrame([(1, "{"), (2, "{}"), (3, None)], "project_id int, document string")
    assert project.loaded(texts, strict=False).heads.count() == 0
    with pytest.raises(Exception, match="not a project document"):
        project.loaded(texts).heads.collect()
    back = project.loaded(project.saved(one_project(spark)))
    assert back.frames.count() == 2 and back.tags.count() == 0 and back.cels.count() == 0


def test_empty_selections(spark):
    s, t = selections.box(*map(F.lit, (1, 2, 0, 5))), selections.box(*map(F.lit, (4, 4, 3, 3)))
    row = spark.range(1).select(selections.inset(s, 9).alias("i"), selections.united(s, t).alias("u"), selections.meets(s, t).alias("m"), selections.inset(t, 9).alias("j")).first()
    assert tuple(row.i) == (1, 2, 0, 5) and tuple(row.u) == (4, 4, 3, 3) and not row.m and tuple(row.j) == (5, 5, 1, 1)
    assert selections.outline(spark.range(1).select("id", s.alias("box"))).count() == 0


def test_blank_rasters(spark):
    blank = spark.createDataFrame([(1, 2, 2, [0, 0, 0, 0])], "frame_id int, w int, h int, pixels array<int>")
    assert raster.trimmed(blank).first().pixels == [0, 0, 0, 0]
    assert describe.scores(blank).first().score == 100
    assert describe.majorities(blank, 2).first().argb == 0
    assert describe.blob_findings(blank).count() == 0
    assert selections.by_colour(blank, 9, 9).count() == 0


def test_maps_with_unknown_tiles(spark):
    cells = spark.createDataFrame([(1, 0, 0, 0, 5, 0), (1, 0, 1, 0, -1, 0)], "map_id int, layer int, x int, y int, tile int, flip int")
    tiles = spark.createDataFrame([(0, [1, 2, 3, 4], 2)], "tile int, pixels array<int>, terrain int")
    assert tilemap.rendered(cells, tiles, 2).count() == 0
    assert {r.terrain for r in tilemap.terrain_of(cells, tiles).collect()} == {0}


def test_ranks_in_two_levels(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), k) for k in rng.sample(range(1000), 300)]
    got = ranked(spark.createDataFrame(rows, "g string, k int").repartition(5), "g", F.floor(F.col("k") / 7), ["k"], "n").collect()
    for g in ("a", "b", None):
        own = sorted(k for h, k in rows if h == g)
        assert [(r.k, r.n) for r in sorted(got, key=lambda r: r.k) if r.g == g] == [(k, i) for i, k in enumerate(own)]


def test_flat_polygons(spark):
    corners = [(1, 0, 0, 3), (1, 1, 9, 3), (1, 2, 5, 3), (2, 0, 0, 0), (2, 1, 4, 4), (3, 0, -5, -5), (3, 1, 50, -5), (3, 2, 50, 50), (3, 3, -5, 50)]
    got = shapes.polygons_filled(spark.createDataFrame(corners, "shape int, ord int, x int, y int"), ["shape"], 6, 4).collect()
    assert {r.shape for r in got} == {3} and len(got) == 24


@pytest.mark.parametrize("limit", ["10MB", "-1"])
def test_tiles_are_sent_to_the_cells(spark, limit):
    """Neither are cells held whole by each task, nor do all cells of a tile meet in one."""
    from framequarry.plans import projects

    cells, tiles = projects.cells(spark, "/root/testdata/sf0.001"), projects.tiles(spark)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        for out in (tilemap.rendered(cells, tiles, 2), tilemap.terrain_of(cells, tiles)):
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "BuildRight" in plan and "BuildLeft" not in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
