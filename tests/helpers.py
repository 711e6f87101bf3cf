"""Small graphs as tables."""

from spoor.sources.tables import Graph


def graph(spark, cells, edges):
    """cells: (id, t, z, y, x)."""
    return Graph(spark.createDataFrame([(i, t, float(z), float(y), float(x)) for i, t, z, y, x in cells], "id bigint, t int, z double, y double, x double"), spark.createDataFrame(edges or [], "source bigint, target bigint"))


def shifted(cells):
    return [(i, t, z, y + 1, x) for i, t, z, y, x in cells]


def pairs(df):
    return {tuple(r) for r in df.collect()}


TRACK = ([(1, 0, 0, 0, 0), (2, 1, 0, 0, 0), (3, 2, 0, 0, 0), (4, 3, 0, 0, 0)], [(2, 1), (3, 2), (4, 3)])
DIVISION = (TRACK[0] + [(5, 2, 3, 0, 0), (6, 3, 3, 0, 0), (7, 4, 3, 0, 0)], TRACK[1] + [(5, 2), (6, 5), (7, 6)])
