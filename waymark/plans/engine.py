"""The engine: a catalog of stars and names, and every question that can be put to it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.text import ascii_fold
from waymark.operators import journal, names, route, spatial
from waymark.operators.catalog import build
from waymark.sources import readers, writers
from waymark.sources.tables import materialize


class NotLoaded(Exception):
    pass


class Engine:
    """Name search, spatial search and routes over one catalog."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.stars: DataFrame | None = None
        self.names: DataFrame | None = None  # the index of names, with their stars' coordinates if it was stored
        self.ids: DataFrame | None = None  # stars by ranges of their ids, if they were stored
        self.side: float | None = None  # of the cells that stored stars are sorted by

    def set_stars(self, stars: DataFrame) -> Engine:
        """Stars (star_id, name, x, y, z); ids may come from ``with_ids``."""
        self.stars, self.names, self.ids, self.side = stars, None, None, None
        return self

    def set_names(self, index: DataFrame) -> Engine:
        """The index of names (``names.ranked``, or a stored one)."""
        self.names = index
        return self

    def set_cells(self, side: float) -> Engine:
        """The side of the cells that the stars' files are sorted by."""
        self.side = side
        return self

    def build(self, raw: DataFrame) -> Engine:
        """Catalog of raw systems that may be searched for, with ids in radix order."""
        return self.set_stars(self.with_ids(build(raw).where("searchable")))

    @staticmethod
    def with_ids(systems: DataFrame) -> DataFrame:
        ids = names.ranked(systems).select("name", "star_id")
        return materialize(systems.join(ids, "name"), "stars")

    def _loaded(self) -> DataFrame:
        if self.stars is None:
            raise NotLoaded("no stars are set")
        return self.stars

    def index(self) -> DataFrame:
        """The index of names, made once."""
        if self.names is None:
            self.names = materialize(names.ranked(self._loaded().select("name")), "index")
        return self.names

    def suggest_words(self, prefix: str, number: int = 10) -> list[str]:
        if self.stars is None:
            return []
        return [r["name"] for r in names.suggest_prefix(self.index(), prefix, number).orderBy("rank").collect()]

    def autocomplete(self, query: str, number: int = 10) -> list[str]:
        """Suggestions from the second character on."""
        return self.suggest_words(query, number) if len(query) >= 2 else []

    def get_star_from_coords(self, x: float, y: float, z: float) -> str | None:
        hit = spatial.nearest(self._loaded(), (x, y, z), start=self.side).first()
        return hit["name"] if hit else None

    def get_star_id(self, name: str) -> int | None:
        """The id of a name, told by its case."""
        hit = self.index().where((F.col("fold") == ascii_fold(F.lit(name))) & (F.col("name") == name)).first()
        return hit["star_id"] if hit else None

    def get_name(self, star_id: int) -> str | None:
        table = self.ids if self.ids is not None else self._loaded()
        hit = table.where(F.col("star_id") == star_id).first()
        return hit["name"] if hit else None

    def get_coords_for_star(self, name: str) -> dict | None:
        table = self._loaded()
        if self.names is not None and set("xyz") <= set(self.names.columns):
            table = self.names.where(F.col("fold") == ascii_fold(F.lit(name)))
        hit = table.where(F.col("name") == name).first()
        return {c: hit[c] for c in "xyz"} if hit else None

    def find_star_near_ray(self, origin: tuple, direction: tuple, tolerance: float) -> dict | None:
        hit = spatial.ray_pick(self._loaded(), origin, direction, tolerance).first()
        return {"name": hit["name"] or "Unknown", "coords": {c: hit[c] for c in "xyz"}} if hit else None

    def pick(self, nodes: DataFrame | None, origin: tuple, direction: tuple, fov: float, height: int) -> str | None:
        """A click: the route's nodes first (0.1 around the ray), then any star within eight pixels."""
        node = spatial.route_pick(nodes, origin, direction, 0.1).first() if nodes is not None else None
        if node:
            return self.get_star_from_coords(node["x"], node["y"], node["z"])
        star = self.find_star_near_ray(origin, direction, fov / height * 8)
        return star["name"] if star else None

    def find_route(self, start: tuple, end: tuple, on_report: Callable[[dict], None] | None = None, **options) -> list[dict]:
        """[{name, coords}] from start to end."""
        ids = route.find_route(self._loaded(), start, end, on_report=on_report, **options)
        table = self.ids if self.ids is not None else self._loaded()
        at = {r["star_id"]: r for r in table.where(F.col("star_id").isin(ids)).collect()}
        return [{"name": at[i]["name"] or "Unknown", "coords": {c: at[i][c] for c in "xyz"}} for i in ids]

    def route_by_name(self, start: str, end: str, external: DataFrame | None = None, **options) -> list[dict]:
        if not start.strip() or not end.strip():
            raise ValueError("a route needs two names")
        points = []
        for name in (start, end):
            found = self.get_coords_for_star(name)
            if found is None and external is not None:
                hit = journal.lookup(external.select("name").where(F.col("name") == name).distinct(), self._loaded().select("name", "x", "y", "z", F.lit(0).alias("pos")), external).first()
                found = {c: hit[c] for c in "xyz"} if hit and hit["x"] is not None else None
            if found is None:
                raise LookupError(f"no system named {name}")
            points.append(tuple(found[c] for c in "xyz"))
        return self.find_route(*points, **options)

    def save(self, path: str, side: float = 0.27, partitions: int = 8) -> None:
        """Stars by cells and by ids, and the index of names with their coordinates, under ``path``."""
        stars = self._loaded().select("star_id", "name", "x", "y", "z")
        index = names.ranked(stars.select("name")).drop("star_id").join(stars, "name")
        writers.write_stars(stars, f"{path}/stars", side, partitions)
        writers.write_ids(stars, f"{path}/ids", partitions)
        writers.write_names(index, f"{path}/names", partitions)
        self.spark.createDataFrame([(float(side),)], "side double").coalesce(1).write.mode("overwrite").json(f"{path}/cells")

    def load(self, path: str) -> Engine:
        """What ``save`` wrote; each question reads the files that its filters leave."""
        self.set_stars(readers.star_table(self.spark, f"{path}/stars"))
        self.ids = readers.star_table(self.spark, f"{path}/ids")
        side = self.spark.read.schema("side double").json(f"{path}/cells").first()["side"]
        return self.set_names(readers.names_index(self.spark, f"{path}/names")).set_cells(side)


class RouteState:
    """The current route and how far along it one is; places are kept, never recomputed."""

    def __init__(self):
        self.nodes: list[str] = []
        self.progress = 0

    def set_route(self, nodes: list[str]) -> None:
        self.nodes, self.progress = list(nodes), 0

    def clear_route(self) -> None:
        self.set_route([])

    def set_progress(self, n: int) -> None:
        """May go back, unlike what visits do."""
        self.progress = n

    def mark_visited(self, system: str) -> None:
        if system in self.nodes:
            self.progress = max(self.progress, self.nodes.index(system) + 1)
