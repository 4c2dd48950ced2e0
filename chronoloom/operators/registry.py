"""The zone registry: names, links, versions, the current zone.

locate() and the column forms resolve links to the canonical zone, whose name results report. A Registry holds one database; reload() gives another, and what
was built from the one before stays valid, as all of it is immutable.
"""

from __future__ import annotations

import os
import re
from pathlib import Path
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.operators.zones import UnknownZone, Zone
from chronoloom.sources.tzdb import Database, load, relations

CONTINENTS = ("Africa", "America", "Antarctica", "Arctic", "Asia", "Atlantic", "Australia", "Europe", "Indian", "Pacific", "Etc")
CURRENT = "CHRONOLOOM_TZ"


def zone_from_link(target: str) -> str | None:
    """The zone that a file's path names: what follows the last zoneinfo/, else from a continent on."""
    if "zoneinfo/" in target:
        return target.rsplit("zoneinfo/", 1)[1] or None
    m = re.search(rf"(?:^|/)((?:{'|'.join(CONTINENTS)})/.+)$", target)
    return m[1] if m else None


def windows_zones(xml: str) -> dict[str, str]:
    """Windows name to IANA name from windowsZones.xml: the first entry of each, and of that the first name."""
    out: dict[str, str] = {}
    for zone in ElementTree.fromstring(xml).iter("mapZone"):
        if zone.get("other") and zone.get("type"):
            out.setdefault(zone.get("other"), zone.get("type").split()[0])
    return out


class Registry:
    """Zones by name."""

    def __init__(self, path: str | None = None, db: Database | None = None):
        self._path, self._db, self._current = path, db, None

    @property
    def db(self) -> Database:
        if self._db is None:
            self._db = load(self._path)
        return self._db

    @property
    def loaded(self) -> bool:
        return self._db is not None

    def set_install(self, path: str) -> None:
        """The source of the database, before it is loaded."""
        if self.loaded:
            raise RuntimeError("the database is loaded already")
        self._path = path

    def get_install(self) -> str | None:
        return self._path

    def reload(self, path: str | None = None) -> Registry:
        """Another registry, of the path or of this one's, read when it is first used; this one stays as it is."""
        return Registry(path or self._path)

    def version(self) -> str:
        return self.db.version

    def zones(self) -> list[str]:
        return sorted(self.db.zones)

    def links(self) -> dict[str, str]:
        return {a: c for a in sorted(self.db.links) if (c := self.db.canonical(a))}

    def try_locate(self, name: str) -> Zone | None:
        """The zone of the database, else of a compiled file in TZDIR or the system's folder."""
        if self.db.canonical(name):
            return Zone(name, self.db)
        folder = Path(os.environ.get("TZDIR", "/usr/share/zoneinfo"))
        at = folder / name
        if name and folder in at.resolve().parents and at.is_file() and (raw := at.read_bytes()).startswith(b"TZif"):
            return Zone.from_file(raw, name)
        return None

    def locate(self, name: str) -> Zone:
        if zone := self.try_locate(name):
            return zone
        raise UnknownZone(f"no zone or link {name} in version {self.version()}" + (f" of {self._path}" if self._path else ""))

    def current_name(self, spark: SparkSession | None = None) -> str:
        """The zone that was set, else the environment's, the session's, or the system's."""
        if self._current or os.environ.get(CURRENT):
            return self._current or os.environ[CURRENT]
        if spark is not None:
            return spark.conf.get("spark.sql.session.timeZone")
        local = Path("/etc/localtime")
        return (zone_from_link(os.readlink(local)) if local.is_symlink() else None) or "UTC"

    def current_zone(self, spark: SparkSession | None = None) -> Zone:
        return self.locate(self.current_name(spark))

    def set_current_zone(self, name: str, spark: SparkSession | None = None) -> None:
        self.locate(name)
        self._current = name
        if spark is not None:
            spark.conf.set("spark.sql.session.timeZone", name)

    def reload_current_zone(self) -> str:
        self._current = None
        return self.current_name()

    def names(self, spark: SparkSession) -> DataFrame:
        """name, canonical, is_link."""
        rows = [(z, z, False) for z in self.zones()] + [(a, c, True) for a, c in self.links().items() if a not in self.db.zones]
        return spark.createDataFrame(rows, "name string, canonical string, is_link boolean")

    def with_canonical(self, df: DataFrame, column: str, to: str = "canonical", strict: bool = False) -> DataFrame:
        """df with the canonical name of the zones in a column; unknown ones are null, or errors if strict."""
        names = self.names(df.sparkSession).select(F.col("name").alias("__name"), F.col("canonical").alias(to))
        out = df.join(F.broadcast(names), F.col(column) == F.col("__name"), "left").drop("__name")
        if strict:
            unknown: Column = F.col(column).isNotNull() & F.col(to).isNull()
            out = out.withColumn(to, F.when(unknown, F.raise_error(F.concat(F.lit("unknown zone "), F.col(column)))).otherwise(F.col(to)))
        return out

    def relations(self, spark: SparkSession) -> dict[str, DataFrame]:
        return relations(spark, self.db)
