"""Engine plugins: extra URL patterns, extra folders and a step after the scan."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import values as V


class EnginePlugin(Protocol):
    id: str
    name: str
    engines: tuple[str, ...]

    def can_handle(self, meta: dict) -> bool: ...

    def additional_scan_dirs(self, workdir: str) -> list[str]: ...

    def url_patterns(self) -> Iterable[str]: ...

    def post_process(self, endpoints: DataFrame) -> DataFrame: ...


class GenericPlugin:
    """The last resort: what no other plugin takes."""

    id, name, engines = "generic", "Generic Android App", ("native",)

    def can_handle(self, meta: dict) -> bool:
        return meta.get("engine") in self.engines

    def additional_scan_dirs(self, workdir: str) -> list[str]:
        return []

    def url_patterns(self) -> Iterable[str]:
        return V.PLUGIN_URLS

    def post_process(self, endpoints: DataFrame) -> DataFrame:
        return endpoints


class Registry:
    """Plugins in the order of registration; the generic one is the last resort."""

    def __init__(self) -> None:
        self.generic = GenericPlugin()
        self.plugins: list[EnginePlugin] = [self.generic]

    def register(self, plugin: EnginePlugin) -> None:
        self.plugins.append(plugin)

    def list(self) -> list[EnginePlugin]:
        return [*self.plugins]

    def select(self, meta: dict) -> EnginePlugin:
        return next((p for p in self.plugins if p.id != "generic" and p.can_handle(meta)), self.generic)


def plugin_urls(lines: DataFrame, plugin: EnginePlugin) -> DataFrame:
    """(file, line, pattern, url): what the plugin's patterns find; patterns are literals, so each is compiled once."""
    every = F.array(*[F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in plugin.url_patterns()])
    found = lines.select("file", "line", F.posexplode(every).alias("pattern", "urls"))
    return found.select("file", "line", "pattern", F.explode("urls").alias("url"))
