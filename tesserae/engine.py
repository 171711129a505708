"""The facade: one scene source through the pipeline, stage by stage or as a whole.

Stages are lazy DataFrames over a ``SceneTables`` bundle, which may hold many scenes; ``run`` is for one
source and writes its documents from the driver.
"""

from __future__ import annotations

import importlib
import json
import sys
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tesserae.operators import graph, packaging, scheduling, visibility
from tesserae.plans.model import SceneTables
from tesserae.session import local_session, scratch_scope
from tesserae.sources import export, payload
from tesserae.sources.cache import CacheEntry, SceneCache, hash_source

SCENE = "scene"

#: The lines a run prints.
SAID = {
    "scene": "Scene snapshot written to {0}",
    "graph": "Dependency graph written to {0}",
    "package": "Package manifest written to {0}",
    "visible": "Visibility analysis: {0} object(s) visible in frames {1}-{2}",
    "cached": "No changes detected for {0}; reusing cached outputs.",
    "cached scene": "Scene snapshot: {0}",
    "cached graph": "Dependency graph: {0}",
}


@dataclass
class Request:
    """One run. ``reader`` names the external program that reads binary scene files, ``reader_script`` what it is to run; both or neither."""

    input_path: str
    scene_output: str = "output/scene.json"
    graph_output: str = "output/dependency_graph.json"
    build_graph: bool = True
    build_package: bool = False
    optimize_package_by_visibility: bool = False
    frame_start: int = 1
    frame_end: int = 24
    package_output: str = "output/package.json"
    cache_dir: str | None = None
    reader: str | None = None
    reader_script: str | None = None


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame


@dataclass
class Result:
    """What a run made. From the cache only the paths and messages are set."""

    from_cache: bool = False
    tables: SceneTables | None = None
    graph: Graph | None = None
    visible_object_ids: set[str] | None = None
    package: dict | None = None
    scene_output_path: Path | None = None
    graph_output_path: Path | None = None
    package_output_path: Path | None = None
    messages: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    def say(self, what: str, *values: object) -> None:
        self.messages.append(SAID[what].format(*values))


class SceneEngine:
    """``reader`` and ``reader_script`` as in Request; ``host_module`` is the module by which one knows to be inside the application
    that makes binary scene files; ``read_binary`` (program, script, file) replaces the way the external program is called."""

    def __init__(
        self, spark: SparkSession | None = None, reader: str | None = None, reader_script: str | None = None, read_binary: Callable[[str, str, Path], str] = payload.inspect_external, host_module: str = "bpy"
    ):
        self.spark = spark or SparkSession.getActiveSession() or local_session()
        self.reader, self.reader_script, self.read_binary, self.host_module = reader, reader_script, read_binary, host_module

    # Stages.

    def load(self, path: str | Path, reader: str | None = None, reader_script: str | None = None) -> dict:
        """A JSON file's object, or what the external reader prints of a binary scene file; without a reader, or if it fails, a placeholder.

        A reader without a script is an error, and so is a binary file without a reader inside the application itself, which is not read there.
        """
        path = Path(path)
        if not path.exists():
            raise FileNotFoundError(f"Input file not found: {path}")
        if path.suffix.lower() == ".blend":
            return json.loads(self._read(path, reader or self.reader, reader_script or self.reader_script) or payload.placeholder(path.stem))
        data = json.loads(path.read_text(encoding="utf-8-sig"))
        if not isinstance(data, dict):
            raise TypeError("Scene payload must be a JSON object")
        return data

    def _read(self, path: Path, program: str | None, script: str | None) -> str | None:
        if program:
            if not script:
                raise ValueError("an external reader needs a reader script")
            try:
                return self.read_binary(program, script, path)
            except Exception as error:  # noqa: BLE001 - whatever the program does, the run goes on
                print(f"external reader failed: {error}", file=sys.stderr)
        try:
            host = importlib.import_module(self.host_module)
        except ImportError:
            return None
        if hasattr(host, "context"):
            raise NotImplementedError("binary scene files are read by an external program only")
        return None

    def scan(self, source: str | Path) -> SceneTables:
        """A source from its file to the scene model."""
        return self.analyze(self.load(source))

    def analyze(self, source: dict | DataFrame | SceneTables, strict: bool = True) -> SceneTables:
        """The scene model of one payload, of (scene_id, payload) rows, or of tables, which are taken as they are."""
        if isinstance(source, SceneTables):
            return source
        if isinstance(source, dict):
            check_payload(source)
            source = payload.payloads_of(self.spark, {SCENE: json.dumps(source)})
        return payload.normalize(source, strict)

    def build_dependency_graph(self, tables: SceneTables) -> Graph:
        return Graph(graph.nodes(tables), graph.edges(tables))

    def check_integrity(self, g: Graph) -> tuple[DataFrame, DataFrame]:
        """Missing targets and unused nodes."""
        return graph.missing_targets(g.nodes, g.edges), graph.unused_nodes(g.nodes, g.edges)

    def analyze_visibility(self, tables: SceneTables, frame_start: int, frame_end: int) -> DataFrame:
        return visibility.report(tables, frame_start, frame_end)

    def build_package(self, tables: SceneTables, frame_start: int, frame_end: int) -> DataFrame:
        return packaging.in_frames(tables.assets, frame_start, frame_end)

    def build_optimized_package(self, tables: SceneTables, g: Graph, frame_start: int, frame_end: int) -> DataFrame:
        return packaging.pruned_for(tables, g.nodes, g.edges, frame_start, frame_end)

    def build_scheduling_plan(self, tables: SceneTables, g: Graph, frame_start: int, frame_end: int, worker_count: int) -> DataFrame:
        return scheduling.costs(tables, g.nodes, g.edges, frame_start, frame_end, worker_count)

    # The whole.

    def run(self, request: Request) -> Result:
        result = Result()
        cache = SceneCache(request.cache_dir) if request.cache_dir else None
        digest = hash_source(request.input_path) if cache else None
        held = cache.get(request.input_path) if cache else None
        if held is not None and held.source_hash == digest:
            return self._cached(request, held, result)
        tables = result.tables = self.analyze(self.load(request.input_path, request.reader, request.reader_script))
        result.scene_output_path = export.write_json(export.document(tables), request.scene_output, sort_keys=True)
        result.say("scene", result.scene_output_path)
        if request.build_graph:
            result.graph = self.build_dependency_graph(tables)
            document = export.graph_document(result.graph.nodes, result.graph.edges)
            result.graph_output_path = export.write_json(document, request.graph_output)
            result.say("graph", result.graph_output_path)
            lines = {r["kind"]: r["message"] for r in graph.warnings(result.graph.nodes, result.graph.edges).collect()}
            result.warnings += [lines[k] for k in ("missing", "unused") if k in lines]
        if request.build_package:
            self._package(request, result)
        if cache:
            graph_path = str(result.graph_output_path) if result.graph_output_path else None
            cache.put(request.input_path, CacheEntry(digest, str(result.scene_output_path), graph_path))
        return result

    def _cached(self, request: Request, held: CacheEntry, result: Result) -> Result:
        result.from_cache = True
        result.scene_output_path = Path(held.scene_output)
        result.say("cached", request.input_path)
        result.say("cached scene", result.scene_output_path)
        if held.graph_output:
            result.graph_output_path = Path(held.graph_output)
            result.say("cached graph", result.graph_output_path)
        return result

    def _package(self, request: Request, result: Result) -> None:
        tables, start, end = result.tables, request.frame_start, request.frame_end
        extra: dict = {}
        with scratch_scope():
            chosen = self._chosen(request, result, extra)
        assets = [{"path": r["path"], "kind": r["kind"], "size_bytes": r["size_bytes"]} for r in chosen]
        result.package = {
            "package_id": f"pkg-{start}-{end}", "frame_start": start, "frame_end": end, "assets": assets,
            "metadata": {"asset_count": len(assets), "required_file_count": len(assets), "total_size_bytes": sum(a["size_bytes"] for a in assets)} | extra,
        }
        result.package_output_path = export.write_json(result.package, request.package_output)
        result.say("package", result.package_output_path)

    def _chosen(self, request: Request, result: Result, extra: dict) -> list:
        """The package's assets in order; what pruning says of itself goes to ``extra``."""
        tables, start, end = result.tables, request.frame_start, request.frame_end
        if request.optimize_package_by_visibility:
            g = result.graph or self.build_dependency_graph(tables)
            result.visible_object_ids = {r["object_id"] for r in self.analyze_visibility(tables, start, end).where("is_visible").collect()}
            result.say("visible", len(result.visible_object_ids), start, end)
            judged = self.build_optimized_package(tables, g, start, end)
            pruned = [r["size_bytes"] for r in judged.where("not is_kept").collect()]
            extra |= {"pruned_asset_count": len(pruned), "pruned_size_bytes": sum(pruned), "visible_object_count": len(result.visible_object_ids)}
            chosen = packaging.in_frames(judged.where("is_kept"), start, end)
        else:
            chosen = self.build_package(tables, start, end)
        return chosen.orderBy("asset_pos").collect()


def check_payload(source: dict) -> None:
    """Errors that concern a payload as a whole, raised before any job: lists that are none, and items that are no objects."""
    for key in ("collections", "objects", "materials", "lights", "textures", "images"):
        found = source.get(key, [])
        if not isinstance(found, list):
            raise TypeError(f"{key}: expected a list")
        if key in ("collections", "objects", "materials") and not all(isinstance(x, dict) for x in found):
            raise TypeError(f"{key} items must be dictionaries")
    for item in source.get("objects", []):
        if not isinstance(item.get("visibility", {}), dict):
            raise TypeError("object visibility must be a dictionary")


class SceneLoader:
    """Scenes from sources that only an adapter can read: whatever has ``load_scene(source)`` and gives a payload or tables."""

    def __init__(self, adapter: object | None = None, engine: SceneEngine | None = None):
        self.adapter, self.engine = adapter, engine

    def load(self, source: str) -> SceneTables:
        if self.adapter is None:
            raise RuntimeError("a scene loader needs an adapter")
        return (self.engine or SceneEngine()).analyze(self.adapter.load_scene(source))
