"""A Spark-native engine for nested scene descriptions and for the data work around a training corpus."""

from tesserae.engine import Graph, Request, Result, SceneEngine, SceneLoader
from tesserae.plans.model import SceneTables
from tesserae.sources.cache import CacheEntry, SceneCache, hash_source

__all__ = ["CacheEntry", "Graph", "Request", "Result", "SceneCache", "SceneEngine", "SceneLoader", "SceneTables", "hash_source"]
