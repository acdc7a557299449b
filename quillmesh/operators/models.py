"""A registry of embedding models: what a model needs of its texts and gives as vectors, by key or by id."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd

from .index import hashing_embedder


@dataclass(frozen=True)
class Model:
    """A model: its key and id, vector size, what is put in front of a passage and of a query, and how to make its embedder."""

    key: str
    id: str
    dimensions: int
    passage_prefix: str = ""
    query_prefix: str = ""
    make: Callable[[], Callable[[pd.Series], pd.Series]] | None = None


class Registry:
    """Models by key; a key or an id that is taken is an error."""

    def __init__(self, *models: Model):
        self._models: dict[str, Model] = {}
        for m in models:
            self.add(m)

    def add(self, model: Model) -> None:
        if model.key in self._models or self.by_id(model.id):
            raise ValueError(f"{model.key} or {model.id} is registered")
        self._models[model.key] = model

    def by_key(self, key: str) -> Model | None:
        return self._models.get(key)

    def by_id(self, id_: str) -> Model | None:
        return next((m for m in self._models.values() if m.id == id_), None)

    def all(self) -> list[Model]:
        return sorted(self._models.values(), key=lambda m: m.key)


#: What works offline; deployments add theirs.
MODELS = Registry(*(Model(f"hash-{n}", f"quillmesh/hash-{n}", n, make=lambda n=n: hashing_embedder(n)) for n in (64, 384, 1024)))
