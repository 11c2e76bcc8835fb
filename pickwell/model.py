"""The factor model every scoring operator works on."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

FACTORS = "id int, features array<double>"


@dataclass(frozen=True)
class FactorModel:
    """Two factor tables ``(id int, features array<double>)`` of one rank.

    Batch and micro-batch models are the same thing; a model is never
    collected, so turning one into the other is a no-op.
    """

    rank: int
    users: DataFrame
    items: DataFrame
    _sizes: dict = field(default_factory=dict, compare=False, repr=False)

    def size(self, side: str) -> int:
        """Row count of ``users`` or ``items``, counted once."""
        if side not in self._sizes:
            self._sizes[side] = getattr(self, side).select("id").count()
        return self._sizes[side]

    def persist(self) -> "FactorModel":
        self.users.persist()
        self.items.persist()
        return self

    def unpersist(self) -> "FactorModel":
        self.users.unpersist()
        self.items.unpersist()
        return self
