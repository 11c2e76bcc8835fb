"""The micro-batch layer: small models, merged lists, model swaps."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pickwell.model import FactorModel
from pickwell.operators.merging import LIST_LENGTH, merged_topn_bulk, merged_topn_users
from pickwell.operators.ratings import Parser, apply_parser
from pickwell.operators.recommenders import Model
from pickwell.operators.scoring import id_lists
from pickwell.plans.training import ITERATIONS, RANK, train_als
from pickwell.sources.models import drop_versions, latest_model, load_model, load_or_keep, newest_saved, newest_version, save_version
from pickwell.sources.tables import write_lists

log = logging.getLogger(__name__)

TRAIN_ABOVE = 100
KEPT_VERSIONS = 2


@dataclass
class ModelStore:
    """The batch model and the last stream model in use.

    Holds references only; ``swap`` caches a new factor model and releases the one
    it replaces. With ``versions``, a folder, stream models are saved there under their batch's number and used as saved, and
    :meth:`recover` finds the last one again in a new process. ``read`` opens a saved model; a recommender that is
    no factor model has a ``save(path)`` to match.
    """

    batch: Model | None = None
    stream: Model | None = None
    batch_path: str | None = field(default=None)
    versions: str | None = field(default=None)
    read: Callable[[SparkSession, str], Model] = field(default=load_model)

    def swap(self, *, batch: Model | None = None, stream: Model | None = None) -> None:
        for name, new in (("batch", batch), ("stream", stream)):
            old = getattr(self, name)
            if new is None or new is old:
                continue
            setattr(self, name, new.persist() if isinstance(new, FactorModel) else new)
            if isinstance(old, FactorModel):
                old.unpersist()

    def install_stream(self, spark: SparkSession, model: Model, number: int) -> None:
        """Use the model that batch ``number`` trained; the last two versions are kept."""
        if self.versions is None:
            self.swap(stream=model)
            return
        path = save_version(model, spark, self.versions, number)
        old, self.stream = self.stream, self.read(spark, f"{path}/model")
        if isinstance(old, FactorModel):
            old.unpersist()
        drop_versions(spark, self.versions, KEPT_VERSIONS)

    def recover(self, spark: SparkSession) -> bool:
        """Use the last stream model that was saved, as at a restart; False without one."""
        path = None if self.versions is None else newest_saved(spark, self.versions)
        if path is not None:
            self.stream = self.read(spark, f"{path}/model")
        return path is not None

    def load(self, spark: SparkSession, path: str | None) -> bool:
        """Install the batch model at ``path``; a bad path keeps the present one."""
        if path is None or path == self.batch_path:
            return False
        found = load_or_keep(spark, path, self.batch)
        if found is self.batch:
            return False
        self.swap(batch=found)
        self.batch_path = path
        return True

    def load_latest(self, spark: SparkSession, root: str) -> bool:
        """Install the newest saved model, as at start-up."""
        return self.load(spark, latest_model(spark, root))


@dataclass(frozen=True)
class SpeedSettings:
    rank: int = RANK
    iterations: int = ITERATIONS
    n: int = LIST_LENGTH
    train_above: int = TRAIN_ABOVE
    vector_source: str = "stream"
    dedupe: str = "max"
    seed: int = 0
    parser: Parser | None = None
    train: Callable[[DataFrame], Model] | None = None
    """Ratings of a large batch to its model; matrix factorisation without."""


def batch_users(ratings: DataFrame) -> DataFrame:
    """Distinct users of a batch as ``id``."""
    return ratings.select(F.col("user").alias("id")).distinct()


def is_large(lines: DataFrame, above: int = TRAIN_ABOVE) -> bool:
    """More than ``above`` rows; reads no further than it must."""
    return lines.limit(above + 1).count() > above


def speed_batch(
    lines: DataFrame, store: ModelStore, settings: SpeedSettings = SpeedSettings(), number: int = 0
) -> DataFrame | None:
    """Lists ``(user, items)`` for one micro-batch of lines, None if it has no rating.

    A large batch trains a model of its own, which becomes the stream model
    and gives lists for all its users; a small one looks its users up in the
    models at hand, all users in one job. Lines are parsed once, and the ratings held while the model is trained.
    """
    ratings = apply_parser(lines, settings.parser).persist()
    try:
        if ratings.isEmpty():
            return None
        if not is_large(lines, settings.train_above):
            if store.batch is None and store.stream is None:
                return None
            return id_lists(merged_topn_users(batch_users(ratings), store.batch, store.stream, settings.n, dedupe=settings.dedupe))
        if settings.train is None:
            model = train_als(ratings, settings.rank, settings.iterations, seed=settings.seed)
        else:
            model = settings.train(ratings)
        store.install_stream(lines.sparkSession, model, number)
    finally:
        # A model that is not saved reads the ratings again only if the cluster lost what it cached.
        ratings.unpersist()
    merged = merged_topn_bulk(
        store.batch, store.stream, settings.n, vector_source=settings.vector_source, dedupe=settings.dedupe
    )
    return id_lists(merged)


def run_speed_layer(
    lines: DataFrame,
    store: ModelStore,
    lists_path: str,
    checkpoint: str,
    settings: SpeedSettings = SpeedSettings(),
    *,
    before_batch: Callable[[], None] | None = None,
    stop_on_error: bool = False,
    **trigger,
) -> StreamingQuery:
    """Run ``speed_batch`` on every micro-batch and store its lists.

    Lists are written under the stream's checkpoint and the batch's number, so a
    repeated batch replaces its own output and nothing else. A failing batch is logged and the stream goes on, unless
    ``stop_on_error``. A store without a stream model gets the last one saved, so a restart goes on from it.
    """
    if store.stream is None:
        store.recover(lines.sparkSession)

    def handle(batch: DataFrame, number: int) -> None:
        try:
            if before_batch is not None:
                before_batch()
            lists = speed_batch(batch, store, settings, number)
            if lists is not None:
                write_lists(lists, lists_path, writer=f"{checkpoint}#{number}")
        except Exception:
            if stop_on_error:
                raise
            log.exception("micro-batch %s failed", number)

    writer = lines.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def follow_models(versions: DataFrame, store: ModelStore, checkpoint: str, **trigger) -> StreamingQuery:
    """Install batch models as their version events arrive."""

    def handle(events: DataFrame, _: int) -> None:
        for row in newest_version(events).toLocalIterator():
            store.load(events.sparkSession, row.path)

    writer = versions.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "10 seconds"})).start()
