"""Documents as a stream: each micro-batch goes on numbering where the vault stands."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.detect import Engine
from ..plans.materialize import drop, written
from ..plans.pseudonymize import pseudonymize
from ..sources.vault_store import VaultStore, people_store
from .people import people_of, people_stream


def pseudonymize_stream(
    docs: DataFrame,
    vault: str,
    sink: Callable[[DataFrame, int], None],
    checkpoint: str,
    policies: DataFrame | None = None,
    engines: Iterable[Engine] = (),
    coreference: bool = False,
    engine_threshold: float = 0.0,
    key: DataFrame | None = None,
) -> StreamingQuery:
    """``docs``: a stream of (dossier_id, seq, text). Late documents take later numbers.

    A batch reads the vault's buckets of its own dossiers and adds its new rows as one commit. A batch
    that is run again finds its rows there and adds none. With ``coreference`` people are numbered by
    ``people_stream``, whose state is in ``checkpoint``, and left in the vault's ``people_store``.
    ``sink`` gets the protected texts and the batch's number, and is done with the texts when it returns: their tables are deleted then.
    """
    engines = list(engines)

    def one(batch: DataFrame, n: int) -> None:
        store = VaultStore(batch.sparkSession, vault, key)
        version = store.version()
        held = written(batch)
        known = written(store.read(held))
        resolved = written(people_of(held)) if coreference else None
        done = pseudonymize(held, policies, known, engines, coreference, engine_threshold=engine_threshold, resolved=resolved)
        store.append(done.fresh, version)
        if resolved is not None:
            people = people_store(batch.sparkSession, vault, key)
            before = people.version()
            changed = resolved.join(people.read(held), ["dossier_id", "surface", "number", "placeholder", "canonical", "ambiguous"], "left_anti")
            people.append(written(changed), before)
        sink(done.texts.drop("spans", "people"), n)
        for table in (held, known, resolved):
            drop(table)

    stream = people_stream(docs, engines, policies, engine_threshold) if coreference else docs
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
