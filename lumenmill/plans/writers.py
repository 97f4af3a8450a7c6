"""Where a job's outputs go: one writer for payload files, one for the ledger.

Payload is written by the tasks that make it, so a payload writer is copied to
every task and must write the same bytes under the same name when a task runs
again. The ledger is a DataFrame, written by Spark. A job takes the writers
registered as ``images`` and ``parquet``.
"""

from __future__ import annotations

import logging
import os
import uuid
from importlib.metadata import entry_points
from typing import Any

from pyspark.sql import DataFrame

GROUP = "lumenmill.writers"
log = logging.getLogger("lumenmill")


def write_once(path: str, data: bytes) -> None:
    """A file under its content's name, local or by URI; repeated and speculative tasks write the same."""
    if "://" in path:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(path)
        if store.get_file_info(path).type != fs.FileType.NotFound:
            return
        store.create_dir(os.path.dirname(path))
        temporary = f"{path}.{uuid.uuid4().hex}"
        with store.open_output_stream(temporary) as f:
            f.write(data)
        store.move(temporary, path)
        return
    if os.path.exists(path):
        return
    os.makedirs(os.path.dirname(path), exist_ok=True)
    temporary = f"{path}.{uuid.uuid4().hex}"
    with open(temporary, "wb") as f:
        f.write(data)
    os.replace(temporary, path)


class OutputWriter:
    """Takes both roles and does nothing; a writer overrides its own."""

    #: whether payload must be encoded for it
    payload = False

    def __init__(self, name: str, config: dict[str, Any] | None = None):
        self.name, self.config = name, dict(config or {})

    def add_payload(self, selection: str, name: str, data: bytes) -> None:
        """In a task: take one encoded sample; it is on disk after ``flush``."""

    def flush(self) -> None:
        """In a task: write what is held. Called after every batch of samples."""

    def add_rows(self, selection: str, rows: DataFrame) -> None:
        """On the driver: write a selection's ledger."""


class ImagesWriter(OutputWriter):
    """Files below ``samples_dir``, at most ``flush_batch_size`` held; none if ``write_samples`` is off."""

    def __init__(self, name: str, config: dict[str, Any] | None = None):
        super().__init__(name, config)
        self.payload = bool(self.config.get("write_samples", True))
        self.held: list[tuple[str, bytes]] = []

    def add_payload(self, selection: str, name: str, data: bytes) -> None:
        self.held.append((f"{self.config['samples_dir'].format(selection=selection)}/{name}", data))
        if len(self.held) >= self.config.get("flush_batch_size", 5):
            self.flush()

    def flush(self) -> None:
        for path, data in self.held:
            write_once(path, data)
        self.held = []


class LedgerWriter(OutputWriter):
    """Parquet at ``path``."""

    def add_rows(self, selection: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(self.config["path"].format(selection=selection))


WRITERS: dict[str, type[OutputWriter]] = {"images": ImagesWriter, "parquet": LedgerWriter}


def register_writer(kind: str, writer: type[OutputWriter]) -> None:
    """Write a role's outputs with this class from now on, or add another kind."""
    WRITERS[kind] = writer


def known_writers() -> dict[str, type[OutputWriter]]:
    return WRITERS | {e.name: e.load() for e in entry_points(group=GROUP)}


def writer_of(kind: str, name: str, config: dict[str, Any]) -> OutputWriter:
    """The job's writer of a kind; without one that output is left out, with a warning."""
    found = known_writers().get(kind)
    if found is None:
        log.warning("no writer %r: %s is not written", kind, name)
        return OutputWriter(name, config)
    return found(name, config)
