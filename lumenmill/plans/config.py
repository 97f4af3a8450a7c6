"""Job configuration: a closed schema, checked before anything runs."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from ..functions.sizes import memory_bytes
from ..operators import models
from ..operators.transformations import Transformation, entries
from ..sources import loaders as sources

COMPUTE = {"seed": 42, "log_level": "INFO", "max_memory": None, "device": None, "progress_bar": True, "threads": 4}
#: What may be done about a failure.
SILENT, FAST = "silent_fail", "fail_fast"
#: Unset rules follow the default, but for transforms and formats, which fail at once unless a job says otherwise.
IMAGES = {"on_decode_failure": None, "on_transform_error": None, "on_unsupported_format": None}
TABULAR = {"on_missing_column": None, "on_file_not_found": None}
OUTPUTS = {"path": None, "write_samples": True, "samples_dir": None, "flush_batch_size": 5, "include": None, "exclude": None, "storage": None}


def closed(section: str, given: dict | None, allowed) -> dict:
    given = dict(given or {})
    if unknown := set(given) - set(allowed):
        raise ValueError(f"{section}: unknown fields: {', '.join(sorted(unknown))}")
    return given


def merged_errors(job: dict | None, own: dict | None) -> dict:
    """The job's error rules with those that a section sets itself on top."""
    out: dict[str, Any] = {"default": SILENT, "max_failure_rate": 0.05, "images": dict(IMAGES), "tabular": dict(TABULAR)}
    for part in (job, own):
        part = closed("errors", part, out)
        for k, v in part.items():
            out[k] = v if k not in ("images", "tabular") else out[k] | closed(f"errors.{k}", v, out[k])
    for name, rule in [("default", out["default"]), *out["images"].items(), *out["tabular"].items()]:
        if rule not in (SILENT, FAST) and (rule is not None or name == "default"):
            raise ValueError(f"errors: {name} must be {SILENT} or {FAST}, not {rule!r}")
    if SILENT in out["tabular"].values():
        raise ValueError("errors.tabular: a missing file or column always stops a job")
    if not 0 <= float(out["max_failure_rate"]) <= 1:
        raise ValueError("errors.max_failure_rate must be within 0 and 1")
    return out


@dataclass
class Job:
    loaders: list[dict]
    transformations: list[Transformation]
    outputs: dict
    errors: dict
    compute: dict = field(default_factory=dict)


def parse(given: dict, instances: dict[str, Any] | None = None) -> Job:
    """A job from its configuration; every fault is a ValueError here."""
    given = closed("job", given, ("storage", "compute", "errors", "dataloaders", "models", "operations"))
    storage = given.get("storage")
    if isinstance(storage, dict) and storage.get("type", "local") != "local":
        raise ValueError("storage: only local is supported")
    compute = COMPUTE | closed("compute", given.get("compute"), COMPUTE)
    if compute["max_memory"] is not None:
        memory_bytes(compute["max_memory"])  # Spark's own settings bound memory; the size must be one
    if not isinstance(compute["threads"], int) or compute["threads"] < 1:
        raise ValueError("compute.threads must be a whole number, 1 at least")
    section = closed("dataloaders", given.get("dataloaders"), ("loaders", "errors"))
    loaders = [sources.validated(x) for x in section.get("loaders") or []]
    if not loaders:
        raise ValueError("dataloaders: at least one loader is needed")
    operations = closed("operations", given.get("operations"), ("transform_batch_size", "errors", "outputs", "transformations"))
    outputs = OUTPUTS | closed("operations.outputs", operations.get("outputs"), OUTPUTS)
    for k in ("path", "samples_dir"):
        if not outputs[k]:
            raise ValueError(f"operations.outputs: {k} is required")
    if not isinstance(outputs["flush_batch_size"], int) or outputs["flush_batch_size"] < 1:
        raise ValueError("operations.outputs.flush_batch_size must be a whole number, 1 at least")
    names = [x["name"] for x in loaders]
    if len(set(names)) < len(names):
        raise ValueError("dataloaders: names must differ")
    if len(loaders) > 1 and "{selection}" not in outputs["path"]:
        raise ValueError("operations.outputs.path needs {selection}: several loaders would overwrite one ledger")
    references = models.normalised(given.get("models"))
    transformations = [t for e in operations.get("transformations") or [] for t in entries(e, compute["seed"], references, instances)]
    return Job(loaders, transformations, outputs, merged_errors(given.get("errors"), operations.get("errors")), compute)
