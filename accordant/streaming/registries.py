"""Registries that reach a running stream: documents in a shared folder, named by their digest, looked up when a frame names one.

A document is put there by who deploys it, so being there under its own digest
is what pins it. Documents never change, so a task may keep what it has read;
a new one is used from the first frame that names its digest on, without a
restart. ``version`` of a document only grows for a key of the stream: a frame
that goes back to an older one is a fault.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyarrow import fs

from accordant.operators.registry import MAX_BYTES, Registry
from accordant.schema import CODES

#: Ceilings that a registry's ``opportunity`` may set, as it names them.
CEILINGS = ("max_active_tracks", "max_frame_inputs", "max_attempts_per_track_modality", "max_outcomes_per_frame", "max_monitor_queue_events")
#: Documents that a task keeps.
KEPT = 16


class Violation(Exception):
    """What a frame breaks of its registry, as a word of the fault."""


def ceilings(document: dict) -> dict[str, int]:
    """The ceilings that a document sets: whole numbers of at least 1, and no others."""
    told = document.get("opportunity", {})
    if not isinstance(told, dict) or set(told) - set(CEILINGS) or any(type(x) is not int or x < 1 for x in told.values()):
        raise ValueError("opportunity sets whole ceilings of at least 1, by their names")
    return told


def publish(text: str, folder: str) -> str:
    """Check a document and put it into the folder; its digest. The same one again changes nothing."""
    found = Registry.from_json(text)
    if type(found.document.get("version")) is not int or found.document["version"] < 0:
        raise ValueError("a registry has a version, a whole number")
    ceilings(found.document)
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path)
    digest = found.digest()
    name = f"{path}/{digest}.json"
    if store.get_file_info(name).type == fs.FileType.NotFound:
        # Written aside and moved, so that no task reads half a document.
        with store.open_output_stream(f"{name}.new") as out:
            out.write(text.encode())
        store.move(f"{name}.new", name)
    return digest


@dataclass
class Registries:
    """The folder, as tasks see it."""

    folder: str
    kept: dict[str, Registry] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return {"folder": self.folder, "kept": {}}

    def find(self, digest: object) -> Registry:
        if not isinstance(digest, str) or not re.fullmatch("[0-9a-f]{64}", digest):
            raise Violation("registry_digest")
        if digest not in self.kept:
            store, path = fs.FileSystem.from_uri(self.folder)
            name = f"{path}/{digest}.json"
            info = store.get_file_info(name)
            if info.type == fs.FileType.NotFound:
                raise Violation("registry_unknown")
            if info.size > MAX_BYTES:
                raise Violation("registry_document")
            with store.open_input_stream(name) as given:
                text = given.read()
            try:
                found = Registry.from_json(text.decode(), digest)
                ceilings(found.document)
            except (ValueError, KeyError, TypeError):
                raise Violation("registry_document") from None
            while len(self.kept) >= KEPT:
                del self.kept[next(iter(self.kept))]
            self.kept[digest] = found
        return self.kept[digest]


def _within(part: dict, at: int) -> bool:
    when = part["applicability"]
    until = when.get("valid_until_timestamp_ms")
    return when["valid_from_timestamp_ms"] <= at and (until is None or at <= until)


def held(document: dict, **received: int) -> None:
    """Raise for the first number that is over its ceiling."""
    told = ceilings(document)
    for name, n in received.items():
        if n > told.get(name, n):
            raise Violation(f"registry_limit:{name}")


def check_summary(document: dict, summary: dict) -> None:
    """A frame's identity, time and modalities against the document."""
    frames = {f["frame_id"]: f for f in document["frames"]}
    contexts = {c["context_id"]: c for c in document["contexts"]}
    frame, context = frames.get(summary["frame_id"]), contexts.get(summary["context_id"])
    if frame is None:
        raise Violation("registry_unknown_frame")
    if context is None:
        raise Violation("registry_unknown_context")
    if context["frame_id"] != summary["frame_id"]:
        raise Violation("registry_frame_context")
    if not (_within(frame, summary["fusion_timestamp_ms"]) and _within(context, summary["fusion_timestamp_ms"])):
        raise Violation("registry_not_applicable")
    expected = sorted((m["modality"] for m in context["expected_modalities"]), key=lambda m: CODES.get(m, len(CODES)))
    if summary["expected_modalities"] != expected:
        raise Violation("registry_modalities")


def check_events(document: dict, summary: dict, events: list[dict]) -> None:
    """What a frame's events tell, against the ceilings and the frame's identity."""
    attempts: dict[tuple, int] = {}
    for e in events:
        pair = (e["track_id"], e["modality"])
        attempts[pair] = attempts.get(pair, 0) + 1
        most = max(attempts[pair], (e.get("attempt_index") or 0) + 1, e.get("candidate_count") or 0)
        index = e.get("measurement_index")
        held(document, max_attempts_per_track_modality=most, max_frame_inputs=0 if index is None else index + 1)
        told = e.get("projection")
        if isinstance(told, dict) and any(told.get(c, summary[c]) != summary[c] for c in ("frame_id", "context_id", "prior_id")):
            raise Violation("registry_projection_identity")
    tracks = max(len({t for t, _ in attempts}), summary.get("active_track_count") or 0)
    held(document, max_active_tracks=tracks, max_frame_inputs=summary.get("input_count") or 0, max_outcomes_per_frame=max(len(events), summary["outcome_count"]))
