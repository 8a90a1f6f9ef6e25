"""Settings of the learners and searches, and configuration files with paths and references in them."""

from __future__ import annotations

import json
import posixpath
import re
from dataclasses import dataclass, fields, replace
from typing import Any


@dataclass(frozen=True)
class Settings:
    """Defaults of the algorithms (UT6). With others, results differ."""

    random_seed: int = 120
    n_samples: int = 1000
    top_types: int = 4
    datetime_threshold: float = 0.5
    constraint_threshold: float = 0.95
    constraint_samples: int = 150
    most_properties: int = 10
    most_duplications: int = 5
    most_duplication_types: int = 4
    training_beam: int = 10
    searching_beam: int = 10
    data_node_hops: int = 2
    class_node_hops: int = 2
    explored: int = 5
    most_candidates: int = 15
    least_chance: float = 0.01

    def with_(self, values: dict[str, Any]) -> Settings:
        """With other values; a name that there isn't is an error, and a value takes its default's type."""
        kinds = {f.name: type(getattr(self, f.name)) for f in fields(self)}
        unknown = sorted(set(values) - set(kinds))
        if unknown:
            raise KeyError(f"no settings {unknown}")
        return replace(self, **{k: kinds[k](v) for k, v in values.items()})


_REMOTE = re.compile(r"([a-zA-Z][a-zA-Z0-9+.-]*://[^/]*)(/.*)?")


def join_path(parent: str, child: str) -> str:
    """A path under another one; parents of any scheme keep it, a child that is a whole address or an absolute path below a
    local one stays (UT5)."""
    if _REMOTE.fullmatch(child):
        return child
    remote = _REMOTE.fullmatch(parent)
    if not remote:
        return posixpath.normpath(posixpath.join(parent, child))
    return remote[1] + posixpath.normpath(posixpath.join(remote[2] or "/", child))


#: Fixed format: ${a.b} stands for the value at a.b.
_REFERENCE = re.compile(r"\$\{([A-Za-z0-9_.-]+)\}")


def resolved(config: dict[str, Any]) -> dict[str, Any]:
    """A configuration whose references are their values (UT5): a string that is one reference becomes the value itself, in
    longer ones its text is put in. A reference to itself, by any way, is an error."""

    def at(path: str, seen: tuple[str, ...]) -> Any:
        if path in seen:
            raise ValueError(f"a reference to itself: {' -> '.join((*seen, path))}")
        value: Any = config
        for step in path.split("."):
            value = value[step]
        return walk(value, (*seen, path))

    def walk(value: Any, seen: tuple[str, ...]) -> Any:
        if isinstance(value, dict):
            return {k: walk(v, seen) for k, v in value.items()}
        if isinstance(value, list):
            return [walk(v, seen) for v in value]
        if not isinstance(value, str):
            return value
        whole = _REFERENCE.fullmatch(value)
        return at(whole[1], seen) if whole else _REFERENCE.sub(lambda m: str(at(m[1], seen)), value)

    return walk(config, ())


def load_config(text: str) -> dict[str, Any]:
    """A configuration from JSON or YAML text, references resolved (UT5)."""
    try:
        found = json.loads(text)
    except ValueError:
        import yaml

        found = yaml.safe_load(text)
    return resolved(found)
