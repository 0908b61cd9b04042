"""Settings, such as the access token of a model host: given, from the environment, or from a file."""

from __future__ import annotations

import json
import os
import warnings


def lookup(name: str, given: str | None = None, variable: str | None = None, file: str | None = None) -> str | None:
    """The setting as given, else from the environment variable, else from the JSON file; None, with
    a warning, if it is nowhere."""
    if given:
        return given
    if variable and os.environ.get(variable):
        return os.environ[variable]
    found = _read(file).get(name) if file else None
    if found is None:
        warnings.warn(f"there is no {name}", stacklevel=2)
    return found


def keep(name: str, value: str, file: str) -> None:
    """Write the setting to the JSON file, which only its owner can read; others in it stay."""
    settings = _read(file) | {name: value}
    os.makedirs(os.path.dirname(os.path.abspath(file)), exist_ok=True)
    with open(os.open(file, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w", encoding="utf-8") as out:
        json.dump(settings, out, indent=2)


def _read(file: str) -> dict:
    if not os.path.exists(file):
        return {}
    with open(file, encoding="utf-8") as source:
        return json.load(source)
