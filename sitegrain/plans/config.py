"""Scan configurations: a table of fields, each with its default and check; merging; hashes."""

from __future__ import annotations

import hashlib
import json
import re
from pathlib import Path

SEVERITIES = ("error", "warning", "info")


def _need(ok: bool, field: str, what: str) -> None:
    if not ok:
        raise ValueError(f"{field} must be {what}")


def _whole(least: int, most: int = 2**53 - 1):
    def check(field, x):
        _need(isinstance(x, int) and not isinstance(x, bool) and least <= x <= most, field, f"an integer between {least} and {most}")

    return check


def _text(pattern: str, what: str):
    return lambda field, x: _need(isinstance(x, str) and re.match(pattern, x, re.I) is not None, field, what)


def _flag(field, x):
    _need(isinstance(x, bool), field, "a boolean")


def _rules(field, x):
    _need(x is None or isinstance(x, list) and all(isinstance(r, str) for r in x), field, "null or an array of rule IDs")


def _map(check):
    def run(field, x):
        _need(isinstance(x, dict), field, "an object")
        for k, v in x.items():
            check(f"{field}.{k}", v)

    return run


def _severity(field, x):
    _need(isinstance(x, str) and x in SEVERITIES, field, "error, warning, or info")


def _suppressions(field, x):
    _need(isinstance(x, list), field, "an array")
    for i, one in enumerate(x):
        _need(isinstance(one, dict), f"{field}[{i}]", "an object")
        for part in ("rule", "urlPattern", "reason"):
            _need(isinstance(one.get(part), str) and one[part] != "", f"{field}[{i}].{part}", "a non-empty string")
        if "expiresAt" in one:
            _need(re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", str(one["expiresAt"])) is not None, f"{field}[{i}].expiresAt", "YYYY-MM-DD")


def _report(field, x):
    _need(isinstance(x, dict), field, "an object")
    for part in ("agencyName", "logo", "primaryColor"):
        _need(isinstance(x.get(part, ""), str), f"{field}.{part}", "a string")
    if x.get("primaryColor"):
        _need(re.fullmatch(r"#[0-9a-fA-F]{6}", x["primaryColor"]) is not None, f"{field}.primaryColor", "a six-digit hex color")


#: Fields, defaults, and the check of each.
FIELDS = {
    "schemaVersion": (1, lambda f, x: _need(x == 1 and x is not True, f, "1")),
    "url": ("", _text(r"https?://", "an HTTP(S) URL")),
    "sitemap": ("auto", _text(r"(?:auto|none)\Z|https?://", "auto, none, or an HTTP(S) URL")),
    "maxPages": (100, _whole(1)),
    "concurrency": (5, _whole(1, 50)),
    "delay": (100, _whole(0)),
    "timeout": (10_000, _whole(1)),
    "respectRobots": (True, _flag),
    "includeQuery": (False, _flag),
    "maxRedirects": (10, _whole(0, 50)),
    "maxResponseBytes": (5 * 1024 * 1024, _whole(1024)),
    "enabledRules": (None, _rules),
    "severityOverrides": ({}, _map(_severity)),
    "suppressions": ([], _suppressions),
    "regressionBudgets": ({}, _map(_whole(0))),
    "report": ({}, _report),
}
#: Fields whose sources are joined key by key; of the others the strongest source counts as a whole.
JOINED = ("severityOverrides", "regressionBudgets", "report")


def validate(config: object) -> dict:
    """The known fields of ``config``; an unknown field or a wrong value is a ValueError that names it."""
    _need(isinstance(config, dict), "config", "an object")
    for field, value in config.items():
        if field == "$schema":
            continue
        if field not in FIELDS:
            raise ValueError(f"unknown config property: {field}")
        FIELDS[field][1](field, value)
    out = {k: v for k, v in config.items() if k not in ("$schema", "schemaVersion")}
    if "report" in out:
        out["report"] = {k: v for k, v in out["report"].items() if k in ("agencyName", "logo", "primaryColor")}
    return out


def read(path: str | None, default: str | None = None) -> dict:
    """A configuration file; without a path the default's file, if there is one."""
    chosen = path or (default if default and Path(default).exists() else None)
    return validate(json.loads(Path(chosen).read_text("utf-8"))) if chosen else {}


def resolve(call: dict, file: dict | None = None, baseline: dict | None = None) -> dict:
    """Defaults, then the baseline's, the file's and the call's values, each stronger than the last."""
    out = {k: d.copy() if isinstance(d, dict | list) else d for k, (d, _) in FIELDS.items()}
    for source in (baseline or {}, file or {}, call):
        for k, v in source.items():
            out[k] = out[k] | v if k in JOINED and v else v if k not in JOINED else out[k]
    return out | {"schemaVersion": 1}


def stable_json(value: object) -> str:
    """JSON without blanks, keys in the order of a language's dictionary: small before large letter, case last."""
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: (k.lower(), k.swapcase()))
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{stable_json(value[k])}" for k in keys) + "}"
    if isinstance(value, list | tuple):
        return "[" + ",".join(map(stable_json, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def configuration_hash(config: dict) -> str:
    return hashlib.sha256(stable_json(config).encode()).hexdigest()
