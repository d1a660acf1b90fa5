"""User rule files in the usual YAML shape, as catalogue rules."""

from __future__ import annotations

from lintlake.rules.model import Rule

_SEVERITY = {"ERROR": "error", "WARNING": "warning", "INFO": "info"}


def parse_rules(text: str) -> list[Rule]:
    """Rules with ``pattern-regex`` entries. Raises ValueError, with their ids, if entries have pattern kinds that need the pack author's regex."""
    import yaml

    rules, left_out = [], []
    for entry in (yaml.safe_load(text) or {}).get("rules", []):
        patterns = [entry] + list(entry.get("patterns") or []) + list(entry.get("pattern-either") or [])
        if not all(item is entry or item.get("pattern-regex") or item.get("regex") for item in patterns) or not any(item.get("pattern-regex") or item.get("regex") for item in patterns):
            left_out.append(str(entry.get("id")))
            continue
        for item in patterns:
            regex = item.get("pattern-regex") or item.get("regex")
            if regex:
                rules.append(
                    Rule(
                        "custom", str(entry["id"]), regex, "", _SEVERITY.get(str(entry.get("severity", "WARNING")).upper(), "warning"),
                        str((entry.get("metadata") or {}).get("category", "security")), str(entry.get("message", "")),
                        languages=tuple(x for x in entry.get("languages", []) if x not in ("generic", "regex")),
                        metadata={k: str(v) for k, v in (entry.get("metadata") or {}).items()},
                    )
                )
    if left_out:
        raise ValueError(f"rules with patterns that are no regex: {', '.join(left_out)}")
    return rules
