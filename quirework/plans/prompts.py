"""What models are asked: templates with named fields; a doubled brace stands for one."""

from __future__ import annotations

TEMPLATES = {
    "draft": "Translate the text. Think first, end the thoughts with {end}, then give the translation alone.",
    "polish": "Polish the draft translation and give the result alone.",
    "check": 'List the issues of the translation as JSON: {{"issues": [{{"issue": ..., "severity": "high" or "low"}}]}}.',
    "fix": "Mend the named issues of the translation, leave the rest, and give the result alone.",
    "titles": 'Translate these titles of a table of contents from {source} to {target}, in their order, as JSON: {{"titles": [...]}}.',
}


def prompt(name: str, **fields: str) -> str:
    """A template with its fields filled; a missing field is an error."""
    return TEMPLATES[name].format(**fields)
