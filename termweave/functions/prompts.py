"""Prompts that ask a language model to order candidates, and the reading of its answer."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from pathlib import Path

#: Text of a prompt; `{format_instructions}`, `{source}` and `{candidates}` are filled in.
TEMPLATE = """You order candidate drug concepts for a query. Each candidate ends with its concept id in parentheses.

## Output
{format_instructions}

## Rules
- Compare ingredient, dose, form (with route and release) and brand. More of these that agree rank higher.
- The brand counts only if the query names one. An unbranded query prefers unbranded candidates.
- Doses that convert into each other agree; so do forms whose words differ in order or language only.
- A wrong brand, further ingredients, packs and kits rank lower, but are not left out.
- Ties go to the closer form, then to the closer dose.

## Query
{source}

## Candidates
{candidates}
"""
FORMAT = 'Return JSON only: {"concept_ids": [id, ...]}, best first, with ids of the candidates. No other text.'
_SLOTS = ("{source}", "{candidates}", "{format_instructions}")
_FENCED = re.compile(r"```(?:json)?\s*(\{.*?\}|\[.*?\])\s*```", re.DOTALL | re.IGNORECASE)


def candidate_line(c: Mapping, scores: Sequence[str] = ()) -> str:
    name = (c.get("concept_name") or c.get("profile_text") or "").strip() or f"Concept {c['concept_id']}"
    told = [f"{s}={c[s]:.4f}" for s in scores if c.get(s) is not None]
    return " | ".join([f"{name} ({c['concept_id']})", *told])


def prompt(query: str, candidates: Sequence[Mapping], template: str = TEMPLATE, context: str | None = None, instructions: str = FORMAT, scores: Sequence[str] = ()) -> str:
    """template filled in; one without slots is followed by query, context, candidates and output format."""
    if not candidates:
        raise ValueError("a prompt needs a candidate")
    lines = "\n".join(candidate_line(c, scores) for c in candidates)
    if any(s in template for s in _SLOTS):
        block = f"Additional context: {context.strip()}\n\n{lines}" if context else lines
        out = template.replace("{source}", query.strip()).replace("{candidates}", block).replace("{format_instructions}", instructions.strip())
    else:
        parts = [template.strip(), f"Query: {query.strip()}", *([f"Additional context: {context.strip()}"] if context else []), f"Candidates (highest score first):\n{lines}", *([f"Output:\n{instructions.strip()}"] if instructions else [])]
        out = "\n\n".join(parts)
    return re.sub(r"\n{3,}", "\n\n", out).strip()


def file_prompt(path: str, *args, **options) -> str:
    """As template_prompt, from a template file."""
    return template_prompt(Path(path).read_text(encoding="utf-8"), *args, **options)


def template_prompt(template: str, query: str, candidates: Sequence[Mapping], context: str | None = None, field: str = "profile_text", limit: int = 512, instructions: str = "") -> str:
    """A prompt from a template; a candidate shows `field`, cut at limit characters."""
    if not candidates:
        raise ValueError("a prompt needs a candidate")

    def line(c: Mapping) -> str:
        text = (c.get(field) or c.get("concept_name") or "").strip()
        text = text[:limit].rstrip() + " …" if limit and len(text) > limit else text
        return f"{text or 'Concept ' + str(c['concept_id'])} ({c['concept_id']})"

    out = template
    for slot, value in (("{source}", query), ("{candidates}", "\n".join(map(line, candidates))), ("{format_instructions}", instructions), ("{extra_context}", context or "")):
        out = out.replace(slot, value.strip())
    return out


def answered_ids(answer: str) -> list[int]:
    """Ids in a JSON answer: {"concept_ids": [...]} or a bare list, in a code fence or not. Anything else is an error."""
    m = _FENCED.search(answer or "")
    blob = m[1] if m else (answer or "").strip()
    try:
        got = json.loads(blob)
    except json.JSONDecodeError as e:
        raise ValueError(f"no JSON in the answer: {answer!r}") from e
    got = got.get("concept_ids") if isinstance(got, dict) else got
    if not isinstance(got, list) or not got:
        raise ValueError(f"no concept_ids in the answer: {answer!r}")
    if any(isinstance(x, bool) for x in got):
        raise ValueError("concept_ids must be integers")
    try:
        return [int(x) for x in got]
    except (TypeError, ValueError) as e:
        raise ValueError(f"concept_ids must be integers: {got!r}") from e


def merged(answer: Sequence[int], candidates: Sequence[int]) -> list[int]:
    """Answered candidates, each once, then the rest in their order."""
    known = set(candidates)
    first = list(dict.fromkeys(i for i in answer if i in known))
    if not first:
        raise ValueError("the answer names no candidate")
    return first + [c for c in candidates if c not in set(first)]
