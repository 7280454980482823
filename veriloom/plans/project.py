"""The plan of a project: its question, packs, criteria and sub-questions, read from TOML."""

from __future__ import annotations

from dataclasses import dataclass, field

from veriloom.plans import packs


@dataclass
class Plan:
    question: str
    lang: str = "en"
    packs: list[str] = field(default_factory=lambda: ["general"])
    since: int | None = None
    criteria: dict = field(default_factory=dict)
    subqs: list[dict] = field(default_factory=list)

    def combined(self, known: dict | None = None) -> packs.Combined:
        return packs.combined(*self.packs, packs=known)

    def first_year(self) -> int:
        return self.since or self.combined().since()


def load_plan(path: str) -> Plan:
    """A plan's file: [question] text, lang, packs, since; [criteria]; [[subq]] id, text, queries, connector_queries. What is unknown is left out."""
    import tomllib

    with open(path, "rb") as f:
        spec = tomllib.load(f)
    q = spec.get("question", {})
    subqs = [{"id": s.get("id") or f"SQ{k}", "text": s.get("text", ""), "queries": list(s.get("queries") or []), "connector_queries": dict(s.get("connector_queries") or {})} for k, s in enumerate(spec.get("subq", []), 1)]
    return Plan(q.get("text", ""), q.get("lang", "en"), list(q.get("packs") or ["general"]), q.get("since"), dict(spec.get("criteria", {})), subqs)
