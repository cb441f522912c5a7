"""Context assembly and its providers: small, ordered, on the driver."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from types import MappingProxyType

#: Fixed value: the order of the parts of a context.
PARTS = ("system", "architecture", "memory", "preamble", "recency", "relevance", "followup", "checkpoint", "contract")


def assemble(parts: Mapping[str, object]) -> list:
    """Messages of the parts that are there, in the fixed order; texts become user messages."""
    user = lambda t: {"role": "user", "content": [{"type": "text", "text": t}]}
    return [user(p) if isinstance(p, str) else p for name in PARTS if (p := parts.get(name))]


@dataclass(frozen=True)
class Edge:
    name: str
    required: bool = True


@dataclass(frozen=True)
class Provider:
    """Renders a section from the sections before it; None is an empty section."""

    identity: str
    render: Callable[[Mapping[str, str], int], str | None]
    priority: int = 0
    tokens: int = 0
    depends_on: tuple[Edge, ...] = ()
    api_version: int = 1


@dataclass
class Rendered:
    sections: dict[str, str] = field(default_factory=dict)
    outcomes: list[tuple[str, str, str]] = field(default_factory=list)  # identity, status, note


class Registry:
    """Providers by identity. What can not be registered says why and changes nothing."""

    VERSIONS = (1,)

    def __init__(self, namespace: str):
        self.providers: dict[str, Provider] = {}
        self._name = re.compile(rf"{re.escape(namespace)}\.[A-Za-z0-9][A-Za-z0-9._-]*")

    def register(self, p: Provider) -> str:
        """'registered', or the reason against it."""
        if not self._name.fullmatch(p.identity):
            return "invalid-identity"
        if p.api_version not in self.VERSIONS:
            return "unsupported-api-version"
        if p.identity in self.providers:
            return "duplicate-identity"
        if p.identity in self._above([e.name for e in p.depends_on]):
            return "circular-dependency"
        self.providers[p.identity] = p
        return "registered"

    def _above(self, names: list[str]) -> set[str]:
        seen: set[str] = set()
        while names:
            n = names.pop()
            if n not in seen:
                seen.add(n)
                names += [e.name for e in self.providers[n].depends_on] if n in self.providers else []
        return seen

    def _disabled(self) -> set[str]:
        """Providers with a required edge to one that is not registered or disabled itself."""
        off: set[str] = set()
        while more := {i for i, p in self.providers.items() if i not in off and any(e.required and (e.name not in self.providers or e.name in off) for e in p.depends_on)}:
            off |= more
        return off

    def _order(self) -> tuple[list[Provider], list[str]]:
        """Independent providers by priority, then dependents as their edges allow, by priority; and those in a cycle."""
        done = [p for p in sorted(self.providers.values(), key=lambda p: p.priority) if not p.depends_on]
        left = [p for p in sorted(self.providers.values(), key=lambda p: p.priority) if p.depends_on]
        while left:
            open_ = {p.identity for p in left}
            ready = next((p for p in left if not any(e.name in open_ for e in p.depends_on)), None)
            if ready is None:
                return done, sorted(open_)
            done.append(ready)
            left.remove(ready)
        return done, []

    def render(self) -> Rendered:
        """Renders all. One that raises is dropped, and with it those that require it; optional edges only order."""
        out, off, failed = Rendered(), self._disabled(), set()
        order, cycle = self._order()
        for p in order:
            broken = next((e.name for e in p.depends_on if e.required and e.name in failed), None)
            if p.identity in off or broken:
                failed |= {p.identity} if broken else set()
                out.outcomes.append((p.identity, "skipped-dependency", f"requires {broken}" if broken else "disabled"))
                continue
            try:
                text = p.render(MappingProxyType(dict(out.sections)), p.tokens)
            except Exception as x:  # a provider must never break the build
                failed.add(p.identity)
                out.outcomes.append((p.identity, "dropped", str(x)))
                continue
            if text is not None:
                out.sections[p.identity] = text
            out.outcomes.append((p.identity, "empty" if text is None else "rendered", ""))
        out.outcomes += [(i, "skipped-dependency", "cycle") for i in cycle]
        return out
