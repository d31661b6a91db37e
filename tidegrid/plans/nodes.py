"""The logical plan: one node per operator, printed one per line."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Node:
    op: str
    args: dict = field(default_factory=dict)
    children: list["Node"] = field(default_factory=list)

    def explain(self) -> str:
        a = ", ".join(f"{k}={v}" for k, v in self.args.items())
        return "\n".join([f"{self.op}({a})" if a else self.op, *("  " + line for c in self.children for line in c.explain().splitlines())])

    def key(self) -> str:
        """Equal for equal sub-plans."""
        return self.explain()
