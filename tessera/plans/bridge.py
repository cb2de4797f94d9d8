"""A bridge to text-to-text models: one function for each role, tried again when it fails, remembered, and with the rules
to fall back on where code is asked for."""

from __future__ import annotations

import hashlib
import random
import time
from collections import Counter, OrderedDict
from collections.abc import Callable

from tessera.operators.rules import modernize_text

CODE_ROLES = ("modernizer", "fixer")
ROLES = ("analyzer", "planner", *CODE_ROLES)


class Bridge:
    """models: role to function(system, text). A role without one has none. Called as a rewriter, it is the modernizer."""

    def __init__(self, models: dict[str, Callable[[str, str], str]] | None = None, tries: int = 3, wait: float = 0.5, capacity: int = 500):
        if unknown := set(models or ()) - set(ROLES):
            raise ValueError(f"no such roles: {sorted(unknown)}")
        self.models, self.tries, self.wait, self.capacity = models or {}, tries, wait, capacity
        self.known: OrderedDict[str, str] = OrderedDict()
        self.stats: Counter[str] = Counter()

    def ask(self, role: str, system: str, text: str, code: str | None = None) -> str | None:
        """The model's answer; without one the rewritten code (the text unless told) for roles that write code, else None."""
        key = hashlib.sha256("\0".join((role, system, text)).encode()).hexdigest()
        if key in self.known:
            self.known.move_to_end(key)
            self.stats["hits"] += 1
            return self.known[key]
        self.stats["misses"] += 1
        answer = None
        for k in range(self.tries if role in self.models else 0):
            try:
                answer = self.models[role](system, text)
                break
            except Exception:  # whatever a model raises
                self.stats["failures"] += 1
                if k + 1 < self.tries:
                    time.sleep(self.wait * 2**k * (1 + random.random() / 4))
        if not answer:
            return modernize_text(text if code is None else code)[0] if role in CODE_ROLES else None
        self.known[key] = answer
        while len(self.known) > self.capacity:
            self.known.popitem(last=False)
        return answer

    def __call__(self, text: str, plan: str = "") -> str:
        """Called as a rewriter; a plan goes before the text."""
        return self.ask("modernizer", "", f"{plan}\n\n{text}" if plan else text, text) or text

    def fix(self, text: str, errors: str, about: str) -> str:
        """Called as a fixer: the errors and the lines about them go before the text."""
        asked = "\n\n".join(x for x in ("Compiler errors:\n" + errors, "Lines:\n" + about if about else "", "```cpp\n" + text + "\n```") if x)
        return self.ask("fixer", "Repair the compiler errors and change nothing else: same names, types and parameters. Answer with the whole code.", asked, text) or text

    def healthy(self) -> tuple[bool, str]:
        return bool(self.models), f"{len(self.models)} of {len(ROLES)} roles have a model"
