"""Phases of a run: operators declare what they need and give, and the plan is checked before it runs."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field
from importlib.metadata import entry_points
from typing import Any

PHASES = ("ANALYSIS", "COMPOSITION", "CALIBRATION")
CONTRACT = 1


@dataclass(frozen=True)
class Operator:
    """A named step: ``run`` takes the products so far, by name, and returns those it gives."""

    id: str
    phase: str
    run: Callable[[dict[str, Any]], dict[str, Any]]
    needs: tuple[str, ...] = ()
    gives: tuple[str, ...] = ()
    priority: int = 100
    contract: int = CONTRACT


@dataclass
class Outcome:
    products: dict[str, Any]
    reasons: set[str] = field(default_factory=set)
    order: list[str] = field(default_factory=list)


class PlanError(ValueError):
    pass


def validate(operators: list[Operator], given: tuple[str, ...] = ()) -> list[Operator]:
    """The operators in the order in which they can run: by phase, then priority and id, each after
    what it needs. Repeated ids, other contracts, unknown phases, products with two producers or
    none, needs from a later phase and cycles are refused."""
    ids = [o.id for o in operators]
    if len(set(ids)) < len(ids):
        raise PlanError("repeated id")
    maker: dict[str, Operator] = {}
    for o in operators:
        if o.contract != CONTRACT or o.phase not in PHASES:
            raise PlanError(f"{o.id}: unknown contract or phase")
        for name in o.gives:
            if name in maker or name in given:
                raise PlanError(f"{name} has two producers")
            maker[name] = o
    for o in operators:
        for name in o.needs:
            if name not in maker and name not in given:
                raise PlanError(f"{o.id} needs {name}, which nothing gives")
            if name in maker and PHASES.index(maker[name].phase) > PHASES.index(o.phase):
                raise PlanError(f"{o.id} needs {name} from a later phase")
    left = sorted(operators, key=lambda o: (PHASES.index(o.phase), o.priority, o.id))
    have, out = set(given), []
    while left:
        ready = next((o for o in left if set(o.needs) <= have), None)
        if ready is None:
            raise PlanError("a cycle among " + ", ".join(o.id for o in left))
        left.remove(ready)
        out.append(ready)
        have |= set(ready.gives)
    return out


def digest(operators: list[Operator]) -> str:
    lines = sorted(f"{o.phase}|{o.priority}|{o.id}|{','.join(sorted(o.needs))}|{','.join(sorted(o.gives))}" for o in operators)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def run(operators: list[Operator], given: dict[str, Any]) -> Outcome:
    """Runs a valid plan. An operator that fails marks the run incomplete, and what needs its products is left out."""
    out = Outcome(dict(given))
    for o in validate(operators, tuple(given)):
        if not set(o.needs) <= set(out.products):
            out.reasons.add(f"SKIPPED:{o.id}")
            continue
        try:
            made = o.run({n: out.products[n] for n in o.needs})
        except Exception as e:  # noqa: BLE001  any failure of a step is a reason, not the end of the run
            out.reasons.add(f"SOURCE_FAILED:{o.id}:{type(e).__name__}")
            continue
        if set(made) != set(o.gives):
            out.reasons.add(f"WRONG_PRODUCTS:{o.id}")
            continue
        out.products |= made
        out.order.append(o.id)
    return out


def discover(group: str = "chainloom.operators") -> list[Operator]:
    """Operators that installed packages offer, by id."""
    return sorted((e.load() for e in entry_points(group=group)), key=lambda o: o.id)
