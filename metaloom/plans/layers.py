"""The build plan of layers: what can run, what is stale, and what blocks what."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass


@dataclass(frozen=True)
class Layer:
    name: str
    inputs: tuple[str, ...] = ()
    after: tuple[str, ...] = ()
    predicates: tuple[str, ...] = ()


def order(layers: list[Layer]) -> list[str]:
    """Names so that every layer comes after those it reads; a cycle raises."""
    left, out = {x.name: set(x.after) for x in layers}, []
    while left:
        ready = sorted(n for n, needs in left.items() if needs <= set(out))
        if not ready:
            raise ValueError(f"layers wait for each other: {sorted(left)}")
        out += ready
        for n in ready:
            del left[n]
    return out


def stamp(layer: Layer, versions: dict[str, str], built: dict[str, str]) -> str:
    """A digest of what a layer is made from: its declaration, its inputs' versions and its predecessors' stamps."""
    parts = [layer.name, *layer.predicates, *(f"{i}={versions.get(i, '')}" for i in layer.inputs), *(f"{a}={built.get(a, '')}" for a in layer.after)]
    return hashlib.sha256("\x1f".join(parts).encode()).hexdigest()[:16]


def plan(layers: list[Layer], versions: dict[str, str], stamps: dict[str, str]) -> list[dict]:
    """Steps (layer, state, reason): ok, build (stale or unstamped), or blocked (an input is absent or a predecessor is blocked)."""
    by, now, steps, blocked = {x.name: x for x in layers}, {}, [], set()
    for name in order(layers):
        x = by[name]
        absent = [i for i in x.inputs if i not in versions]
        waits = [a for a in x.after if a in blocked]
        now[name] = stamp(x, versions, now)
        if absent or waits:
            blocked.add(name)
            steps.append({"layer": name, "state": "blocked", "reason": ", ".join(absent + waits)})
        elif stamps.get(name) == now[name]:
            steps.append({"layer": name, "state": "ok", "reason": ""})
        else:
            steps.append({"layer": name, "state": "build", "reason": "stale" if name in stamps else "unstamped"})
    return steps


def channel_availability(layers: list[Layer], steps: list[dict], needs: dict[str, list[str]]) -> dict[str, list[str]]:
    """Metapath to the layers that keep it from running; an empty list is available."""
    maker = {p: x.name for x in layers for p in x.predicates}
    down = {s["layer"] for s in steps if s["state"] == "blocked"}
    return {m: sorted({maker.get(p, f"no layer makes {p}") for p in ps if maker.get(p) in down or p not in maker}) for m, ps in needs.items()}


def calibrate(auc: float | None, low: float | None, reached_positives: int, least: int = 10) -> dict:
    """Whether a channel can be judged and tells the classes apart, and the weight it earns."""
    evaluable = auc is not None and reached_positives >= least
    tells = bool(evaluable and low is not None and low > 0.5)
    return {"evaluable": evaluable, "discriminates": tells, "weight": max(0.0, auc - 0.5) if tells else 0.0}
