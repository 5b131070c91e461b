"""An averaged perceptron over named features."""

from __future__ import annotations

import random


class Perceptron:
    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = weights or {}

    def score(self, features: list[str]) -> float:
        w = self.weights
        return sum(w.get(f, 0.0) for f in features)

    @classmethod
    def train(cls, examples: list[tuple[list[str], bool]], rounds: int = 5, seed: int = 7, margin: float = 1.0) -> "Perceptron":
        """Weights averaged over all steps; an example within the margin counts as
        a mistake. The order of the examples is shuffled with a fixed seed."""
        now: dict[str, float] = {}
        total: dict[str, float] = {}
        stamp: dict[str, int] = {}
        order, rng, step = list(range(len(examples))), random.Random(seed), 0
        for _ in range(rounds):
            rng.shuffle(order)
            for i in order:
                feats, good = examples[i]
                step += 1
                s = sum(now.get(f, 0.0) for f in feats)
                d = 1.0 if good else -1.0
                if s * d <= margin:
                    for f in feats:
                        total[f] = total.get(f, 0.0) + (step - stamp.get(f, 0)) * now.get(f, 0.0)
                        stamp[f] = step
                        now[f] = now.get(f, 0.0) + d
        return cls({f: (total.get(f, 0.0) + (step - stamp[f]) * v) / max(1, step) for f, v in now.items()})
