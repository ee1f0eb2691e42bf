"""Budgets of a source tree, recomputed in plain Python."""

from collections import defaultdict


def fill(amount, weights, limits):
    """``amount`` by weight with nobody above its limit; what one can't take goes to the others by weight."""
    given, open_ = [0.0] * len(weights), [i for i, (w, c) in enumerate(zip(weights, limits)) if w > 0 and c > 0]
    while open_ and amount > 1e-9:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if amount * weights[i] / total >= limits[i]]
        if not full:
            for i in open_:
                given[i] = amount * weights[i] / total
            break
        for i in full:
            given[i] = limits[i]
        amount -= sum(limits[i] for i in full)
        open_ = [i for i in open_ if i not in full]
    return given


def weight(weights, path):
    """The weight of the most exact pattern that fits, 1 where none does."""
    fits = [(sum(p == "*" for p in k), w) for k, w in weights.items() if len(k) == len(path) and all(p in ("*", x) for p, x in zip(k, path))]
    return min(fits)[1] if fits else 1.0


def budgets(available, total, epochs, weights=None):
    out = {}

    def deal(prefix, amount, leaves):
        if len(leaves) == 1 and leaves[0] == prefix:
            out[prefix] = int(amount + 1e-6)
            return
        below = defaultdict(list)
        for leaf in leaves:
            below[leaf[: len(prefix) + 1]].append(leaf)
        nodes = sorted(below)
        limits = [epochs * sum(available[leaf] for leaf in below[n]) for n in nodes]
        for n, given in zip(nodes, fill(amount, [weight(weights or {}, n) for n in nodes], limits)):
            deal(n, given, below[n])

    if available:
        deal((), min(total, epochs * sum(available.values())), list(available))
    return out
