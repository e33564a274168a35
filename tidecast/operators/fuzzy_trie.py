"""Interval type-2 inference of one model on a block of rows, for any number of rules.

The antecedents of the rules form a trie, feature by feature: rules that begin alike share the product of
the degrees that they share, so a node costs one multiplication. Both ends of the type-reduced set come from
running sums over the rules in the order of their consequents.
"""

from __future__ import annotations

import numpy as np

from tidecast.functions.fuzzy import NO_FIRING


class Trie:
    """Antecedents (rules x features of membership indices) as levels of (parent node, degree column)."""

    def __init__(self, antecedents: np.ndarray, mfs: int):
        self.levels = []
        node = np.zeros(len(antecedents), np.int64)
        for feature in range(antecedents.shape[1] if len(antecedents) else 0):
            column = feature * mfs + antecedents[:, feature].astype(np.int64)
            paths, node = np.unique(np.stack([node, column], axis=1), axis=0, return_inverse=True)
            self.levels.append(paths.T)
            node = node.ravel()
        self.leaf = node

    def products(self, degrees: np.ndarray) -> np.ndarray:
        """(rows x rules): product of each rule's degrees, given (rows x membership columns)."""
        made = np.ones((len(degrees), 1))
        for parent, column in self.levels:
            made = made[:, parent] * degrees[:, column]
        return made[:, self.leaf]


def degrees_of(x: np.ndarray, feature, center, sigma, scale, lag) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper degree of each membership; of a NaN the lower one is 0 and the upper one NaN."""
    gap = x[:, feature] - center
    upper = np.exp(-0.5 * (gap / sigma) ** 2)
    shifted = scale * np.exp(-0.5 * ((gap - lag) / sigma) ** 2)
    return np.fmax(0.0, np.fmin(upper, shifted)), upper


def switch_means(lower: np.ndarray, gain: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Weighted means after raising the first 0, 1, 2, ... rules from their lower to their upper firing."""
    raised = np.hstack([np.zeros((len(gain), 1)), gain])
    total = lower.sum(axis=1, keepdims=True) + raised.cumsum(axis=1)
    # row by row, so that a result does not depend on the rows beside it
    moment = (lower * level).sum(axis=1, keepdims=True) + (raised * np.append(0.0, level)).cumsum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(total > NO_FIRING, moment / total, np.nan)


def ends(lower: np.ndarray, upper: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both ends of the type-reduced set, NaN where nothing fires; `level` rises from rule to rule.

    The optimum of the center-of-sets interval always lies where some first rules, or some last ones, have
    their upper and the others their lower firing, so no iteration is needed.
    """
    gain = upper - lower
    left = np.fmin.reduce(switch_means(lower, gain, level), axis=1)
    right = np.fmax.reduce(switch_means(lower[:, ::-1], gain[:, ::-1], level[::-1]), axis=1)
    return left, right


def crisp(left, right, upper_sum, fallback: float) -> tuple[np.ndarray, np.ndarray]:
    """Prediction (NaN of an unknown input) and whether no rule fired."""
    silent = upper_sum <= NO_FIRING
    return np.where(silent, fallback, np.clip((left + right) / 2, 0.0, 1.0)), silent


class Model:
    """Arrays of one model; rules stand in the order of their consequents."""

    def __init__(self, mfs: int, memberships: dict[str, np.ndarray], rules: dict[str, np.ndarray], fallback: float):
        self.memberships, self.fallback = memberships, fallback
        order = np.lexsort((rules["rule_id"], rules["consequent"]))
        self.rule_id, self.consequent, self.weight = (rules[k][order] for k in ("rule_id", "consequent", "weight"))
        self.trie = Trie(rules["antecedent"][order], mfs)

    def degrees(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        names = ("feature", "center", "sigma", "lower_scale", "lower_lag")
        return degrees_of(x, *(self.memberships[k] for k in names))

    def firing(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper firing of every rule (rows x rules)."""
        lower, upper = (self.trie.products(side) * self.weight for side in self.degrees(x))
        return lower, upper

    def interval(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both ends and the sum of the upper firings."""
        lower, upper = self.firing(x)
        return *ends(lower, upper, self.consequent), upper.sum(axis=1)
