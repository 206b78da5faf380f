"""A small linear-chain conditional random field over sparse binary features, in numpy.

Training works on the bounded sample a caller passes; decoding runs inside Spark's tasks.
"""

from __future__ import annotations

import numpy as np


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Crf:
    """`emit` has a row of tag weights per feature, `move` the weights of going from tag to tag."""

    def __init__(self, features: int, tags: int):
        self.emit, self.move, self.first = np.zeros((features, tags)), np.zeros((tags, tags)), np.zeros(tags)

    def scores(self, clauses: list[list[int]]) -> np.ndarray:
        return np.array([self.emit[c].sum(axis=0) for c in clauses])

    def decode(self, clauses: list[list[int]]) -> list[int]:
        """The best tags of one sequence (Viterbi); ties go to the lower tag; none for no clauses."""
        if not clauses:
            return []
        s = self.scores(clauses)
        best, back = self.first + s[0], []
        for row in s[1:]:
            paths = best[:, None] + self.move
            back.append(paths.argmax(axis=0))
            best = paths.max(axis=0) + row
        tags = [int(best.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]

    def fit(self, sequences: list[list[list[int]]], tags: list[list[int]], decay: np.ndarray, rounds: int = 80, rate: float = 0.3) -> Crf:
        """Maximise the conditional likelihood by Adam, all sequences of one length at a time.

        `decay` draws each feature's weights to 0, the more the larger it is.
        """
        groups: dict[int, list[int]] = {}
        for i, s in enumerate(sequences):
            groups.setdefault(len(s), []).append(i)
        data = []
        for length, members in sorted(groups.items()):
            flat = [c for i in members for c in sequences[i]]
            at = np.repeat(np.arange(len(flat)), [len(c) for c in flat])
            data.append((length, np.concatenate([np.asarray(c, int) for c in flat]), at, np.array([tags[i] for i in members])))
        params = [self.emit, self.move, self.first]
        mean, var = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        n, k = len(sequences), len(self.first)
        for turn in range(1, rounds + 1):
            grads = [decay[:, None] * self.emit, 1e-4 * self.move, 1e-4 * self.first]
            for length, cols, at, gold in data:
                m = len(gold)
                s = np.stack([np.bincount(at, self.emit[cols, t], m * length) for t in range(k)], axis=1).reshape(m, length, k)
                forward, backward = np.empty_like(s), np.zeros_like(s)
                forward[:, 0] = self.first + s[:, 0]
                for j in range(1, length):
                    forward[:, j] = _log_sum(forward[:, j - 1, :, None] + self.move, 1) + s[:, j]
                for j in range(length - 2, -1, -1):
                    backward[:, j] = _log_sum(self.move + (s[:, j + 1] + backward[:, j + 1])[:, None, :], 2)
                total = _log_sum(forward[:, -1], 1)
                off = np.exp(forward + backward - total[:, None, None])
                for j in range(1, length):
                    pair = forward[:, j - 1, :, None] + self.move + (s[:, j] + backward[:, j])[:, None, :]
                    grads[1] += np.exp(pair - total[:, None, None]).sum(axis=0) / n
                    np.add.at(grads[1], (gold[:, j - 1], gold[:, j]), -1.0 / n)
                off[np.arange(m)[:, None], np.arange(length)[None, :], gold] -= 1.0
                grads[2] += off[:, 0].sum(axis=0) / n
                per = off.reshape(m * length, k)[at] / n
                for t in range(k):
                    grads[0][:, t] += np.bincount(cols, per[:, t], len(self.emit))
            for p, g, a, b in zip(params, grads, mean, var, strict=True):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= rate * (a / (1 - 0.9**turn)) / (np.sqrt(b / (1 - 0.99**turn)) + 1e-8)
        return self
