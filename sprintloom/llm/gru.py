"""A gated recurrent language model in numpy with a class-factored softmax and truncated backpropagation.

Tokens are numbered by falling frequency. The first ``words`` numbers have weights of their own, in classes of
neighbouring numbers that hold about equal sums of square roots of occurrences, which keeps the softmax
over a class short on average; every other token belongs to one last class. The model gives P(class | state) P(token | class, state), and for the last class
only P(class | state): what a token's share of that class is does not depend on the state.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np


def class_bounds(counts: np.ndarray, classes: int) -> np.ndarray:
    """First token of each class and the end: at most ``classes`` of about equal sums of square roots of occurrences.

    With p(w) the frequency of token w, no other bounds make the sum of p(w) times the size of w's class much smaller."""
    if not len(counts):
        return np.zeros(1, np.int64)
    roots = np.sqrt(counts)
    share = np.cumsum(roots) / roots.sum()
    group = np.minimum((share - roots / roots.sum() / 2) * classes, classes - 1).astype(np.int64)
    return np.r_[0, np.flatnonzero(np.diff(group)) + 1, len(counts)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


@dataclass
class Trail:
    """What a step back needs of all steps of a window, and their states: update and reset gates side by side, the candidate,
    and the recurrent part of all three."""

    ids: np.ndarray
    live: np.ndarray
    before: np.ndarray
    both: np.ndarray
    candidate: np.ndarray
    mixed: np.ndarray
    states: np.ndarray


@dataclass
class Net:
    """Weights. ``inputs`` has a row per token with weights, then one for all others and one for the start."""

    bounds: np.ndarray
    inputs: np.ndarray
    recurrent: np.ndarray
    classes: np.ndarray
    class_bias: np.ndarray
    outputs: np.ndarray
    output_bias: np.ndarray

    PARTS = ("inputs", "recurrent", "classes", "class_bias", "outputs", "output_bias")

    @classmethod
    def new(cls, counts: np.ndarray, others: float, hidden: int, classes: int, seed: int = 7) -> Net:
        """A net that starts at the tokens' frequencies, ``others`` being the last class's."""
        rng, words, bounds = np.random.default_rng(seed), len(counts), class_bounds(counts, classes)
        mass = np.r_[np.add.reduceat(counts, bounds[:-1]) if words else np.empty(0), others].astype(np.float64)
        small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        return cls(bounds, small(words + 2, 3 * hidden), small(hidden, 3 * hidden), np.zeros((hidden, len(mass)), np.float32),
                   np.log(mass / mass.sum()).astype(np.float32), np.zeros((words, hidden), np.float32),
                   np.log(np.maximum(counts, 1)).astype(np.float32))

    @property
    def words(self) -> int:
        return len(self.outputs)

    @property
    def hidden(self) -> int:
        return len(self.recurrent)

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, p).ravel() for p in self.PARTS])

    def with_flat(self, values: np.ndarray) -> Net:
        parts, at = [], 0
        for name in self.PARTS:
            own = getattr(self, name)
            parts.append(values[at:at + own.size].reshape(own.shape).astype(np.float32))
            at += own.size
        return Net(self.bounds, *parts)

    def run(self, ids: np.ndarray, widths: list[int], state: np.ndarray) -> Trail:
        """The states of a window of steps: ``ids`` are the inputs of all steps, step by step, ``widths`` how many each has, and
        ``state`` the lanes' states before. A lane whose input is the start begins with state zero."""
        size, total = self.hidden, len(ids)
        live = (ids != self.words + 1).astype(np.float32)[:, None]
        gates, empty = self.inputs[ids], lambda n: np.empty((total, n), np.float32)
        trail = Trail(ids, live, empty(size), empty(2 * size), empty(size), empty(3 * size), empty(size))
        first = 0
        for width in widths:
            rows = slice(first, first + width)
            first += width
            before, both, candidate, mixed, after = (x[rows] for x in (trail.before, trail.both, trail.candidate, trail.mixed, trail.states))
            np.multiply(state[:width], live[rows], out=before)
            np.matmul(before, self.recurrent, out=mixed)
            np.add(gates[rows, :2 * size], mixed[:, :2 * size], out=both)
            _sigmoid(both)
            np.multiply(both[:, size:], mixed[:, 2 * size:], out=candidate)
            candidate += gates[rows, 2 * size:]
            np.tanh(candidate, out=candidate)
            np.subtract(before, candidate, out=after)
            after *= both[:, :size]
            after += candidate
            state = after
        return trail

    def _shares(self, states: np.ndarray, weights: np.ndarray, bias: np.ndarray, chosen: np.ndarray):
        """Softmax over the columns of ``weights`` and the log-probability of the chosen one. States lie between -1
        and 1, so weights bound the logits; only logits that might overflow are moved down first."""
        logits = states @ weights
        logits += bias
        if float((np.abs(weights).sum(0) + np.abs(bias)).max()) > 80:
            logits -= logits.max(1, keepdims=True)
        picked = logits[np.arange(len(chosen)), chosen]
        share = np.exp(logits, out=logits)
        total = share @ np.ones(share.shape[1], np.float32)
        return share, total, picked - np.log(total)

    def log_probs(self, states: np.ndarray, targets: np.ndarray, grads: Grads | None = None) -> np.ndarray:
        """Natural log-probability of each target given its state; with ``grads`` also the loss's gradients.

        Targets of ``words`` or more are of the last class. ``grads.states`` receives the gradient by state."""
        count = len(self.bounds) - 1
        class_of = np.r_[np.repeat(np.arange(count), np.diff(self.bounds)), count].astype(np.uint16)
        own_class = class_of[np.minimum(targets, self.words)]
        order = np.argsort(own_class, kind="stable")  # from here on rows lie class by class
        states, targets, own_class = states[order], targets[order], own_class[order]
        share, total, logs = self._shares(states, self.classes, self.class_bias, own_class)
        if grads:
            # Rows of the softmax are left as they are; what multiplies them is divided by their totals.
            part = 1 / total
            share[np.arange(len(targets)), own_class] -= total
            grads.classes, grads.class_bias = (states * part[:, None]).T @ share, part @ share
            grads.outputs, grads.output_bias = np.zeros_like(self.outputs), np.zeros_like(self.output_bias)
            by_state = share @ self.classes.T
            by_state *= part[:, None]
        cuts = np.r_[0, np.cumsum(np.bincount(own_class, minlength=count + 1))].tolist()
        for c in range(count):
            first, last, some = self.bounds[c], self.bounds[c + 1], slice(cuts[c], cuts[c + 1])
            if last - first < 2 or cuts[c] == cuts[c + 1]:
                continue
            own, place, weights = states[some], targets[some] - first, self.outputs[first:last]
            share, total, inner = self._shares(own, weights.T, self.output_bias[first:last], place)
            logs[some] += inner
            if grads:
                part = 1 / total
                share[np.arange(len(own)), place] -= total
                np.matmul(share.T, own * part[:, None], out=grads.outputs[first:last])
                np.matmul(part, share, out=grads.output_bias[first:last])
                by_state[some] += (share @ weights) * part[:, None]
        out = np.empty_like(logs)
        out[order] = logs
        if grads:
            grads.states = np.empty_like(by_state)
            grads.states[order] = by_state
        return out


class Grads:
    """Gradients of one window."""


class Adagrad:
    def __init__(self, net: Net, rate: float):
        self.net, self.rate = net, np.float32(rate)
        self.sums = {p: np.full(getattr(net, p).shape, 1e-2, np.float32) for p in Net.PARTS}

    def apply(self, part: str, grad: np.ndarray, where=slice(None)) -> None:
        grad = np.clip(grad, -5, 5)
        self.sums[part][where] += grad * grad
        getattr(self.net, part)[where] -= self.rate * grad / np.sqrt(self.sums[part][where])


class Lanes:
    """Documents laid end to end on parallel lanes, the longest first and each to the shortest lane.

    ``targets``, ``inputs`` and ``document`` are step by lane; lanes are ordered by falling length and ``widths`` says how
    many of them still run at each step. A document is never divided, and its first input is the start."""

    def __init__(self, docs: list[np.ndarray], lanes: int, words: int):
        import heapq

        lanes = min(lanes, len(docs))
        heap, dealt = [(0, i) for i in range(lanes)], [[] for _ in range(lanes)]
        for d in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
            length, lane = heapq.heappop(heap)
            dealt[lane].append(d)
            heapq.heappush(heap, (length + len(docs[d]), lane))
        sizes = [sum(len(docs[d]) for d in lane) for lane in dealt]
        order = sorted(range(lanes), key=lambda i: -sizes[i])
        steps = max(sizes, default=0)
        self.targets = np.zeros((steps, lanes), np.int32)
        self.inputs = np.zeros((steps, lanes), np.int32)
        self.document = np.zeros((steps, lanes), np.int32)
        for column, lane in enumerate(order):
            at = 0
            for d in dealt[lane]:
                ids = np.minimum(docs[d], words)
                end = at + len(ids)
                self.targets[at:end, column], self.document[at:end, column] = ids, d
                self.inputs[at, column], self.inputs[at + 1:end, column] = words + 1, ids[:-1]
                at = end
        lengths = np.array([sizes[i] for i in order])
        self.widths = np.searchsorted(-lengths, -np.arange(steps), "left") if lanes else np.zeros(0, np.int64)

    def windows(self, size: int) -> Iterator[tuple[int, int]]:
        """Starts and numbers of steps of windows of ``size`` steps. Where few lanes run on, with the rest of long documents,
        a window has up to eight times as many, so it is not mostly fixed cost."""
        at = 0
        while at < len(self.targets):
            steps = min(8 * size, max(size, size * self.targets.shape[1] // int(self.widths[at])))
            yield at, steps
            at += steps

    def window(self, at: int, size: int, *tables: np.ndarray) -> tuple:
        """The running lanes' entries of the tables, step by step, for ``size`` steps from ``at`` on, and how many each step has."""
        widths = self.widths[at:at + size].tolist()
        return *(np.concatenate([table[at + i, :width] for i, width in enumerate(widths)]) for table in tables), widths


def train(net: Net, docs: list[np.ndarray], optimizer: Adagrad, lanes: int, window: int) -> float:
    """One pass over documents of token numbers; returns the summed log-probability met on the way.

    Backpropagation is cut at ``Lanes.windows``; the state goes on from one to the next."""
    laid, size, total = Lanes(docs, lanes, net.words), net.hidden, 0.0
    state = np.zeros((laid.targets.shape[1], size), np.float32)
    for at, steps in laid.windows(window):
        ids, targets, widths = laid.window(at, steps, laid.inputs, laid.targets)
        trail = net.run(ids, widths, state)
        state = trail.states[len(ids) - widths[-1]:]
        grads = Grads()
        total += float(net.log_probs(trail.states, targets, grads).sum())
        # What each gate's gradient is times the state's, for all steps at once.
        before, update, reset, candidate, part = trail.before, trail.both[:, :size], trail.both[:, size:], trail.candidate, trail.mixed[:, 2 * size:]
        keep = 1 - update
        by_update = (before - candidate) * update
        by_update *= keep
        by_candidate = candidate * candidate
        np.subtract(1, by_candidate, out=by_candidate)
        by_candidate *= keep
        by_part = by_candidate * reset
        by_reset = 1 - reset
        by_reset *= by_part
        by_reset *= part
        gates, mixed = np.empty((len(ids), 3 * size), np.float32), np.empty((len(ids), 3 * size), np.float32)
        back, last, recurrent = None, len(ids), np.ascontiguousarray(net.recurrent.T)
        for width in reversed(widths):
            rows = slice(last - width, last)
            last = rows.start
            grad = grads.states[rows]
            if back is not None:
                grad[:len(back)] += back
            own = mixed[rows]
            np.multiply(grad, by_update[rows], out=own[:, :size])
            np.multiply(grad, by_reset[rows], out=own[:, size:2 * size])
            np.multiply(grad, by_part[rows], out=own[:, 2 * size:])
            np.multiply(grad, by_candidate[rows], out=gates[rows, 2 * size:])
            back = grad * update[rows]
            back += own @ recurrent
            back *= trail.live[rows]
        gates[:, :2 * size] = mixed[:, :2 * size]
        recurrent = before.T @ mixed
        order = np.argsort(ids, kind="stable")
        firsts = np.flatnonzero(np.r_[True, np.diff(ids[order]) > 0])
        optimizer.apply("inputs", np.add.reduceat(gates[order], firsts, axis=0), ids[order][firsts])
        optimizer.apply("recurrent", recurrent)
        optimizer.apply("classes", grads.classes)
        optimizer.apply("class_bias", grads.class_bias)
        optimizer.apply("outputs", grads.outputs)
        optimizer.apply("output_bias", grads.output_bias)
    return total


def score(net: Net, docs: list[np.ndarray], lanes: int, window: int = 32) -> np.ndarray:
    """The natural log-probability of each whole document of token numbers, its state carried throughout."""
    laid, out = Lanes(docs, lanes, net.words), np.zeros(len(docs))
    state = np.zeros((laid.targets.shape[1], net.hidden), np.float32)
    for at, steps in laid.windows(window):
        ids, targets, owners, widths = laid.window(at, steps, laid.inputs, laid.targets, laid.document)
        states = net.run(ids, widths, state).states
        state = states[len(ids) - widths[-1]:]
        out += np.bincount(owners, net.log_probs(states, targets).astype(np.float64), len(docs))
    return out
