"""A causal self-attention model of subword ids, in numpy.

Every id has a query, a key, a value and a residual of its own (tables, no
projections at run time); attention weighs the last keys of a window by content
and distance.  tanh of residual and attended value meets a hierarchical softmax
over the whole vocabulary: a Huffman tree with a learned vector and bias at each
inner node, so that an id costs about as many dot products as it has bits.  The
tree starts as the ids' frequencies.

Scoring: a document is cut into blocks of ``BLOCK`` positions; a block's
queries see the block before and, causally, their own, so windows overlap by
half and each position is scored once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

WIDTH, BLOCK = 15, 24
#: With the constant behind them, a row of WIDTH numbers fills a cache line.
#: Training steps at least; one window of SPREAD trains: all of them.
STEPS, BATCH, RATE, SPREAD = 1000, 96, 0.08, 1
#: Tree levels that are worked out for all nodes at once; blocks in a row that train together.
TOP, RUN = 6, 16
FAR, BOUND = np.float32(1e4), 14


@dataclass
class Tree:
    """Paths of all ids, end to end: node numbers by level and the turns taken."""

    nodes: np.ndarray  # levels x ids
    turns: np.ndarray  # levels x ids: 1 and -1, 0 past the end
    depth: np.ndarray
    bias: np.ndarray  # a node's log odds of its first turn


@dataclass
class Model:
    tree: Tree
    tables: dict[str, np.ndarray]

    @property
    def size(self) -> int:
        """Ids; the tables go on with the start and padding."""
        return len(self.tree.depth)


def huffman(counts: np.ndarray) -> Tree:
    """Frequent ids come first and have short paths; nodes are numbered from the root."""
    size = len(counts)
    heap = [(float(c), i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    left, right = np.zeros(size, np.int64), np.zeros(size, np.int64)
    weight = np.zeros((2, max(1, size - 1)))
    for n in range(size - 1):
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        left[n], right[n], weight[0, n], weight[1, n] = i, j, a, b
        heapq.heappush(heap, (a + b, size + n))
    depth = np.zeros(size, np.int64)
    paths: list[list[tuple[int, int]]] = [[] for _ in range(size)]
    todo: list[tuple[int, tuple]] = [(heap[0][1], ())] if size > 1 else []
    number = lambda n: 2 * size - 2 - n  # noqa: E731  (the root, made last, is 0)
    while todo:
        at, path = todo.pop()
        if at < size:
            paths[at], depth[at] = list(path), len(path)
            continue
        n = at - size
        todo.append((left[n], (*path, (number(at), 1))))
        todo.append((right[n], (*path, (number(at), -1))))
    levels = int(depth.max(initial=0))
    nodes, turns = np.zeros((levels, size), np.int32), np.zeros((levels, size), np.int8)
    for i, path in enumerate(paths):
        if path:
            nodes[: len(path), i], turns[: len(path), i] = zip(*path, strict=True)
    bias = np.log(weight[0, ::-1]) - np.log(weight[1, ::-1]) if size > 1 else np.zeros(1)
    # Nodes in order of depth, so that the first levels are the first numbers.
    order = np.full(max(1, size - 1), levels, np.int64)
    for lv in range(levels - 1, -1, -1):
        order[nodes[lv][turns[lv] != 0]] = lv
    rank = np.argsort(np.argsort(order, kind="stable"), kind="stable")
    new = np.zeros_like(bias)
    new[rank] = bias
    return Tree(np.where(turns != 0, rank[nodes], 0).astype(np.int32), turns, depth, new.astype(np.float32))


def _mask() -> np.ndarray:
    """Distance of each key from each query, 2 * BLOCK where a key lies ahead."""
    i, j = np.arange(BLOCK)[:, None] + BLOCK, np.arange(2 * BLOCK)[None, :]
    return np.where(j > i, 2 * BLOCK, i - j)


_MASK = _mask()


def blocks(rows: np.ndarray, lengths: np.ndarray, padding: int) -> tuple[np.ndarray, np.ndarray]:
    """Lay texts out as blocks, each text behind a block of padding.

    Returns (blocks, first block of a text?); ``lengths`` sum to ``len(rows)``.
    """
    room = BLOCK * (1 + -(-lengths // BLOCK))
    starts = np.cumsum(room) - room
    out = np.full(int(room.sum()), padding, rows.dtype)
    at = np.arange(len(rows)) + np.repeat(starts + BLOCK - (np.cumsum(lengths) - lengths), lengths)
    out[at] = rows
    first = np.zeros(len(out) // BLOCK, bool)
    first[starts // BLOCK] = True
    return out.reshape(-1, BLOCK), first


def attended(q: np.ndarray, r: np.ndarray, k: np.ndarray, v: np.ndarray, far: np.ndarray) -> tuple:
    """Queries and residuals of blocks meet keys and values of two blocks -> (hidden
    states with a one behind them, what the gradient needs).

    The last column of a key is 0, or -FAR for padding; that of a query is 1.
    The last column of a value is 1, so one product gives weights and their sum.
    Scores are bounded by a clip instead of a maximum, which costs more."""
    s = q @ k.swapaxes(-1, -2)
    s += np.take(np.append(far, -FAR), _MASK)
    np.clip(s, -60, 60, out=s)
    np.exp(s, out=s)
    mean = s @ v
    total = np.maximum(mean[..., -1:], 1e-30)
    mean /= total
    h = mean.copy()
    h[..., :-1] += r
    np.tanh(h, out=h)
    h[..., -1] = 1
    return h.reshape(-1, WIDTH + 1), (q, k, v, s, total, mean, h)


def attend(t: dict[str, np.ndarray], before: np.ndarray, now: np.ndarray) -> tuple:
    """``attended`` of blocks of ids, each with its block before; their keys' ids lead what is kept."""
    keys = np.concatenate([before, now], axis=1)
    out, kept = attended(np.take(t["q"], now, axis=0), np.take(t["r"], now, axis=0), np.take(t["k"], keys, axis=0), np.take(t["v"], keys, axis=0), t["far"])
    return out, (keys, *kept)


def _odds(x: np.ndarray) -> np.ndarray:
    """1 + exp(-x), in place of x; both turns of a node still sum to one.  The bound
    keeps a product over TOP levels within single precision."""
    np.clip(x, -BOUND, BOUND, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return x


def _paths(tree: Tree, target: np.ndarray, top: int) -> tuple[np.ndarray, list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Levels from ``top`` on, end to end: (targets that reach them, deep ones first, so that
    those of a level are a prefix; how many each level has; of each step down: its target's
    place among them, node and turn)."""
    depth = np.take(tree.depth, target)
    order = np.argsort(np.minimum(depth, 255).astype(np.uint8), kind="stable")[::-1]
    reach = np.cumsum(np.bincount(depth, minlength=len(tree.nodes) + 1)[::-1])[::-1][top + 1 :]
    reach = reach[reach > 0]
    order = order[: int(reach[0]) if len(reach) else 0]
    starts = np.cumsum(reach) - reach
    at = np.arange(int(reach.sum())) - np.repeat(starts, reach)
    cell = np.take(np.take(target, order), at)
    cell += np.repeat((top + np.arange(len(reach))) * len(tree.depth), reach)
    return order, reach.tolist(), at, np.take(tree.nodes.reshape(-1), cell), np.take(tree.turns.reshape(-1), cell)


def _by_level(values: np.ndarray, reach: list[int]) -> np.ndarray:
    """The sum over all levels of what ``_paths`` laid end to end, for each of its targets."""
    out, start = values[: reach[0]].copy(), reach[0]
    for n in reach[1:]:
        out[:n] += values[start : start + n]
        start += n
    return out


def tree_log(tree: Tree, nodes: np.ndarray, hidden: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log P of each target under the tree: a sum of log sigmoids down its path."""
    top = min(TOP, len(tree.nodes))
    first = int(tree.nodes[:top].max(initial=0)) + 1
    dense = hidden @ nodes[:first].T
    at = np.take(tree.nodes[:top], target, axis=1)
    at += np.arange(len(target), dtype=np.int32) * np.int32(first)
    x = np.take(dense.reshape(-1), at)
    x *= np.take(tree.turns[:top], target, axis=1)
    depth = np.take(tree.depth, target)
    # A level past the end has turn 0 and counts as a half, which is taken back.
    out = np.log(2) * np.maximum(top - depth, 0).astype(np.float32) - np.log(_odds(x).prod(0))
    order, reach, place, at, turn = _paths(tree, target, top)
    if reach:
        x = np.einsum("nw,nw->n", np.take(nodes, at, axis=0), np.take(np.take(hidden, order, axis=0), place, axis=0))
        x *= turn
        out[order] -= _by_level(np.log(_odds(x)), reach)
    return out


def tree_gradients(tree: Tree, nodes: np.ndarray, hidden: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gradient of the hidden states, nodes met, their gradients) of -log P, summed."""
    top, every = min(TOP, len(tree.nodes)), np.arange(len(target))
    first = int(tree.nodes[:top].max(initial=0)) + 1
    if not len(target) or not top:
        return np.zeros_like(hidden), np.zeros(0, np.int64), np.zeros((0, hidden.shape[1]), hidden.dtype)
    # The first levels are all nodes' work, in matrix products.
    at, turn = np.take(tree.nodes[:top], target, axis=1), np.take(tree.turns[:top], target, axis=1)
    cell = at + every * first
    x = np.take((hidden @ nodes[:first].T).reshape(-1), cell)
    d = -turn / (1 + np.exp(np.clip(x * turn, -60, 60)))
    dense = np.zeros(len(target) * first, hidden.dtype)
    for lv in range(top - 1, -1, -1):  # a level past the end is 0 at the root, which comes last
        dense[cell[lv]] = d[lv]
    dense = dense.reshape(-1, first)
    dh, du = dense @ nodes[:first], dense.T @ hidden
    order, reach, place, at, turn = _paths(tree, target, top)
    if not reach:
        return dh, np.arange(first), du
    u, h = np.take(nodes, at, axis=0), np.take(np.take(hidden, order, axis=0), place, axis=0)
    x = np.einsum("nw,nw->n", u, h)
    x *= turn
    d = (-turn / (1 + np.exp(np.clip(x, -60, 60, out=x))))[:, None]
    u *= d
    h *= d
    dh[order] += _by_level(u, reach)
    rows, deep = added(at, h)
    return dh, np.append(np.arange(first), rows), np.concatenate([du, deep])


def added(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows met, the sum of ``values`` at each)."""
    if not len(at):
        return at, values
    order = np.argsort(at.astype(np.uint16) if at.max() < 1 << 16 else at, kind="stable")  # short numbers are sorted by radix
    sorted_at = np.take(at, order)
    starts = np.flatnonzero(np.diff(sorted_at, prepend=sorted_at[0] - 1))
    rows = np.take(values, order, axis=0)
    pairs = rows.dtype == np.float32 and rows.shape[1] % 2 == 0  # added two at once, as complex numbers
    sums = np.add.reduceat(rows.view(np.complex64) if pairs else rows, starts, axis=0)
    return sorted_at[starts], sums.view(rows.dtype)


def pulled(kept: tuple, dh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of what ``attended`` took, from that of the hidden states: (queries and
    residuals, keys and values, distances), the first two side by side.

    Behind a hidden state's gradient stands what the weights' sum takes back; the value's
    last column, 1, adds it in the same product."""
    q, k, v, s, total, mean, h = kept
    own, keys = np.empty((*q.shape[:-1], 2 * WIDTH + 2), h.dtype), np.empty((*k.shape[:-1], 2 * WIDTH + 2), h.dtype)
    dz = h * h
    np.subtract(1, dz, out=dz)
    dz *= dh.reshape(h.shape)
    e = dz / total
    e[..., -1] = -np.einsum("...w,...w->...", e, mean)
    ds = e @ v.swapaxes(-1, -2)
    ds *= s
    np.matmul(ds, k, out=own[..., : WIDTH + 1])
    own[..., WIDTH + 1 :] = dz
    np.matmul(ds.swapaxes(-1, -2), q, out=keys[..., : WIDTH + 1])
    np.matmul(s.swapaxes(-1, -2), e, out=keys[..., WIDTH + 1 :])
    far = np.bincount(_MASK.reshape(-1), ds.reshape(-1, _MASK.size).sum(0), 2 * BLOCK + 1)[:-1]
    return own, keys, far.astype(h.dtype)


def summed(now: np.ndarray, own: np.ndarray, keyed: np.ndarray, keys: np.ndarray, far: np.ndarray, nodes: tuple[np.ndarray, np.ndarray], n: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """name -> (rows, gradients), of what ``pulled`` gives for ids ``now`` and ``keyed``: means over n."""
    g = {"u": nodes, "far": (np.arange(2 * BLOCK), far)}
    for names, at, both in ((("q", "r"), now, own), (("k", "v"), keyed, keys)):
        rows, both = added(at.reshape(-1), both.reshape(-1, 2 * WIDTH + 2))
        both[:, WIDTH] = both[:, -1] = 0  # the last column of some tables is fixed
        g[names[0]], g[names[1]] = (rows, both[:, : WIDTH + 1]), (rows, both[:, WIDTH + 1 : 2 * WIDTH + 1 if names[1] == "r" else None])
    return {name: (rows, x / max(1, n)) for name, (rows, x) in g.items()}


def hidden_gradients(tree: Tree, nodes: np.ndarray, hidden: np.ndarray, target: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], int]:
    """(gradient of the hidden states, (nodes met, theirs), live targets): sums over those."""
    at = np.flatnonzero(live)
    if len(at) == len(live):
        dh, *found = tree_gradients(tree, nodes, hidden, target)
        return dh, tuple(found), len(at)
    every = np.zeros_like(hidden)
    every[at], *found = tree_gradients(tree, nodes, np.take(hidden, at, axis=0), np.take(target, at))
    return every, tuple(found), len(at)


def gradients(t: dict[str, np.ndarray], tree: Tree, now: np.ndarray, hidden: np.ndarray, kept: tuple, target: np.ndarray, live: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """name -> (rows, gradients) of the mean -log P of the live targets."""
    dh, nodes, n = hidden_gradients(tree, t["u"], hidden, target, live)
    own, keys, far = pulled(kept[1:], dh)
    return summed(now, own, kept[0], keys, far, nodes, n)


def shifted(values: np.ndarray, lengths: np.ndarray, start: int) -> np.ndarray:
    """What stands before each position; ``start`` before a text's first."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[np.cumsum(lengths) - lengths] = start
    return out


def windows(ids: np.ndarray, lengths: np.ndarray, size: int, pick=None) -> np.ndarray:
    """What trains one block, a row each: the inputs before, its inputs and its
    targets, as ids, ``size`` at a start, ``size`` + 1 in padding.

    ``pick(text, place)``: which ones to make, by number of text and place in it."""
    count = -(-lengths // BLOCK)
    text = np.repeat(np.arange(len(lengths)), count)
    place = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    if pick is not None:
        chosen = pick(text, place)
        text, place = text[chosen], place[chosen]
    start, at = (np.cumsum(lengths) - lengths)[text], place * BLOCK
    spot = at[:, None] + np.arange(-BLOCK, BLOCK)[None, :]  # targets of the block before, and its own
    inside = (spot >= 0) & (spot < lengths[text][:, None])
    y = np.where(inside, np.take(ids, np.where(inside, start[:, None] + spot, 0)) if len(ids) else 0, size + 1)
    x = np.where(inside & (spot > 0), np.take(ids, np.where(inside & (spot > 0), start[:, None] + spot - 1, 0)) if len(ids) else 0, np.where(inside, size, size + 1))
    return np.concatenate([x, y[:, BLOCK:]], axis=1)


def drawn(rows: np.ndarray, steps: int, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Batches of windows that fit into memory: all of them in random order, again and again."""
    order = np.zeros(0, np.int64)
    for _ in range(steps):
        while len(order) < min(BATCH, len(rows)):
            order = np.append(order, rng.permutation(len(rows)))
        yield rows[order[:BATCH]]
        order = order[BATCH:]


def share_and_steps(n: int) -> tuple[float, int]:
    """(share of ``n`` windows that trains, steps): both grow with the corpus."""
    steps = max(STEPS, -(-n // (SPREAD * BATCH)))
    return min(1.0, steps * BATCH / max(1, n)), steps


def start_tables(size: int, tree: Tree, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """Fresh tables of ``size`` ids, the start and padding."""
    t = {x: (rng.standard_normal((size + 2, WIDTH + (x in "qkv"))) * 0.1).astype(np.float32) for x in ("q", "k", "v", "r")}
    t["q"][:, -1], t["k"][:, -1], t["v"][:, -1] = 1, 0, 1
    t["k"][size + 1, -1] = -FAR
    t["far"] = (-0.1 * np.arange(2 * BLOCK)).astype(np.float32)
    t["u"] = np.column_stack([np.zeros((len(tree.bias), WIDTH), np.float32), tree.bias])
    return t


def descend(model: Model, seen: dict[str, np.ndarray], found: dict[str, tuple[np.ndarray, np.ndarray]], rate: float) -> None:
    """One step of Adagrad on the rows that have gradients, in place."""
    for name, (rows, g) in found.items():
        t, held = model.tables[name], np.take(seen[name], rows, axis=0)
        held += g * g
        seen[name][rows] = held
        t[rows] = np.take(t, rows, axis=0) - rate * g / np.sqrt(held, out=held)


def update(model: Model, seen: dict[str, np.ndarray], batch: np.ndarray, rate: float) -> None:
    """One step on a batch of windows."""
    t, size = model.tables, model.size
    before, now, target = batch[:, :BLOCK], batch[:, BLOCK : 2 * BLOCK], batch[:, 2 * BLOCK :].reshape(-1)
    hidden, kept = attend(t, before, now)
    descend(model, seen, gradients(t, model.tree, now, hidden, kept, target, target < size), rate)


def stretches(ids: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts as stretches of RUN blocks in a row: (inputs, with the block
    before in front; targets), ``size`` + 1 in padding and in the block ahead of a text."""
    x, _ = blocks(shifted(ids, lengths, size), lengths, size + 1)
    y, _ = blocks(ids, lengths, size + 1)
    rest = np.full((-len(x) % RUN, BLOCK), size + 1, x.dtype)
    x, y = np.concatenate([np.full((1, BLOCK), size + 1, x.dtype), x, rest]), np.concatenate([y, rest])
    at = np.arange(0, len(y), RUN)[:, None] + np.arange(RUN + 1)
    return x[at], y.reshape(-1, RUN, BLOCK)


def overlapped(keys: np.ndarray) -> np.ndarray:
    """Stretches of keys (stretch, place, number) -> views of two blocks in a row, a block apart."""
    a, b, c = keys.strides
    return np.lib.stride_tricks.as_strided(keys, (len(keys), keys.shape[1] // BLOCK - 1, 2 * BLOCK, keys.shape[2]), (a, BLOCK * b, b, c), writeable=False)


def stretch_gradients(t: dict[str, np.ndarray], tree: Tree, x: np.ndarray, y: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """``gradients`` of the windows of stretches.  A block's keys are fetched once for both
    windows that see it, and what they get is added up before it is sorted by id."""
    now, keyed, target = x[:, 1:], x.reshape(len(x), -1), y.reshape(-1)
    hidden, kept = attended(np.take(t["q"], now, axis=0), np.take(t["r"], now, axis=0), overlapped(np.take(t["k"], keyed, axis=0)), overlapped(np.take(t["v"], keyed, axis=0)), t["far"])
    dh, nodes, n = hidden_gradients(tree, t["u"], hidden, target, target < len(tree.depth))
    own, each, far = pulled(kept, dh)
    keys = np.empty((*x.shape, each.shape[-1]), each.dtype)
    keys[:, 0], keys[:, 1:] = each[:, 0, :BLOCK], each[:, :, BLOCK:]
    keys[:, 1:-1] += each[:, 1:, :BLOCK]
    return summed(now, own, keyed, keys, far, nodes, n)


def opened(counts: np.ndarray, batches: Iterable[np.ndarray], steps: int, rng: np.random.Generator) -> tuple[Model, dict[str, np.ndarray]]:
    """A model fitted on ``steps`` batches of windows, and what Adagrad has seen."""
    tree = huffman(counts + 1.0)
    model = Model(tree, start_tables(len(counts), tree, rng))
    seen = {k: np.full(v.shape, 1e-6, np.float32) for k, v in model.tables.items()}
    for step, batch in enumerate(batches, 1):
        update(model, seen, batch, RATE * min(1, step / 30) * (1.1 - min(1.0, step / (steps + 1))))
    return model, seen


def learn(counts: np.ndarray, batches: Iterable[np.ndarray], steps: int, rng: np.random.Generator) -> Model:
    return opened(counts, batches, steps, rng)[0]


def flat(tables: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([tables[k].reshape(-1) for k in sorted(tables)])


def unflat(values: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    names = sorted(like)
    parts = np.split(values, np.cumsum([like[k].size for k in names])[:-1])
    return {k: v.reshape(like[k].shape) for k, v in zip(names, parts, strict=True)}


def train(ids: np.ndarray, lengths: np.ndarray, size: int, steps: int | None = None, seed: int = 11) -> Model:
    """Fit on texts in memory (``ids`` end to end, each with its end id)."""
    rng, steps = np.random.default_rng(seed), STEPS if steps is None else steps
    rows = windows(ids, lengths, size)
    return learn(np.bincount(ids, minlength=size), drawn(rows, steps if len(rows) else 0, rng), steps, rng)


def log10_probabilities(model: Model, ids: np.ndarray, lengths: np.ndarray, step: int = 16) -> np.ndarray:
    """log10 P of each text; ``ids`` end to end, ``lengths`` all at least 1."""
    t, (x, y) = model.tables, stretches(ids, lengths, model.size)
    found = []
    for i in range(0, len(x), step):
        now, keyed, target = x[i : i + step, 1:], x[i : i + step].reshape(-1, (RUN + 1) * BLOCK), y[i : i + step].reshape(-1)
        hidden, _ = attended(np.take(t["q"], now, axis=0), np.take(t["r"], now, axis=0), overlapped(np.take(t["k"], keyed, axis=0)), overlapped(np.take(t["v"], keyed, axis=0)), t["far"])
        live = np.flatnonzero(target < model.size)
        found.append(tree_log(model.tree, t["u"], np.take(hidden, live, axis=0), np.take(target, live)))
    each = np.concatenate(found).astype(np.float64) / np.log(10)  # in the order of ids
    return np.add.reduceat(each, np.cumsum(lengths) - lengths)
