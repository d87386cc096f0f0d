"""A causal self-attention model in numpy: forward, backward, training, scoring.

Ids are laid out in blocks of BLOCK. A position attends to its own block up to itself and to the block before, in the
same text: windows of two blocks that overlap by one, each of which scores the ids of its second block, so every id is
scored once, with BLOCK to 2 BLOCK - 1 ids before it (fewer at a text's start). All windows of a batch go through one
masked attention. Distances enter as a learned bias. A state is the id's embedding, plus what attention gathers, plus a
layer of rectified units.

The output is a tree of three choices among `branch` ways each: ids are numbered by falling frequency and dealt out by
that number, so the first two choices tell frequent ids apart. A lower choice sees the state through rectified units
that the choices above shift. The biases of all choices start at the log frequencies; those of the last stay there.

What is learnt by gradient, but for the embeddings, lies in one flat vector. It takes Adam steps; an embedding takes
AdaGrad steps scaled by the sum of its squared gradients, for the ids of a batch alone.
"""

from __future__ import annotations

import functools
import math

import numpy as np

BLOCK, KEYS, VALUES, HIDDEN = 16, 8, 16, 16
Model = dict  # of arrays: slots (ids x 3), emb, flat, last (the last choice's biases); view() names the parts of flat


def shapes(dim: int, branch: int) -> dict[str, tuple[int, ...]]:
    return {
        "qkv": (dim, 2 * KEYS + VALUES), "o": (VALUES - 1, dim), "dist": (2 * BLOCK,), "w1": (dim, HIDDEN), "b1": (HIDDEN,), "w2": (HIDDEN, dim),
        "n1": (dim, branch), "c1": (branch,), "a2": (dim, HIDDEN), "e2": (HIDDEN, branch), "n2": (HIDDEN, branch), "c2": (branch, branch),
        "a3": (dim, HIDDEN), "e3": (HIDDEN, branch), "f3": (HIDDEN, branch), "n3": (HIDDEN, branch),
    }


@functools.lru_cache
def _places(dim: int, branch: int) -> list[tuple[str, int, int, tuple[int, ...]]]:
    out, at = [], 0
    for name, shape in shapes(dim, branch).items():
        out.append((name, at, at := at + math.prod(shape), shape))
    return out


def view(flat: np.ndarray, dim: int, branch: int) -> dict[str, np.ndarray]:
    return {name: flat[at:to].reshape(shape) for name, at, to, shape in _places(dim, branch)}


def _pick(table: np.ndarray, at: np.ndarray, axis: int) -> np.ndarray:
    """np.take for places that are all there: without the checks it takes less than half the time."""
    return np.take(table, at, axis, mode="clip")


def init(vocabulary: int, dim: int, counts: np.ndarray, seed: int = 7) -> Model:
    """counts: how often each id occurs; its place in the order of frequency fixes an id's choices."""
    branch, r = max(2, math.ceil(vocabulary ** (1 / 3) - 1e-9)), np.random.default_rng(seed)
    slot = np.empty(vocabulary, np.int64)
    slot[np.lexsort((np.arange(vocabulary), -counts))] = np.arange(vocabulary)
    slots = np.stack([slot % branch, slot // branch % branch, slot // branch**2]).T  # a choice of all ids lies in one run
    share = np.zeros((branch, branch, branch))
    share[tuple(slots.T)] = counts + 1.0
    with np.errstate(divide="ignore", invalid="ignore"):
        one, two = share.sum((1, 2)), share.sum(2)
        c1, c2, last = np.log(one / one.sum()), np.log(two / one[:, None]), np.log(share / two[:, :, None])
    c1, c2, last = (np.maximum(np.nan_to_num(x, nan=-30.0, neginf=-30.0), -30) for x in (c1, c2, last))
    flat = np.zeros(sum(map(math.prod, shapes(dim, branch).values())), np.float32)
    p = view(flat, dim, branch)
    for name, scale in (("qkv", 0.5), ("w1", 1), ("n1", 0.1), ("a2", 0.5), ("n2", 0.1), ("a3", 0.5), ("n3", 0.1), ("o", 0.3), ("w2", 0.1), ("e2", 0.1), ("e3", 0.1), ("f3", 0.1)):
        p[name][...] = r.standard_normal(p[name].shape) * scale * p[name].shape[0] ** -0.5
    p["qkv"][:, -1] = 0
    p["c1"][...], p["c2"][...] = c1, c2.T
    emb = (r.standard_normal((vocabulary, dim)) * 0.3).astype(np.float32)
    return {"slots": slots, "emb": emb, "flat": flat, "last": np.ascontiguousarray(last.reshape(branch * branch, branch).T, np.float32)}


_OWN = np.tril(np.ones((BLOCK, BLOCK), bool))
_DIST = np.arange(BLOCK)[:, None] - np.arange(BLOCK)[None]
_NEAR, _OWN_DIST, _FAR_DIST = np.where(_OWN, _DIST, 0), _DIST[_OWN], (_DIST + BLOCK).ravel()


def _shape(m: Model) -> tuple[int, int]:
    return m["emb"].shape[1], m["last"].shape[0]


def layout(texts: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids before each position, ids to score or -1, whether a block is a text's first), by block; each text is closed by end."""
    size = np.array([len(t) + 1 for t in texts])
    blocks = -(-size // BLOCK)
    first = np.zeros(int(blocks.sum()), bool)
    starts = np.cumsum(blocks) - blocks
    first[starts] = True
    goal = np.full(len(first) * BLOCK, -1, np.int32)
    for t, s, n in zip(texts, (starts * BLOCK).tolist(), size.tolist()):
        goal[s : s + n - 1] = t
        goal[s + n - 1] = end
    given = np.concatenate([[end], np.maximum(goal[:-1], 0)]).astype(np.int32)
    given[starts * BLOCK] = end
    return given.reshape(-1, BLOCK), goal.reshape(-1, BLOCK), first


def _weights(dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What exponentials of scores are multiplied by: within a block, and to the block before."""
    near = np.exp(dist)
    return np.where(_OWN, near[_NEAR], 0).astype(dist.dtype), near[_DIST + BLOCK]


def _padded(o: np.ndarray) -> np.ndarray:
    return np.concatenate([o, np.zeros((1, o.shape[1]), o.dtype)])


def states(m: Model, given: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, tuple]:
    """(states by position, what backward needs)."""
    p, n = view(m["flat"], *_shape(m)), len(given)
    x = _pick(m["emb"], given.ravel(), 0)
    y = (x @ p["qkv"]).reshape(n, BLOCK, -1)
    y[:, :, -1] = 1  # so that the sum of weights comes with the values
    q, k, v = y[:, :, :KEYS], y[:, :, KEYS : 2 * KEYS], y[:, :, 2 * KEYS :]
    within, across = _weights(p["dist"])
    own = np.matmul(q, k.transpose(0, 2, 1))
    np.minimum(own, 60, out=own)
    np.exp(own, out=own)
    own *= within
    far = np.matmul(q[1:], k[:-1].transpose(0, 2, 1))
    np.minimum(far, 60, out=far)
    np.exp(far, out=far)
    far *= across
    far[first[1:]] = 0
    a = np.matmul(own, v)
    a[1:] += np.matmul(far, v[:-1])
    a = a.reshape(-1, VALUES)
    den = a[:, -1:].copy()
    a /= den  # the last is 1, and no row of o takes it
    z = a @ _padded(p["o"])
    z += x
    u = z @ p["w1"]
    u += p["b1"]
    np.maximum(u, 0, out=u)
    out = u @ p["w2"]
    out += z
    return out, (x, y, own, far, a, den, z, u)


def _choice(logits: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log softmax of each column at one place, sums of the exponentials); logits turn into exponentials."""
    logits -= logits.max(0)
    got = _pick(logits.ravel(), place, 0)
    np.exp(logits, out=logits)
    s = logits.sum(0)
    return got - np.log(s), s


def _levels(m: Model, z: np.ndarray, goal: np.ndarray) -> tuple[np.ndarray, tuple]:
    """(natural log probabilities of goal given states, what backward needs); features run down, positions across."""
    p, branch, at = view(m["flat"], *_shape(m)), m["last"].shape[0], np.arange(len(goal))
    c1, c2, c3 = _pick(m["slots"].T, goal, 1)
    w = np.concatenate([p["n1"], p["a2"], p["a3"]], 1)
    t = w.T @ z.T  # what the three choices take from the state
    l1, h2, h3 = t[:branch], t[branch : branch + HIDDEN], t[branch + HIDDEN :]
    l1 += p["c1"][:, None]
    lp, s1 = _choice(l1, c1 * len(goal) + at)
    t[branch:] += _pick(np.concatenate([p["e2"], p["e3"]]), c1, 1)
    h3 += _pick(p["f3"], c2, 1)
    np.maximum(t[branch:], 0, out=t[branch:])
    l2 = p["n2"].T @ h2
    l2 += _pick(p["c2"], c1, 1)
    more, s2 = _choice(l2, c2 * len(goal) + at)
    lp += more
    l3 = p["n3"].T @ h3
    l3 += _pick(m["last"], c1 * branch + c2, 1)
    more, s3 = _choice(l3, c3 * len(goal) + at)
    lp += more
    return lp, (c1, c2, c3, at, w, t, s1, l2, s2, l3, s3)


def score(m: Model, texts: list[np.ndarray], end: int, step: int = 128) -> np.ndarray:
    """The natural log probability of each text and its end."""
    given, goal, first = layout(texts, end)
    place = np.repeat(np.arange(len(texts)), [-(-(len(t) + 1) // BLOCK) for t in texts])
    out = np.zeros(len(texts))
    for at in range(0, len(first), step):  # a cut text goes on with the block before as context
        to = min(at + step, len(first))
        lo = at if first[at] else at - 1
        f = first[lo:to].copy()
        f[0] = True
        z = states(m, given[lo:to], f)[0][(at - lo) * BLOCK :]
        g = goal[at:to].ravel()
        lp = _levels(m, z, np.maximum(g, 0))[0]
        lp[g < 0] = 0
        out += np.bincount(place[at:to], lp.reshape(-1, BLOCK).sum(1, dtype=np.float64), len(texts))
    return out


def gradients(m: Model, given: np.ndarray, goal: np.ndarray, first: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(mean negative log probability, gradient of flat, ids given, gradients of their embeddings)."""
    dim, branch = _shape(m)
    p, n = view(m["flat"], dim, branch), len(given)
    flat = np.zeros_like(m["flat"])
    g = view(flat, dim, branch)
    z, (x, y, own, far, a, den, z0, u) = states(m, given, first)
    goal = goal.ravel()
    there = goal >= 0
    lp, (c1, c2, c3, at, w, t, s1, l2, s2, l3, s3) = _levels(m, z, np.maximum(goal, 0))
    l1, h2, h3 = t[:branch], t[branch : branch + HIDDEN], t[branch + HIDDEN :]
    share = there.astype(z.dtype) / there.sum()
    loss = -float((lp * share).sum(dtype=np.float64))
    one = np.eye(branch, dtype=z.dtype)
    o1, o2 = _pick(one, c1, 0), _pick(one, c2, 0)
    for e, s, c in ((l1, s1, c1), (l2, s2, c2), (l3, s3, c3)):
        e *= share / s
        e.reshape(-1)[c * len(goal) + at] -= share
    g["n2"][...], g["n3"][...] = h2 @ l2.T, h3 @ l3.T
    alive = t[branch:] > 0
    np.matmul(p["n2"], l2, out=h2)
    np.matmul(p["n3"], l3, out=h3)
    t[branch:] *= alive  # t turns into its own gradient
    g["c1"][...], g["c2"][...], g["f3"][...] = l1.sum(1), l2 @ o1, h3 @ o2
    e23, w123 = t[branch:] @ o1, z.T @ t.T
    g["e2"][...], g["e3"][...] = e23[:HIDDEN], e23[HIDDEN:]
    g["n1"][...], g["a2"][...], g["a3"][...] = w123[:, :branch], w123[:, branch : branch + HIDDEN], w123[:, branch + HIDDEN :]
    dz = t.T @ w.T
    du = dz @ p["w2"].T
    du *= u > 0
    g["w2"][...], g["w1"][...], g["b1"][...] = u.T @ dz, z0.T @ du, du.sum(0)
    dz += du @ p["w1"].T
    g["o"][...] = (a.T @ dz)[:-1]
    da = dz @ _padded(p["o"]).T
    da /= den
    np.negative(np.einsum("ij,ij->i", da, a), out=da[:, -1])
    da = da.reshape(n, BLOCK, VALUES)
    q, k, v = y[:, :, :KEYS], y[:, :, KEYS : 2 * KEYS], y[:, :, 2 * KEYS :]
    dy = np.empty_like(y)
    dv = dy[:, :, 2 * KEYS :]
    np.matmul(own.transpose(0, 2, 1), da, out=dv)
    dv[:-1] += np.matmul(far.transpose(0, 2, 1), da[1:])
    dv[:, :, -1] = 0
    do = np.matmul(da, v.transpose(0, 2, 1))
    do *= own
    df = np.matmul(da[1:], v[:-1].transpose(0, 2, 1))
    df *= far
    dq, dk = dy[:, :, :KEYS], dy[:, :, KEYS : 2 * KEYS]
    np.matmul(do, k, out=dq)
    dq[1:] += np.matmul(df, k[:-1])
    np.matmul(do.transpose(0, 2, 1), q, out=dk)
    dk[:-1] += np.matmul(df.transpose(0, 2, 1), q[1:])
    g["dist"][...] = np.bincount(_OWN_DIST, do.sum(0)[_OWN], 2 * BLOCK) + np.bincount(_FAR_DIST, df.sum(0).ravel(), 2 * BLOCK)
    dy = dy.reshape(len(x), -1)
    g["qkv"][...] = x.T @ dy
    dz += dy @ p["qkv"].T
    ids = given.ravel()
    order = np.argsort(ids.astype(np.uint16) if len(m["emb"]) <= 1 << 16 else ids, kind="stable")
    ids = ids[order]
    starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    return loss, flat, ids[starts], np.add.reduceat(_pick(dz, order, 0), starts, axis=0)


class Trainer:
    """Steps over the blocks of texts, each block once, in runs of permuted order. expected: the ids that are to come in all;
    the rate falls with those seen to a tenth."""

    RUN = 8

    def __init__(self, model: Model, end: int, expected: int, rate: float, blocks: int = 64, seed: int = 1):
        self.model, self.end, self.expected, self.rate, self.blocks = {**model, "emb": model["emb"].copy(), "flat": model["flat"].copy()}, end, max(1, expected), rate, blocks
        self.m, self.s, self.t, self.seen = np.zeros_like(model["flat"]), np.zeros_like(model["flat"]), 0, 0
        self.sums, self.random = np.full(len(model["emb"]), 1e-8, model["emb"].dtype), np.random.default_rng(seed)

    def feed(self, texts: list[np.ndarray]) -> None:
        if not texts:
            return
        given, goal, first = layout(texts, self.end)
        run = max(1, min(self.RUN, len(first)))
        each, order = max(1, self.blocks // run), self.random.permutation(np.arange(0, len(first), run))
        for k in range(0, len(order), each):
            pick = (order[k : k + each, None] + np.arange(run)).ravel()
            head = np.zeros(len(pick), bool)
            head[::run] = True
            there = pick < len(first)  # the last run may be shorter
            pick, head = pick[there], head[there]
            self.step(_pick(given, pick, 0), _pick(goal, pick, 0), _pick(first, pick, 0) | head)

    def step(self, given: np.ndarray, goal: np.ndarray, first: np.ndarray) -> float:
        loss, flat, ids, emb = gradients(self.model, given, goal, first)
        self.seen += int((goal >= 0).sum())
        self.t += 1
        rate = self.rate * max(0.1, 1 - 0.9 * self.seen / self.expected)
        self.m += 0.1 * (flat - self.m)
        self.s += 0.01 * (flat * flat - self.s)
        self.model["flat"] -= (rate / (1 - 0.9**self.t)) * self.m / (np.sqrt(self.s / (1 - 0.99**self.t)) + 1e-8)
        sums = _pick(self.sums, ids, 0)
        sums += np.einsum("ij,ij->i", emb, emb)
        self.sums[ids] = sums
        emb *= (10 * rate / np.sqrt(sums))[:, None]
        self.model["emb"][ids] = np.subtract(_pick(self.model["emb"], ids, 0), emb, out=emb)
        return loss
