"""A one-layer causal self-attention model over subword ids, trained and evaluated in numpy.

At every place it predicts the next id, over all ids. The output is a hierarchical softmax: an id is a leaf of a Huffman tree
over the corpus counts, and its probability the product of the left-or-right decisions on the way to it, so the
probabilities of all ids sum to one and a place costs as many products as the id's code has bits. Untrained, the
decisions give the unigram of the counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Ids of a context window, and how many of them are context only in all windows but a text's first.
WINDOW = 32
CONTEXT = 8
STRIDE = WINDOW - CONTEXT
WIDTH = 12
#: A state has one more component, always 1, for the decisions' biases.
HIDDEN = 15
#: Ids with an embedding of their own; the others share one.
OWN = 8192
#: Nodes near the root whose decisions and gradients are matrix products.
TOP = 64
#: No id: before a text's start, and after its end.
NONE = -1


def _ragged(size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)


def laid_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(windows of WINDOW + 1 ids, whether each of their last STRIDE ids is one): every id of every text is among the last STRIDE of one window."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    counts = -(-sizes // STRIDE)
    length = counts * STRIDE + CONTEXT + 1
    begin = np.cumsum(length) - length
    flat = np.full(int(length.sum()), NONE, dtype=np.int32)
    flat[np.repeat(begin + CONTEXT + 1, sizes) + _ragged(sizes)] = np.concatenate(texts) if texts else []
    windows = flat[(np.repeat(begin, counts) + _ragged(counts) * STRIDE)[:, None] + np.arange(WINDOW + 1)]
    return windows, windows[:, CONTEXT + 1 :] != NONE


class Codes:
    """The Huffman codes of ids with a count above zero: for each id the inner nodes on its path and the side (1 or -1) taken there."""

    def __init__(self, counts: np.ndarray) -> None:
        leaves = np.flatnonzero(counts > 0)
        leaves = leaves[np.argsort(counts[leaves], kind="stable")]
        n = len(leaves)
        weight = np.r_[counts[leaves].astype(np.float64), np.zeros(max(0, n - 1))]
        parent, side = np.full(len(weight), -1, dtype=np.int64), np.zeros(len(weight), dtype=np.float32)
        leaf, inner = 0, n  # the lightest of either sort
        for new in range(n, 2 * n - 1):
            for s in (1.0, -1.0):
                if leaf < n and (inner >= new or weight[leaf] <= weight[inner]):
                    k, leaf = leaf, leaf + 1
                else:
                    k, inner = inner, inner + 1
                parent[k], side[k] = new, s
                weight[new] += weight[k]
        self.nodes = max(1, n - 1)
        self.bias = np.zeros(self.nodes, dtype=np.float32)  # log odds of side 1
        for s in (1.0, -1.0):
            k = np.flatnonzero(side == s)
            self.bias[parent[k] - n] += s * np.log(weight[k])
        rows, nodes, sides = [], [], []
        at, who = np.arange(n), leaves
        while len(at):
            up = parent[at] >= 0
            at, who = at[up], who[up]
            rows.append(who)
            nodes.append(parent[at] - n)
            sides.append(side[at])
            at = parent[at]
        rows = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
        by = np.argsort(rows, kind="stable")
        self.node = np.concatenate(nodes)[by].astype(np.int32) if nodes else np.zeros(0, dtype=np.int32)
        self.side = np.concatenate(sides)[by] if sides else np.zeros(0, dtype=np.float32)
        self.length = np.bincount(rows, minlength=len(counts))
        self.first = np.cumsum(self.length) - self.length
        self.cuts: tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None = None

    def paths(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows of ids, nodes, sides) of the paths of ids, those of one length together: a line for each id."""
        size = self.length[ids]
        order = np.argsort(size.astype(np.int16), kind="stable")
        ends = np.cumsum(np.bincount(size))
        for n in range(1, len(ends)):
            rows = order[ends[n - 1] : ends[n]]
            if len(rows):
                at = self.first[ids[rows]][:, None] + np.arange(n)
                yield rows, self.node[at], self.side[at]

    def cut(self, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(nodes of each id's path below the `top` last nodes, row of the rest of its path, rows: nodes counted from those, sides).

        The nodes below come first, as a node's parent has a larger number; rows are filled up in front by the root with side 0.
        """
        if self.cuts is None or self.cuts[0] != top:
            base = max(0, self.nodes - top)
            ends = np.r_[0, np.cumsum(self.node < base)]
            low = ends[self.first + self.length] - ends[self.first]
            on = np.flatnonzero(self.length > low)
            at = self.first[on] + low[on]
            _, who, row = np.unique(2 * self.node[at].astype(np.int64) + (self.side[at] > 0), return_index=True, return_inverse=True)
            rest = (self.length - low)[on[who]]
            nodes = np.full((len(who) + 1, int(rest.max(initial=1))), self.nodes - 1 - base, dtype=np.int32)
            sides = np.zeros(nodes.shape, dtype=np.float32)
            for k, (x, n) in enumerate(zip(on[who], rest, strict=True)):
                end = self.first[x] + self.length[x]
                nodes[k, -n:], sides[k, -n:] = self.node[end - n : end] - base, self.side[end - n : end]
            rows = np.full(len(low), len(who), dtype=np.int32)
            rows[on] = row.reshape(-1)
            self.cuts = top, low.astype(np.int16), rows, nodes, sides
        return self.cuts[1:]


class Attention:
    def __init__(self, id_counts: np.ndarray, seed: int = 11) -> None:
        """id_counts: of every id in the training text; only ids with a count can be scored."""
        self.rows = OWN + 2  # the last two: a rare id, no id
        frequent = np.argsort(-id_counts, kind="stable")[:OWN]
        self.row = np.full(len(id_counts) + 1, OWN, dtype=np.int32)
        self.row[frequent] = np.arange(len(frequent))
        self.row[NONE] = OWN + 1
        self.codes = Codes(id_counts)
        rng = np.random.default_rng(seed)
        w = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"e": (0.3 * rng.standard_normal((self.rows, WIDTH))).astype(np.float32), "pos": 0.1 * w(WINDOW, WIDTH), "q": w(WIDTH, WIDTH), "k": w(WIDTH, WIDTH), "v": w(WIDTH, WIDTH), "w1": w(2 * WIDTH, HIDDEN), "b1": np.zeros(HIDDEN, np.float32), "w2": np.c_[np.zeros((self.codes.nodes, HIDDEN), np.float32), self.codes.bias]}
        self.mask = np.tril(np.ones((WINDOW, WINDOW), dtype=np.float32))

    def forward(self, rows: np.ndarray, first: int = 0) -> dict:
        """rows: (windows, WINDOW) embedding rows. What asks (`q` and all that follows from it) are the places from `first` on."""
        p = self.p
        n = len(rows)
        x = np.take(p["e"], rows.reshape(-1), axis=0).reshape(n, WINDOW, WIDTH)
        x += p["pos"]
        flat = x.reshape(-1, WIDTH)
        qkv = np.concatenate([p["q"] / np.float32(np.sqrt(WIDTH)), p["k"], p["v"]], axis=1)
        y = (flat @ qkv).reshape(n, WINDOW, 3 * WIDTH)
        q, k, v = y[:, first:, :WIDTH], y[:, :, WIDTH : 2 * WIDTH], y[:, :, 2 * WIDTH :]
        s = np.matmul(q, k.transpose(0, 2, 1))
        np.clip(s, -30, 30, out=s)
        np.exp(s, out=s)
        s *= self.mask[first:]
        total = np.matmul(s, np.ones((WINDOW, 1), dtype=s.dtype))
        asking = WINDOW - first
        inside = np.empty((n, asking, 2 * WIDTH), dtype=x.dtype)
        inside[:, :, :WIDTH] = x[:, first:]
        np.divide(np.matmul(s, v), total, out=inside[:, :, WIDTH:])
        inside = inside.reshape(-1, 2 * WIDTH)
        h = inside @ p["w1"]
        h += p["b1"]
        u = np.ones((len(h), HIDDEN + 1), dtype=h.dtype)
        below = np.abs(h)
        below += 1
        np.divide(h, below, out=u[:, :HIDDEN])
        return {"x": x, "q": q, "k": k, "v": v, "s": s, "total": total, "inside": inside, "below": below, "u": u, "qkv": qkv}

    def order(self, ids: np.ndarray) -> np.ndarray:
        """Of ids, those with the longest paths below the TOP last nodes first."""
        return np.argsort(-self.codes.cut(TOP)[0][ids], kind="stable")

    def decisions(self, u: np.ndarray, ids: np.ndarray) -> tuple[tuple, tuple]:
        """Of the paths to ids, which are in order(), after their states u: (how many ids go on at each level, line, node, side, logit of
        the side taken, weights of the nodes) below the TOP last nodes, level after level, and of the rest, a line for each id, (place in
        a matrix of ids and the last nodes, side, logit)."""
        low, row, nodes, sides = self.codes.cut(TOP)
        w, first, size, row = self.p["w2"], self.codes.first[ids], low[ids], row[ids]
        sizes = (len(ids) - np.cumsum(np.bincount(size))[:-1]).tolist()
        lines = np.arange(len(ids))
        line = np.concatenate([lines[:n] for n in sizes]) if sizes else lines[:0]
        at = np.concatenate([first[:n] + k for k, n in enumerate(sizes)]) if sizes else lines[:0]
        node, side = np.take(self.codes.node, at), np.take(self.codes.side, at)
        own = np.take(w, node, axis=0)
        z = np.einsum("ij,ij->i", np.take(u, line, axis=0), own)
        z *= side
        top = u @ w[-TOP:].T
        place, taken = np.take(nodes, row, axis=0), np.take(sides, row, axis=0)
        place = place + (lines * top.shape[1])[:, None]
        high = np.take(top, place)
        high *= taken
        return (sizes, line, node, side, np.clip(z, -30, 30, out=z), own), (place, taken, np.clip(high, -30, 30, out=high))

    def log_probabilities(self, u: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Natural log probability of each id after its state u."""
        order = self.order(ids)
        (sizes, _, _, _, z, _), (_, taken, high) = self.decisions(np.take(u, order, axis=0), ids[order])
        for x in (z, high):
            np.negative(x, out=x)
            np.exp(x, out=x)
        high *= np.abs(taken, out=taken)  # nothing is decided where a line is filled up
        for x in (z, high):
            x += 1
            np.log(x, out=x)
        sums = -(high @ np.ones(high.shape[1], dtype=high.dtype))
        begin = 0
        for n in sizes:
            sums[:n] -= z[begin : begin + n]
            begin += n
        out = np.empty_like(sums)
        out[order] = sums
        return out

    def gradients(self, rows: np.ndarray, target: np.ndarray) -> tuple[float, dict]:
        """Mean loss over all places with a target (an id, NONE: no target) and its gradients; those of `e` and `w2` as (rows, values)."""
        first = 0 if (target[:, :CONTEXT] >= 0).any() else CONTEXT  # of the places that have a target
        p, f = self.p, self.forward(rows, first)
        n = len(rows)
        target = target[:, first:].reshape(-1)
        at = np.flatnonzero(target >= 0)
        at = at[self.order(target[at])]
        u = np.take(f["u"], at, axis=0)
        (sizes, line, node, side, z, own), (place, taken, high) = self.decisions(u, target[at])
        loss = -np.log(2) * float((taken == 0).sum())  # lines are filled up by decisions of 1 : 1
        for x, s in ((z, side), (high, taken)):
            loss -= float(x.sum())
            np.exp(x, out=x)
            x += 1
            loss += float(np.log(x).sum())
            x *= -len(at)
            np.divide(s, x, out=x)
        top = np.zeros((len(at), min(TOP, self.codes.nodes)), dtype=u.dtype)
        top.reshape(-1)[place.reshape(-1)] = high.reshape(-1)  # the last of equal places stays: the root itself
        base = self.codes.nodes - top.shape[1]
        du_at = top @ p["w2"][base:]
        own *= z[:, None]
        begin = 0
        for k in sizes:
            du_at[:k] += own[begin : begin + k]
            begin += k
        g = {}
        low = _grouped(node, z[:, None] * np.take(u, line, axis=0))
        g["w2"] = np.concatenate([low[0], np.arange(base, self.codes.nodes, dtype=low[0].dtype)]), np.concatenate([low[1], top.T @ u])
        du = np.zeros((len(f["u"]), HIDDEN), dtype=u.dtype)
        du[at] = du_at[:, :HIDDEN]
        du /= f["below"]
        du /= f["below"]
        inside = f["inside"]
        g["w1"], g["b1"] = inside.T @ du, np.ones(len(du), dtype=du.dtype) @ du
        di = du @ p["w1"].T
        dz = di[:, WIDTH:].reshape(n, WINDOW - first, WIDTH)
        z = inside[:, WIDTH:].reshape(dz.shape)
        a = np.divide(f["s"], f["total"], out=f["s"])
        dy = np.zeros((n, WINDOW, 3 * WIDTH), dtype=u.dtype)
        np.matmul(a.transpose(0, 2, 1), dz, out=dy[:, :, 2 * WIDTH :])
        ds = np.matmul(dz, f["v"].transpose(0, 2, 1))
        ds -= np.einsum("nij,nij->ni", dz, z)[:, :, None]
        ds *= a
        np.matmul(ds, f["k"], out=dy[:, first:, :WIDTH])
        np.matmul(ds.transpose(0, 2, 1), f["q"], out=dy[:, :, WIDTH : 2 * WIDTH])
        dy = dy.reshape(-1, 3 * WIDTH)
        x = f["x"].reshape(-1, WIDTH)
        dqkv = x.T @ dy
        g["q"], g["k"], g["v"] = dqkv[:, :WIDTH] * np.float32(1 / np.sqrt(WIDTH)), dqkv[:, WIDTH : 2 * WIDTH], dqkv[:, 2 * WIDTH :]
        dx = (dy @ f["qkv"].T).reshape(n, WINDOW, WIDTH)
        dx[:, first:] += di[:, :WIDTH].reshape(dz.shape)
        g["pos"] = dx.sum(0)
        g["e"] = _grouped(rows.reshape(-1), dx.reshape(-1, WIDTH))
        return loss / len(at), g

    def laid_out(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return laid_out(texts)

    def train(self, windows: np.ndarray, steps: int, batch: int = 96, seed: int = 13, rate: float = 0.08) -> list[float]:
        """Adagrad over windows of WINDOW + 1 ids, all of them in a new random order before any comes again; what an id or a decision has learned slows its own steps alone."""
        rng = np.random.default_rng(seed)
        order = np.concatenate([rng.permutation(len(windows)) for _ in range(-(-steps * batch // len(windows)))])
        past = {k: np.full(v.shape[:1] if k in ("e", "w2") else v.shape, 1e-8, dtype=np.float32) for k, v in self.p.items()}
        losses = []
        for step in range(steps):
            ids = windows[order[step * batch : (step + 1) * batch]]
            target = np.full((batch, WINDOW), NONE, dtype=np.int64)
            target[:, CONTEXT:] = ids[:, CONTEXT + 1 :]
            if not (target >= 0).any():
                continue
            loss, g = self.gradients(self.row[ids[:, :-1]], target)
            losses.append(loss)
            now = rate * (1 - step / (steps + 1))
            for k, v in self.p.items():
                if isinstance(g[k], tuple):
                    at, x = g[k]
                    own = np.take(past[k], at) + np.einsum("ij,ij->i", x, x) / np.float32(x.shape[1])
                    past[k][at] = own
                    x *= (now / np.sqrt(own))[:, None]
                    v[at] = np.take(v, at, axis=0) - x
                else:
                    past[k] += g[k] ** 2
                    v -= now * g[k] / np.sqrt(past[k])
        return losses

    def score(self, texts: list[np.ndarray], batch: int = 192) -> np.ndarray:
        """Natural log probability of each id of all texts, end to end, given the ids before it in its window. Each is scored once, with CONTEXT ids before it at least."""
        windows, real = self.laid_out(texts)
        out = [np.zeros(0)]
        for a in range(0, len(windows), batch):
            w, use = windows[a : a + batch], real[a : a + batch]
            u = self.forward(self.row[w[:, :-1]], CONTEXT)["u"]
            at = np.flatnonzero(use)
            out.append(self.log_probabilities(np.take(u, at, axis=0), np.take(w[:, CONTEXT + 1 :], at)))
        return np.concatenate(out)


def _grouped(key: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, sums of their rows)."""
    if not len(key):
        return key, values[:0]
    short = key.astype(np.int16) if key.max() < 1 << 15 else key
    order = np.argsort(short, kind="stable")
    short = np.take(short, order)
    new = np.ones(len(key), dtype=bool)
    np.not_equal(short[1:], short[:-1], out=new[1:])
    new = np.flatnonzero(new)
    return np.take(short, new).astype(key.dtype), np.add.reduceat(np.take(values, order, axis=0), new, axis=0)
