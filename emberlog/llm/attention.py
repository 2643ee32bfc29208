"""A small causal self-attention model over subword ids, in numpy: training steps and batched scoring.

An id's probability is that of its group, of its class within the group, and of the id within the class. Group and class come from
one masked attention layer over the ids before it (queries and keys are one matrix, ``match``, and values are projected after they
are summed, which is the same with fewer products; a softmax of two levels, so an id costs GROUPS + SUBS logits instead of
their product), the last share from corpus counts; the most frequent ids have a class to themselves. Windows of CONTEXT + STEP places
overlap by CONTEXT, and each id is scored in exactly one window.
"""

from __future__ import annotations

import numpy as np

STEP, CONTEXT, WIDTH, GROUPS, SUBS, BUCKETS = 32, 8, 12, 16, 32, 2048
CLASSES = GROUPS * SUBS
LENGTH = STEP + CONTEXT
#: Causal mask: place CONTEXT + i sees itself and the places before it.
MASK = np.tril(np.ones((STEP, LENGTH), np.float32), CONTEXT)
NAMES = ("embed", "place", "match", "value", "out", "bias", "sub", "sub_bias")
#: Logits are cut here, so that no exponential overflows.
MOST = np.float32(60)


class Vocabulary:
    """What the corpus counts of ids give: input buckets, classes and each id's log share of its class.

    The most frequent ids have a bucket and a class each; the others share the rest by rank, so that classes are of like
    weight. Classes of near ranks are a group. The counts have 0.5 added: every id has a share.
    """

    def __init__(self, counts: np.ndarray, start_id: int):
        n = len(counts)
        weight = counts.astype(np.float64) + 0.5
        order = np.argsort(-weight, kind="stable")
        own = CLASSES * 3 // 4
        self.classes = np.empty(n, np.int64)
        self.classes[order[:own]] = np.arange(min(own, n))
        rest = order[own:]
        mass = np.cumsum(weight[rest])
        self.classes[rest] = own + np.minimum((mass - weight[rest]) / mass[-1] * (CLASSES - own), CLASSES - own - 1).astype(np.int64) if len(rest) else 0
        self.buckets = np.empty(n, np.int64)
        single = BUCKETS * 3 // 4
        self.buckets[order[:single]] = np.arange(min(single, n))
        self.buckets[order[single:]] = single + np.arange(max(0, n - single)) % (BUCKETS - single)
        totals = np.bincount(self.classes, weight, CLASSES)
        self.share = np.log(weight / totals[self.classes]).astype(np.float32)
        groups = np.maximum(totals.reshape(GROUPS, SUBS), 1e-9)
        self.prior = np.log(groups.sum(1) / groups.sum()).astype(np.float32)
        self.sub_prior = np.log(groups / groups.sum(1, keepdims=True)).astype(np.float32)
        self.start_id = start_id


def initial(vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    """The model before training: with hardly any weight between places it predicts the classes' frequencies."""
    rng = np.random.default_rng(11)
    draw = lambda *shape: rng.normal(size=shape).astype(np.float32)
    return {
        "embed": draw(BUCKETS, WIDTH) * 0.5, "place": draw(LENGTH, WIDTH) * 0.1, "match": draw(WIDTH, WIDTH) * 0.05, "value": draw(WIDTH, WIDTH) * 0.2,
        "out": draw(WIDTH, GROUPS) * 0.02, "bias": vocabulary.prior.copy(), "sub": draw(GROUPS, WIDTH, SUBS) * 0.02, "sub_bias": vocabulary.sub_prior.copy(),
    }


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums over the last axis, as a product."""
    return (x.reshape(-1, x.shape[-1]) @ np.ones(x.shape[-1], np.float32)).reshape(x.shape[:-1])


def _segments(keys: np.ndarray) -> list[tuple[int, int, int]]:
    """(key, start, end) of the runs of sorted keys."""
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])).tolist() if len(keys) else [0]
    return [(int(keys[a]), a, b) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def _weights(scores: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Attention from scaled scores (windows, STEP, LENGTH), in their place; not divided by its sums."""
    np.minimum(scores, MOST, out=scores)
    np.exp(scores, out=scores)
    scores[:, :, CONTEXT:] *= MASK[:, CONTEXT:]  # all places of the context are seen
    if not seen.all():
        scores *= np.where(seen, np.float32(1), np.float32(1e-30))[:, None, :]  # never quite 0: a place with nothing to see sees itself
    return scores


def _sub_logits(h: np.ndarray, runs: list[tuple[int, int, int]], sub: np.ndarray, bias: np.ndarray | None = None) -> np.ndarray:
    """Logits of the classes of each row's group; rows are sorted by group."""
    out = np.empty((len(h), SUBS), np.float32)
    for g, a, b in runs:
        np.matmul(h[a:b], sub[g], out=out[a:b])
        if bias is not None:
            out[a:b] += bias[g]
    return np.minimum(out, MOST, out=out)


def _with_bias(w: dict) -> tuple[np.ndarray, np.ndarray]:
    """``out`` and ``sub`` with their biases as a last row, which a last 1 of each place's vector meets."""
    return np.concatenate([w["out"], w["bias"][None]]), np.concatenate([w["sub"], w["sub_bias"][:, None]], axis=1)


class Trainer:
    """Weights, with what Adam remembers of them from step to step."""

    def __init__(self, weights: dict[str, np.ndarray], vocabulary: Vocabulary, rate: float = 0.01):
        self.v, self.rate, self.steps = vocabulary, rate, 0
        self.flat = np.concatenate([weights[k].ravel() for k in NAMES])
        self.first, self.second = np.zeros_like(self.flat), np.zeros_like(self.flat)
        cuts = np.cumsum([weights[k].size for k in NAMES])[:-1]
        self.w = {k: x.reshape(weights[k].shape) for k, x in zip(NAMES, np.split(self.flat, cuts), strict=True)}  # views

    def learn(self, windows: np.ndarray, batch: int = 128) -> float:
        """One pass over windows (n, LENGTH + 1; -1 where there is nothing); the mean loss on the way."""
        loss = n = 0
        for at in range(0, len(windows), batch):
            total, real, gradients = self.step(windows[at : at + batch])
            loss, n = loss + total, n + real
            self.move(gradients)
        return loss / max(1, n)

    def step(self, part: np.ndarray) -> tuple[float, int, dict[str, np.ndarray]]:
        """Summed loss, targets and gradients (of the mean loss) of some windows."""
        w, n, scale = self.w, len(part), np.float32(WIDTH**-0.5)
        inputs, targets = part[:, :-1], part[:, CONTEXT + 1 :]
        seen = inputs >= 0
        real = ((targets >= 0) & seen[:, CONTEXT:]).ravel()
        buckets, classes = self.v.buckets[np.maximum(inputs, 0)], self.v.classes[np.maximum(targets, 0)].ravel()
        x = w["embed"][buckets]
        x += w["place"]
        own = x[:, CONTEXT:].reshape(-1, WIDTH)
        q = (own @ (w["match"] * scale)).reshape(n, STEP, WIDTH)
        att = _weights(np.matmul(q, x.transpose(0, 2, 1)), seen)
        divisor = _sums(att)[:, :, None]
        mean = np.matmul(att, x)
        mean /= divisor
        mean = mean.reshape(-1, WIDTH)
        h = mean @ w["value"]
        h += own

        group = classes // SUBS
        order = np.argsort(group.astype(np.uint8), kind="stable")
        order = order[real[order]]
        runs, sorted_h, sub_class, at = _segments(group[order]), h[order], classes[order] % SUBS, np.arange(len(order))
        p = h @ w["out"]
        p += w["bias"]
        np.minimum(p, MOST, out=p)
        p2 = _sub_logits(sorted_h, runs, w["sub"], w["sub_bias"])
        picked = float(p[order, group[order]].sum(dtype=np.float64) + p2[at, sub_class].sum(dtype=np.float64))
        np.exp(p, out=p)
        np.exp(p2, out=p2)
        sums, sums2 = _sums(p), _sums(p2)
        loss = float(np.log(sums[order]).sum(dtype=np.float64) + np.log(sums2).sum(dtype=np.float64)) - picked
        share = real.astype(np.float32)
        share /= max(1, len(order))
        p *= (share / sums)[:, None]
        p[np.arange(len(p)), group] -= share
        p2 *= (share[order] / sums2)[:, None]
        p2[at, sub_class] -= share[order]

        g = {"out": h.T @ p, "bias": np.ones(len(p), np.float32) @ p, "sub": np.zeros_like(w["sub"]), "sub_bias": np.zeros_like(w["sub_bias"])}
        dh, d2 = p @ w["out"].T, np.empty_like(sorted_h)
        for i, a, b in runs:
            np.matmul(p2[a:b], w["sub"][i].T, out=d2[a:b])
            g["sub"][i] = sorted_h[a:b].T @ p2[a:b]
            g["sub_bias"][i] = np.ones(b - a, np.float32) @ p2[a:b]
        dh[order] += d2
        g["value"] = mean.T @ dh
        dmean = dh @ w["value"].T
        # A score's gradient is its weight times (its value's product less the mean's); the sums divide what is small.
        less = _sums(dmean * mean).reshape(n, STEP, 1)
        less /= divisor
        dmean = dmean.reshape(n, STEP, WIDTH)
        dmean /= divisor
        dx = np.matmul(att.transpose(0, 2, 1), dmean)
        ds = np.matmul(dmean, x.transpose(0, 2, 1))
        ds -= less
        ds *= att
        dx += np.matmul(ds.transpose(0, 2, 1), q)
        dq = np.matmul(ds, x).reshape(-1, WIDTH)
        g["match"] = (own.T @ dq) * scale
        dh += dq @ (w["match"] * scale).T
        dx[:, CONTEXT:] += dh.reshape(n, STEP, WIDTH)
        g["place"] = dx.sum(0)
        where = (buckets.reshape(-1, 1) * WIDTH + np.arange(WIDTH)).ravel()
        g["embed"] = np.bincount(where, dx.ravel(), BUCKETS * WIDTH).reshape(BUCKETS, WIDTH).astype(dx.dtype)
        return loss, len(at), g

    def move(self, gradients: dict[str, np.ndarray]) -> None:
        self.steps += 1
        g = np.concatenate([gradients[k].ravel() for k in NAMES])
        self.first *= np.float32(0.9)
        self.first += np.float32(0.1) * g
        self.second *= np.float32(0.99)
        g *= g
        g *= np.float32(0.01)
        self.second += g
        size = np.sqrt(self.second / np.float32(1 - 0.99**self.steps))
        size += np.float32(1e-8)
        np.divide(self.first, size, out=size)
        size *= np.float32(self.rate / (1 - 0.9**self.steps))
        self.flat -= size


class Scorer:
    """Queries of every bucket are looked up, not multiplied; attention and classes are batched over windows."""

    AT_ONCE = 128

    def __init__(self, w: dict, vocabulary: Vocabulary):
        self.v, match = vocabulary, w["match"] * np.float32(WIDTH**-0.5)
        self.queries, self.query_places = w["embed"] @ match, w["place"][CONTEXT:] @ match
        # Vectors end with a 1: sums of the attention and biases then come with the products.
        self.embed, self.place = np.ones((BUCKETS, WIDTH + 1), np.float32), np.zeros((LENGTH, WIDTH + 1), np.float32)
        self.embed[:, :WIDTH], self.place[:, :WIDTH] = w["embed"], w["place"]
        self.value = np.zeros((WIDTH + 1, WIDTH + 1), np.float32)
        self.value[:WIDTH, :WIDTH] = w["value"]
        self.out, self.sub = _with_bias(w)

    def log10(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """log10 probability of every row's ids (which end with the row's end id), each given the row's ids before it."""
        n = np.diff(bounds)
        windows = -(-n // STEP)
        at = np.concatenate([[0], np.cumsum(windows * STEP + CONTEXT)])
        inputs, targets = np.full(at[-1] + CONTEXT, -1, np.int32), np.full(at[-1] + CONTEXT, -1, np.int32)
        where = np.arange(len(ids)) + np.repeat(at[:-1] + CONTEXT - bounds[:-1], n)
        before = np.empty(len(ids), np.int32)
        before[1:], before[bounds[:-1][n > 0]] = ids[:-1], self.v.start_id
        inputs[where], targets[where] = before, ids
        row = np.repeat(np.arange(len(n)), windows)
        start = np.repeat(at[:-1], windows) + (np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)) * STEP
        total = np.zeros(len(n))
        real = inputs >= 0
        buckets = self.v.buckets[np.maximum(inputs, 0)]
        for lo in range(0, len(start), self.AT_ONCE):
            place = start[lo : lo + self.AT_ONCE, None] + np.arange(LENGTH)
            bucket = buckets[place]
            x, q = self.embed[bucket], self.queries[bucket[:, CONTEXT:]]
            x += self.place
            q += self.query_places
            att = _weights(np.matmul(q, x[:, :, :WIDTH].transpose(0, 2, 1)), real[place])
            h = np.matmul(att, x)
            h /= h[:, :, WIDTH:].copy()
            h = (h.reshape(-1, WIDTH + 1) @ self.value).reshape(len(place), STEP, WIDTH + 1)
            h += x[:, CONTEXT:]
            target = targets[place[:, CONTEXT:]].ravel()
            classes = self.v.classes[np.maximum(target, 0)]
            group = classes // SUBS
            order = np.argsort(group.astype(np.uint8), kind="stable")
            order = order[target[order] >= 0]
            h, group, sub_class = h.reshape(-1, WIDTH + 1)[order], group[order], classes[order] % SUBS
            p = h @ self.out
            np.minimum(p, MOST, out=p)
            p2 = _sub_logits(h, _segments(group), self.sub)
            i = np.arange(len(order))
            picked = p[i, group] + p2[i, sub_class] + self.v.share[target[order]]
            np.exp(p, out=p)
            np.exp(p2, out=p2)
            each = np.zeros(len(target))
            each[order] = picked - np.log(_sums(p)) - np.log(_sums(p2))
            total += np.bincount(row[lo : lo + self.AT_ONCE], each.reshape(-1, STEP).sum(1), len(n))
        return total / np.log(10)
