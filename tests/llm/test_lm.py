import collections
import math
import re

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from emberlog.llm import attention
from emberlog.llm import op8_lm_score as op

FILE = public_tokenizers.path(op.FILE)
DOCS = [(1, None), (2, ""), (None, "a B"), (5, "a b c d e f g"), (5, "a b c d e f g"), (6, "B  b\n<|endoftext|> é"), (7, "the cat sat " * 900), (8, "the dog sat " * 40)]


def test_base_score(spark):
    docs = spark.createDataFrame([(d, t, 1) for d, t in DOCS], "doc_id long, text string, score int")
    got = op.score_documents(docs, FILE).collect()
    cut = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    counts = collections.Counter(w for d, t in DOCS if op.fold_of(d) != 1 for w in cut(t))
    n, v = sum(counts.values()), len(counts)
    want = [(str(d), op.fold_of(d) == 1, len(w := cut(t)), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)) for d, t in DOCS]
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)
    assert all(r.score < 0 for r in got)
    assert op.score_documents(docs.limit(0), FILE).count() == 0
    alone = op.score_documents(docs.where("doc_id = 5"), FILE).collect()  # no training documents
    assert {r.train_tokens for r in alone} == {0} and {r.n_known for r in alone} == {0}


def plain_score(w, v, ids):
    """Each id by itself: the forward pass over its window, without batches or tables."""
    total, before = 0.0, [v.start_id, *ids[:-1]]
    for i, target in enumerate(ids):
        block = i // attention.STEP * attention.STEP
        lo = max(0, block - attention.CONTEXT)
        places = np.arange(lo, i + 1) - block + attention.CONTEXT
        x = w["embed"][v.buckets[before[lo : i + 1]]] + w["place"][places]
        scores = np.clip((x[-1] @ w["match"]) @ x.T / math.sqrt(attention.WIDTH), -30, 30)
        att = np.exp(scores) / np.exp(scores).sum()
        h, (group, sub) = att @ (x @ w["value"]) + x[-1], divmod(v.classes[target], attention.SUBS)
        for logits, at in ((h @ w["out"] + w["bias"], group), (h @ w["sub"][group] + w["sub_bias"][group], sub)):
            total += logits[at] - np.log(np.exp(logits - logits.max()).sum()) - logits.max()
        total += v.share[target]
    return total / math.log(10)


def test_scorer_scores_each_id_once():
    rng = np.random.default_rng(2)
    v = attention.Vocabulary(rng.integers(0, 50, 500), 499)
    w = {k: x + rng.normal(size=x.shape).astype(np.float32) * 0.3 for k, x in attention.initial(v).items()}
    lengths = [1, 0, 15, 16, 17, 31, 32, 33, 100, 3]
    ids = rng.integers(0, 500, sum(lengths))
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    got = attention.Scorer(w, v).log10(ids, bounds)
    want = [plain_score(w, v, ids[a:b].tolist()) if b > a else 0.0 for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert np.allclose(got, want, rtol=1e-4)
    shares = np.bincount(v.classes, np.exp(v.share), attention.CLASSES)
    assert np.allclose(shares[np.bincount(v.classes, minlength=attention.CLASSES) > 0], 1, atol=1e-4)


def test_gradients():
    """Each gradient against differences of the loss, on windows with places that hold nothing."""
    rng = np.random.default_rng(8)
    v = attention.Vocabulary(rng.integers(0, 60, 700), 699)
    start = {k: (x + rng.normal(size=x.shape) * 0.3).astype(np.float64) for k, x in attention.initial(v).items()}
    windows = rng.integers(0, 700, (5, attention.LENGTH + 1)).astype(np.int32)
    windows[0, : attention.CONTEXT] = -1
    windows[1, attention.CONTEXT + 7 :] = -1
    loss = lambda w: (lambda got: got[0] / got[1])(attention.Trainer(w, v).step(windows))
    gradients = attention.Trainer(start, v).step(windows)[2]
    for name in attention.NAMES:
        strongest = np.unravel_index(np.argsort(-np.abs(gradients[name]), axis=None)[:4], gradients[name].shape)
        for at in zip(*strongest, strict=True):
            up, down = ({**start, name: start[name].copy()} for _ in range(2))
            up[name][at] += 1e-3
            down[name][at] -= 1e-3
            want = (loss(up) - loss(down)) / 2e-3
            assert abs(gradients[name][at] - want) < 1e-4 + 0.02 * abs(want), (name, at)


def test_training_learns():
    """A repeating pattern is learned far beyond the classes' frequencies, on windows not trained on."""
    rng = np.random.default_rng(4)
    make = lambda n: np.stack([(np.arange(attention.LENGTH + 1) + rng.integers(0, 7)) % 7 for _ in range(n)]).astype(np.int32)
    v = attention.Vocabulary(np.full(10, 100), 9)
    trainer = attention.Trainer(attention.initial(v), v)
    mean = lambda: (lambda got: got[0] / got[1])(trainer.step(make(64)))
    before = mean()
    for _ in range(4):
        trainer.learn(make(1000), batch=32)
    assert mean() < 0.2 * before


def test_score_against_a_plain_loop(spark):
    """Training and scoring as jobs give what one loop over the same blobs gives; held-out text is scored better than by frequency."""
    rng = np.random.default_rng(12)
    words = ["water", "stone", "under", "light", "river", "house", "garden", "window", "tomorrow", "evening"]
    text = lambda start, n: " ".join(words[j % 10] for j in range(start, start + n))
    docs = [(i, text(int(rng.integers(0, 10)), int(rng.integers(5, 60)))) for i in range(400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.score for r in op.score_documents(frame, FILE, rounds=2, workers=1).collect()}
    own = op.worker(FILE, "word")
    ids = {i: [*own.library.encode(t, add_special_tokens=False).ids, op.END_ID] for i, t in docs}
    counts = np.bincount([x for i, t in docs if op.fold_of(i) != 1 for x in ids[i]], minlength=own.library.get_vocab_size())
    v = attention.Vocabulary(counts, op.START_ID)
    weights = attention.initial(v)
    blobs = [(r.bucket, bytes(r.extra), bytes(r.counts)) for r in op._gather(frame.withColumn("h", F.xxhash64("text")), 4, FILE).collect() if r.kind == op.WINDOW]
    for k in range(2):
        trainer = attention.Trainer(weights, v, rate=0.01 / (1 + k))
        for _, extra, lengths in sorted(b for b in blobs if b[0] % 2 == k):
            windows = op.windows_of(np.frombuffer(extra, np.uint16), np.frombuffer(lengths, np.int32))
            trainer.learn(windows[np.random.default_rng(len(windows)).permutation(len(windows))])
        weights = trainer.w
    want = {i: plain_score(weights, v, x) for i, x in ids.items()}
    assert all(math.isclose(got[i], want[i], rel_tol=1e-3, abs_tol=1e-3) for i in ids)
    frequency = lambda x: sum(math.log10((counts[y] + 0.5) / (counts + 0.5).sum()) for y in x)
    out = [i for i in ids if op.fold_of(i) == 1]
    assert sum(got[i] for i in out) > sum(frequency(ids[i]) for i in out)
    assert got == {r.doc_id: r.score for r in op.score_documents(frame, FILE, rounds=2, workers=1).collect()}


def test_every_training_id_is_a_target(spark):
    """The windows that training takes hold each id of the training documents once as a target, with the ids before it."""
    docs = spark.createDataFrame([(d, t) for d, t in [*DOCS, *((20 + i, "the red cat sat " * 70 * i) for i in range(10))]], "doc_id long, text string").withColumn("h", F.xxhash64("text"))
    rows = op._gather(docs, 4, FILE).collect()
    want, got = collections.Counter(), collections.Counter()
    for r in rows:
        if r.kind == op.IDS and r.bucket != op.DOCUMENTS:
            want[r.bucket] += r.n
    for r in rows:
        if r.kind == op.WINDOW:
            ids, lengths = np.frombuffer(bytes(r.extra), np.uint16), np.frombuffer(bytes(r.counts), np.int32)
            windows, ends = op.windows_of(ids, lengths), np.cumsum(lengths)
            targets = windows[:, attention.CONTEXT + 1 :]
            assert targets[targets >= 0].tolist() == ids.tolist() and windows[0, attention.CONTEXT] == op.START_ID
            got.update(ids.tolist())
            plain = [[-1] * attention.CONTEXT + [op.START_ID, *ids[e - n : e].tolist()] + [-1] * attention.STEP for n, e in zip(lengths, ends, strict=True)]
            assert windows.tolist() == [p[at : at + attention.LENGTH + 1] for p, n in zip(plain, lengths, strict=True) for at in range(0, n, attention.STEP)]
    assert got == want and sum(got.values()) > 1000


def test_steps_move_the_weights_as_plain_adam():
    """Three steps of the trainer, whose weights are one array, against Adam written out for each matrix."""
    rng = np.random.default_rng(9)
    v = attention.Vocabulary(rng.integers(0, 60, 700), 699)
    start = attention.initial(v)
    trainer, plain = attention.Trainer(start, v), {k: x.astype(np.float64) for k, x in start.items()}
    first, second = ({k: np.zeros_like(x) for k, x in plain.items()} for _ in range(2))
    assert np.shares_memory(trainer.w["embed"], trainer.flat)
    for step in range(1, 4):
        gradients = trainer.step(rng.integers(0, 700, (6, attention.LENGTH + 1)).astype(np.int32))[2]
        trainer.move({k: g.copy() for k, g in gradients.items()})
        for k, g in gradients.items():
            first[k], second[k] = 0.9 * first[k] + 0.1 * g, 0.99 * second[k] + 0.01 * g.astype(np.float64) ** 2
            plain[k] -= trainer.rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    assert all(np.allclose(trainer.w[k], plain[k], atol=1e-4) for k in attention.NAMES)
