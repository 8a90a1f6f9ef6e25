"""Operator 9, toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as its own embedding (for words that the training sample repeats) beside the mean of the
embeddings of its character n-grams, prefixes and ends. Two gated recurrent layers read each window of
words forwards and backwards; attention pools their states; a logistic unit scores the window. Every
text is scored whole, in windows that overlap by half, and its score is that of its worst window. A longer
token than `piece` bytes (a script without spaces, words joined by _ or commas) is several words: its parts
between joining characters, those still longer being cut into pieces that overlap by half.

Training is multiple-instance: a document's label belongs to its worst window under the current weights.
It takes a bounded sample of labelled rows (`positives`, `negatives`, and texts of at most `longest` bytes),
chosen by hash from those whose crc32(doc_id) mod 4 is not 2, weighted back to the labels' true proportion.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import columns_of, slices, small_batches


@dataclass(frozen=True)
class ToxicRules:
    """Production parameters."""

    positives: int = 1500
    negatives: int = 2500
    #: Bytes of a text that is still trained on; with the numbers of rows it bounds what the driver gathers.
    #: Longer ones are scored like all others.
    longest: int = 1 << 16
    #: Bytes of a token, without its edges, from which on it is cut into several words.
    piece: int = 40
    window: int = 32
    stride: int = 16
    #: Windows of a document that one training round looks at.
    windows: int = 24
    state: int = 8
    word_size: int = 8
    char_size: int = 8
    buckets: int = 8192
    words: int = 4096
    rounds: int = 14
    #: Small samples are gone through more often, until so many steps are made (within most_rounds).
    least_steps: int = 150
    most_rounds: int = 40
    warm: int = 3
    rate: float = 0.012
    #: Whether a component of the embeddings starts as the log odds of its word or n-gram.
    odds_start: bool = True
    threshold: float = 0.3
    seed: int = 9


#: Windows scored at a time: their states stay in the cache.
CHUNK = 512
_EDGES = " \t\n\v\f\r.,;:!?\"'()[]{}<>*#%$&|-_/\\"


#: Parts of a long token, each with the joining characters behind it; all of them are among the edges.
_PARTS = re.compile(r"[^_\-/,;:|&.\\]+[_\-/,;:|&.\\]*|[_\-/,;:|&.\\]+")


def _bytes(word: str) -> bytes:
    """The UTF-8 of a word without its edges."""
    return (word.strip(_EDGES) or word).encode("utf-8", "surrogatepass")


def pieces(word: str, most: int) -> list[str]:
    """The parts of a long token, cut where they still hold more than `most` bytes: no character is left out."""
    out = []
    for part in _PARTS.findall(word):
        if len(_bytes(part)) <= most:
            out.append(part)
            continue
        ends = np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in part]).tolist()
        start = before = 0
        while True:
            end = max(start + 1, bisect_right(ends, before + most))
            out.append(part[start:end])
            if end == len(part):
                break
            start = max(start + 1, bisect_right(ends, before + most // 2))
            before = ends[start - 1]
    return out


def tokens(text: str | None, most: int = ToxicRules.piece) -> list[str]:
    split = text.lower().split() if text else []
    # No character has more than 4 bytes.
    cut = {w: pieces(w, most) for w in {w for w in split if 4 * len(w) > most} if len(_bytes(w)) > most}
    return [p for w in split for p in cut.get(w, (w,))] if cut else split


def grams(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word's byte trigrams, prefixes of 4 to 7 and whole form, its edges marked: all of
    them in word order, and how many each word has."""
    marked = [b"^" + _bytes(w) + b"$" for w in words]
    size = np.array([len(m) for m in marked], np.int64)
    raw = np.frombuffer(b"".join(marked) + bytes(8), np.uint8).astype(np.uint64)
    end = np.cumsum(size)
    begin, word = end - size, np.repeat(np.arange(len(words)), size)
    place = np.arange(len(word)) - begin[word]
    mixed = lambda h, kind: ((h + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % buckets
    step = np.uint64(0x100000001B3)
    three = (raw[:-10] * step + raw[1:-9]) * step + raw[2:-8] if len(raw) > 10 else np.zeros(0, np.uint64)
    at = np.flatnonzero(place[: len(three)] + 3 <= size[word[: len(three)]])
    owners, found = [word[at]], [mixed(three[at], 1 << 40)]
    folded = np.zeros(len(words), np.uint64)
    for k in range(7):
        folded = folded * step + raw[begin + k]
        if k >= 3:
            fits = np.flatnonzero(size > k)
            owners.append(fits)
            found.append(mixed(folded[fits], k))
    owners.append(np.arange(len(words)))
    found.append(np.fromiter(map(zlib.crc32, marked), np.int64, len(words)) % buckets)
    owner, bucket = np.concatenate(owners), np.concatenate(found)
    return bucket[np.argsort(owner, kind="stable")].astype(np.int32), np.bincount(owner, minlength=len(words))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """The weights and both passes. Inputs are windows of word rows, shape (words, windows)."""

    def __init__(self, rules: ToxicRules, vocabulary: dict[str, int]):
        self.rules, self.vocabulary = rules, vocabulary
        rng = np.random.default_rng(rules.seed)
        h, d = rules.state, rules.word_size + rules.char_size
        make = lambda *s: (rng.normal(0, 1 / np.sqrt(s[0]), s)).astype(np.float32)
        self.w = {"word": (0.1 * rng.normal(0, 1, (len(vocabulary) + 1, rules.word_size))).astype(np.float32), "char": (0.5 * rng.normal(0, 1, (rules.buckets, rules.char_size))).astype(np.float32)}
        for way in "fb":
            self.w |= {f"x{way}": make(d, 3 * h), f"c{way}": np.zeros(3 * h, np.float32), f"u{way}": make(h, 2 * h), f"n{way}": make(h, h)}
            self.w[f"c{way}"][:h] = 1.0
        self.w |= {"a": make(2 * h, h), "v": make(h, 1)[:, 0], "o": make(2 * h, 1)[:, 0], "b": np.full(1, -2.0, np.float32)}

    def inputs(self, words: list[str]) -> np.ndarray:
        """A row per word."""
        flat, count = grams(words, self.rules.buckets)
        chars = np.add.reduceat(self.w["char"][flat], np.cumsum(count) - count, axis=0) / count[:, None]
        own = np.array([self.vocabulary.get(x.strip(_EDGES), 0) for x in words])
        return np.concatenate([self.w["word"][own], chars], 1).astype(np.float32)

    def _layer(self, way: str, steps: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """States of one layer over (time, windows, 3 * state) input projections, in time order of `steps`; they
        are zero where there is no word, so what fills a window up can't reach its words."""
        h, w = self.rules.state, self.w
        state = np.zeros((steps.shape[1], h), np.float32)
        out = np.empty((*steps.shape[:2], h), np.float32)
        for t in range(len(steps)):
            gate = _sigmoid(steps[t, :, : 2 * h] + state @ w[f"u{way}"])
            inner = state @ w[f"n{way}"]
            new = np.tanh(steps[t, :, 2 * h :] + gate[:, h:] * inner)
            if keep is not None:
                keep.append((state, gate, inner, new))
            state = (gate[:, :h] * state + (1 - gate[:, :h]) * new) * mask[t, :, None]
            out[t] = state
        return out

    def project(self, x: np.ndarray) -> np.ndarray:
        """Input projections of both ways, side by side; they depend on the word alone."""
        return np.concatenate([x @ self.w["xf"] + self.w["cf"], x @ self.w["xb"] + self.w["cb"]], -1)

    def forward(self, projected: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows. projected: (time, windows, 6 * state); mask: (time, windows), 1 for a word."""
        h = 3 * self.rules.state
        kf, kb = ([], []) if keep is not None else (None, None)
        states = np.concatenate([self._layer("f", projected[:, :, :h], mask, kf), self._layer("b", projected[::-1, :, h:], mask[::-1], kb)[::-1]], 2)
        hidden = np.tanh(states @ self.w["a"])
        score = np.where(mask > 0, hidden @ self.w["v"], -1e9)
        part = np.exp(score - score.max(0))
        part /= part.sum(0)
        pooled = np.einsum("tn,tnh->nh", part, states)
        if keep is not None:
            keep |= {"f": kf, "b": kb, "states": states, "hidden": hidden, "part": part, "pooled": pooled, "mask": mask}
        return pooled @ self.w["o"] + self.w["b"][0]

    def backward(self, x: np.ndarray, keep: dict, out: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of all weights but the embeddings, and of the inputs, for loss gradients `out` of the logits."""
        w, h, g = self.w, self.rules.state, {}
        states, hidden, part, pooled = keep["states"], keep["hidden"], keep["part"], keep["pooled"]
        g["b"], g["o"] = out.sum(keepdims=True), pooled.T @ out
        d_pool = out[:, None] * w["o"]
        d_states = part[:, :, None] * d_pool
        d_part = np.einsum("nh,tnh->tn", d_pool, states)
        d_score = part * (d_part - (part * d_part).sum(0))
        g["v"] = np.einsum("tn,tnh->h", d_score, hidden)
        d_hidden = d_score[:, :, None] * w["v"] * (1 - hidden**2)
        g["a"] = np.einsum("tnh,tnk->hk", states, d_hidden)
        d_states = d_states + d_hidden @ w["a"].T
        d_x = np.zeros_like(x)
        for way, sides in (("f", d_states[:, :, :h]), ("b", d_states[::-1, :, h:])):
            xs, mask = (x, keep["mask"]) if way == "f" else (x[::-1], keep["mask"][::-1])
            gx, gc, gu, gn = (np.zeros_like(w[f"{k}{way}"]) for k in "xcun")
            carry = np.zeros_like(sides[0])
            for t in range(len(xs) - 1, -1, -1):
                state, gate, inner, new = keep[way][t]
                z, r = gate[:, :h], gate[:, h:]
                carry = (carry + sides[t]) * mask[t, :, None]
                d_new = carry * (1 - z) * (1 - new**2)
                d_gate = np.concatenate([carry * (state - new), d_new * inner], 1) * gate * (1 - gate)
                d_in = np.concatenate([d_gate, d_new], 1)
                gx += xs[t].T @ d_in
                gc += d_in.sum(0)
                gu += state.T @ d_gate
                gn += state.T @ (d_new * r)
                (d_x if way == "f" else d_x[::-1])[t] += d_in @ w[f"x{way}"].T
                carry = carry * z + d_gate @ w[f"u{way}"].T + (d_new * r) @ w[f"n{way}"].T
            g |= {f"x{way}": gx, f"c{way}": gc, f"u{way}": gu, f"n{way}": gn}
        return g, d_x


def starts(n: int, rules: ToxicRules) -> list[int]:
    """Starts of the windows over n words: every stride, the last one reaching the end."""
    return list(range(0, max(1, n - rules.window + rules.stride), rules.stride))


def fit(texts: list[str | None], labels: list[int], weights: list[float], rules: ToxicRules = ToxicRules()) -> Network:
    """Trains on labelled texts."""
    number: dict[str, int] = {}
    ids = [np.fromiter((number.setdefault(x, len(number)) for x in tokens(t, rules.piece)), np.int32) for t in texts]
    listed = list(number)
    bare = [x.strip(_EDGES) for x in listed]
    seen: Counter[str] = Counter()
    for i in ids:
        seen.update({bare[k] for k in np.unique(i).tolist()})
    often = sorted((-n, x) for x, n in seen.items() if n >= 5 and x)[: rules.words]
    network = Network(rules, {x: i + 1 for i, (_, x) in enumerate(often)})
    if not listed:
        return network
    rng = np.random.default_rng(rules.seed + 1)
    flat, count = grams(listed, rules.buckets)
    begin = np.cumsum(count) - count
    vocab = np.array([network.vocabulary.get(x, 0) for x in bare])
    del number, listed, bare, seen
    y, weight = np.array(labels, np.float32), np.array(weights, np.float32)
    weight /= weight.mean()

    # The first component of both embeddings starts as what a word, or an n-gram, says of its documents.
    def odds(parts: list[np.ndarray], n: int) -> np.ndarray:
        with_, without = np.full(n, 0.5), np.full(n, 0.5)
        for d, part in enumerate(parts):
            (with_ if y[d] else without)[np.unique(part)] += 1
        sure = np.minimum(1, (with_ + without - 1) / 8)
        return np.clip(sure * (np.log(with_ / (y.sum() + 1)) - np.log(without / (len(y) - y.sum() + 1))), -3, 3)

    if rules.odds_start:
        network.w["word"][:, 0] = odds([vocab[i] for i in ids], len(network.w["word"]))
        network.w["word"][0] = 0
        bag_of = [np.concatenate([flat[begin[u] : begin[u] + count[u]] for u in np.unique(i)]) if len(i) else i for i in ids]
        network.w["char"][:, 0] = odds(bag_of, rules.buckets)
    moments: dict[str, list] = {}
    step = 0

    def windows(which: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        out, mask = np.zeros((rules.window, len(which)), np.int64), np.zeros((rules.window, len(which)), np.float32)
        for k, (d, s) in enumerate(which):
            part = ids[d][s : s + rules.window]
            out[: len(part), k], mask[: len(part), k] = part, 1
        return out, mask

    def update(name: str, grad: np.ndarray) -> None:
        m, v = moments.setdefault(name, [np.zeros_like(grad), np.zeros_like(grad)])
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        network.w[name] -= (rules.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)

    def projections() -> np.ndarray:
        out = np.empty((len(count), 6 * rules.state), np.float32)
        for k in range(0, len(count), 20_000):
            lens, part = count[k : k + 20_000], flat[begin[k] : begin[k] + count[k : k + 20_000].sum()]
            chars = np.add.reduceat(network.w["char"][part], np.cumsum(lens) - lens, axis=0) / lens[:, None]
            out[k : k + 20_000] = network.project(np.concatenate([network.w["word"][vocab[k : k + 20_000]], chars], 1).astype(np.float32))
        return out

    usable = [d for d in range(len(ids)) if len(ids[d])]
    round_ = -1
    while round_ + 1 < rules.rounds or (step < rules.least_steps and round_ + 1 < rules.most_rounds):
        round_ += 1
        offered = []
        for d in usable:
            s = starts(len(ids[d]), rules)
            offered += [(d, s[k]) for k in (range(len(s)) if len(s) <= rules.windows else rng.choice(len(s), rules.windows, replace=False))]
        projected = projections()
        logit = np.empty(len(offered), np.float32)
        for k in range(0, len(offered), 2048):
            at, mask = windows(offered[k : k + 2048])
            logit[k : k + 2048] = network.forward(projected[at], mask)
        by_doc: dict[int, list[int]] = {}
        for k, (d, _) in enumerate(offered):
            by_doc.setdefault(d, []).append(k)
        chosen = []
        for d, ks in by_doc.items():
            one = rng.choice(ks) if round_ < rules.warm else max(ks, key=lambda k: logit[k])
            chosen.append(offered[one])
            if not y[d] and len(ks) > 1:
                chosen.append(offered[rng.choice(ks)])
            elif y[d] and round_ < rules.warm:
                chosen += [offered[k] for k in rng.choice(ks, min(3, len(ks)), replace=False)]
        order = rng.permutation(len(chosen))
        for k in range(0, len(order), 256):
            step += 1
            batch = [chosen[i] for i in order[k : k + 256]]
            at, mask = windows(batch)
            used, place = np.unique(at, return_inverse=True)
            place = place.reshape(at.shape)
            lens = count[used]
            bag = np.concatenate([flat[begin[u] : begin[u] + count[u]] for u in used])
            cut = np.cumsum(lens) - lens
            x_used = np.concatenate([network.w["word"][vocab[used]], np.add.reduceat(network.w["char"][bag], cut, axis=0) / lens[:, None]], 1).astype(np.float32)
            keep: dict = {}
            z = network.forward(network.project(x_used)[place], mask, keep)
            own = np.array([d for d, _ in batch])
            grad_out = (weight[own] * (_sigmoid(z) - y[own]) / len(batch)).astype(np.float32)
            grads, d_x = network.backward(x_used[place], keep, grad_out)
            d_used = np.zeros_like(x_used)
            np.add.at(d_used, place.ravel(), (d_x * mask[:, :, None]).reshape(-1, x_used.shape[1]))
            g_word, g_char = np.zeros_like(network.w["word"]), np.zeros_like(network.w["char"])
            np.add.at(g_word, vocab[used], d_used[:, : rules.word_size])
            g_word[0] = 0
            np.add.at(g_char, bag, np.repeat(d_used[:, rules.word_size :] / lens[:, None], lens, axis=0))
            for name, grad in {**grads, "word": g_word, "char": g_char}.items():
                update(name, grad)
    return network


class Scorer:
    """Scores whole texts; projections of the words seen last are kept."""

    def __init__(self, network: Network, most_words: int = 100_000):
        self.network, self.most, self.number = network, most_words, {}
        self.table = np.zeros((0, 6 * network.rules.state), np.float32)

    def _ids(self, words: list[str]) -> np.ndarray:
        new = sorted({x for x in words if x not in self.number})
        if len(self.number) + len(new) > self.most:
            self.number, new = {}, sorted(set(words))
            self.table = self.table[:0]
        if new:
            made = [self.network.project(self.network.inputs(new[k : k + 20_000])) for k in range(0, len(new), 20_000)]
            first = len(self.number)
            self.number |= {x: first + i for i, x in enumerate(new)}
            self.table = np.concatenate([self.table, *made])
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def windows(self, text: str | None) -> np.ndarray:
        """Every window's probability."""
        return self([text], True)[0]

    def __call__(self, texts: list[str | None], every: bool = False) -> list:
        rules = self.network.rules
        split = [tokens(t, rules.piece) for t in texts]
        flat = self._ids([x for s in split for x in s])
        lens = np.array([len(s) for s in split], np.int64)
        first = np.cumsum(lens) - lens
        all_starts = [starts(int(n), rules) for n in lens]
        doc = np.repeat(np.arange(len(texts)), [len(s) for s in all_starts])
        at = np.concatenate([np.array(s) for s in all_starts]) if texts else np.zeros(0, np.int64)
        span, logit = np.arange(rules.window)[:, None], np.empty(len(at), np.float32)
        padded = np.append(flat, np.zeros(rules.window, np.int64))
        for k in range(0, len(at), CHUNK):
            d, s = doc[k : k + CHUNK], at[k : k + CHUNK]
            mask = (s + span < lens[d]).astype(np.float32)
            rows = padded[np.minimum(first[d] + s + span, len(padded) - 1)]
            table = self.table if len(self.table) else np.zeros((1, 6 * rules.state), np.float32)
            logit[k : k + CHUNK] = self.network.forward(table[rows], mask)
        p = _sigmoid(logit.astype(np.float64))
        if every:
            return [p[doc == i] for i in range(len(texts))]
        out = np.zeros(len(texts))
        np.maximum.at(out, doc, p)
        return out.tolist()


def train(docs: DataFrame, labels: DataFrame, rules: ToxicRules = ToxicRules()) -> Network:
    """Fits the network on a bounded sample of the labelled rows that are not held out.

    Rows without a doc_id or with another label than 0 and 1 take no part. Of different labels of one doc_id,
    toxic counts; of different texts of one, the smallest does. Without any usable row the network is as it starts.
    """
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    known = columns_of(labels, "doc_id", "toxic").where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).where(~held)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    total = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for value, most in ((1, rules.positives), (0, rules.negatives)):
        part = known.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id", F.lit(rules.seed)), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    # Within positives + negatives rows of at most `longest` bytes.
    texts = columns_of(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    texts = texts.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= rules.longest)
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    got = Counter(r["toxic"] for r in rows)
    return fit([r["text"] for r in rows], [r["toxic"] for r in rows], [total[r["toxic"]] / got[r["toxic"]] for r in rows], rules)


def score(docs: DataFrame, network: Network, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep`, the score and the prediction per row.

    Null and empty texts are one window without words and get its score. Texts are scored whole; repeated
    rows repeat their scores; an empty table gives no rows; extra columns are not read.
    """
    small_batches(docs.sparkSession)
    rows = columns_of(docs, *dict.fromkeys((*keep, "text")))
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(scorer(batch.column("text").to_pylist()), pa.float64())], [*keep, "score"])

    kept = rows.select(*keep).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    out = rows.mapInArrow(run, f"{schema}, score double")
    return out.withColumn("predicted", (F.col("score") >= network.rules.threshold).cast("int"))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's score, and whether its label was held out of training."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")
