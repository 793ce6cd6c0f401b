"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwell.llm.common import batch, tidy
from dwell.llm.simhash import fingerprint
from dwell.llm.tokens import slices, spans

#: Tokens of a block of a chain, and words of a worker's cache.
BLOCK, CACHE_WORDS = 64, 100_000
#: Bytes of the texts that a model is fitted on, and of those scored at a time.
SAMPLE_BYTES, SLICE_BYTES = 64 << 20, 2 << 20
#: Toxic documents that a word must be in to mark them.
LEAST = 4
_EDGES = b".,;:!?\"'()[]{}<>|*#$%&"
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@dataclass(frozen=True)
class ToxicityModel:
    bits: int
    own: np.ndarray  # weight of a word's hashes for the tag of its own token
    before: np.ndarray  # for the tag of the next token
    after: np.ndarray  # for the tag of the token before
    bias: float
    trans: np.ndarray  # (2, 2) log potentials from tag to tag
    reading: np.ndarray  # weights of the columns of _signs


def normal(word: bytes) -> bytes:
    lower = word.lower() if word.isascii() else word.decode().lower().encode()
    return lower.strip(_EDGES) or word


def _features(word: bytes, bits: int) -> tuple[int, ...]:
    """Hashed identity, beginnings and end of a normalised word."""
    cut = lambda tag, x: xxhash.xxh64_intdigest(tag + x) >> (64 - bits)
    return cut(b"w", word), cut(b"3", word[:3]), cut(b"5", word[:5]), cut(b"7", word[:7]), cut(b"s", word[-3:])


def _chances(first: np.ndarray, lengths: np.ndarray, own: np.ndarray, before: np.ndarray, after: np.ndarray, bias: float, trans: np.ndarray) -> np.ndarray:
    """P(tag 1) of each place (chain, place) of chains over tokens with these weights."""
    token = spans(first, lengths)
    p, _ = _marginals(_potentials(lengths, own[token], before[token], after[token], bias), lengths, trans)
    out = np.zeros((len(first), int(lengths.max())))
    out[np.repeat(np.arange(len(first)), lengths), spans(np.zeros(len(first), np.int64), lengths)] = p
    return out


def _potentials(sizes: np.ndarray, own: np.ndarray, before: np.ndarray, after: np.ndarray, bias: float) -> np.ndarray:
    """The log odds of each token by itself and its neighbours, of texts of ``sizes`` tokens, one after the other."""
    scores = bias + own
    joined = np.ones(len(own), bool)  # to the token before
    joined[(np.cumsum(sizes) - sizes)[sizes > 0]] = False
    scores[1:] += np.where(joined[1:], before[:-1], 0.0)
    scores[:-1] += np.where(joined[1:], after[1:], 0.0)
    return scores


def _marginals(scores: np.ndarray, sizes: np.ndarray, trans: np.ndarray, pairs: bool = False):
    """P(tag 1) of each token, one chain for each text, and the expected tag pairs if asked for.

    Texts are cut into blocks of BLOCK tokens that are worked on side by side. A block's product of
    transfer matrices, taken first, carries the exact messages of the rest of the chain over it, so the
    result is that of the whole chain. Messages are ratios of tag 1 to tag 0.
    """
    sizes = sizes[sizes > 0]
    if not len(sizes):
        return np.empty(0), np.zeros((2, 2))
    starts = np.cumsum(sizes) - sizes
    blocks = -(-sizes // BLOCK)
    text = np.repeat(np.arange(len(sizes)), blocks)
    number = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    first = starts[text] + number * BLOCK
    length = np.minimum(BLOCK, starts[text] + sizes[text] - first)
    width = int(length.max())
    at = np.minimum(first[None] + np.arange(width)[:, None], len(scores) - 1)
    inside = np.arange(width)[:, None] < length[None]
    odds = np.exp(np.clip(scores, -30, 30))[at]
    (a, b), (c, d) = np.exp(trans)

    # the product of [[a, b o], [c, d o]] over the block's tokens but the first
    m00, m01, m10, m11 = (np.full(len(first), x) for x in (1.0, 0.0, 0.0, 1.0))
    for t in range(1, width):
        on, o = inside[t], odds[t]
        n00, n01, n10, n11 = m00 * a + m01 * c, (m00 * b + m01 * d) * o, m10 * a + m11 * c, (m10 * b + m11 * d) * o
        scale = 1 / (n00 + n01 + n10 + n11)
        m00, m01, m10, m11 = (np.where(on, n * scale, m) for n, m in ((n00, m00), (n01, m01), (n10, m10), (n11, m11)))

    # messages into each block, along all texts at once; texts with more blocks first
    order = np.argsort(-blocks, kind="stable")
    origin = (np.cumsum(blocks) - blocks)[order]
    left = np.sort(blocks)
    into, back = np.ones(len(first)), np.ones(len(first))
    for k in range(int(blocks.max()) - 1):
        here = origin[: len(left) - int(np.searchsorted(left, k + 1, side="right"))] + k
        x = odds[0, here] * into[here]
        r = (m01[here] + m11[here] * x) / (m00[here] + m10[here] * x)
        into[here + 1] = (b + d * r) / (a + c * r)
    for k in range(int(blocks.max()) - 1, 0, -1):
        here = origin[: len(left) - int(np.searchsorted(left, k, side="right"))] + k
        r = (m10[here] + m11[here] * back[here]) / (m00[here] + m01[here] * back[here])
        x = odds[0, here] * r
        back[here - 1] = (c + d * x) / (a + b * x)

    forth = np.empty_like(odds)
    np.multiply(odds[0], into, out=forth[0])
    for t in range(1, width):
        r = forth[t - 1]
        np.multiply(odds[t], (b + r * d) / (a + r * c), out=forth[t])
    behind = np.empty_like(odds)
    behind[width - 1] = back
    for t in range(width - 2, -1, -1):
        x = odds[t + 1] * behind[t + 1]
        np.copyto(behind[t], np.where(inside[t + 1], (c + d * x) / (a + b * x), back))
    forth, behind, odds = (x.T[inside.T] for x in (forth, behind, odds))
    both = forth * behind
    total = np.zeros((2, 2))
    if pairs:
        joined = np.ones(len(scores), bool)
        joined[starts] = False
        on = np.flatnonzero(joined)
        f, x = forth[on - 1], odds[on] * behind[on]
        parts = np.stack([np.full(len(on), a), b * x, c * f, d * f * x])
        total = (parts / parts.sum(0)).sum(1).reshape(2, 2)
    return both / (1 + both), total


def _signs(expected: np.ndarray, largest: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """What a document's score reads: expected toxic tokens, the largest marginal, and the length they are spread over."""
    return np.stack([np.ones(len(expected)), np.log1p(expected), largest, np.log1p(tokens)], 1)


def _fit_reading(x: np.ndarray, toxic: np.ndarray, rate: float) -> np.ndarray:
    """Logistic regression of document labels on their signs, moved to the labels' real rate."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - toxic) + 0.05 * w * [0, 1, 1, 1]
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 0.05 * np.diag([1e-6, 1, 1, 1])
        w -= np.clip(np.linalg.solve(hess, grad), -5, 5)
    share = np.clip(toxic.mean(), 1e-4, 1 - 1e-4)
    rate = np.clip(rate, 1e-4, 1 - 1e-4)
    w[0] += np.log(rate / (1 - rate)) - np.log(share / (1 - share))
    return w


def held_out() -> Column:
    """crc32(doc_id as text) mod 3 is 1; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _tag_words(token: np.ndarray, text: np.ndarray, toxic: np.ndarray, words: int) -> np.ndarray:
    """Whether each word marks toxic documents: far more usual there, and in no few of them."""
    held = np.unique(token * len(toxic) + text)
    word, bad = held // len(toxic), toxic[held % len(toxic)]
    t, c = np.bincount(word, bad, words), np.bincount(word, 1 - bad, words)
    n1, n0 = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    return (t >= max(LEAST, n1 // 500)) & ((t + 0.5) / (n1 + 1) > 12 * (c + 0.5) / (n0 + 1))


def _sample(texts: DataFrame, marked: DataFrame, per_class: int, sample_bytes: int):
    """Labelled rows (doc_id, text, toxic) by doc_id, without near copies, and the count of each class."""
    counts = {r["toxic"]: r["count"] for r in texts.select("doc_id").join(marked, "doc_id").groupBy("toxic").count().collect()}
    if not counts.get(0) or not counts.get(1):
        return [], counts
    share = F.when(F.col("toxic") == 1, per_class / counts[1]).otherwise(per_class / counts[0])
    # drawn before texts are read: about two times per_class labels at most, whatever the input
    drawn = marked.withColumn("draw", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))).where(F.col("draw") < share * (1 << 30))
    sizes = texts.join(F.broadcast(drawn), "doc_id").select("doc_id", "toxic", "draw", F.octet_length("text").alias("size")).collect()
    kept, left = set(), {0: sample_bytes // 2, 1: sample_bytes // 2}
    for r in sorted(sizes, key=lambda r: (r["draw"], r["doc_id"], r["size"])):
        if r["size"] <= left[r["toxic"]]:
            left[r["toxic"]] -= r["size"]
            kept.add((r["doc_id"], r["size"]))
    named = texts.sparkSession.createDataFrame(sorted(kept), "doc_id long, size int")
    whole = texts.withColumn("size", F.octet_length("text")).join(F.broadcast(named), ["doc_id", "size"]).join(F.broadcast(drawn), "doc_id")
    rows = sorted((r["doc_id"], r["text"].encode(), r["toxic"]) for r in whole.select("doc_id", "text", "toxic").toLocalIterator())
    prints = np.array([int.from_bytes(fingerprint(t)) for _, t, _ in rows], np.uint64)
    return [row for i, row in enumerate(rows) if not (np.bitwise_count(prints[:i] ^ prints[i]) <= 12).any()], counts


def train(documents: DataFrame, labels: DataFrame, per_class: int = 3000, bits: int = 18, epochs: int = 3, seed: int = 0, sample_bytes: int = SAMPLE_BYTES) -> ToxicityModel | None:
    """Fit on about ``per_class`` labelled documents of each class at most, whole texts of ``sample_bytes`` in all.

    ``labels`` has doc_id and toxic; several labels of a document count as toxic if one is. The sample is
    drawn by a hash of doc_id; texts that would pass half of ``sample_bytes`` for their class are left
    out. Of near copies in it (SimHash within 12 bits) the first stays, so that a copied text doesn't
    make its words look toxic. Labelled tokens: in toxic documents, the words that are far more usual in
    toxic documents than in others, and from the second epoch on those that the chain itself tags; all
    else is clean. One chain for each text is trained on them by stochastic gradients with per-weight
    steps, then document labels are regressed on its marginals. Null labels, ids and texts are left out.
    Without both classes there's no model.
    """
    marked = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    texts = documents.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, counts = _sample(texts, marked, per_class, sample_bytes)
    toxic = np.array([r[2] for r in rows])
    if not toxic.any() or toxic.all():
        return None
    names: dict[bytes, int] = {}
    parts = [np.array([names.setdefault(normal(w), len(names)) for w in t.split()], np.int64) for _, t, _ in rows]
    sizes = np.array([len(x) for x in parts])
    token = np.concatenate(parts)
    del rows, parts
    starts, text = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
    marks = _tag_words(token, text, toxic, len(names))
    tag, open_ = (marks[token] & (toxic[text] == 1)).astype(float), toxic[text].astype(float)  # open: tokens that may turn out toxic
    feature = np.array([_features(w, bits) for w in names], np.int64).reshape(len(names), 5)
    weights = {k: np.zeros(1 << bits) for k in ("own", "before", "after")}
    squares = {k: np.full(1 << bits, 1e-2) for k in weights}
    bias, bias2, trans, trans2 = -4.0, 1e-2, np.zeros((2, 2)), np.full((2, 2), 1e-2)
    rng = np.random.default_rng(seed)
    rate = 0.3
    step = max(1024, min(1 << 15, len(token) // 32))  # tokens of a step; few labels still make enough steps

    for epoch in range(epochs):
        order = rng.permutation(len(sizes))
        chunk = (np.cumsum(sizes[order]) - sizes[order]) // step
        for pick in np.split(order, np.flatnonzero(np.diff(chunk)) + 1):
            n = sizes[pick]
            spot = spans(starts[pick], n)
            if not len(spot):
                continue
            used, ids = np.unique(token[spot], return_inverse=True)
            local = {k: v[feature[used]].sum(1)[ids] for k, v in weights.items()}
            p, expected = _marginals(_potentials(n, local["own"], local["before"], local["after"], bias), n, trans, pairs=True)
            gold = tag[spot]
            if epoch:  # rare words of toxic documents that look like the labelled ones
                gold = np.maximum(gold, np.where(p >= 0.5, open_[spot], 0.0))
            off = p - gold
            joined = text[spot[1:]] == text[spot[:-1]]
            g = {
                "own": np.bincount(ids, off, len(used)),
                "before": np.bincount(ids[:-1], np.where(joined, off[1:], 0.0), len(used)),
                "after": np.bincount(ids[1:], np.where(joined, off[:-1], 0.0), len(used)),
            }
            for k, per_word in g.items():
                grad = np.bincount(feature[used].ravel(), np.repeat(per_word, 5), 1 << bits)
                on = np.flatnonzero(grad)
                grad = grad[on] + 1e-3 * weights[k][on]
                squares[k][on] += grad**2
                weights[k][on] -= rate * grad / np.sqrt(squares[k][on])
            bias2 += off.sum() ** 2
            bias -= rate * off.sum() / np.sqrt(bias2)
            real = np.bincount((2 * gold[:-1] + gold[1:]).astype(int)[joined], minlength=4).reshape(2, 2)
            trans2 += (expected - real) ** 2
            trans = trans - rate * (expected - real) / np.sqrt(trans2)
    own, before, after = (weights[k][feature].sum(1) for k in weights)
    sums, tops = np.zeros(len(sizes)), np.zeros(len(sizes))
    for s in range(0, len(sizes), 256):
        n = sizes[s : s + 256]
        ids = token[starts[s] : starts[s] + n.sum()]
        sums[s : s + 256], tops[s : s + 256] = _summed(_marginals(_potentials(n, own[ids], before[ids], after[ids], bias), n, trans)[0], n)
    reading = _fit_reading(_signs(sums, tops, sizes), toxic.astype(float), counts[1] / (counts[0] + counts[1]))
    kept = {k: v.astype(np.float32) for k, v in weights.items()}
    return ToxicityModel(bits, kept["own"], kept["before"], kept["after"], float(bias), trans, reading)


def _summed(p: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum and the largest of each text's marginals, 0 without tokens."""
    sums, tops, some = np.zeros(len(sizes)), np.zeros(len(sizes)), sizes > 0
    if len(p):
        starts = (np.cumsum(sizes) - sizes)[some]
        sums[some], tops[some] = np.add.reduceat(p, starts), np.maximum.reduceat(p, starts)
    return sums, tops


class _Scorer:
    """Marginals of whole texts under one model."""

    def __init__(self, model: ToxicityModel):
        self.model = model
        self.known: dict[str, tuple[float, float, float]] = {}  # three weights of each word

    def _weights(self, words: list[str]) -> np.ndarray:
        known, m = self.known, self.model
        if len(known) > CACHE_WORDS:
            known.clear()
        new = [w for w in words if w not in known]
        if new:
            f = np.array([_features(normal(w.encode()), m.bits) for w in new], np.int64)
            known.update(zip(new, zip(*(x[f].sum(1).tolist() for x in (m.own, m.before, m.after)))))
        return np.array([known[w] for w in words]).reshape(-1, 3).T

    def __call__(self, texts: pa.Array):
        """(scores, marginals of all tokens, first token of each text and the end); texts aren't null."""
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        full = pc.binary_length(words.dictionary).to_numpy(zero_copy_only=False) > 0
        code = words.indices.to_numpy()
        first = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        if not full.all():  # an empty word at a text's ends is no token
            real = full[code]
            code, first = code[real], np.concatenate([[0], np.cumsum(real)])[first]
        sizes = np.diff(first)
        own, before, after = (w[code] for w in self._weights(words.dictionary.to_pylist()))
        p, _ = _marginals(_potentials(sizes, own, before, after, self.model.bias), sizes, self.model.trans)
        sums, tops = _summed(p, sizes)
        return 1 / (1 + np.exp(-np.clip(_signs(sums, tops, sizes) @ self.model.reading, -30, 30))), p, first


def _offsets(text: bytes, chances: dict[int, float]) -> list[dict]:
    """Code point ranges of runs of toxic tokens, given by number."""
    out: list[dict] = []
    last = None
    chars, byte = 0, 0
    for k, m in enumerate(_WORD.finditer(text)):
        if k in chances:
            chars += len(text[byte : m.start()].decode())
            size = len(m[0].decode())
            if last == k - 1:
                out[-1]["end"] = chars + size
                out[-1]["chance"] = max(out[-1]["chance"], chances[k])
            else:
                out.append({"begin": chars, "end": chars + size, "chance": chances[k]})
            chars, byte, last = chars + size, m.end(), k
    return out


_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("chance", pa.float64())]))


def score(documents: DataFrame, model: ToxicityModel | None, threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted, spans), one row for each row of ``documents`` (doc_id, text).

    score is from 0 to 1; predicted is 1 from ``threshold`` on; spans are code point ranges of runs of
    tokens whose marginal is at least a half. Null and empty texts have no token and get the score of
    that. Without a model all scores are 0. Repeated rows get equal results; other columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = _Scorer(shared.value) if shared.value else None
        for b in batches:
            chance, spots = np.zeros(b.num_rows), [[] for _ in range(b.num_rows)]
            for at, texts in slices(b.column(1), SLICE_BYTES) if scorer else ():
                chance[at : at + len(texts)], p, first = scorer(texts)
                toxic = np.flatnonzero(p >= 0.5)
                owner = np.searchsorted(first, toxic, side="right") - 1
                for i in np.unique(owner).tolist():
                    own = toxic[owner == i]
                    spots[at + i] = _offsets(texts[i].as_py().encode(), dict(zip((own - first[i]).tolist(), p[own].tolist())))
            yield batch(doc_id=b.column(0), score=chance, predicted=pa.array((chance >= threshold).astype(np.int32)), spans=pa.array(spots, _SPANS))

    kinds = "doc_id long, score double, predicted int, spans array<struct<begin:long,end:long,chance:double>>"
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), kinds)


def drop_toxic(documents: DataFrame, model: ToxicityModel | None, threshold: float = 0.7) -> DataFrame:
    """``documents`` without the rows whose score reaches ``threshold``; columns and other rows unchanged."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index("text")

    def run(batches):
        scorer = _Scorer(shared.value) if shared.value else None
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            for start, texts in slices(b.column(at), SLICE_BYTES) if scorer else ():
                keep[start : start + len(texts)] = scorer(texts)[0] < threshold
            yield b.filter(pa.array(keep))

    return documents.mapInArrow(tidy(run), documents.schema)
