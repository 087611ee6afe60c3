"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs, in numpy."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import small_batches

WINDOW = 32
STRIDE = 16
HIDDEN = 8
WIDTH = 8
#: Rows of the embedding tables: whole words, and runs of characters inside a word.
TABLES = (1 << 18, 1 << 18)
#: Lengths of the runs that end at each character of a word (cut at the word's beginning).
RUNS = (3, 5, 7)
THRESHOLD = 0.7
#: Share of tokens whose word or characters training leaves out, so that neither decides alone.
DROPPED = 0.3
#: Characters tokenized at once.
PIECE = 1 << 19
#: Runs of characters whose embeddings are gathered at once, and tokens whose features are counted at once.
GATHERED, COUNTED = 1 << 18, 1 << 15
_letters: list[np.ndarray] = []


def _in_word() -> np.ndarray:
    """Which of the first 65536 code points are letters or digits; those above count as letters."""
    if not _letters:
        _letters.append(np.fromiter((chr(x).isalnum() for x in range(65536)), dtype=bool, count=65536))
    return _letters[0]


class Tokens:
    """Words one after another, each given by its place ``index`` in a vocabulary: the row of a word, and the rows of its runs of characters, word v's from ``first[v]`` to ``first[v + 1]``."""

    def __init__(self, word: np.ndarray, gram: np.ndarray, first: np.ndarray, index: np.ndarray | None = None):
        self.word, self.gram, self.first = word, gram, first
        self.index = np.arange(len(word)) if index is None else index

    def __len__(self) -> int:
        return len(self.index)

    def runs(self) -> np.ndarray:
        """How many runs of characters each word of the vocabulary has."""
        return np.diff(self.first)

    def at(self, places: np.ndarray) -> Tokens:
        """The tokens at some places, with the vocabulary that they use."""
        used, index = np.unique(self.index[places], return_inverse=True)
        size = self.runs()[used]
        first = np.concatenate(([0], np.cumsum(size)))
        gram = self.gram[np.repeat(self.first[used] - first[:-1], size) + np.arange(first[-1])]
        return Tokens(self.word[used], gram, first, index)

    @classmethod
    def joined(cls, parts: list[Tokens]) -> Tokens:
        first = np.concatenate([[0], *(p.runs() for p in parts)]).cumsum()
        empty, before = np.zeros(0, dtype=np.int32), np.cumsum([0, *(len(p.word) for p in parts)])
        index = np.concatenate([np.zeros(0, dtype=np.int64), *(p.index + k for p, k in zip(parts, before[:-1], strict=True))])
        return cls(np.concatenate([empty, *(p.word for p in parts)]), np.concatenate([empty, *(p.gram for p in parts)]), first, index)


def _blocks(first: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of the parts that ``first`` borders, each of one part or of several with at most ``most`` entries in all."""
    begin, many = 0, len(first) - 1
    while begin < many:
        end = max(begin + 1, int(np.searchsorted(first, first[begin] + most, side="right")) - 1)
        yield begin, end
        begin = end


def _rows(x: np.ndarray, many: int) -> np.ndarray:
    return ((((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)) % np.uint64(many)).astype(np.int32)


def _features(text: str) -> tuple[Tokens, np.ndarray]:
    """The runs of letters and digits of ``text``, and where each starts."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inside = _in_word()[np.minimum(code, 65535)] | (code > 65535)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    begin, size = edge[::2], edge[1::2] - edge[::2]
    if not len(begin):
        return Tokens.joined([]), begin
    chars = code[inside].astype(np.uint64) + np.uint64(1)
    first = np.concatenate(([0], np.cumsum(size)))
    power = np.cumprod(np.full(64, 0x100000001B3, dtype=np.uint64))
    place = np.arange(len(chars)) - np.repeat(first[:-1], size)
    # What a word is made of is worked out once for each distinct word.
    words, where, index = np.unique(np.add.reduceat(chars * power[place & 63], first[:-1]), return_index=True, return_inverse=True)
    size = size[where]
    starts = np.concatenate(([0], np.cumsum(size)))
    at = np.arange(starts[-1]) - np.repeat(starts[:-1], size)
    chars = chars[np.repeat(first[where], size) + at]
    run, runs = np.zeros_like(chars), []
    for back in range(max(RUNS)):
        earlier = np.zeros_like(chars)
        earlier[back:] = np.where(at[back:] >= back, chars[: max(0, len(chars) - back)], 0)
        run += earlier * power[back]
        if back + 1 in RUNS:
            runs.append(_rows((run + np.uint64(back)) * np.uint64(0x9E3779B97F4A7C15), TABLES[1]))
    return Tokens(_rows(words, TABLES[0]), np.stack(runs, axis=1).ravel(), starts * len(RUNS), index), begin


def tokenize(texts: list[str | None]) -> tuple[Tokens, np.ndarray]:
    """All tokens of the texts, one after another, and the number of tokens of each text. Long texts are cut at white space on the way."""
    pieces, owner = [], []
    for k, text in enumerate(texts):
        text = (text or "").lower()
        while len(text) > PIECE and (cut := max(text.rfind(" ", 0, PIECE), text.rfind("\n", 0, PIECE))) > 0:
            pieces.append(text[:cut])
            owner.append(k)
            text = text[cut:]
        pieces.append(text)
        owner.append(k)
    found, counts = [], np.zeros(len(texts), dtype=np.int64)
    k = 0
    while k < len(pieces):
        last, chars = k, 0
        while last < len(pieces) and (last == k or chars + len(pieces[last]) <= PIECE):
            chars += len(pieces[last]) + 1
            last += 1
        features, begin = _features("\n".join(pieces[k:last]))
        ends = np.cumsum([len(x) + 1 for x in pieces[k:last]])
        np.add.at(counts, np.asarray(owner[k:last]), np.diff(np.searchsorted(begin, np.concatenate(([0], ends)))))
        found.append(features)
        k = last
    return Tokens.joined(found), counts


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and document of every window: one each STRIDE tokens until the text is covered, one at least."""
    per = 1 + np.maximum(0, -(-(counts - WINDOW) // STRIDE))
    doc = np.repeat(np.arange(len(counts)), per)
    rank = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    start = rank * STRIDE
    return np.repeat(np.cumsum(counts) - counts, per) + start, np.clip(counts[doc] - start, 0, WINDOW), doc


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Network:
    """Parameters, forward pass and gradients. Directions share arrays whose first axis has two entries."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        put = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.tables = [put(rows, WIDTH, scale=0.05) for rows in TABLES]
        self.p = {
            "wx": put(2, 2 * WIDTH, 3 * HIDDEN, scale=0.3), "bx": np.zeros((2, 1, 3 * HIDDEN), np.float32), "u": put(2, HIDDEN, 3 * HIDDEN, scale=0.3),
            "v": put(2 * HIDDEN, scale=0.3), "w": put(2 * HIDDEN, scale=0.3), "b": np.zeros(1, np.float32),
        }
        self.scale = np.array([1.0, 0.0])

    def embedded(self, features: Tokens) -> np.ndarray:
        """For each word of the vocabulary its embedding beside the sum of those of its runs of characters, by the root of their number."""
        out = np.zeros((len(features.word), 2 * WIDTH), dtype=np.float32)
        for a, b in _blocks(features.first, GATHERED):
            first = features.first[a : b + 1]
            out[a:b, :WIDTH] = self.tables[0][features.word[a:b]]
            out[a:b, WIDTH:] = np.add.reduceat(self.tables[1][features.gram[first[0] : first[-1]]].astype(np.float32, copy=False), first[:-1] - first[0])
            out[a:b, WIDTH:] /= np.sqrt(np.diff(first))[:, None]
        return out

    def forward(self, projected: np.ndarray, start: np.ndarray, size: np.ndarray, keep: bool = False):
        """Logit of every window; ``projected`` (2, tokens + 1, 3 * HIDDEN) ends with the row that padding gets."""
        many, none = len(start), projected.shape[1] - 1
        step = np.arange(WINDOW)[:, None]
        index = np.where(step < size, start + step, none)
        real = (step < size).astype(np.float32)[..., None]
        h = np.zeros((2, many, HIDDEN), dtype=np.float32)
        states = np.empty((WINDOW, many, 2 * HIDDEN), dtype=np.float32)
        kept = []
        for t in range(WINDOW):
            back = WINDOW - 1 - t
            x = np.stack((projected[0][index[t]], projected[1][index[back]]))
            g = h @ self.p["u"]
            zr = _sigmoid(x[..., : 2 * HIDDEN] + g[..., : 2 * HIDDEN])
            z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
            n = np.tanh(x[..., 2 * HIDDEN :] + r * g[..., 2 * HIDDEN :])
            before, m = h, np.stack((real[t], real[back]))
            h = (n + z * (h - n)) * m
            states[t, :, :HIDDEN], states[back, :, HIDDEN:] = h[0], h[1]
            if keep:
                kept.append((before, z, r, n, g[..., 2 * HIDDEN :], m))
        score = np.where(real[..., 0] > 0, states @ self.p["v"], np.float32(-1e9))
        weight = np.exp(score - score.max(0)) * real[..., 0]
        weight /= np.maximum(weight.sum(0), 1e-9)
        pooled = np.einsum("tb,tbh->bh", weight, states, optimize=True)
        logit = pooled @ self.p["w"] + self.p["b"]
        return (logit, (index, states, weight, pooled, kept)) if keep else logit

    def project(self, x: np.ndarray) -> np.ndarray:
        """Input half of the gates for every token, and a last row for padding."""
        padded = np.concatenate((x, np.zeros((1, x.shape[1]), np.float32)))
        return padded @ self.p["wx"] + self.p["bx"]

    def logits(self, features: Tokens, start: np.ndarray, size: np.ndarray, block: int = 2048) -> np.ndarray:
        out, known = np.empty(len(start), dtype=np.float32), self.embedded(features)
        for k in range(0, len(start), block):
            first, last = (int(start[k]), int(max(start[k : k + block] + size[k : k + block]))) if len(start) else (0, 0)
            out[k : k + block] = self.forward(self.project(known[features.index[first:last]]), start[k : k + block] - first, size[k : k + block])
        return out

    def gradients(self, features: Tokens, start: np.ndarray, size: np.ndarray, label: np.ndarray, weight: np.ndarray, rng: np.random.Generator):
        """Gradients of the weighted logistic loss: of the dense parameters, and per used word of its embedding and of that of each of its runs of characters."""
        step = np.arange(WINDOW)
        tokens = np.concatenate([np.arange(s, s + n) for s, n in zip(start, size, strict=True)])
        begin = np.cumsum(size) - size
        used = (rng.random((len(tokens), len(TABLES))) >= DROPPED).astype(np.float32) / (1 - DROPPED)
        some = features.at(tokens)
        used = np.repeat(used, WIDTH, axis=1)
        x = self.embedded(some)[some.index] * used
        logit, (index, states, attention, pooled, kept) = self.forward(self.project(x), begin, size, keep=True)
        d_logit = (_sigmoid(logit) - label) * weight / len(start)
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["b"][0], grad["w"] = d_logit.sum(), pooled.T @ d_logit
        d_pooled = d_logit[:, None] * self.p["w"]
        d_weight = np.einsum("tbh,bh->tb", states, d_pooled, optimize=True)
        d_score = attention * (d_weight - (attention * d_weight).sum(0))
        grad["v"] = np.einsum("tb,tbh->h", d_score, states, optimize=True)
        d_states = attention[..., None] * d_pooled + d_score[..., None] * self.p["v"]
        d_projected = np.zeros((2, len(tokens) + 1, 3 * HIDDEN), dtype=np.float32)
        d_h = np.zeros((2, len(start), HIDDEN), dtype=np.float32)
        for t in step[::-1]:
            back = WINDOW - 1 - t
            before, z, r, n, g_n, m = kept[t]
            d_h = (d_h + np.stack((d_states[t, :, :HIDDEN], d_states[back, :, HIDDEN:]))) * m
            d_n = d_h * (1 - z) * (1 - n * n)
            d_z = d_h * (before - n) * z * (1 - z)
            d_r = d_n * g_n * r * (1 - r)
            d_g = np.concatenate((d_z, d_r, d_n * r), axis=2)
            d_x = np.concatenate((d_z, d_r, d_n), axis=2)
            grad["u"] += before.transpose(0, 2, 1) @ d_g
            d_h = d_h * z + d_g @ self.p["u"].transpose(0, 2, 1)
            np.add.at(d_projected[0], index[t], d_x[0])
            np.add.at(d_projected[1], index[back], d_x[1])
        d_projected[:, -1] = 0
        grad["bx"] = d_projected.sum(1, keepdims=True)
        grad["wx"] = x.T @ d_projected[:, :-1]
        d_input = (d_projected[:, :-1] @ self.p["wx"].transpose(0, 2, 1)).sum(0)
        order = np.argsort(some.index, kind="stable")
        d_word = np.add.reduceat((d_input * used)[order], np.concatenate(([0], np.cumsum(np.bincount(some.index))[:-1])))
        d_word[:, WIDTH:] /= np.sqrt(some.runs())[:, None].astype(np.float32)
        return grad, some, d_word

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Calibrated probability of each text: that of its most toxic window."""
        features, counts = tokenize(texts)
        start, size, doc = windows(counts)
        top = np.full(len(texts), -np.inf)
        np.maximum.at(top, doc, self.logits(features, start, size))
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * top + self.scale[1], -60, 60)))


def _met(features: Tokens, counts: np.ndarray, labels: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each table, in how many documents each row occurs, and in how many of those labelled 1; counted some documents at a time."""
    many, border = len(features.word), np.concatenate(([0], np.cumsum(counts)))
    found = [(np.zeros(rows, dtype=np.int64), np.zeros(rows)) for rows in TABLES]
    for a, b in _blocks(border, COUNTED):
        met = np.unique(np.repeat(np.arange(a, b, dtype=np.int64), counts[a:b]) * many + features.index[border[a] : border[b]])
        owner, of = met // many, met % many
        size = features.first[of + 1] - features.first[of]
        ends = np.cumsum(size)
        gram = features.gram[np.repeat(features.first[of] - ends + size, size) + np.arange(size.sum())]
        for rows, (seen, toxic), pair in zip(TABLES, found, (owner * TABLES[0] + features.word[of], np.repeat(owner, size) * TABLES[1] + gram), strict=True):
            pair = np.unique(pair)
            seen += np.bincount(pair % rows, minlength=rows)
            toxic += np.bincount(pair % rows, weights=labels[pair // rows], minlength=rows)
    return found


def train(texts: list[str | None], labels: np.ndarray, seed: int = 7, rounds: int = 5, batch: int = 64, rate: float = 0.01, lean_start: bool = True) -> Network:
    """Fit on whole texts with one label each; the list of texts is emptied once they are tokenized.

    A label says that some window is toxic, so each round trains on the window that the network finds most toxic
    in every text, and on another of each clean one. The first dimension of every embedding starts from how far
    its feature leans to either label (unless ``lean_start`` is off); the first round's windows are chosen by that.
    """
    rng = np.random.default_rng(seed)
    network = Network(seed)
    labels = labels.astype(np.float32)
    many = len(texts)
    features, counts = tokenize(texts)
    texts.clear()
    start, size, doc = windows(counts)
    share = labels.mean()
    lean = np.zeros(len(features.word), dtype=np.float32)
    for k, (seen, toxic) in enumerate(_met(features, counts, labels) if lean_start and len(features) else ()):
        z = np.where(seen > 2, np.tanh((toxic - seen * share) / np.sqrt(seen * share * (1 - share) + 1) / 4), 0).astype(np.float32)
        network.tables[k][:, 0] = z
        if k == 0:
            lean += z[features.word]
            continue
        for a, b in _blocks(features.first, GATHERED):
            first = features.first[a : b + 1]
            lean[a:b] += np.add.reduceat(z[features.gram[first[0] : first[-1]]], first[:-1] - first[0]) / np.sqrt(np.diff(first))
    lean = lean[features.index]
    total = np.concatenate(([0.0], np.cumsum(np.maximum(lean, 0))))
    logit = total[start + size] - total[start]
    del lean, total
    sums = {k: np.zeros_like(v) for k, v in network.p.items()}
    squares = {k: np.zeros_like(v) for k, v in network.p.items()}
    spread = [np.full(rows, 1e-3, np.float32) for rows in TABLES]
    balance = np.where(labels > 0, np.sqrt((1 - share) / share), 1).astype(np.float32)
    count = 0
    for turn in range(rounds):
        if turn:
            logit = network.logits(features, start, size)
        order = np.lexsort((-logit, doc))
        first = np.searchsorted(doc[order], np.arange(many))
        chosen = order[first]
        other = order[first + (rng.random(many) * np.bincount(doc, minlength=many)).astype(np.int64)]
        chosen = np.concatenate((chosen, other[labels == 0]))
        chosen = rng.permutation(chosen[size[chosen] > 0])
        speed = rate * (1 - turn / rounds) + rate / 10
        repeats = max(1, -(-60 * batch // max(1, len(chosen))))
        chosen = np.concatenate([rng.permutation(chosen) for _ in range(repeats)])
        for k in range(0, len(chosen), batch):
            some = chosen[k : k + batch]
            grad, used, d_word = network.gradients(features, start[some], size[some], labels[doc[some]], balance[doc[some]], rng)
            count += 1
            for name, g in grad.items():
                sums[name] = 0.9 * sums[name] + 0.1 * g
                squares[name] = 0.99 * squares[name] + 0.01 * g * g
                network.p[name] -= speed * (sums[name] / (1 - 0.9**count)) / (np.sqrt(squares[name] / (1 - 0.99**count)) + 1e-6)
            d_gram = np.repeat(d_word[:, WIDTH:], used.runs(), axis=0)
            for which, (places, d) in enumerate(((used.word, d_word[:, :WIDTH]), (used.gram, d_gram))):
                row, inverse = np.unique(places, return_inverse=True)
                order = np.argsort(inverse, kind="stable")
                step = np.add.reduceat(d[order], np.concatenate(([0], np.cumsum(np.bincount(inverse))[:-1])))
                spread[which][row] += (step * step).mean(1)
                network.tables[which][row] -= speed * step / np.sqrt(spread[which][row])[:, None]
    network.tables = [table.astype(np.float16) for table in network.tables]  # half the bytes to send around
    top = np.full(many, -np.inf)
    np.maximum.at(top, doc, network.logits(features, start, size))
    network.scale = _calibrated(top, labels)
    return network


def _calibrated(top: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Slope (0.3 to 1.5) and offset of the logistic curve that fits smoothed labels best; the offset that balances the residuals is found by halving."""
    ones, zeros = labels.sum(), (1 - labels).sum()
    target = np.where(labels > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    best = (np.inf, 1.0, 0.0)
    for slope in np.linspace(0.3, 1.5, 13):
        low, high = -60.0, 60.0
        for _ in range(60):
            offset = (low + high) / 2
            p = 1 / (1 + np.exp(-np.clip(slope * top + offset, -60, 60)))
            low, high = (offset, high) if (p - target).sum() < 0 else (low, offset)
        p = np.clip(p, 1e-9, 1 - 1e-9)
        loss = -(target * np.log(p) + (1 - target) * np.log(1 - p)).mean()
        best = min(best, (loss, slope, offset))
    return np.array(best[1:])


def held_out(doc_id: Column) -> Column:
    """Rows whose label is never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = 1500, max_clean: int = 4000, seed: int = 7) -> Network | None:
    """Train on a bounded sample of the labelled documents: at most ``max_toxic`` and ``max_clean``, the first by a hash of doc_id.

    Held-out rows, null ids and labels other than 0 and 1 are left out; of several labels of a document the largest
    counts. None without a text of either label. The sample is trained on in one task; only the network comes to the
    driver.
    """
    small_batches(docs.sparkSession)
    usable = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    single = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    parts = [single.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for label, most in ((1, max_toxic), (0, max_clean))]
    sample = F.broadcast(parts[0].union(parts[1]))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sample, "doc_id")

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(frames)
        if not parts:
            return
        found = pd.concat(parts, ignore_index=True).sort_values(["doc_id", "text"])
        del parts
        labels, texts = found["toxic"].to_numpy(), found["text"].tolist()
        del found
        if 0 < labels.sum() < len(labels):
            yield pd.DataFrame({"network": [pickle.dumps(train(texts, labels, seed))]})

    learnt = rows.repartition(1).mapInPandas(learn, "network binary").collect()
    return pickle.loads(learnt[0].network) if learnt else None


def score_toxicity(docs: DataFrame, network: Network | None) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from 0.7 up); columns of those names are replaced.

    The whole text counts, in windows of 32 words that overlap by half; null and empty texts have one empty window
    and get the score of no evidence. Without a network (no labels to learn from) every score is 0. Row order,
    repeated rows and other columns don't matter to a score. Nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    plain = docs.drop("score", "predicted")
    if network is None:
        scored = plain.withColumn("score", F.lit(0.0))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(network)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(0, batch.num_rows, 250):
                    part = batch.slice(k, 250)
                    got = shared.value.scores(part.column("text").to_pylist())
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.float64())], names=[*part.schema.names, "score"])

        scored = plain.mapInArrow(score, plain.withColumn("score", F.lit(0.0)).schema)
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's score, from a network that saw no held-out label."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_toxicity(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
