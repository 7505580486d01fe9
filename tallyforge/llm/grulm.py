"""A gated recurrent language model in numpy, with counts of the whole training corpus.

Tokens are words without ASCII white space (A-Z lower-cased) and one end a text. Their counts over all training
texts are one distributed aggregation, keyed by 64-bit hashes of the words. The CLASSES * WIDTH commonest are the
model's own words, in classes of WIDTH by rank; all others are one more class. The model factors
P(token) = P(class | state) * P(word | class, state); within the class of all others, P is by the counts
((c + 1) over their sum), with one share for all words never seen. So a text's probabilities need the counts of rare
words, of which there is no bounded number: texts meet them in a join, and only the HEAD commonest, at most, are sent to all.

Training is by truncated backpropagation, data-parallel: in each round every task starts from the same parameters,
passes over its share of that round's hash slice of the training texts, CHUNK tokens or so at once, and the parameters
are averaged by tokens. The rounds' slices part the training texts, so that every token of them is a goal once. Scoring carries the state across windows of WINDOW tokens through the whole
text; a lane is a text, and lanes end with their texts.

Edge cases: null and empty texts are one end; without training texts all tokens are unknown and every score is 0; rows
are told apart by place, so repeated rows and null ids each give their own result; an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import Sent, by_step, materialize, small_batches
from tallyforge.llm.textvec import SPACED, U64, Members, mix, words

END = mix(np.array([0xE0D], U64))[0]
HEAD = 1 << 16
CLASSES, WIDTH, HIDDEN, SHARED = 32, 32, 24, 64
OWN = CLASSES * WIDTH
WINDOW, LANES, TRUNCATE = 32, 64, 16
#: Texts that scoring steps through side by side, whose gates fit a core's cache; tokens of a window at least, where texts last; and tokens whose texts are scored together.
SIDE, FULL, POOL = 512, 1 << 13, 1 << 21
#: Classes of a step that are multiplied each alone, being the largest; the others are padded to one size.
ALONE = 4
#: Rows of a group that are added for all groups at once.
EACH = 10
#: Parameters that one step of Adam takes at once.
PIECE = 1 << 15
#: Learning rates of the rounds of training, which share out all training texts; and tokens that a task holds at once.
RATES, CHUNK = (0.02, 0.01, 0.005), 1 << 20
LOG10 = np.log(10.0)
ONE = np.float32(1)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's end last, and the n + 1 places where texts begin."""
    w = words(data, offsets, SPACED)
    n = len(offsets) - 1
    first = w.first + np.arange(n + 1)
    out = np.empty(first[-1], U64)
    out[first[1:] - 1] = END
    out[np.arange(len(w.hashes)) + w.doc] = w.hashes
    return out, first


def count(docs: DataFrame) -> DataFrame:
    """h, c: how often each token is in docs."""
    small_batches(docs.sparkSession)

    def of(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray):
        h, c = np.unique(tokens(data, offsets)[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["h", "c"])

    return docs.select("text").mapInArrow(by_step(of, most=4 << 20), "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))


@dataclass
class Vocab:
    head: Members  # by rank
    counts: np.ndarray  # of the head
    total: int  # of all counts
    types: int
    rest_total: int  # the same of all but the model's own words
    rest_types: int

    def ranks(self, h: np.ndarray) -> np.ndarray:
        return self.head.places(h)


def vocab(counts: DataFrame) -> Vocab:
    all_ = counts.agg(F.count("*").alias("types"), F.coalesce(F.sum("c"), F.lit(0)).alias("total")).first()
    head = counts
    if all_["types"] > HEAD:  # the commonest words, in whole steps of frequency, as many as HEAD holds: only they leave the executors
        step = F.floor(F.log2("c") * 16).cast("int")
        sizes, least, n = counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect(), None, 0
        for r in sizes:
            n += r["n"]
            if n > HEAD:
                break
            least = r["step"]
        head = counts.filter(step >= least) if least is not None else counts.limit(0)
    top = sorted(head.collect(), key=lambda r: (-r["c"], r["h"]))
    h, c = np.array([r["h"] for r in top], np.int64).view(U64), np.array([r["c"] for r in top], np.int64)
    own = c[:OWN]
    return Vocab(Ranks(h), c, int(all_["total"]), int(all_["types"]), int(all_["total"] - own.sum()), int(all_["types"] - len(own)))


class Gru:
    """Parameters: x, the gates' inputs of each input symbol; u, state to gates; wc, bc, class scores; ww, bw, word scores of each class."""

    NAMES = ("x", "u", "wc", "bc", "ww", "bw")

    def __init__(self, v: Vocab) -> None:
        rng = np.random.default_rng(3)
        f = np.float32
        self.p = {"x": rng.normal(0, 0.1, (OWN + SHARED, 3 * HIDDEN)).astype(f), "u": rng.normal(0, 0.2, (HIDDEN, 3 * HIDDEN)).astype(f), "wc": np.zeros((HIDDEN, CLASSES + 1), f), "ww": np.zeros((CLASSES, HIDDEN, WIDTH), f)}
        own = np.zeros(OWN)
        own[: min(OWN, len(v.counts))] = v.counts[:OWN]
        own = own.reshape(CLASSES, WIDTH)
        share = np.append(own.sum(1), v.rest_total + 1)
        # without a state the model has the counts' probabilities; places without a word are as good as impossible
        self.p["bc"] = np.log(np.maximum(share, 1e-12) / share.sum()).astype(f)
        self.p["bw"] = np.log(np.maximum(own, 1e-12) / np.maximum(own.sum(1, keepdims=True), 1e-12)).astype(f)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.NAMES])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k in self.NAMES:
            n = self.p[k].size
            self.p[k] = flat[at : at + n].reshape(self.p[k].shape).astype(np.float32)
            at += n

    @staticmethod
    def symbols(h: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Inputs: own words by rank, others by a few bits of their hash."""
        return np.where((rank >= 0) & (rank < OWN), rank, OWN + (h % U64(SHARED)).astype(np.int64))

    def step(self, x: np.ndarray, h: np.ndarray, a: np.ndarray | None = None, out: np.ndarray | None = None):
        """One token of every lane; a lane is a column, so that a gate's values lie together. x: 3 * HIDDEN rows of inputs, which the gates overwrite. a, out: room for their likes among the results."""
        a = np.matmul(self.p["u"].T, h, out=a)
        zr = x[: 2 * HIDDEN]
        zr += a[: 2 * HIDDEN]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += ONE
        np.reciprocal(zr, out=zr)
        z, r, a, n = zr[:HIDDEN], zr[HIDDEN:], a[2 * HIDDEN :], x[2 * HIDDEN :]
        n += r * a
        np.tanh(n, out=n)
        out = np.subtract(h, n, out=out)
        out *= z
        out += n
        return out, z, r, n, a

    def log_probs(self, h: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Natural logs of P(class) * P(word | class) of own words, of P(class) of others."""
        kind = np.where((rank >= 0) & (rank < OWN), rank // WIDTH, CLASSES).astype(np.uint8)
        out = np.empty(len(h), np.float32)
        for i in range(0, len(h), FULL // 4):  # as many as stay in the cache
            k = kind[i : i + FULL // 4]
            s = h[i : i + FULL // 4] @ self.p["wc"]
            s += self.p["bc"]
            out[i : i + len(k)] = s[np.arange(len(k)), k]
            out[i : i + len(k)] -= np.log(sums(np.exp(s, out=s)))
        order = np.argsort(kind, kind="stable")
        edge = np.searchsorted(kind[order], np.arange(CLASSES + 1)).tolist()
        order = order[: edge[CLASSES]]
        own, word = h[order], rank[order] % WIDTH
        lp = np.empty(len(order), np.float32)
        for c, (i, j) in enumerate(zip(edge, edge[1:])):
            if i < j:
                w = own[i:j] @ self.p["ww"][c]
                w += self.p["bw"][c]
                lp[i:j] = w[np.arange(j - i), word[i:j]]
                lp[i:j] -= np.log(sums(np.exp(w, out=w)))
        out[order] += lp
        return out

    def score(self, h: np.ndarray, rank: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Natural log probability of each text, but for the counts' part of words that aren't the model's own."""
        return self.score_symbols(self.symbols(h, rank), rank, first)

    def score_symbols(self, symbol: np.ndarray, rank: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The same of texts whose inputs are known. The longest texts go side by side, so that few steps have few lanes."""
        length = np.diff(first)
        order = np.argsort(-length, kind="stable")
        out = np.zeros(len(length))
        start = self.symbols(np.array([END]), np.array([self.end]))[0]
        for i in range(0, len(order), SIDE):
            lane = order[i : i + SIDE]
            begin, short, longest = first[lane], -length[lane], int(length[lane[0]])
            state, n, t = np.zeros((HIDDEN, len(lane)), np.float32), len(lane), 0
            while t < longest:
                steps, lanes, places, size, t0 = [], [], [], 0, t
                while t < longest and (t < t0 + WINDOW or size < FULL):
                    n = int(np.searchsorted(short[:n], -t, "left"))
                    at = begin[:n] + t
                    x = self.p["x"].take(symbol[at - 1] if t else np.full(n, start), 0)
                    state = self.step(np.ascontiguousarray(x.T), state[:, :n])[0]
                    steps.append(state.T)
                    lanes.append(lane[:n])
                    places.append(at)
                    size += n
                    t += 1
                lp = self.log_probs(np.concatenate(steps), rank[np.concatenate(places)])
                out += np.bincount(np.concatenate(lanes), lp, len(out))
        return out

    end = -1  # the rank of the end


def sums(e: np.ndarray) -> np.ndarray:
    """Of each row."""
    return e @ np.ones(e.shape[1], np.float32)


class Ranks(Members):
    """Members that are looked up by the few that share a hash's first bits."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.order = np.argsort(hashes, kind="stable").astype(np.int32)
        self.sorted = hashes[self.order]
        self.bits = max(10, int(len(hashes)).bit_length() + 1)
        self.first = np.searchsorted(self.sorted >> U64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=U64)).astype(np.int32)

    def places(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        b = (h >> U64(64 - self.bits)).astype(np.int64)
        at, end = self.first[b], self.first[1:][b]
        open_ = np.flatnonzero(at < end)
        at, end, h = at[open_], end[open_], h[open_]
        while len(open_):
            hit = self.sorted[at] == h
            out[open_[hit]] = self.order[at[hit]]
            more = np.flatnonzero(~hit & (at + 1 < end))
            open_, at, end, h = open_[more], at[more] + 1, end[more], h[more]
        return out


class Adam:
    """Moments (but for constant factors) of all parameters, which lie in one array: the model's own become views of it."""

    def __init__(self, model: Gru) -> None:
        self.all = model.flat().astype(np.float32)
        self.g, self.m, self.s, self.a = (np.zeros_like(self.all) for _ in range(4))
        self.i, self.grad, at = 0, {}, 0
        # weights and biases lie together, the biases as the weights of one more input, which is 1
        held, n = {}, HIDDEN + 1
        for k, shape in (("x", model.p["x"].shape), ("u", model.p["u"].shape), ("classes", (n, CLASSES + 1)), ("words", (CLASSES, n, WIDTH))):
            size = int(np.prod(shape))
            held[k] = [x[at : at + size].reshape(shape) for x in (self.all, self.g)]
            at += size
        (self.classes, self.classes_grad), (self.words, self.words_grad) = held["classes"], held["words"]
        for out, of in ((model.p, 0), (self.grad, 1)):
            x, u, c, w = (held[k][of] for k in held)
            views = {"x": x, "u": u, "wc": c[:-1], "bc": c[-1], "ww": w[:, :-1], "bw": w[:, -1]}
            for k in Gru.NAMES if of == 0 else ():
                views[k][:] = model.p[k]
            out.update(views)

    def step(self, rate: float) -> None:
        """In pieces that stay in a core's cache. Gradients are kept."""
        self.i += 1
        c = np.sqrt(1 - 0.99**self.i)
        # m is 10 and s 100 times the moment: the root of s is 10 times its own
        tiny, rate = np.float32(1e-5 * c), np.float32(rate * c / (1 - 0.9**self.i))
        for k in range(0, len(self.all), PIECE):
            g, m, s, a, p = (x[k : k + PIECE] for x in (self.g, self.m, self.s, self.a, self.all))
            m *= np.float32(0.9)
            m += g
            s *= np.float32(0.99)
            s += np.multiply(g, g, out=a)
            np.sqrt(s, out=a)
            a += tiny
            np.divide(m, a, out=a)
            a *= rate
            p -= a


def sums_of(rows: np.ndarray, order: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups and the sums of their rows; order lists rows by group, group says which. The first rows of each group are added for all groups at once, only what large ones have beyond EACH goes group by group."""
    at = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(at, append=len(order))
    by_size = np.argsort(-size, kind="stable")
    at, size = at[by_size], size[by_size]
    out = rows.take(order[at], 0)
    larger = np.searchsorted(-size, -np.arange(EACH + 1), "left").tolist()  # groups of more than 0, 1, ... rows
    for k in range(1, EACH):
        if n := larger[k]:
            out[:n] += rows.take(order[at[:n] + k], 0)
    if n := larger[EACH]:
        more = size[:n] - EACH
        start = np.cumsum(more) - more
        rest = np.arange(more.sum()) + np.repeat(at[:n] + EACH - start, more)
        out[:n] += np.add.reduceat(rows.take(order[rest], 0), start)
    return group[at], out


def train(model: Gru, h: np.ndarray, rank: np.ndarray, rate: float, adam: Adam | None = None) -> None:
    """One pass of truncated backpropagation over a stream of texts, cut into LANES; Adam. Every token is a goal once."""
    if not len(h):
        return
    adam = adam or Adam(model)
    symbol = model.symbols(np.append(U64(END), h[:-1]), np.append(model.end, rank[:-1]))  # the first text follows an end
    lanes = max(1, min(LANES, len(h) // (TRUNCATE + 1)))
    n = -(-len(h) // lanes)
    # the lanes' last places may lie beyond the stream: symbols there are of any kind, goals have no weight
    inputs, goals = np.resize(symbol, n * lanes).reshape(lanes, n), np.resize(rank, n * lanes).reshape(lanes, n)
    live = (np.arange(n * lanes) < len(h)).reshape(lanes, n)
    state = np.zeros((HIDDEN, lanes), np.float32)
    p, g, touched = model.p, adam.grad, slice(None)
    for t0 in range(0, n, TRUNCATE):
        steps = min(TRUNCATE, n - t0)
        size = steps * lanes
        flat = inputs[:, t0 : t0 + steps].T.ravel()
        xs = p["x"].take(flat, 0).reshape(steps, lanes, 3 * HIDDEN).transpose(0, 2, 1).copy()
        states, a = np.empty((steps + 1, HIDDEN, lanes), np.float32), np.empty_like(xs)
        states[0] = state
        for t in range(steps):
            model.step(xs[t], states[t], a[t], states[t + 1])
        state, before, a = states[steps], states[:steps], a[:, 2 * HIDDEN :]
        z, r, c = xs[:, :HIDDEN], xs[:, HIDDEN : 2 * HIDDEN], xs[:, 2 * HIDDEN :]
        # by token: the states before, the same later by a step, a last input of 1, and a last row of 0 that fills up
        all_ = np.zeros((size + lanes + 1, HIDDEN + 1), np.float32)
        all_[:-1, HIDDEN] = 1
        all_[:-1].reshape(steps + 1, lanes, HIDDEN + 1)[:, :, :HIDDEN] = states.transpose(0, 2, 1)
        hs = all_[lanes:]
        goal = goals[:, t0 : t0 + steps].T.ravel()
        kind = np.where((goal >= 0) & (goal < OWN), goal // WIDTH, CLASSES).astype(np.uint8)
        ok = live[:, t0 : t0 + steps].T.ravel()
        whole = bool(ok.all())
        share = np.float32(1 / max(int(ok.sum()), 1))
        e = hs[:size] @ adam.classes
        np.exp(e, out=e)
        e *= (share / sums(e))[:, None]
        e[np.arange(size), kind] -= share
        if not whole:
            e[~ok] = 0
        np.matmul(hs[:size].T, e, out=adam.classes_grad)
        dh = np.zeros((size + 1, HIDDEN), np.float32)
        np.matmul(e, p["wc"].T, out=dh[:size])
        # words of all classes, by class: the largest classes each alone, the others together, filled up to one size
        order = np.argsort(kind if whole else np.where(ok, kind, CLASSES).astype(np.uint8), kind="stable")
        many = np.bincount(kind if whole else kind[ok], minlength=CLASSES + 1)[:CLASSES]
        start = np.cumsum(many) - many
        order = order[: many.sum()]
        word = goal[order] % WIDTH
        by_size = np.argsort(-many, kind="stable")
        for k in by_size[:ALONE].tolist():
            i, j = start[k], start[k] + many[k]
            own = hs.take(order[i:j], 0)
            e = own @ adam.words[k]
            np.exp(e, out=e)
            e *= (share / sums(e))[:, None]
            e[np.arange(j - i), word[i:j]] -= share
            np.matmul(own.T, e, out=adam.words_grad[k])
            dh[order[i:j]] += e @ p["ww"][k].T
        few = np.sort(by_size[ALONE:])
        most = int(many[few].max())
        if most:
            slot = np.zeros(CLASSES, np.int64)
            slot[few] = np.arange(len(few)) * most - start[few]
            mine = np.ones(CLASSES, bool)
            mine[by_size[:ALONE]] = False
            kinds = kind[order]
            picked = np.flatnonzero(mine[kinds])
            at = slot[kinds[picked]] + picked
            token = np.full(len(few) * most, size)
            token[at] = order[picked]
            own, words_ = hs.take(token, 0).reshape(len(few), most, HIDDEN + 1), adam.words.take(few, 0)
            e = (own @ words_).reshape(-1, WIDTH)
            np.exp(e, out=e)
            e *= (np.where(token < size, share, np.float32(0)) / sums(e))[:, None]
            e[at, word[picked]] -= share
            e = e.reshape(len(few), most, WIDTH)
            adam.words_grad[few] = own.transpose(0, 2, 1) @ e
            dh[token] += (e @ words_[:, :HIDDEN].transpose(0, 2, 1)).reshape(-1, HIDDEN)  # rows that fill up are 0
        else:
            adam.words_grad[few] = 0
        dh = dh[:size]
        dh = dh.reshape(steps, lanes, HIDDEN).transpose(0, 2, 1).copy()
        # the gates' gradients are those of the state times these
        inner = (1 - z) * (1 - c * c)
        by = np.empty((steps, 3, HIDDEN, lanes), np.float32)
        np.multiply(before - c, z * (1 - z), out=by[:, 0])
        np.multiply(inner, r, out=by[:, 2])
        np.multiply(by[:, 2] * a, 1 - r, out=by[:, 1])
        back = np.zeros_like(state)
        da = np.empty((steps, 3, HIDDEN, lanes), np.float32)
        for t in range(steps - 1, -1, -1):
            d = dh[t]
            d += back
            np.multiply(d, by[t], out=da[t])
            back = p["u"] @ da[t].reshape(3 * HIDDEN, lanes)
            back += d * z[t]
        by_lane = lambda x: x.transpose(0, 2, 1).reshape(size, -1)
        rows = by_lane(da.reshape(steps, 3 * HIDDEN, lanes))
        g["u"][:] = all_[:size, :HIDDEN].T @ rows
        rows[:, 2 * HIDDEN :] = by_lane(dh * inner)  # of the inputs, from here on
        order = np.argsort(flat.astype(np.uint16), kind="stable")
        g["x"][touched] = 0
        touched, summed = sums_of(rows, order, flat[order])
        g["x"][touched] = summed
        adam.step(rate)


def fit(docs: DataFrame, v: Vocab) -> Gru:
    """Rounds of local training and averaging over hash slices of docs (doc_id, text): a text is in one round."""
    spark = docs.sparkSession
    small_batches(spark)
    model = Gru(v)
    model.end = int(v.ranks(np.array([END]))[0])
    if not v.total:
        return model
    slice_ = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(len(RATES)))
    for r, rate in enumerate(RATES):
        sent = Sent(spark, (v, model))

        def run(batches, sent=sent, rate=rate):
            v, own = sent.value
            adam = Adam(own)
            seen: list[np.ndarray] = []
            n, who = 0, 0

            def learn() -> None:
                nonlocal n, who
                h = np.concatenate(seen)
                seen.clear()
                train(own, h, v.ranks(h), rate, adam)
                who = who if n else int(h[:1].view(np.int64)[0])
                n += len(h)

            def of(rows, data, offsets):
                seen.append(tokens(data, offsets)[0])
                if sum(map(len, seen)) >= CHUNK:
                    learn()
                return ()

            for _ in by_step(of)(batches):
                pass
            if seen:
                learn()
            flat = own.flat()
            size = len(flat) if n else 0
            at = list(range(0, size, 4096))
            yield pa.RecordBatch.from_arrays([pa.array([k // 4096 for k in at], pa.int32()), pa.array([who & 63] * len(at), pa.int32()), pa.array([float(n)] * len(at)), pa.array([flat[k : k + 4096].tobytes() for k in at], pa.binary())], ["part", "salt", "n", "values"])

        schema = "part int, salt int, n double, values binary"
        made = docs.filter(slice_ == r).select("text").mapInArrow(run, schema)

        def mean(rows: pd.DataFrame) -> pd.DataFrame:
            w = rows["n"].to_numpy()
            total = sum(np.frombuffer(b, np.float32).astype(np.float64) * x for b, x in zip(rows["values"], w, strict=True)) / w.sum()
            return pd.DataFrame({"part": rows["part"].iloc[:1], "salt": [0], "n": [w.sum()], "values": [total.astype(np.float32).tobytes()]})

        # in two steps, so that no group holds the parts of all tasks
        got = made.groupBy("part", "salt").applyInPandas(mean, schema).groupBy("part").applyInPandas(mean, schema).collect()
        sent.drop()
        if got:
            model.load(np.concatenate([np.frombuffer(x["values"], np.float32) for x in sorted(got, key=lambda x: x["part"])]))
    return model


def score(docs: DataFrame, train_rows: Column, keep: list[str]) -> DataFrame:
    """`keep` and n_tokens, n_known, train_tokens, base_score, score of every row of docs; learns from rows where train_rows holds."""
    spark = docs.sparkSession
    small_batches(spark)
    learn = docs.filter(train_rows).select("doc_id", "text")
    counts = materialize(count(learn), "counts")
    v = vocab(counts)
    sent = Sent(spark, (v, fit(learn, v)))
    names = [f"k{i}" for i in range(len(keep))]
    picked = docs.select(F.monotonically_increasing_id().alias("rid"), *(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), "text")

    columns = ["rid", "h", "tf", *names, "n_tokens", "head_known", "head_logs", "model"]

    def run(batches):
        v, model = sent.value
        logs = np.log10(v.counts + 1.0) if len(v.counts) else np.zeros(1)
        each_rest = np.log10(v.rest_total + v.rest_types + 1.0)
        held: list[tuple[list, np.ndarray, np.ndarray, np.ndarray]] = []  # columns, inputs, ranks and lengths of texts

        def pooled():
            """Texts of many steps are scored together: alone, the few long ones of a step would go through most of its time side by side with none."""
            cols, symbol, rank, length = zip(*held, strict=True)
            held.clear()
            got = model.score_symbols(np.concatenate(symbol), np.concatenate(rank), np.concatenate([[0], np.cumsum(np.concatenate(length))])) / LOG10
            at = np.cumsum([0, *map(len, length)])
            for c, i, j in zip(cols, at[:-1], at[1:], strict=True):
                yield pa.RecordBatch.from_arrays([*c[:-1], pa.array(got[i:j] + c[-1])], columns)

        def of(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray):
            h, first = tokens(data, offsets)
            n_docs, length = rows.num_rows, np.diff(first)
            doc = np.repeat(np.arange(n_docs), length)
            rank = v.ranks(h)
            known = rank >= 0
            lc = logs[np.maximum(rank, 0)]
            lc[~known] = 0
            rest = rank >= OWN
            by_counts = np.bincount(doc[rest], lc[rest], n_docs) - np.bincount(doc[rest | ~known], minlength=n_docs) * each_rest
            rid = rows.column(0).to_numpy()
            own = mix(rid.astype(np.int64).view(U64) + U64(77))  # a row for the text itself lies anywhere, and adds no word
            cols = [pa.array(rid), pa.array(own.view(np.int64)), pa.array(np.zeros(n_docs, np.int32)), *(rows.column(1 + i) for i in range(len(names)))]
            cols += [pa.array(length), pa.array(np.bincount(doc[known], minlength=n_docs)), pa.array(np.bincount(doc, lc, n_docs))]
            held.append(([*cols, by_counts], model.symbols(h, rank).astype(np.uint16), rank.astype(np.int32), length))
            # words beyond the head: one row for each of a text
            pair_doc, pair_h = doc[~known], h[~known]
            order = np.lexsort((pair_h, pair_doc))
            pair_doc, pair_h = pair_doc[order], pair_h[order]
            at = np.flatnonzero(np.concatenate([[True], (pair_doc[1:] != pair_doc[:-1]) | (pair_h[1:] != pair_h[:-1])])) if len(order) else np.zeros(0, np.int64)
            tf = np.diff(np.append(at, len(order)))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(rid[pair_doc[at]]), pa.array(pair_h[at].view(np.int64)), pa.array(tf.astype(np.int32)), *(pa.nulls(len(at), rows.column(1 + i).type) for i in range(len(names))), *(pa.nulls(len(at), t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64()))], columns)
            if sum(len(x[1]) for x in held) >= POOL:
                yield from pooled()

        yield from by_step(of)(batches)
        if held:
            yield from pooled()

    kinds = [f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(keep, names, strict=True)]
    rows = picked.mapInArrow(run, ", ".join(["rid bigint", "h bigint", "tf int", *kinds, "n_tokens bigint", "head_known bigint", "head_logs double", "model double"]))
    met = rows.join(counts, "h", "left").withColumn("tail", F.when(F.col("tf") > 0, F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + 1)).otherwise(0.0)).withColumn("tail_known", F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0))
    one = met.groupBy("rid").agg(*(F.max(n).alias(n) for n in names), F.max("n_tokens").alias("n_tokens"), F.max("head_known").alias("head_known"), F.max("head_logs").alias("head_logs"), F.max("model").alias("model"), F.sum("tail").alias("tail"), F.sum("tail_known").alias("tail_known"))
    each = float(np.log10(v.total + v.types + 1.0))
    return one.select(
        *(F.col(n).alias(c) for c, n in zip(keep, names, strict=True)), "n_tokens", (F.col("head_known") + F.col("tail_known")).alias("n_known"), F.lit(v.total).cast("bigint").alias("train_tokens"),
        (F.col("head_logs") + F.col("tail") - F.col("n_tokens") * each).alias("base_score"), (F.col("model") + F.col("tail")).alias("score"),
    )
