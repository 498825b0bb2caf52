"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a text forwards and backwards, white space and
all, labels every byte position with a distribution over the learned languages,
and a document's probabilities are the mean over all its positions: whole
texts count, however long.  A long text is read in pieces of whole characters
of about ``PIECE`` bytes; each direction starts ``CONTEXT`` bytes outside its
piece, so positions at a piece's ends have words before and after them like
others, and no position counts twice.

Training is plain numpy: backpropagation through time over windows of
``WINDOW`` bytes, Adam, a fixed seed.  It learns from at most ``BOUND``
documents of each language (smallest hashes of their ids; of rows that repeat an
id one text, the one with the smallest hash), in one task; the weights (about
three thousand numbers) travel to the tasks that predict.  Every language that a
learnable row names is learned.

Cases.  Null text, or a text without a letter: ``und``, score 0.0.  Nothing to
learn from: ``und`` for all.  Repeated rows are predicted each.  A null
``doc_id`` is not held out.  Empty table: no rows.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiforge.llm.common import byte_view, same_type, slices, stored

BOUND = 600  # documents of each language that are learned from at most
HIDDEN, EMBED = 8, 8
WINDOW, STEPS, BATCH = 48, 800, 128
PIECE, CONTEXT = 448, 32  # bytes of a text that are read as one, and bytes around them that are read on the way
TOGETHER = 1 << 19  # positions that are read at a time


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class ByteGRU:
    """Two gated recurrent layers (one per direction) over byte embeddings and a softmax at every position."""

    def __init__(self, languages: int, hidden: int = HIDDEN, embed: int = EMBED, seed: int = 7):
        rng = np.random.default_rng(seed)
        scale = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"e": scale(256, embed) * 8, "o": scale(2 * hidden, languages), "c": np.zeros(languages, np.float32)}
        for d in "fb":
            self.p |= {d + "x": scale(embed, 3 * hidden), d + "h": scale(hidden, 3 * hidden), d + "b": np.zeros(3 * hidden, np.float32)}
        self.hidden = hidden

    def _run(self, d: str, x: np.ndarray, on: np.ndarray, keep: bool):
        """States (batch, time, hidden) of one direction; positions that are off keep the state."""
        n, t, _ = x.shape
        H = self.hidden
        order = range(t) if d == "f" else range(t - 1, -1, -1)
        gates = x @ self.p[d + "x"] + self.p[d + "b"]
        h, out, tape = np.zeros((n, H), np.float32), np.zeros((n, t, H), np.float32), {}
        wh = self.p[d + "h"]
        for k in order:
            zr = sigmoid(gates[:, k, : 2 * H] + h @ wh[:, : 2 * H])
            z, r = zr[:, :H], zr[:, H:]
            rh = r * h
            c = np.tanh(gates[:, k, 2 * H:] + rh @ wh[:, 2 * H:])
            new = np.where(on[:, k: k + 1], h + z * (c - h), h)
            if keep:
                tape[k] = (h, z, r, c, rh)
            h = new
            out[:, k] = h
        return out, tape

    def probabilities(self, words: np.ndarray, on: np.ndarray, tape: bool = False):
        """Distribution over languages at every position of padded words (batch, time)."""
        x = self.p["e"][words]
        f, tf = self._run("f", x, on, tape)
        b, tb = self._run("b", x, on, tape)
        both = np.concatenate([f, b], 2)
        logit = both @ self.p["o"] + self.p["c"]
        q = np.exp(logit - logit.max(2, keepdims=True))
        q /= q.sum(2, keepdims=True)
        return (q, x, both, tf, tb) if tape else q

    def gradients(self, words: np.ndarray, on: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Backpropagation through time of the mean cross-entropy over positions that are on."""
        q, x, both, tf, tb = self.probabilities(words, on, True)
        n, t, H = len(words), words.shape[1], self.hidden
        d = q.copy()
        d[np.arange(n), :, label] -= 1
        d *= on[:, :, None] / on.sum()
        g = {"o": np.tensordot(both, d, ([0, 1], [0, 1])), "c": d.sum((0, 1)), "e": np.zeros_like(self.p["e"])}
        back, dx = d @ self.p["o"].T, np.zeros_like(x)
        for name, tape, dout in (("f", tf, back[:, :, :H]), ("b", tb, back[:, :, H:])):
            wx, wh = self.p[name + "x"], self.p[name + "h"]
            gx, gh, gb = np.zeros_like(wx), np.zeros_like(wh), np.zeros(3 * H, np.float32)
            dh = np.zeros((n, H), np.float32)
            for k in (range(t - 1, -1, -1) if name == "f" else range(t)):
                h, z, r, c, rh = tape[k]
                live = on[:, k: k + 1]
                total = dh + dout[:, k]
                dnew = total * live
                dc = dnew * z * (1 - c * c)
                dz = dnew * (c - h) * z * (1 - z)
                drh = dc @ wh[:, 2 * H:].T
                dr = drh * h * r * (1 - r)
                dgate = np.concatenate([dz, dr, dc], 1)
                gx += x[:, k].T @ dgate
                gb += dgate.sum(0)
                gh[:, : 2 * H] += h.T @ dgate[:, : 2 * H]
                gh[:, 2 * H:] += rh.T @ dc
                dx[:, k] += dgate @ wx.T
                dh = total * ~live + dnew * (1 - z) + drh * r + dgate[:, : 2 * H] @ wh[:, : 2 * H].T
            g |= {name + "x": gx, name + "h": gh, name + "b": gb}
        np.add.at(g["e"], words.ravel(), dx.reshape(-1, dx.shape[2]))
        return g


def padded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words as rows of bytes, and which positions are theirs."""
    length = ends - starts
    t = int(length.max())
    at = starts[:, None] + np.arange(t)
    on = np.arange(t) < length[:, None]
    return np.where(on, data[np.minimum(at, len(data) - 1)], 0), on


def train(texts: pa.Array, label: np.ndarray, languages: int, steps: int = STEPS, batch: int = BATCH, seed: int = 7) -> ByteGRU:
    """Fit on windows of the texts, languages drawn evenly."""
    data, bounds = byte_view(texts)
    low, size = bounds[:-1], np.diff(bounds)
    pool = [np.flatnonzero((label == k) & (size > 0)) for k in range(languages)]
    pool = [p for p in pool if len(p)]
    net, rng = ByteGRU(languages, seed=seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(p, -(-batch // len(pool))) for p in pool])
        starts = low[pick] + (rng.random(len(pick)) * (np.maximum(size[pick] - WINDOW, 0) + 1)).astype(np.int64)
        starts = whole(data, starts, low[pick] + size[pick] - 1)
        words, on = padded(data, starts, np.minimum(starts + WINDOW, low[pick] + size[pick]))
        rate = 0.01 * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in net.gradients(words, on, label[pick]).items():
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            net.p[k] -= (rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return net


def whole(data: np.ndarray, at: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Places moved on to where a character starts (``most`` at last)."""
    for _ in range(3):
        inside = (data[np.minimum(at, len(data) - 1)] & 0xC0) == 0x80
        at = np.minimum(at + inside, most)
    return at


class Reader:
    """A network's sums over positions, without its tape: a byte's share of the gates is looked up."""

    def __init__(self, net: ByteGRU, languages: int):
        self.languages, self.hidden, self.bias = languages, net.hidden, net.p["c"]
        self.side = []
        for k, d in enumerate("fb"):
            gates = (net.p["e"] @ net.p[d + "x"] + net.p[d + "b"]).astype(np.float32)
            hidden, out = net.p[d + "h"], net.p["o"][k * net.hidden: (k + 1) * net.hidden]
            self.side.append((gates, hidden[:, : 2 * net.hidden].copy(), hidden[:, 2 * net.hidden:].copy(), out))

    def _side(self, which: int, words: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Logits (time, piece, language) of one direction over pieces in falling order of length, the first ``live[t]`` at step t."""
        gates, wzr, wc, out = self.side[which]
        H, (t, n) = self.hidden, words.shape
        h, logits = np.zeros((n, H), np.float32), np.zeros((t, n, self.languages), np.float32)
        for k in range(t):
            m = live[k]
            own, g = h[:m], gates[words[k, :m]]
            zr = own @ wzr
            zr += g[:, : 2 * H]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            c = (zr[:, H:] * own) @ wc
            c += g[:, 2 * H:]
            np.tanh(c, out=c)
            c -= own
            c *= zr[:, :H]
            own += c
            logits[k, :m] = own @ out
        return logits

    def sums(self, data: np.ndarray, low: np.ndarray, high: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Sum of the distributions at positions first..last of pieces that are read from low to high."""
        total = np.zeros((len(low), self.languages), np.float32)
        order = np.argsort(low - high, kind="stable")
        lo = 0
        while lo < len(order):
            t = int(high[order[lo]] - low[order[lo]])
            part = order[lo: lo + max(TOGETHER // t, 1)]
            lo += len(part)
            size, step = high[part] - low[part], np.arange(t)[:, None]
            live = np.searchsorted(-size, -np.arange(t), "left")  # pieces longer than the step
            ahead = data[np.minimum(low[part] + step, len(data) - 1)]
            back = data[np.maximum(high[part] - 1 - step, 0)]
            f, b = self._side(0, ahead, live), self._side(1, back, live)
            logit = f + b[np.maximum(size - 1 - step, 0), np.arange(len(part))] + self.bias
            logit -= logit.max(2, keepdims=True)
            q = np.exp(logit, out=logit)
            q /= q.sum(2, keepdims=True)
            at = low[part] + step
            q *= ((at >= first[part]) & (at < last[part]))[:, :, None]
            total[part] = q.sum(0)
        return total


def pieces(data: np.ndarray, bounds: np.ndarray, piece: int = PIECE, context: int = CONTEXT):
    """Pieces of whole characters of all rows: row, first and end byte, and where reading starts and ends."""
    size = np.diff(bounds)
    n = -(-size // piece)
    row = np.repeat(np.arange(len(size)), n)
    low, high = bounds[:-1][row], bounds[1:][row]
    turn = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    first = whole(data, low + turn * piece, high)
    last = whole(data, np.minimum(low + (turn + 1) * piece, high), high)
    return row, first, last, whole(data, np.maximum(first - context, low), first), whole(data, np.minimum(last + context, high), high)


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    """Whether the CRC-32 of the id as text falls into the fold that is never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("long").cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", bound: int = BOUND, steps: int = STEPS):
    """Learned languages and the network (None if there is nothing to learn from)."""
    src = same_type(docs, {doc_id: "long", text: "string", lang: "string"}).select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(
        ~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    names = sorted(r[0] for r in src.select("lang").distinct().collect())  # as many as there are languages
    if not names:
        return [], None
    ranked = src.select("doc_id", "lang").distinct().select("doc_id", "lang", F.row_number().over(
        Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")).alias("k")).where(F.col("k") <= bound)
    sample = stored(ranked.select("doc_id", "lang"), "lang-sample")  # at most bound rows a language

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("lang", "ascending"), ("doc_id", "ascending"), ("text", "ascending")])
        label = np.searchsorted(np.array(names), np.array(table.column("lang").to_pylist()))
        if not any(len((t or "").split()) for t in table.column("text").to_pylist()):
            return pa.table({"name": pa.array([], pa.string()), "shape": pa.array([], pa.list_(pa.int32())), "values": pa.array([], pa.binary())})
        net = train(table.column("text"), label, len(names), steps)
        return pa.table({"name": list(net.p), "shape": pa.array([list(v.shape) for v in net.p.values()], pa.list_(pa.int32())),
                         "values": pa.array([v.tobytes() for v in net.p.values()], pa.binary())})

    # one text an id and language, however often it is repeated, chosen where the rows lie
    once = src.join(F.broadcast(sample), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = once.groupBy(F.lit(0).alias("one")).applyInArrow(
        lambda t: learn(t), "name string, shape array<int>, values binary").collect()
    if not rows:
        return [], None
    net = ByteGRU(len(names))
    net.p = {r["name"]: np.frombuffer(r["values"], np.float32).reshape(r["shape"]).copy() for r in rows}
    return names, net


def predict(docs: DataFrame, model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row."""
    names, net = model
    src = same_type(docs, {doc_id: "long", text: "string"})
    src = src.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"),
                     F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    if net is None:
        return src.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches):
        reader = Reader(net, len(names))
        for batch in batches:
            data, bounds = byte_view(batch.column(2))
            total = np.zeros((batch.num_rows, len(names)))
            for i, j in slices(bounds):
                part, edge = data[bounds[i]: bounds[j]], bounds[i: j + 1] - bounds[i]
                if not len(part):
                    continue
                row, first, last, low, high = pieces(part, edge)
                sums = reader.sums(part, low, high, first, last)
                for k in range(len(names)):
                    total[i:j, k] = np.bincount(row, weights=sums[:, k], minlength=j - i)
            letters = np.asarray(batch.column(3))
            share = total / np.maximum(np.diff(bounds), 1)[:, None]
            best = share.argmax(1)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(np.where(letters, np.array([*names], object)[best], "und"), pa.string()),
                pa.array(np.where(letters, np.clip(share[np.arange(len(best)), best], 0, 1), 0.0))], ["doc_id", "held_out", "lang_pred", "score"])

    return src.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
