"""Toxicity classifier with counterfactual regularisation.

Features of a text are the presence of words (runs of word characters, A-Z as
a-z) and of word beginnings (5 to 10 bytes, for inflected and compound words)
of a vocabulary: those whose share among toxic and other labelled texts differs
by a clear margin (a likelihood ratio of ``Z`` standard errors), and all
identity terms.  A logistic model is fitted on them.  Every labelled text
that names a group is also seen with its identity terms swapped for those of
other groups of the same kind, and the fit penalises the squared change of the
logit (weight ``penalty``), so that naming a group moves a score by next to
nothing and neutral mentions are not taken for insults.

Fitting uses at most ``BOUND`` labelled documents of either label (smallest
hashes of their ids; of rows that repeat an id one text, the one with the
smallest hash), in one task; scoring covers every whole text.  Scores
see the text only.

Cases.  Null or empty text: the score of a text without known words.
Documents labelled both ways count as toxic.  No toxic or no other labels:
every score is the share of toxic labels (0.0 without any).  Rows that repeat
a ``doc_id`` are scored each; null ``doc_id`` is not held out.  Empty table:
no rows.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import MULTIPLIERS, byte_view, classes, same_type, slices, stored, word_hashes, word_spans

BOUND = 8_000  # labelled documents of either label used at most
VOCABULARY = 4_096
STEMS = (5, 6, 7, 8, 10)
Z = 4.0  # standard errors by which a term must tell the labels apart
PENALTY = 1.0

# fixed values: identity terms, each line one kind (of one language) whose terms replace each other
IDENTITY = [
    "women men", "woman man", "female male", "girl boy", "girls boys", "she he",
    "muslim christian jewish hindu buddhist atheist", "muslims christians jews hindus buddhists atheists",
    "black white asian latino african european", "gay straight lesbian bisexual transgender",
    "immigrant native refugee", "immigrants natives refugees", "disabled deaf blind autistic", "old young elderly",
    "american mexican chinese indian russian turkish polish german french",
    # French
    "femmes hommes", "femme homme", "fille garçon", "filles garçons", "elle il",
    "musulman chrétien juif hindou bouddhiste athée", "musulmans chrétiens juifs hindous bouddhistes athées",
    "noir blanc asiatique arabe africain européen", "homosexuel hétérosexuel bisexuel transgenre", "immigré réfugié étranger",
    "immigrés réfugiés étrangers", "handicapé sourd aveugle autiste", "jeune vieux âgé", "américain mexicain chinois indien russe turc polonais allemand français",
    # German
    "frauen männer", "frau mann", "mädchen junge", "sie er", "muslim christ jude hindu buddhist atheist",
    "muslime christen juden hindus buddhisten atheisten", "schwarze weiße asiaten araber afrikaner europäer",
    "schwul lesbisch hetero bisexuell transgender", "einwanderer flüchtling ausländer", "behindert taub blind autistisch", "alt jung",
    "amerikaner mexikaner chinese inder russe türke pole deutscher franzose",
    # Spanish
    "mujeres hombres", "mujer hombre", "niña niño", "niñas niños", "ella él", "musulmán cristiano judío hindú budista ateo",
    "musulmanes cristianos judíos hindúes budistas ateos", "negro blanco asiático árabe africano europeo", "gay heterosexual lesbiana bisexual transgénero",
    "inmigrante refugiado extranjero", "inmigrantes refugiados extranjeros", "discapacitado sordo ciego autista", "joven viejo anciano",
    "americano mexicano chino indio ruso turco polaco alemán francés",
]
_WORDS = classes("", True)
_LETTERS = np.where([(48 <= b < 58) or (65 <= b < 91) or b == 95 or (97 <= b < 123) or b >= 128 for b in range(256)], 1, 0).astype(np.uint8)
_TABLE = (_LETTERS, _WORDS[1])


def word_keys(words: list[str]) -> np.ndarray:
    data, bounds = byte_view(pa.array(words, pa.string()))
    return word_hashes(data, bounds[:-1], bounds[1:], _TABLE[1])


def terms(col):
    """Per slice: first row, rows, hashes of words and of the beginnings of longer words, and each one's row."""
    data, bounds = byte_view(col)
    for i, j in slices(bounds):
        part, edge = data[bounds[i]: bounds[j]], bounds[i: j + 1] - bounds[i]
        starts, ends, rows = word_spans(part, edge, _TABLE[0])
        found, of = [word_hashes(part, starts, ends, _TABLE[1])], [rows]
        for size in STEMS:
            longer = np.flatnonzero(ends - starts > size)
            found.append(word_hashes(part, starts[longer], starts[longer] + size, _TABLE[1]) ^ MULTIPLIERS[4])
            of.append(rows[longer])
        yield i, j - i, np.concatenate(found), np.concatenate(of)


def presence(col):
    """Per slice: first row, rows, and the distinct (row, term hash) of its texts."""
    for first, n, words, rows in terms(col):
        order = np.lexsort((words, rows))
        words, rows = words[order], rows[order]
        new = np.ones(len(words), bool)
        new[1:] = (words[1:] != words[:-1]) | (rows[1:] != rows[:-1])
        yield first, n, rows[new], words[new]


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    """Whether the CRC-32 of the id as text falls into the fold that is never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("long").cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def vocabulary(rows: np.ndarray, words: np.ndarray, toxic: np.ndarray, most: int = VOCABULARY) -> np.ndarray:
    """Term hashes that tell the labels apart, and every identity term, sorted."""
    keys, at = np.unique(words, return_inverse=True)
    pos = np.bincount(at, weights=toxic[rows], minlength=len(keys))
    neg = np.bincount(at, weights=~toxic[rows], minlength=len(keys))
    p, n = toxic.sum(), (~toxic).sum()
    # root of the likelihood ratio of the two-by-two table: about normal where labels and term are unrelated
    ratio = np.zeros(len(keys))
    for seen, whole in ((pos, p), (neg, n)):
        for part, share in ((seen, (pos + neg) / (p + n)), (whole - seen, 1 - (pos + neg) / (p + n))):
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio += np.where(part > 0, part * np.log(part / (whole * share)), 0.0)
    z = np.sqrt(2 * np.maximum(ratio, 0))
    strong = np.flatnonzero(np.abs(z) >= Z)
    strong = strong[np.argsort(-np.abs(z[strong]), kind="stable")][:most]
    return np.unique(np.concatenate([keys[strong], word_keys(" ".join(IDENTITY).split())]))


def term_features(term: str, at: dict[int, int]) -> set[int]:
    """Vocabulary places of a word and of its beginnings."""
    _, _, _, found = next(presence(pa.array([term], pa.string())))
    return {at[int(k)] for k in found if int(k) in at}


def swaps(rows: np.ndarray, cols: np.ndarray, names: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Counterfactual changes: for each text that names a group, (features, -1 or +1) with its terms replaced by others of their kind."""
    at = {int(k): i for i, k in enumerate(names.tolist())}
    kinds = [[(at[int(k)], term_features(t, at)) for k, t in zip(word_keys(line.split()), line.split())] for line in IDENTITY]
    of: dict[int, tuple[int, int]] = {}
    for k, line in enumerate(kinds):  # a term that two languages share stands with the kind that is listed first
        for i, (c, _) in enumerate(line):
            of.setdefault(c, (k, i))
    own: dict[int, set[int]] = {}
    for r, c in zip(rows.tolist(), cols.tolist()):
        if c in of:
            own.setdefault(r, set()).add(c)
    out = []
    for present in own.values():
        for turn in range(1, max(len(kinds[of[c][0]]) for c in present)):
            before, after = set(), set()
            for c in present:
                kind, place = kinds[of[c][0]], of[c][1]
                before |= kind[place][1]
                after |= kind[(place + turn) % len(kind)][1]
            gone, come = sorted(before - after), sorted(after - before)
            if gone or come:
                out.append((np.array(gone + come), np.array([-1.0] * len(gone) + [1.0] * len(come))))
    return out


def fit_logistic(rows, cols, y, width: int, changes, penalty: float = PENALTY, ridge: float = 1e-3, steps: int = 300):
    """Weights and bias of a logistic model over binary features, by gradient steps with momentum (Adam)."""
    n, w = len(y), np.zeros(width + 1)
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    w[-1] = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    if changes:
        ci = np.concatenate([c for c, _ in changes])
        cv = np.concatenate([s for _, s in changes])
        cr = np.repeat(np.arange(len(changes)), [len(c) for c, _ in changes])
    for step in range(1, steps + 1):
        logit = w[-1] + np.bincount(rows, weights=w[cols], minlength=n)
        error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / n
        g = np.append(np.bincount(cols, weights=error[rows], minlength=width), error.sum())
        g[:-1] += ridge * w[:-1] / 10
        if changes:
            move = np.bincount(cr, weights=w[ci] * cv, minlength=len(changes))
            g[:-1] += 2 * penalty * np.bincount(ci, weights=cv * move[cr], minlength=width) / len(changes)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return w[:-1], float(w[-1])


def train(texts: pa.Array, toxic: np.ndarray, prior: float, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray, float]:
    """Vocabulary, weights and bias; ``prior``: share of toxic among all labels (the sample may be balanced)."""
    rows, words = [], []
    for first, _, r, w in presence(texts):
        rows.append(r + first)
        words.append(w)
    rows, words = np.concatenate(rows), np.concatenate(words)
    names = vocabulary(rows, words, toxic)
    at = np.minimum(np.searchsorted(names, words), len(names) - 1)
    hit = names[at] == words
    rows, cols = rows[hit], at[hit]
    weight, bias = fit_logistic(rows, cols, toxic.astype(float), len(names), swaps(rows, cols, names), penalty)
    share = toxic.mean()
    return names, weight, bias + np.log(prior / (1 - prior)) - np.log(share / (1 - share))


def labelled(labels: DataFrame, bound: int = BOUND) -> tuple[DataFrame, float]:
    """At most ``bound`` learnable ids of either label, and the share of toxic among all learnable labels."""
    own = same_type(labels, {"doc_id": "long", "toxic": "int"}).dropna().where(~held_out(F.col("doc_id"))).where("toxic IN (0, 1)")
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, pos = own.agg(F.count("*"), F.sum("toxic")).first()
    pick = [own.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound) for k in (0, 1)]
    return pick[0].unionByName(pick[1]), (pos or 0) / n if n else 0.0


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", bound: int = BOUND, penalty: float = PENALTY):
    """``(words, weights, bias)``; without both labels no words and a constant."""
    sample, prior = labelled(labels, bound)
    if not 0 < prior < 1:
        return np.zeros(0, np.uint64), np.zeros(0), float(np.log((prior + 1e-9) / (1 - prior + 1e-9)))
    sample = stored(sample, "toxic-sample")  # at most 2 * bound rows
    src = same_type(docs, {doc_id: "long", text: "string"}).withColumnRenamed(doc_id, "doc_id").join(F.broadcast(sample), "doc_id")

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        toxic = table.column("toxic").to_numpy() == 1
        if toxic.all() or not toxic.any():
            names, weight, bias = np.zeros(0, np.uint64), np.zeros(0), float(np.log(prior / (1 - prior)))
        else:
            names, weight, bias = train(table.column(text), toxic, prior, penalty)
        return pa.table({"names": pa.array([names.tobytes()], pa.binary()), "weights": pa.array([weight.tobytes()], pa.binary()), "bias": [bias]})

    # one text an id, however often it is repeated, chosen where the rows lie
    once = src.groupBy("doc_id").agg(F.min_by(text, F.xxhash64(text)).alias(text), F.max("toxic").alias("toxic"))
    rows = once.groupBy(F.lit(0).alias("one")).applyInArrow(
        lambda t: learn(t), "names binary, weights binary, bias double").collect()
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(0), float(np.log(prior / (1 - prior)))
    return np.frombuffer(rows[0][0], np.uint64), np.frombuffer(rows[0][1]), rows[0][2]


def logits(col, names: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    out = []
    for _, n, words, rows in terms(col):
        total = np.full(n, bias)
        if len(names):
            at = np.minimum(np.searchsorted(names, words), len(names) - 1)
            hit = names[at] == words
            once = np.unique(rows[hit] * len(names) + at[hit])
            total = total + np.bincount(once // len(names), weights=weights[once % len(names)], minlength=n)
        out.append(total)
    return np.concatenate(out) if out else np.zeros(0)


def score(docs: DataFrame, model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    names, weights, bias = model

    def run(batches):
        for batch in batches:
            s = 1 / (1 + np.exp(-np.clip(logits(batch.column(2), names, weights, bias), -60, 60)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                                             ["doc_id", "held_out", "score", "predicted"])

    src = same_type(docs, {doc_id: "long", text: "string"})
    return src.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), text).mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int")
