"""Toxicity by weak supervision.

Labels are used to find and to test voters, never as votes.  Texts are folded
first, so that disguised words are words again.  Lexicon voters are groups of
byte grams that begin words of toxic rows significantly more often, in both
halves of the training rows; where a gram inside of words marks as well, it
counts there too.  Other voters look at doses of lexicon grams, at hidden
letters and at patterns of shouting and symbols.  A generative model with a
hidden class, a table of votes by class and n-gram profile for each voter, and
a tree of dependences between voters (Chow-Liu on conditional mutual
information) is fitted by EM.  Its posteriors are the targets of a logistic
regression on counts of grams and pattern rates, which scores all texts.
"""

from __future__ import annotations

import itertools
import math
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import folding
from .common import small_batches, unit
from .langid import fold
from .shingles import bounded, shingle_sets, text_bytes

#: Labelled rows of each label that training reads (expected number, by the hash of doc_id).
TRAIN_ROWS = 4000
#: A lexicon gram marks this many toxic training rows at least (near copies count once), in each half so many times as large a share of the toxic rows as of the clean ones,
#: and its log-likelihood ratio exceeds the log of the number of grams tested by OVER_CHANCE nats; of more than MOST_ENTRIES such grams the strongest are the model.
LEAST_ROWS, LEAST_LIFT, OVER_CHANCE, MOST_ENTRIES = 5, 2.0, 3.0, 400
#: Lexicon voters; each has grams of every strength.
GROUPS = 32
#: Groups of training texts by their letters' pairs, and hashed pairs.
PROFILES, PAIRS = 8, 128
#: Steps of the label model and of the regression, after which they warn that they have not settled.
EM_STEPS, NEWTON_STEPS = 500, 100
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_PATTERNS = (b"!?", b"#$%&*@^|~<>=+\\", b"0123456789", bytes(range(65, 91)))


def pattern_rates(column: pa.Array) -> np.ndarray:
    """texts x 4: exclamation and question marks, symbols, digits, ASCII capitals (each as a share of the text's bytes)."""
    data, starts = text_bytes(column)
    out = np.zeros((len(starts) - 1, len(_PATTERNS)))
    length = np.maximum(np.diff(starts) - 1, 1)
    for i, chars in enumerate(_PATTERNS):
        table = np.zeros(256, dtype=bool)
        table[list(chars)] = True
        sums = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
        out[:, i] = (sums[starts[1:]] - sums[starts[:-1]]) / length
    return out


def pair_profile(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """texts x PAIRS: roots of the shares of hashed pairs of neighbouring bytes of folded texts."""
    pairs = (data[:-1].astype(np.uint64) << np.uint64(8)) | data[1:]
    slot = (pairs * _SPREAD >> np.uint64(57)).astype(np.int64)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    # The pair of each byte and the one before it: the first text begins behind a space.
    out = np.bincount(text * PAIRS + slot[starts[0] - 1 :], minlength=(len(starts) - 1) * PAIRS).reshape(-1, PAIRS)
    return np.sqrt(out / np.maximum(out.sum(axis=1, keepdims=True), 1))


def _letters(raw: bytes) -> list[int]:
    """Places of a gram's ASCII letters behind its first letter."""
    return [j for j in range(1, len(raw)) if 97 <= raw[j] <= 122 and raw[j - 1] != folding.SPACE]


def misspelt(gram: int) -> list[int]:
    """A gram of six letters or more with two neighbouring letters swapped or one left out, never the first."""
    raw = folding.as_bytes(gram)
    inner = _letters(raw)
    if len(raw.strip()) < 6:
        return []
    found = {raw[:j] + raw[j + 1 :] for j in inner}
    found |= {raw[:j] + raw[j + 1 : j + 2] + raw[j : j + 1] + raw[j + 2 :] for j in inner if j + 1 in inner}
    return sorted(int.from_bytes(x, "little") for x in found - {raw})


class Lexicon:
    """Grams; each also with one or, from five letters on, two of its ASCII letters but the first hidden, and in the misspellings given.

    A gram marks a text that has it least_times, and in each word least_share times or more; one that counts inside of words
    must begin a word, or be there twice.
    """

    def __init__(self, grams: list[int], least_times: np.ndarray | None = None, least_share: np.ndarray | None = None, spellings: dict[int, list[int]] | None = None):
        self.grams = grams
        self.least_times = np.ones(len(grams)) if least_times is None else least_times
        self.least_share = np.zeros(len(grams)) if least_share is None else least_share
        found: dict[int, dict[int, int]] = {}
        for i, g in enumerate(grams):
            found.setdefault(len(folding.as_bytes(g)), {})[g] = i
        for count in (1, 2):
            for i, g in enumerate(grams):
                raw = folding.as_bytes(g)
                if count == 2 and len(raw.strip()) < 5:
                    continue
                for places in itertools.combinations(_letters(raw), count):
                    code = int.from_bytes(bytes(folding.HIDDEN if j in places else x for j, x in enumerate(raw)), "little")
                    found[len(raw)].setdefault(code, i)
        for i, g in enumerate(grams):
            for code in (spellings or {}).get(g, []):
                found.setdefault(len(folding.as_bytes(code)), {}).setdefault(code, i)
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n, entries in found.items():
            codes = np.array(sorted(entries), np.uint64)
            table = np.zeros(1 << 16, dtype=bool)
            table[(codes * _SPREAD) >> np.uint64(48)] = True
            self.by_size[n] = codes, np.array([entries[int(c)] for c in codes]), table

    def hits(self, data: np.ndarray, starts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of folded texts: text, entry that marks it and number of occurrences, one row a text and entry, in this order."""
        texts, entries, begins = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, bool)]
        for n, (codes, index, table) in self.by_size.items():
            here = folding.packed(data, n)
            place = np.flatnonzero(table[(here * _SPREAD) >> np.uint64(48)])
            at = np.searchsorted(codes, here[place])
            at[at == len(codes)] = 0
            right = codes[at] == here[place]
            place = place[right]
            texts.append(np.searchsorted(starts, place + 1, side="right") - 1)
            entries.append(index[at[right]])
            begins.append((data[place] == folding.SPACE) | (data[np.maximum(place - 1, 0)] == folding.SPACE))
        size = max(len(self.grams), 1)
        both, row, times = np.unique(np.concatenate(texts) * size + np.concatenate(entries), return_inverse=True, return_counts=True)
        text, entry = both // size, both % size
        begun = np.bincount(row, weights=np.concatenate(begins), minlength=len(both)) > 0
        marks = (times >= self.least_times[entry]) & (times >= self.least_share[entry] * words[text]) & (begun | (times > 1)) if len(both) else np.empty(0, bool)
        return text[marks], entry[marks], times[marks]


class Seen:
    """What the model sees of a column of texts: marks of the lexicon, words, hidden letters, pattern rates."""

    def __init__(self, lexicon: Lexicon, column: pa.Array):
        data, starts = folding.folded(column)
        self.n = len(starts) - 1
        self.words = np.maximum(folding.n_words(data, starts), 1)
        self.text, self.entry, self.times = lexicon.hits(data, starts, self.words)
        sums = np.concatenate([[0], np.cumsum(data == folding.HIDDEN)])
        self.hidden = np.minimum(sums[starts[1:]] - sums[starts[:-1]], 1)
        self.rates = pattern_rates(column)
        self.folded = data, starts

    def numbers(self) -> np.ndarray:
        total, kinds = np.bincount(self.text, weights=self.times, minlength=self.n), np.bincount(self.text, minlength=self.n)
        return numbers_of(total, kinds, self.words, self.hidden, self.rates)


def numbers_of(total: np.ndarray, kinds: np.ndarray, words: np.ndarray, hidden: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """texts x NUMBERS: log of 1 + occurrences, log of 1 + kinds, share of the words (capped), hidden letters, pattern rates."""
    return np.column_stack([np.log1p(total), np.log1p(kinds), 10 * np.minimum(total / words, 0.25), hidden, rates])


NUMBERS = 4 + len(_PATTERNS)


def votes(dense: np.ndarray, numbers: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """texts x voters: 0 abstains, 1 votes clean, 2 votes toxic; dense: texts x entries, the strongest entries first."""
    out = []
    for g in range(min(groups, dense.shape[1])):
        out.append(np.where(dense[:, g::groups].any(axis=1), 2, 0))
    total, kinds, share, hidden, patterns = numbers[:, 0], numbers[:, 1], numbers[:, 2], numbers[:, 3], numbers[:, 4:]
    out.append(np.where(total > np.log1p(2.5), 2, np.where(total == 0, 1, 0)))
    out.append(np.where(kinds > np.log1p(1.5), 2, np.where(kinds == 0, 1, 0)))
    out += [np.where(share > s, 2, np.where(share == 0, 1, 0)) for s in (0.1, 0.3)]
    out.append(np.where((hidden > 0) & (total > 0), 2, 0))
    out += [np.where(patterns[:, i] > s, 2, 0) for i, s in enumerate((0.02, 0.05, 0.05, 0.3))]
    return np.column_stack(out).astype(np.int8)


def tested(v: np.ndarray, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which voters say toxic of a larger share of the rows labelled toxic than of the clean ones; the others are left out."""
    toxic, clean = weight * (label == 1), weight * (label == 0)
    return (v == 2).T @ toxic / max(toxic.sum(), 1e-9) > (v == 2).T @ clean / max(clean.sum(), 1e-9)


def majority(v: np.ndarray) -> np.ndarray:
    """First posteriors: the share of toxic votes among the votes, 0.1 without any."""
    toxic, clean = (v == 2).sum(axis=1), (v == 1).sum(axis=1)
    return np.clip((toxic + 0.1) / (toxic + clean + 1.0), 0.02, 0.98)


def profiles(x: np.ndarray, k: int = PROFILES, steps: int = 20) -> np.ndarray:
    """Group of each row of pair profiles (k-means from farthest points, ties to the first)."""
    if not len(x):
        return np.empty(0, np.int64)
    centres = [x.mean(axis=0)]
    for _ in range(k):
        far = np.min([((x - c) ** 2).sum(axis=1) for c in centres[-k:]], axis=0)
        centres.append(x[far.argmax()])
    centres = np.stack(centres[1:])
    for _ in range(steps):
        group = ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
        new = np.stack([x[group == g].mean(axis=0) if (group == g).any() else centres[g] for g in range(k)])
        if np.allclose(new, centres):
            break
        centres = new
    return group


def _tree(joint: list[tuple[np.ndarray, float]], j: int) -> list[tuple[int, int | None]]:
    """Voters and their parents, parents first: the heaviest spanning tree by mutual information given the class."""
    info = np.zeros((j, j))
    for table, mass in joint:
        p = (table.reshape(j, 3, j, 3).transpose(0, 2, 1, 3) + 0.1) / (mass + 0.9)
        info += mass * (p * np.log(p / (p.sum(axis=3, keepdims=True) * p.sum(axis=2, keepdims=True)))).sum(axis=(2, 3))
    order, inside, best, parent = [(0, None)], {0}, info[0].copy(), np.zeros(j, dtype=int)
    while len(inside) < j:
        k = max((i for i in range(j) if i not in inside), key=lambda i: best[i])
        inside.add(k)
        order.append((k, int(parent[k])))
        closer = info[k] > best
        best[closer], parent[closer] = info[k][closer], k
    return order


def label_model(v: np.ndarray, start: np.ndarray, weight: np.ndarray, profile: np.ndarray | None = None) -> np.ndarray:
    """P(class 1) of each row of votes by EM on a hidden class and a tree of voters; start: first posteriors.

    Votes' tables belong to a class and a profile, so that voters of one language say nothing by their silence about texts of another.
    """
    n, j = v.shape
    profile = np.zeros(n, dtype=np.int64) if profile is None else profile
    hot = np.zeros((n, 3 * j))
    hot[np.arange(n)[:, None], v + 3 * np.arange(j)] = 1.0
    members = [np.flatnonzero(profile == p) for p in range(int(profile.max()) + 1 if n else 0)]
    q, tree = start.copy(), None
    for step in range(EM_STEPS):
        share = float((weight * q).sum() / weight.sum())
        joint = {}
        for p, rows in enumerate(members):
            for y in (0, 1):
                w = weight[rows] * (q[rows] if y else 1 - q[rows])
                joint[p, y] = (hot[rows] * w[:, None]).T @ hot[rows], float(w.sum())
        if tree is None or step == 5:
            tree = _tree([(sum(joint[p, y][0] for p in range(len(members))), sum(joint[p, y][1] for p in range(len(members)))) for y in (0, 1)], j)
        new = np.zeros(n)
        for p, rows in enumerate(members):
            if not len(rows):
                continue
            log = []
            for y in (0, 1):
                table, mass = joint[p, y]
                total = np.full(len(rows), np.log(mass + 4 * (share if y else 1 - share) + 1e-9))
                for k, up in tree:
                    # Smoothed, given the parent towards the voter's own table, so that rare votes of the parent say little.
                    own = np.diag(table)[3 * k : 3 * k + 3] + 0.5
                    if up is None:
                        total += np.log(own / own.sum())[v[rows, k]]
                    else:
                        t = table[3 * k : 3 * k + 3, 3 * up : 3 * up + 3] + 4 * (own / own.sum())[:, None]
                        total += np.log(t / t.sum(axis=0))[v[rows, k], v[rows, up]]
                log.append(total)
            new[rows] = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        moved = np.abs(new - q).max()
        q = new
        if moved < 1e-4 and step > 5:
            return q
    warnings.warn(f"the label model still moved by {moved:.2g} after {EM_STEPS} steps", stacklevel=2)
    return q


def logistic(x: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights and, last, the intercept of a ridge logistic regression, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(NEWTON_STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - target)) + penalty * w
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            return w
    warnings.warn(f"the regression still moved by {np.abs(step).max():.2g} after {NEWTON_STEPS} steps", stacklevel=2)
    return w


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray):
        """weights: of the grams' log counts, of Seen.numbers, and the intercept."""
        self.lexicon, self.weights = lexicon, weights

    def score(self, column: pa.Array) -> np.ndarray:
        seen, n = Seen(self.lexicon, column), len(self.lexicon.grams)
        x = np.bincount(seen.text, weights=self.weights[seen.entry] * np.log1p(seen.times), minlength=seen.n)
        x = x + seen.numbers() @ self.weights[n:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def no_model() -> Model:
    """The model without rows of both labels: all texts score 0."""
    return Model(Lexicon([]), np.array([0.0] * NUMBERS + [-30.0]))


def candidates(sample: DataFrame) -> list[tuple[int, float]]:
    """sample(label, half, lead, text) -> word beginnings that pass the lexicon's limits, with their log-likelihood ratios, the strongest first.

    Toxic near copies count once.  The driver gets the grams that pass.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded(batch, 2):
                data, starts = folding.folded(part.column(2))
                grams, places = folding.beginnings(data)
                text = np.searchsorted(starts, places, side="right") - 1
                order = np.lexsort((text, grams))
                grams, text = grams[order], text[order]
                once = np.concatenate([[True], (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])]) if len(grams) else np.empty(0, bool)
                grams, text = grams[once], text[once]
                kind = (2 * part.column(0).to_numpy() + part.column(1).to_numpy())[text]
                cut = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.empty(0, np.int64)
                out = [np.add.reduceat((kind == k).astype(np.int32), cut) if len(cut) else np.empty(0, np.int32) for k in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array(grams[cut].view(np.int64)), *[pa.array(x, pa.int32()) for x in out]], ["gram", "b0", "b1", "a0", "a1"])

    sample = sample.where("lead = 1").drop("lead")
    n = {(r.label, r.half): float(r["n"]) for r in sample.groupBy("label", "half").agg(F.count("*").alias("n")).collect()}
    n0, n1 = n.get((0, 0), 0.0) + n.get((0, 1), 0.0), n.get((1, 0), 0.0) + n.get((1, 1), 0.0)
    if not n0 or not n1:
        return []
    table = small_batches(sample).mapInArrow(count, "gram bigint, b0 int, b1 int, a0 int, a1 int").groupBy("gram")
    table = table.agg(*[F.sum(c).cast("double").alias(c) for c in ("b0", "b1", "a0", "a1")])
    table = table.withColumns({"a": F.col("a0") + F.col("a1"), "b": F.col("b0") + F.col("b1")}).where(F.col("a") >= LEAST_ROWS).persist()
    tested_grams = table.count()
    least = OVER_CHANCE + math.log(max(tested_grams, 1))
    counted = table
    for h in (0, 1):
        table = table.where((F.col(f"a{h}") > 0) & (F.col(f"a{h}") * n.get((0, h), 0.0) >= LEAST_LIFT * F.col(f"b{h}") * n.get((1, h), 0.0)))

    def part_of(x: "F.Column", of: "F.Column") -> "F.Column":
        return F.when(x > 0, x * F.log(x / of)).otherwise(0.0)

    a, b = F.col("a"), F.col("b")
    share = (a + b) / (n1 + n0)
    ratio = part_of(a, share * n1) + part_of(b, share * n0) + part_of(n1 - a, (1 - share) * n1) + part_of(n0 - b, (1 - share) * n0)
    found = table.select("gram", F.round(ratio, 6).alias("ratio")).where(F.col("ratio") >= least).collect()
    counted.unpersist()
    out = [(r.gram % (1 << 64), r.ratio) for r in found]
    # Of equal ones an open end comes before a whole word, then the longer one.
    return sorted(out, key=lambda x: (-x[1], folding.as_bytes(x[0]).endswith(b" "), -len(folding.as_bytes(x[0])), x[0]))


def apart(grams: list[tuple[int, float]]) -> list[int]:
    """The grams without those that begin like a stronger one or are such a one's beginning; MOST_ENTRIES at most."""
    out: list[bytes] = []
    kept, begun = set(), set()
    for g, _ in grams:
        raw = folding.as_bytes(g)
        heads = [raw[:n] for n in range(1, len(raw) + 1)]
        if raw not in begun and kept.isdisjoint(heads):
            out.append(raw)
            kept.add(raw)
            begun.update(heads)
    return [int.from_bytes(raw, "little") for raw in out[:MOST_ENTRIES]]


def log_ratio(a: np.ndarray, b: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Log-likelihood ratio of marks in a of n1 and b of n0 rows against one common rate."""
    share = (a + b) / (n1 + n0)
    out = np.zeros(len(a))
    for x, of in ((a, share * n1), (b, share * n0), (n1 - a, (1 - share) * n1), (n0 - b, (1 - share) * n0)):
        some = x > 0
        out[some] += x[some] * np.log(x[some] / of[some])
    return np.where(a * n0 > b * n1, out, 0.0)


#: How often, and in which share of the words, a gram must be there to mark a text: the choices for each gram are all pairs.
TIMES, SHARES = (1, 2, 3, 5), (0.0, 0.005, 0.01, 0.02, 0.03, 0.05)


def ruled(grams: list[int], dense: np.ndarray, words: np.ndarray, label: np.ndarray, spellings: dict[int, list[int]] | None = None) -> tuple[Lexicon, np.ndarray]:
    """The lexicon, the strongest grams first, and the training rows' counts in it.

    Each gram has the rule of TIMES and SHARES that tells labels apart best (of
    equal ones the first); it is taken inside of words too (second half of
    dense) if that marks as well as at words' beginnings (first half).
    """
    n, n1 = len(grams), float((label == 1).sum())
    n0 = float(len(label)) - n1
    rules = [(t, s) for s in SHARES for t in TIMES]
    ratio = np.zeros((len(rules), 2 * n))
    for i, (times, share) in enumerate(rules):
        there = (dense >= times) & (dense >= share * words[:, None])
        ratio[i] = log_ratio(there[label == 1].sum(axis=0).astype(float), there[label == 0].sum(axis=0).astype(float), n1, n0)
    rule, best = ratio.argmax(axis=0), ratio.max(axis=0)
    chosen = np.where(best[n:] >= 0.995 * best[:n], np.arange(n, 2 * n), np.arange(n))
    chosen = chosen[np.argsort(-best[chosen], kind="stable")]
    forms = grams + [g >> 8 for g in grams]
    times, shares = (np.array([rules[rule[i]][k] for i in chosen], dtype=float) for k in (0, 1))
    dense = dense[:, chosen]
    return Lexicon([forms[i] for i in chosen], times, shares, spellings), np.where((dense >= times) & (dense >= shares * words[:, None]), dense, 0)


def training_rows(docs: DataFrame, labels: DataFrame, seed: int) -> tuple[DataFrame, dict[int, float]] | None:
    """A sample (label, half, lead, text) of about TRAIN_ROWS labelled rows of each label, and the labels' rates; None without both labels.

    One row a doc_id and a text.  lead is 1 for clean rows and for one of the toxic rows whose least hash of three-word shingles is the same, as most near copies' is.
    """
    labels = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    sizes = {r.label: r["n"] for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    rate = {y: min(1.0, TRAIN_ROWS / n) for y, n in sizes.items()}
    chosen = labels.where(unit(seed, F.col("doc_id")) < F.when(F.col("label") == 1, rate[1]).otherwise(rate[0]))

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded(batch, 2):
                found = [int(x[0]) if len(x) else 0 for x in shingle_sets(part.column(2), 3)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "label", "text", "least"])

    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    marked = small_batches(rows).mapInArrow(least, "doc_id bigint, label int, text string, least bigint")
    text = F.min(F.struct(F.xxhash64("text").alias("h"), "text", "least")).alias("t")
    one = marked.groupBy("doc_id").agg(F.max("label").alias("label"), text)
    once = one.groupBy("label", F.col("t.h").alias("h")).agg(F.min("t").alias("t")).select("label", "h", "t.text", "t.least")
    lead = (F.row_number().over(Window.partitionBy("label", "least").orderBy("h")) == 1) | (F.col("label") == 0)
    return once.select("label", F.pmod(F.xxhash64("least"), F.lit(2)).cast("int").alias("half"), lead.cast("int").alias("lead"), "text"), rate


def learn(docs: DataFrame, labels: DataFrame, seed: int = 5_003) -> Model:
    """docs(doc_id, text), labels(doc_id, toxic): from about TRAIN_ROWS labelled rows of each label.

    Labels other than 0 and 1 and null ids teach nothing; without rows of both labels all texts score 0.
    Equal texts of a label and rows of one doc_id count once.  The driver gets
    the sample's hits and numbers (at most about 2 * TRAIN_ROWS rows), no text.
    """
    drawn = training_rows(docs, labels, seed)
    if drawn is None:
        return no_model()
    sample, rate = drawn
    sample = sample.persist()
    grams = apart(candidates(sample))
    lexicon = Lexicon(grams + [g >> 8 for g in grams])
    variants = sorted({v for g in lexicon.grams for v in misspelt(g)} - set(lexicon.grams))
    # Misspellings that clean rows hold are words of their own.
    others = Lexicon(variants)
    lexicon_grams, index = set(lexicon.grams), {v: i for i, v in enumerate(variants)}

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded(batch, 3):
                seen = Seen(lexicon, part.column(3))
                offsets = pa.array(np.searchsorted(seen.text, np.arange(seen.n + 1)).astype(np.int32))
                found = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (seen.entry, seen.times)]
                text, wrong, _ = others.hits(*seen.folded, seen.words)
                offsets = pa.array(np.searchsorted(text, np.arange(seen.n + 1)).astype(np.int32))
                found.append(pa.ListArray.from_arrays(offsets, pa.array(wrong.astype(np.int32))))
                other = np.column_stack([seen.words, seen.hidden, seen.rates])
                numbers = [pa.array(list(x), pa.list_(pa.float32())) for x in (other, pair_profile(*seen.folded))]
                yield pa.RecordBatch.from_arrays([part.column(0), *found, *numbers], ["label", "entry", "times", "wrong", "x", "pairs"])

    table = small_batches(sample).mapInArrow(described, "label int, entry array<int>, times array<int>, wrong array<int>, x array<float>, pairs array<float>").toArrow()
    sample.unpersist()
    label = table.column("label").to_numpy()
    if len(np.unique(label)) < 2:
        return no_model()
    other, pairs = (np.stack(table.column(c).to_numpy(zero_copy_only=False)).astype(np.float64) for c in ("x", "pairs"))
    dense = np.zeros((len(label), 2 * len(grams)))
    rows = np.repeat(np.arange(len(label)), table.column("entry").combine_chunks().value_lengths().to_numpy())
    dense[rows, table.column("entry").combine_chunks().flatten().to_numpy()] = table.column("times").combine_chunks().flatten().to_numpy()
    own_words = set(table.filter(pc.equal(table.column("label"), 0)).column("wrong").combine_chunks().flatten().to_pylist())
    spellings = {g: [v for v in misspelt(g) if v not in lexicon_grams and index[v] not in own_words] for g in lexicon.grams}
    # Any order of rows gives the same model.
    order = np.lexsort((*pairs.T[::-1], *other.T[::-1], label))
    label, other, pairs, dense = label[order], other[order], pairs[order], dense[order]
    lexicon, dense = ruled(grams, dense, other[:, 0], label, spellings)
    numbers = numbers_of(dense.sum(axis=1), (dense > 0).sum(axis=1), other[:, 0], other[:, 1], other[:, 2:])
    weight = np.where(label == 1, 1 / rate[1], 1 / rate[0])
    weight /= weight.mean()
    v = votes(dense, numbers)
    v = v[:, tested(v, label, weight)]
    if not v.shape[1]:
        return no_model()
    q = label_model(v, majority(v), weight, profiles(pairs))
    return Model(lexicon, logistic(np.column_stack([np.log1p(dense), numbers]), q, weight))


def scored(docs: DataFrame, model: Model, columns: list[str], name: str = "score") -> DataFrame:
    """The given columns of docs(..., text), and each text's score under `name`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*[F.col(f"`{c}`") for c in columns], F.col("text").alias("__sl_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[:-1]) + f", {name} double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded(batch, batch.num_columns - 1):
                score = shared.value.score(part.column(part.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(score)], [*part.schema.names[:-1], name])

    return small_batches(kept).mapInArrow(run, schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents; learned from labelled rows outside the fold 0 of 5.

    Null and empty texts get the score of a text without any mark; equal texts have equal scores; an empty table has no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.withColumn("held_out", F.coalesce(fold(5) == 0, F.lit(False)))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.col("doc_id").isNotNull() & (fold(5) != 0))
    model = learn(docs, labels)
    return scored(docs, model, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
