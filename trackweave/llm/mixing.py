"""Mixing sources to target weights with soft memberships.

1. A naive Bayes classifier over hashed byte n-grams, titles, contributors and languages is trained on all labelled
   documents, one half for the other: its counts are sums, so every task sends one table of fixed size. 2. It gives each
   document a posterior over the sources. A document's membership is its label, softened by `label_noise` times the
   posterior; without a label it is the posterior. 3. Projected gradient descent on least squares fits non-negative
   document rates, at most max_repeats, until the expected tokens of every source that can be reached meet its target.
   Documents of equal membership have equal rates, so they are first added up; a step sends one row of sums to the
   driver. Sources whose documents all end at their cap can't be reached: they stay there and leave the sum of squares.
   4. Rates become whole repeats: a document is used while (k - 1 + u) / rate is below its source's threshold, u being a
   hash of its id. A threshold of 1 gives the fitted totals up to chance; the one taken, near 1, meets the target of the
   labels to the nearest document.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.llm.tokens import size
from trackweave.runtime import cut

#: Length of the byte n-grams and number of their hash buckets (a power of two).
GRAM, BUCKETS = 4, 4096
#: Hash buckets of the other features of a document, in the order of `mix`'s `features`.
SIDE = (4096, 1024, 256)
#: Posteriors are rounded to this many steps before documents are added up.
STEPS = 16
#: A source may be short if its documents' fitted rates use up more than this share of their caps.
NEAR_CAP = 0.5
_TEMPERATURES = (0.0, *(2.0**k for k in range(-2, 13)))


@dataclass(frozen=True)
class Target:
    source: str
    share: float
    max_repeats: int


def label(source: str | Column) -> Column:
    """A source name as it is compared: blanks trimmed, lower case."""
    return F.lower(F.trim(F.col(source) if isinstance(source, str) else source))


def _buckets(b: np.ndarray) -> np.ndarray:
    """Counts of the hashed n-grams of one text (bytes)."""
    if len(b) < GRAM:
        return np.zeros(BUCKETS, np.int64)
    grams = np.ndarray((len(b) - GRAM + 1,), "<u4", b.data, strides=(1,))
    return np.bincount((grams * np.uint32(2654435761)) >> np.uint32(32 - 12), minlength=BUCKETS)


def _bytes(texts: pa.Array) -> Iterator[np.ndarray]:
    for t in texts:
        yield np.frombuffer(t.as_buffer() if t.is_valid else b"", np.uint8)


def train(labelled: DataFrame, n_sources: int) -> np.ndarray:
    """Log probabilities by half, source and feature, from (half, s, raw, side).

    The halves are 0 and 1; a half's numbers come from the documents of the other one. raw is the text as binary, side
    the numbers of the other features (below sum(SIDE)). The last column is the log prior.
    """
    width = BUCKETS + sum(SIDE) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, n_sources, width), np.int64)
        for batch in batches:
            half, s = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for h, i, b in zip(half, s, _bytes(batch.column(2))):
                sums[h, i, :BUCKETS] += _buckets(b)
                sums[h, i, -1] += 1
            side = _matrix(batch.column(3), len(SIDE))
            for f in range(len(SIDE)):
                np.add.at(sums, (half, s, BUCKETS + side[:, f]), 1)
        h, s, k = np.nonzero(sums)
        arrays = [pa.array(x, pa.int32()) for x in (h, s, k)]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array(sums[h, s, k])], ["half", "s", "k", "n"])

    found = labelled.select("half", "s", "raw", "side").mapInArrow(count, "half int, s int, k int, n long").groupBy("half", "s", "k")
    table = found.agg(F.sum("n").alias("n")).toArrow()  # halves x sources x buckets numbers at most: the model
    total = np.zeros((2, n_sources, width))
    total[tuple(table[c].to_numpy() for c in ("half", "s", "k"))] = table["n"].to_numpy()
    total = total[::-1]  # each half is judged by the other
    grams, docs = total[..., :BUCKETS], total[..., -1:]
    all_grams = grams.sum(axis=(1, 2), keepdims=True)
    smooth = grams + (grams.sum(axis=1, keepdims=True) + 1.0) / (all_grams + BUCKETS) * 100.0
    parts, at = [np.log(smooth / smooth.sum(axis=-1, keepdims=True))], BUCKETS
    for n in SIDE:
        own = total[..., at : at + n]
        base = (own.sum(axis=1, keepdims=True) + 1.0 / n) / (docs.sum(axis=1, keepdims=True) + 1.0)
        parts.append(np.log((own + base) / (docs + base.sum(axis=-1, keepdims=True))))  # one document like the average
        at += n
    parts.append(np.log((docs + 1) / (docs.sum(axis=1, keepdims=True) + n_sources)))
    return np.concatenate(parts, axis=-1)


def scorer(model: np.ndarray):
    """An Arrow function from (half, text as binary, side) to each source's mean log likelihood of the n-grams, followed
    by its log likelihood of the other features with the prior."""
    n = model.shape[1]
    grams = [np.ascontiguousarray(m[:, :BUCKETS].T) for m in model]
    others = [np.ascontiguousarray(m[:, BUCKETS:-1].T) for m in model]

    def score(half: pa.Array, texts: pa.Array, side: pa.Array) -> pa.Array:
        out = np.zeros((len(texts), 2 * n))
        halves, features = half.to_numpy(), _matrix(side, len(SIDE))
        for i, (h, b) in enumerate(zip(halves, _bytes(texts))):
            if len(b) >= GRAM:
                out[i, :n] = _buckets(b) @ grams[h] / (len(b) - GRAM + 1)
            out[i, n:] = others[h][features[i]].sum(axis=0) + model[h, :, -1]
        return _lists(out)

    return F.arrow_udf(score, "array<double>")


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _matrix(lists: pa.Array, n: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.reshape(-1)))


def posterior(n: int, temperature: float):
    """An Arrow function from the scores of `scorer` to posteriors."""

    def soften(scores: pa.Array) -> pa.Array:
        m = _matrix(scores, 2 * n)
        return _lists(_softmax(m[:, :n] * temperature + m[:, n:]))

    return F.arrow_udf(soften, "array<double>")


def _temperature(scored: DataFrame, n: int) -> float:
    """The weight of the mean log likelihoods under which the labels are most probable, each judged by the other half."""

    def own(scores: pa.Array, s: pa.Array) -> pa.Array:
        m, i = _matrix(scores, 2 * n), s.to_numpy()
        each = [_softmax(m[:, :n] * t + m[:, n:])[np.arange(len(m)), i] for t in _TEMPERATURES]
        return _lists(np.log(np.maximum(np.stack(each, axis=1), 1e-12)))

    logs = scored.where("s IS NOT NULL").select(F.arrow_udf(own, "array<double>")("scores", "s").alias("p"))
    sums = logs.agg(*[F.sum(F.get("p", F.lit(i))) for i in range(len(_TEMPERATURES))]).first()
    return _TEMPERATURES[max(range(len(_TEMPERATURES)), key=lambda i: sums[i] if sums[i] is not None else -1e300)]


@dataclass
class Fit:
    """Where the projected descent ended: its steps, the sources that stay at their caps, and each source's expected
    tokens and share of its documents' caps (in tokens) that the rates use."""

    path: list[list[float]]
    capped: list[int]
    expected: np.ndarray
    used: np.ndarray

    def rate(self) -> Column:
        """The rate of a document with memberships m, source s and cap."""
        r = rate(self.path)
        return F.when(F.col("s").isin(*self.capped), F.col("cap")).otherwise(r) if self.capped else r


def fit_rates(classes: DataFrame, targets: np.ndarray, tolerance: float = 1e-6) -> Fit:
    """Rates for classes (s, m: memberships that sum to 1 at most, cap, tokens) by projected gradient descent.

    The squared misses are weighted by the tokens there are of each source, and rates are measured per token, so that
    steps of length 1 converge: rate <- clip(rate - m . (expected - target) / available). Each step is one row of sums. A
    source without documents, or whose documents are all at their caps below its target, can't be reached; it stays
    there and no longer pulls at the others. The descent ends once every other source meets its target within
    `tolerance` of it, or once a step changes no expectation by more than a hundredth of that (documents at rate 0).
    """
    n = len(targets)
    weigh = lambda x: [F.coalesce(F.sum(F.get("m", F.lit(s)) * F.col("tokens") * x), F.lit(0.0)) for s in range(n)]
    owned = lambda x: [F.coalesce(F.sum(F.when(F.col("s") == s, F.col("tokens") * x)), F.lit(0.0)) for s in range(n)]
    first = np.array(classes.agg(*weigh(F.lit(1.0)), *owned(F.col("cap"))).first(), float)
    available, most = np.maximum(first[:n], 1.0), first[n:]
    fit = Fit([], [s for s in range(n) if most[s] <= 0], np.zeros(n), np.ones(n))
    allowed = tolerance * np.maximum(targets, 1.0)
    while True:
        r = fit.rate()
        sums = np.array(classes.agg(*weigh(r), *owned(r)).first(), float)
        moved = np.abs(sums[:n] - fit.expected)
        fit.expected = sums[:n]
        fit.used = np.where(most > 0, sums[n:] / np.maximum(most, 1e-300), 1.0)
        active = np.array([s not in fit.capped for s in range(n)])
        miss = fit.expected - targets
        full = [s for s in range(n) if active[s] and miss[s] < -allowed[s] and fit.used[s] >= 1 - 1e-12]
        if full:
            fit.capped += full
            active[full] = False
        if (np.abs(miss) <= allowed)[active].all() or (not full and fit.path and (moved <= allowed / 100).all()):
            return fit
        fit.path.append([float(x) for x in np.where(active, miss / available, 0.0)])


def rate(path: Sequence[Sequence[float]]) -> Column:
    """The rate of a document with memberships m and cap after the steps in `path`, starting at 0."""
    if not path:
        return F.lit(0.0)
    steps = F.array(*[F.array(*[F.lit(x) for x in p]) for p in path])
    dot = lambda g: F.aggregate(F.zip_with("m", g, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(steps, F.lit(0.0), lambda r, g: F.greatest(F.lit(0.0), F.least(F.col("cap"), r - dot(g))))


def _by_source(values: Sequence[float]) -> Column:
    return F.get(F.array(*[F.lit(float(v)) for v in values]), F.col("s"))


def _step(k: Column) -> Column:
    """The threshold from which on a document is used for the k-th time."""
    return (k - 1 + F.col("u")) / F.col("rate")


def whole_repeats(docs: DataFrame, targets: np.ndarray, capped: Sequence[int], bins: int = 256) -> DataFrame:
    """docs (s, tokens, rate, cap, u, ...) with `repeats`, so that every source's tokens come as near to its target as
    whole documents allow; the documents of the sources in `capped` are at their caps.

    The threshold of a source is a quantile of its documents' steps weighted by tokens: histograms of the steps, a
    bounded number of rows per round, narrow the interval that holds the target until it is one step (or steps at the
    same threshold, which enter together); then the nearer side of it is taken. Documents of rate 0 are never used.
    """
    n = len(targets)
    times = F.explode(F.sequence(F.lit(1), F.col("cap").cast("int"))).alias("k")
    steps = docs.where("rate > 0 AND cap >= 1").select("s", "tokens", "rate", "u", times).select("s", "tokens", _step(F.col("k")).alias("at"))
    most, below, before = np.full(n, np.inf), np.full(n, -1.0), np.zeros(n)
    lo, hi, todo = np.zeros(n), np.zeros(n), []
    for r in steps.groupBy("s").agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.sum("tokens").alias("t")).collect():  # a row per source
        if r["s"] not in capped and r["t"] >= targets[r["s"]]:
            lo[r["s"]], hi[r["s"]] = r["lo"], r["hi"]
            todo.append(r["s"])
    while todo:
        low, high = _by_source(lo), _by_source(hi)
        share = F.when(high > low, F.try_divide(F.col("at") - low, high - low)).otherwise(0.0)
        within = steps.where(F.col("s").isin(*todo) & (F.col("at") >= low) & (F.col("at") <= high))
        counts = F.sum("tokens").alias("t"), F.count("*").alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi")
        got = within.groupBy("s", F.least(F.lit(bins - 1), F.floor(share * bins)).alias("bin")).agg(*counts).collect()
        left = []
        for s in todo:
            upto, last = before[s], below[s]
            for r in sorted((r for r in got if r["s"] == s), key=lambda r: r["bin"]):
                if upto + r["t"] >= targets[s]:
                    break
                upto, last = upto + r["t"], r["hi"]
            if r["n"] == 1 or r["lo"] == r["hi"]:
                most[s] = r["hi"] if upto + r["t"] - targets[s] <= targets[s] - upto else last
            else:
                lo[s], hi[s], before[s], below[s] = r["lo"], r["hi"], upto, last
                left.append(s)
        todo = left
    used = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("cap").cast("int"))), lambda k: (k <= F.col("cap")) & (_step(k) <= _by_source(most))))
    repeats = F.when(F.col("rate") > 0, used).otherwise(0)
    return docs.withColumn("repeats", (F.when(F.col("s").isin(*capped), F.col("cap")).otherwise(repeats) if capped else repeats).cast("int"))


@dataclass
class Mixed:
    """chosen: the documents to use. shares: what each source reaches. recall: how well the classifier knows it."""

    chosen: DataFrame
    shares: DataFrame
    recall: DataFrame


def mix(
    documents: DataFrame,
    targets: Sequence[Target],
    label_noise: float = 0.01,
    admit_unlabelled: bool = False,
    doc: str = "doc_id",
    text: str = "text",
    source: str = "source",
    features: Sequence[str] = ("title", "contributor", "lang"),
) -> Mixed:
    """The documents to use with their repeats, and what each source reaches.

    chosen: doc_id, source (as in targets), n_tokens, repeats (>= 1). shares: source, target_share, target_tokens,
    n_docs, available_tokens, reachable_tokens (available times max_repeats), expected_tokens (of the fitted rates, by
    membership), reached_tokens, reached_share (of all tokens chosen), most_repeats and short (the target can't be
    reached: the fit used up more than NEAR_CAP of the source's caps, and they don't suffice). recall: source, n_docs,
    n_right, recall, the documents whose label the classifier trained on the other half finds. Targets are shares of the
    tokens of all documents, of whatever source; where sources are short, the others still meet their own target_tokens,
    so that reached_share is above target_share. A document belongs to a source if its label is equal after `label`; one
    without such a label belongs to none and is not chosen, unless admit_unlabelled gives it to its most probable
    source. Null texts have no size and are left out; empty ones are never chosen, as they add nothing. Of `features`
    those are used that the table has, three at most; null counts as a value. A source without documents reaches 0. No targets
    give no rows.
    """
    names = [t.source for t in targets]
    numbered = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n.strip(" ").lower(), i)]) if names else F.create_map()
    caps = [t.max_repeats for t in targets]
    n = max(1, len(names))
    known = [f if f in documents.columns else None for f in [*features, *[None] * len(SIDE)][: len(SIDE)]]
    starts = np.cumsum([0, *SIDE]).tolist()
    value = lambda f: F.lit(0).cast("long") if f is None else F.xxhash64(F.coalesce(F.col(f).cast("string"), F.lit("")))
    docs = documents.where(F.col(text).isNotNull()).select(
        F.col(doc).alias("doc_id"),
        size(text).alias("tokens"),
        (numbered[label(source)] if names else F.lit(None)).cast("int").alias("s"),
        F.pmod(F.xxhash64(F.col(doc), F.lit(7)), F.lit(2)).cast("int").alias("half"),
        F.col(text).cast("binary").alias("raw"),
        F.array(*[(F.pmod(value(f), F.lit(w)) + a).cast("int") for f, w, a in zip(known, SIDE, starts)]).alias("side"),
    )
    model = train(docs.where("s IS NOT NULL"), n)
    scored = cut(docs.select("doc_id", "tokens", "s", scorer(model)("half", "raw", "side").alias("scores")))
    soft = posterior(n, _temperature(scored, n))(F.col("scores"))
    given = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == F.col("given")).cast("double"))
    rounded = F.transform("soft", lambda p: F.round(p * STEPS) / STEPS)
    member = F.when(F.col("given").isNotNull(), F.zip_with(given, "soft", lambda g, p: g * (1 - label_noise) + p * label_noise)).otherwise(F.col("soft"))
    likeliest = (F.array_position("soft", F.array_max("soft")) - 1).cast("int")
    s = F.coalesce("given", "likeliest") if admit_unlabelled else F.col("given")
    cap = F.when(F.col("s").isNull(), 0).otherwise(_by_source(caps)) if names else F.lit(0)
    judged = scored.select("doc_id", "tokens", F.col("s").alias("given"), soft.alias("soft")).withColumn("likeliest", likeliest)
    ready = cut(
        judged.withColumn("soft", rounded)
        .withColumn("m", member)
        .withColumn("s", s)
        .select("doc_id", "tokens", "given", "likeliest", "s", "m", cap.cast("double").alias("cap"))
    )
    total = float(ready.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0])
    goal = np.array([t.share * total for t in targets] or [0.0])
    classes = cut(ready.where("s IS NOT NULL").groupBy("s", "m", "cap").agg(F.sum("tokens").cast("double").alias("tokens")))
    fit = fit_rates(classes, goal)
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    rated = cut(ready.where("s IS NOT NULL AND tokens > 0").select("doc_id", "tokens", "s", "cap", fit.rate().alias("rate"), unit.alias("u")))
    used = cut(whole_repeats(rated, goal, fit.capped).select("doc_id", "tokens", "s", "repeats"))
    title = F.get(F.array(*[F.lit(x) for x in names]) if names else F.array(F.lit("")), F.col("s"))
    chosen = used.where("repeats > 0").select("doc_id", title.alias("source"), F.col("tokens").alias("n_tokens"), "repeats")
    right = F.count_if(F.col("likeliest") == F.col("given"))
    by_source = ready.where("given IS NOT NULL").groupBy(F.col("given").alias("s")).agg(F.count("*").alias("n_docs"), right.alias("n_right"))
    recall = by_source.select(title.alias("source"), "n_docs", "n_right", (F.col("n_right") / F.col("n_docs")).alias("recall"))
    return Mixed(chosen, _shares(documents.sparkSession, ready, used, targets, total, fit), recall)


def _shares(spark, ready: DataFrame, used: DataFrame, targets: Sequence[Target], total: float, fit: Fit) -> DataFrame:
    rows = [
        (i, t.source, float(t.share), int(t.max_repeats), t.share * total, float(fit.expected[i]), bool(fit.used[i] > NEAR_CAP))
        for i, t in enumerate(targets)
    ]
    wanted = spark.createDataFrame(
        rows, "s int, source string, target_share double, max_repeats int, target_tokens double, expected_tokens double, near_cap boolean"
    )
    have = ready.groupBy("s").agg(F.count("*").alias("n_docs"), F.sum("tokens").alias("available_tokens"))
    took = used.groupBy("s").agg(
        F.sum(F.col("tokens") * F.col("repeats")).alias("reached_tokens"), F.max("repeats").alias("most_repeats")
    )
    per = F.broadcast(wanted).join(have, "s", "left").join(took, "s", "left").na.fill(0, ["n_docs", "available_tokens", "reached_tokens", "most_repeats"])
    all_used = used.agg(F.coalesce(F.sum(F.col("tokens") * F.col("repeats")), F.lit(0))).first()[0]
    reachable = F.col("available_tokens") * F.col("max_repeats")
    return per.select(
        "source",
        "target_share",
        "target_tokens",
        "n_docs",
        "available_tokens",
        reachable.alias("reachable_tokens"),
        "expected_tokens",
        "reached_tokens",
        (F.col("reached_tokens") / F.lit(float(max(all_used, 1)))).alias("reached_share"),
        "most_repeats",
        (F.col("near_cap") & (reachable < F.col("target_tokens"))).alias("short"),
    )
