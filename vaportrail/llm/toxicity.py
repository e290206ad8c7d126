"""Toxic passages as maximum-scoring segments of token log-odds, calibrated by extreme-value statistics."""

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaportrail.llm.words import in_slices, mix
from vaportrail.session import stage, unstage

SAMPLE = 25_000  # labelled rows of each class, at most about so many, that the model is fitted on
VOCABULARY = 20_000  # words, as many stems, and as many words of the tone, that may carry a score
PRIOR = 1.0  # pseudo-documents that hold a token, dealt to the classes at the base rate
LEAST_Z, LEAST_ODDS = 4.0, 2.0  # of a token's likelihood ratio (as a z-score) and log-odds to count as evidence
KEYS = 50_000  # tokens that a task counts before it hands them on
FOLDS = 4  # of the sample: each is calibrated with the tokens of the others
NEUTRAL = 10  # words without log-odds that every text is given, so that the tone of a short one stays near 0
STEMS = (8, 7, 6, 5, 4, 3)  # lengths of beginnings that inflected forms share
DRIFT = 0.3  # taken off for every token without evidence, so that segments end
SIGNIFICANT = 0.01  # expected chance segments of a passage that is reported
_TOKEN = re.compile(r"\w+")
PASSAGES = "array<struct<start:long,stop:long,score:double,expected:double>>"


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0  # lambda of the extreme-value law of chance segments
    log_k: float = 0.0  # and the logarithm of its K
    tones: dict[str, float] = field(default_factory=dict)  # log-odds of either sign, among texts no passage explains
    weights: tuple[float, ...] = (0.0, 0.0, 0.0)  # of the logistic calibration: constant, evidence, tone


def stems_of(token: str) -> list[str]:
    return [token[:n] for n in STEMS if len(token) > n]


class _Scores(dict):
    """token -> log-odds: its own, else the largest of its stems, else 0."""

    LIMIT = 100_000

    def __init__(self, model: Model, limit: int = LIMIT):
        super().__init__()
        self.model, self.limit = model, limit

    def __missing__(self, token: str) -> float:
        if len(self) >= self.limit:
            self.clear()
        own = self.model.words.get(token)
        if own is None:
            own = max((self.model.stems.get(stem, 0.0) for stem in stems_of(token)), default=0.0)
        self[token] = own
        return own


def segments(hits: list[tuple[int, float]]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first token, last token, score) of tokens that cost DRIFT unless hit.

    ``hits`` are (position, score) in order. Ruzzo and Tompa's scan: a new segment swallows the nearest earlier one that
    starts lower, as long as that one ends lower too. Each keeps a link to that nearest one, so the scan is linear.
    """
    found: list[tuple[int, int, float, float, int]] = []  # first, last, sum before, sum after, nearest that starts lower
    total, at = 0.0, 0
    for i, score in hits:
        total -= DRIFT * (i - at)
        at = i + 1
        first, last, low = i, i, total
        total += score
        k = len(found) - 1
        while True:
            while k >= 0 and found[k][2] >= low:
                k = found[k][4]
            if k < 0 or found[k][3] >= total:
                break
            first, _, low, _, link = found[k]
            del found[k:]
            k = link
        found.append((first, last, low, total, k))
    return [(first, last, high - low) for first, last, low, high, _ in found]


def tokens_of(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def passages(tokens: list[str], scores: _Scores) -> list[tuple[int, int, float]]:
    hits = [(i, s) for i, s in enumerate(map(scores.__getitem__, tokens)) if s > 0]
    return segments(hits) if hits else []


def tone(model: Model, words: set[str]) -> float:
    """Mean log-odds of a text's distinct words, for texts whose words are no evidence one by one."""
    if not model.tones:
        return 0.0
    return math.fsum(model.tones.get(word, 0.0) for word in words) / (len(words) + NEUTRAL)


def log_expected(model: Model, score: float, n: int) -> float:
    """Logarithm of how many segments of this score chance would put into n tokens."""
    return model.log_k + math.log(max(n, 1)) - model.rate * score


def evidence(model: Model, n: int, found: list[tuple[int, int, float]]) -> float:
    """Evidence against chance, in nats and bounded, of the best segments together; 0 without segments.

    For the r best segments chance reaches a sum t of normalised scores with about exp(-t) t^(r-1) / (r! (r-1)!); the r
    that chance explains worst counts.
    """
    best, total = 0.0, 0.0
    for r, score in enumerate(sorted((s for _, _, s in found), reverse=True), 1):
        total -= log_expected(model, score, n)
        if total <= 0:
            break
        best = max(best, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r))
        if best >= 30.0:
            return 30.0
    return math.log1p(math.exp(best)) if found else 0.0


def held_out(id_col: Column) -> Column:
    """Rows that no model may learn from: a fixed fifth of the ids."""
    return F.crc32(id_col.cast("string")) % 5 == 0


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, size: int) -> DataFrame:
    """(id, text, toxic) of labelled documents outside the held-out fifth; at most about ``size`` of each class, by hash.

    The ids are bounded by that parameter, so they go to the texts and not the texts to them.
    """
    known = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max((F.col(label_col) > 0).cast("int")).alias("toxic"))
    )
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, size / max(counts.get(1, 0), 1)).otherwise(size / max(counts.get(0, 0), 1))
    place = F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(1 << 30)) / (1 << 30)
    chosen = known.where(place < share)
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return texts.join(F.broadcast(chosen), "id")


def _sketch(tokens: list[str]) -> int:
    """A MinHash of the token pairs: near copies mostly share it."""
    import xxhash

    h = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    pairs = mix(h[:-1] + mix(h[1:])) if len(h) > 1 else h
    return int(pairs.min().astype(np.int64)) if len(pairs) else 0


def _fold(sketch: int) -> int:
    """The fold by sketch, so copies stay in one."""
    return int(mix(np.array([sketch], np.int64).view(np.uint64))[0] % FOLDS)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sketch, fold, toxic, words): distinct words, and a MinHash by which near copies are told."""
    for batch in in_slices(batches):
        sketches, words = [], []
        for text in batch.column(0):
            tokens = tokens_of(text.as_py())
            sketches.append(_sketch(tokens))
            words.append(list(set(tokens)))
        folds = pa.array(map(_fold, sketches), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(sketches, pa.int64()), folds, batch.column(1), pa.array(words, pa.list_(pa.string()))],
            names=["sketch", "fold", "toxic", "words"],
        )


def _document_counts(stems: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(token, stem, counts): how many documents hold a word and, if ``stems``, a word with this stem; summed up in part.

    ``counts`` are the clean and toxic documents of the first fold, then those of the next. A task holds KEYS tokens, and
    those of one document more.
    """

    def rows(counts: dict) -> pa.RecordBatch:
        columns = zip(*((t, stem, n) for (t, stem), n in counts.items()), strict=True) if counts else [[]] * 3
        types = [pa.string(), pa.bool_(), pa.list_(pa.int64())]
        arrays = [pa.array(list(c), k) for c, k in zip(columns, types, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=["token", "stem", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, bool], list[int]] = {}
        for batch in batches:
            for fold, toxic, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = words.as_py()
                keys = [(w, False) for w in words]
                if stems:
                    keys += [(s, True) for s in {s for w in words for s in stems_of(w)}]
                for key in keys:
                    counts.setdefault(key, [0] * (2 * FOLDS))[2 * fold + toxic] += 1
                if len(counts) > KEYS:
                    yield rows(counts)
                    counts = {}
        yield rows(counts)

    return count


def _counts(single: DataFrame, of: list[int], stems: bool) -> DataFrame:
    """(token, stem, counts) of all documents, where the counts at the places ``of`` make 3 or more."""
    held = [F.sum(F.get("counts", F.lit(i))).alias(f"n{i}") for i in range(2 * FOLDS)]
    return (
        single.select("fold", "toxic", "words")
        .mapInArrow(_document_counts(stems), "token string, stem boolean, counts array<long>")
        .groupBy("token", "stem")
        .agg(*held)
        .where(sum((F.col(f"n{i}") for i in of), F.lit(0)) >= 3)
        .select("token", "stem", F.array(*[f"n{i}" for i in range(2 * FOLDS)]).alias("counts"))
    )


def _odds(toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> tuple[Column, Column]:
    """Log-odds with a prior of PRIOR pseudo-documents at the base rate, and the signed root of the likelihood ratio.

    The ratio is that of the token's own share of toxic documents to the base rate. It grows with the token's count, and
    the larger sample does not raise the bar.
    """
    share = n_toxic / (n_toxic + n_clean)
    a, b = toxic + PRIOR * share, clean + PRIOR * (1 - share)
    without = lambda n, held: F.greatest(F.lit(0.5), n + PRIOR - held)  # noqa: E731  a token may be in every document
    odds = F.log(a / without(n_toxic, a)) - F.log(b / without(n_clean, b))
    both = toxic + clean
    part = lambda n, p: F.when(n > 0, n * F.log(n / (both * p))).otherwise(0.0)
    ratio = 2 * (part(toxic, share) + part(clean, 1 - share))
    return odds, F.signum(toxic - both * share) * F.sqrt(F.greatest(F.lit(0.0), ratio))


def _evident(counts: DataFrame, n_toxic: int, n_clean: int) -> DataFrame:
    odds, z = _odds(F.col("toxic"), F.col("clean"), n_toxic, n_clean)
    scored = counts.where("toxic >= 3").select("token", "stem", odds.alias("odds"), z.alias("z"))
    return scored.where((F.col("z") >= LEAST_Z) & (F.col("odds") >= LEAST_ODDS))


def _learnt(counts: DataFrame, sizes: dict[tuple[int, int], int], without: int | None = None) -> Model:
    """A model with the tokens of all folds, or of all but one."""
    folds = [k for k in range(FOLDS) if k != without]
    n_clean, n_toxic = (sum(sizes.get((toxic, k), 0) for k in folds) for toxic in (0, 1))
    if not (n_toxic and n_clean):
        return Model()
    total = lambda toxic: sum((F.get("counts", F.lit(2 * k + toxic)) for k in folds), F.lit(0))
    summed = counts.select("token", "stem", total(1).alias("toxic"), total(0).alias("clean"))
    evident = stage(_evident(summed, n_toxic, n_clean), "toxicity-tokens")
    top = lambda df: {r["token"]: r["odds"] for r in df.orderBy(F.desc("z"), "token").limit(VOCABULARY).collect()}
    model = Model(top(evident.where("not stem")), top(evident.where("stem")))
    unstage(evident)
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Ridge-penalised logistic regression with a constant, by Newton steps."""
    design = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(design.shape[1])
    ridge = np.diag([1e-3] + [1e-2] * (design.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hessian = design.T @ (design * (p * (1 - p))[:, None]) + ridge
        step = np.linalg.solve(hessian, design.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def _rate(histogram: dict[float, float]) -> float:
    """The positive root of sum p(s) exp(rate s) = 1 over token scores of clean text."""
    s, p = np.array(list(histogram)), np.array(list(histogram.values()), float)
    p /= p.sum()
    if not (s > 0).any():
        return 1.0
    low, high = 1e-6, 1.0
    while (p * np.exp(np.minimum(high * s, 700))).sum() < 1 and high < 64:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if (p * np.exp(np.minimum(middle * s, 700))).sum() < 1 else (low, middle)
    return high


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample: int = SAMPLE,
) -> Model:
    """Token log-odds, the extreme-value law of chance segments, the tone of texts without evidence, a logistic calibration.

    Fitted on about ``sample`` labelled documents of each class at most; near copies among them count once. Tokens are
    learnt on all of them; each fold is calibrated with the tokens that the other folds show. Without labels of both
    classes the model has no tokens and its scores are the share of toxic labels.
    """
    texts = training_sample(docs, labels, id_col, text_col, label_col, sample).select("text", "toxic")
    features = "sketch long, fold int, toxic int, words array<string>"
    featured = stage(texts.mapInArrow(_features, features), "toxicity-words")
    # one document for each sketch and class
    single = featured.groupBy("sketch", "fold", "toxic").agg(F.min_by("words", F.size("words")).alias("words"))
    single = stage(single, "toxicity-single")
    sizes = {(r["toxic"], r["fold"]): r["count"] for r in single.groupBy("toxic", "fold").count().collect()}
    n_toxic, n_clean = (sum(n for (t, _), n in sizes.items() if t == toxic) for toxic in (1, 0))
    base = (n_toxic + 1) / (n_toxic + n_clean + 2)
    constant = (math.log(base / (1 - base)), 0.0, 0.0)
    if not (n_toxic and n_clean):
        unstage(featured, single)
        return Model(weights=constant)
    counts = stage(_counts(single, of=[2 * k + 1 for k in range(FOLDS)], stems=True), "toxicity-counts")
    model, parts = _learnt(counts, sizes), [_learnt(counts, sizes, k) for k in range(FOLDS)]
    model.weights = constant
    unstage(featured, counts)
    found, x, y = _chance(model, parts, texts, single.select("sketch", "toxic"))
    if not 0 < y.sum() < len(y):
        unstage(single)
        return model
    constant, slope = _logistic(x[:, None], y)
    left = [key for key, e in zip(found, x, strict=True) if constant + slope * e < 0]
    tones = _tones(model, single, left)
    unstage(single)
    return _calibrated(model, found, x, y, tones)


def _chance(model: Model, parts: list[Model], texts: DataFrame, ids: DataFrame) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Fits the chance law on clean documents; (sketch, toxic) of the sample, its evidence, and its labels.

    Each document is scored by the part without its fold. One row of numbers for each document of the bounded sample comes
    to the driver, and the counts of token scores.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_fold = [_Scores(part, _Scores.LIMIT // FOLDS) for part in parts]
        for batch in in_slices(batches):
            rows = []
            for text, toxic in zip(batch.column(0), batch.column(1), strict=True):
                tokens = tokens_of(text.as_py())
                sketch = _sketch(tokens)
                scores = by_fold[_fold(sketch)]
                rows.append(
                    {
                        "sketch": sketch,
                        "toxic": toxic.as_py(),
                        "n": len(tokens),
                        "found": [s for _, _, s in passages(tokens, scores)],
                        "hits": [s for s in map(scores.__getitem__, tokens) if s > 0],
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    arrow = pa.schema(
        [
            ("sketch", pa.int64()),
            ("toxic", pa.int32()),
            ("n", pa.int64()),
            ("found", pa.list_(pa.float64())),
            ("hits", pa.list_(pa.float64())),
        ]
    )
    measured = texts.mapInArrow(measure, "sketch long, toxic int, n long, found array<double>, hits array<double>")
    single = measured.join(F.broadcast(ids), ["sketch", "toxic"]).groupBy("sketch", "toxic")
    single = stage(single.agg(*[F.first(c).alias(c) for c in ("n", "found", "hits")]), "toxicity-measured")
    clean = single.where("toxic = 0")
    tokens = clean.agg(F.sum("n")).first()[0] or 0
    # as many values as tokens with evidence
    hits = clean.select(F.explode("hits").alias("s")).groupBy("s").count()
    histogram: dict[float, float] = {r["s"]: r["count"] for r in hits.collect()}
    best = max([*model.words.values(), *model.stems.values()], default=1.0)
    histogram[best] = histogram.get(best, 0) + 0.5  # a chance hit not seen yet
    histogram[-DRIFT] = max(1.0, tokens - sum(histogram.values()))
    model.rate = _rate(histogram)
    chance = clean.select(F.explode("found").alias("s"))
    middle = chance.agg(F.percentile_approx("s", 0.5)).first()[0]
    above = 1 if middle is None else chance.where(F.col("s") >= middle).count()
    model.log_k = math.log((above + 0.5) / max(tokens, 1)) + model.rate * (best if middle is None else middle)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[(0, 0, s) for s in scores.as_py()] for scores in batch.column(3)]
            values = [evidence(model, n, f) for n, f in zip(batch.column(2).to_pylist(), found, strict=True)]
            columns = [batch.column(0), batch.column(1), pa.array(values, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["sketch", "toxic", "evidence"])

    weighed = single.select("sketch", "toxic", "n", "found").mapInArrow(weigh, "sketch long, toxic int, evidence double")
    rows = weighed.collect()
    unstage(single)
    return [(r["sketch"], r["toxic"]) for r in rows], np.array([r["evidence"] for r in rows]), np.array([float(r["toxic"]) for r in rows])


def _tone_model(counts: DataFrame, sizes: dict[tuple[int, int], int], without: int | None = None) -> Model:
    """Log-odds of either sign of the words that most of the counted documents hold, of all folds or of all but one."""
    folds = [k for k in range(FOLDS) if k != without]
    n_clean, n_toxic = (sum(sizes.get((toxic, k), 0) for k in folds) for toxic in (0, 1))
    if not (n_toxic and n_clean):
        return Model()
    total = lambda toxic: sum((F.get("counts", F.lit(2 * k + toxic)) for k in folds), F.lit(0))
    summed = counts.select("token", total(1).alias("toxic"), total(0).alias("clean"))
    odds, _ = _odds(F.col("toxic"), F.col("clean"), n_toxic, n_clean)
    common = summed.orderBy(F.desc(F.col("toxic") + F.col("clean")), "token").limit(VOCABULARY)
    return Model(tones={r["token"]: r["odds"] for r in common.select("token", odds.alias("odds")).collect()})


def _tones(model: Model, single: DataFrame, left: list[tuple[int, int]]) -> dict[tuple[int, int], float]:
    """Learns the tone of ``model`` on the sample's documents ``left`` without evidence, and gives the tone of each document of
    the sample by words that the other folds show."""
    keys = single.sparkSession.createDataFrame(left, "sketch long, toxic int")
    unexplained = single.join(F.broadcast(keys), ["sketch", "toxic"])
    sizes = {(r["toxic"], r["fold"]): r["count"] for r in unexplained.groupBy("toxic", "fold").count().collect()}
    counts = stage(_counts(unexplained, of=list(range(2 * FOLDS)), stems=False), "toxicity-tones")
    model.tones = _tone_model(counts, sizes).tones
    parts = [_tone_model(counts, sizes, k) for k in range(FOLDS)]
    unstage(counts)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folds, words = batch.column(2).to_pylist(), batch.column(3)
            tones = [tone(parts[fold], set(own.as_py())) for fold, own in zip(folds, words, strict=True)]
            columns = [batch.column(0), batch.column(1), pa.array(tones, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["sketch", "toxic", "tone"])

    rows = single.select("sketch", "toxic", "fold", "words").mapInArrow(measure, "sketch long, toxic int, tone double").collect()
    return {(r["sketch"], r["toxic"]): r["tone"] for r in rows}


def _calibrated(
    model: Model, found: list[tuple[int, int]], x: np.ndarray, y: np.ndarray, tones: dict[tuple[int, int], float]
) -> Model:
    """The logistic step, on evidence and tone of words that each document's own fold did not show."""
    model.weights = _logistic(np.column_stack([x, [tones[key] for key in found]]), y)
    return model


def score_texts(docs: DataFrame, model: Model, text_col: str = "text", prefix: str = "") -> DataFrame:
    """All columns of ``docs`` and score, predicted, passages (names may get a prefix), row by row without a shuffle.

    ``passages`` are the significant segments: token positions, score, and how many such segments chance would make.
    """
    names = [f"{prefix}score", f"{prefix}predicted", f"{prefix}passages"]
    at = docs.columns.index(text_col)
    kind = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _Scores(model)
        constant, slope, tone_slope = model.weights
        for batch in in_slices(batches):
            values, spans = [], []
            for text in batch.column(at):
                tokens = tokens_of(text.as_py())
                n, found = len(tokens), passages(tokens, scores)
                z = constant + slope * evidence(model, n, found) + tone_slope * tone(model, set(tokens))
                values.append(1 / (1 + math.exp(-max(-40.0, min(40.0, z)))))
                expected = [math.exp(min(50.0, log_expected(model, s, n))) for _, _, s in found]
                spans.append(
                    [
                        {"start": first, "stop": last + 1, "score": s, "expected": e}
                        for (first, last, s), e in zip(found, expected, strict=True)
                        if e <= SIGNIFICANT
                    ]
                )
            value = pa.array(values, pa.float64())
            predicted = pa.array([int(v >= 0.5) for v in values], pa.int32())
            columns = [*batch.columns, value, predicted, pa.array(spans, pa.list_(kind))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *names])

    added = [T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())]
    added.append(T.StructField(names[2], T._parse_datatype_string(PASSAGES)))
    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, *added]))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(id, held_out, score, predicted, passages) of every row.

    Null and empty texts have no passage and get the score of texts without evidence. A null id is not held out and never
    learnt from. Repeated rows come out as they came in; several labels of one id count as toxic if one is. Other columns
    are ignored.
    """
    model = fit(docs, labels, id_col, text_col, label_col)
    slim = docs.select(docs[id_col].alias(id_col), docs[text_col].alias("text"))
    scored = score_texts(slim, model)
    return scored.select(
        id_col, F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), "score", "predicted", "passages"
    )
