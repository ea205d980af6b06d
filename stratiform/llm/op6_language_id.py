"""Language ID by interpolated Kneser-Ney character models, one per language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from stratiform.llm.common import crc_of_id, documents, materialize, mix64, slices

ORDER = 4
#: Bounds of what is learned from: documents of a language for counts, and in all for calibration;
#: most n-grams of a language that a model keeps (the most frequent; all lower orders follow from them).
TRAIN_DOCS, CALIBRATION_DOCS, MOST_NGRAMS = 4_000, 3_000, 300_000
#: Bytes of text that are looked up at once.
SLICE = 1 << 19
HELD_OUT, FOLDS = 0, 5
UNKNOWN = "und"
_U = np.uint64
_LETTER = np.zeros(0x110000, bool)


def _letters() -> np.ndarray:
    if not _LETTER.any():
        _LETTER[:] = [chr(c).isalpha() for c in range(0x110000)]
    return _LETTER


def characters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters as 16-bit codes, each run of others as one 0: (code, document).

    Every text with a letter starts and ends with a 0; a text without one yields nothing.
    """
    joined = "\n".join((t or "").replace("\n", " ") for t in texts).lower() if texts else ""
    # lower() may change a length, so documents are told apart by their line feeds
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.cumsum(cp == 10) - (cp == 10)
    letter = _letters()[cp]
    code = np.where(letter, (cp ^ (cp >> np.uint32(16)) * np.uint32(0x9E37)) & np.uint32(0xFFFF), 0).astype(np.uint16)
    code[letter & (code == 0)] = 1
    has = np.bincount(doc[letter], minlength=len(texts)) > 0 if len(doc) else np.zeros(len(texts), bool)
    n = len(texts)
    # a 0 in front of and behind each document; runs of others shrink to one
    code = np.concatenate([code, np.zeros(2 * n, np.uint16)])
    doc = np.concatenate([doc, np.arange(n), np.arange(n)])
    place = np.concatenate([np.arange(len(cp)) + 1, np.searchsorted(doc[: len(cp)], np.arange(n)), np.searchsorted(doc[: len(cp)], np.arange(n), side="right") + 1])
    order = np.lexsort((place, doc))
    code, doc = code[order], doc[order]
    keep = has[doc]
    code, doc = code[keep], doc[keep]
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0) | (doc[1:] != doc[:-1])
    return code[keep], doc[keep]


def ngrams(code: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed ``ORDER``-grams that end at each character but the first of a document: (gram, document).

    Contexts that would reach before a document are filled with 0.
    """
    out = np.zeros(len(code), _U)
    for back in range(ORDER):
        c = np.zeros(len(code), _U)
        c[back:] = code[: len(code) - back]
        if back:
            same = np.zeros(len(code), bool)
            same[back:] = doc[back:] == doc[: len(doc) - back]
            c[~same] = 0
        out |= c << _U(16 * back)
    first = np.ones(len(code), bool)
    first[1:] = doc[1:] != doc[:-1]
    return out[~first], doc[~first]


@dataclass
class Model:
    """Sorted hashes of n-grams and contexts of each order, with a column for each language.

    ``keys[n]`` and ``alpha[n]``: discounted probabilities of n-grams; ``ctx[n]`` and ``gamma[n]``:
    weights of the lower order after a context of n - 1 characters.
    """

    langs: list[str]
    keys: list[np.ndarray]
    alpha: list[np.ndarray]
    ctx: list[np.ndarray]
    gamma: list[np.ndarray]
    floor: np.ndarray
    scale: float = 1.0
    limit: np.ndarray | None = None


def _find(keys: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(q), np.int64), np.zeros(len(q), bool)
    at = np.minimum(np.searchsorted(keys, q), len(keys) - 1)
    return at, keys[at] == q


def _hash(gram: np.ndarray, n: int) -> np.ndarray:
    """Hash of the last n characters of packed grams."""
    mask = _U((1 << (16 * n)) - 1) if n < 4 else _U(0xFFFFFFFFFFFFFFFF)
    return mix64((gram & mask) * _U(2) + _U(n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))


def fit(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """Models from each language's (gram, count) arrays."""
    langs = sorted(counts)
    per: list[list[dict]] = []
    vocabulary = max(2, len(np.unique(np.concatenate([g & _U(0xFFFF) for g, _ in counts.values()]))) if counts else 2)
    for lang in langs:
        gram, c = counts[lang]
        orders = []
        for n in range(ORDER, 0, -1):
            mask = _U(0xFFFFFFFFFFFFFFFF) if n == 4 else _U((1 << (16 * n)) - 1)
            if n < ORDER:  # continuation counts: distinct characters in front
                gram, c = np.unique(gram & mask, return_counts=True)
            n1, n2 = int((c == 1).sum()), int((c == 2).sum())
            d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            context, inverse = np.unique(gram >> _U(16), return_inverse=True)
            total = np.bincount(inverse, c)
            kinds = np.bincount(inverse)
            orders.append({"n": n, "gram": gram, "alpha": np.maximum(c - d, 0) / total[inverse], "ctx": context, "gamma": d * kinds / total})
        per.append(orders)
    keys, alpha, ctx, gamma = [], [], [], []
    for o in range(ORDER):
        n = ORDER - o
        for field, value, names, columns, shift in (("gram", "alpha", keys, alpha, 0), ("ctx", "gamma", ctx, gamma, 1)):
            all_keys = [_hash(p[o][field] << _U(16 * shift) if shift else p[o][field], n) for p in per]
            union = np.unique(np.concatenate(all_keys)) if per else np.zeros(0, _U)
            table = np.full((len(union), len(langs)), 0.0 if value == "alpha" else 1.0, np.float32)
            for j, (k, p) in enumerate(zip(all_keys, per)):
                table[np.searchsorted(union, k), j] = p[o][value]
            names.append(union)
            columns.append(table)
    return Model(langs, keys, alpha, ctx, gamma, np.full(len(langs), 1.0 / vocabulary, np.float32))


def log_probabilities(model: Model, gram: np.ndarray) -> np.ndarray:
    """log2 P(last character | the ones before) of packed grams, for each language."""
    p = np.repeat(model.floor[None], len(gram), 0)
    for o in range(ORDER - 1, -1, -1):
        n = ORDER - o
        at, hit = _find(model.ctx[o], _hash(gram >> _U(16) << _U(16), n))
        weight = np.where(hit[:, None], model.gamma[o][at], np.float32(1.0))
        at, hit = _find(model.keys[o], _hash(gram, n))
        p = weight * p + np.where(hit[:, None], model.alpha[o][at], np.float32(0.0))
    return np.log2(np.maximum(p, 1e-12))


def entropies(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy in bits a character of each text under each language, and its characters."""
    code, doc = characters(texts)
    gram, doc = ngrams(code, doc)
    n = np.bincount(doc, minlength=len(texts))
    if not len(gram) or not model.langs:
        return np.full((len(texts), len(model.langs)), np.inf), n
    kinds, inverse = np.unique(gram, return_inverse=True)
    bits = -log_probabilities(model, kinds)
    out = np.stack([np.bincount(doc, bits[inverse, j], len(texts)) for j in range(len(model.langs))], 1)
    return np.where(n[:, None] > 0, out / np.maximum(n, 1)[:, None], np.inf), n


def decide(model: Model, h: np.ndarray, n: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language of least entropy (ties: the first by name), its probability, and whether it is rejected."""
    if not model.langs:
        return [UNKNOWN] * len(n), np.zeros(len(n)), np.ones(len(n), bool)
    best = h.argmin(1)
    least = h[np.arange(len(n)), best]
    with np.errstate(invalid="ignore"):
        gap = np.where(n[:, None] > 0, h - least[:, None], 0.0)
    odds = np.exp2(-np.minimum(model.scale * gap * np.sqrt(n)[:, None], 60.0)).sum(1)
    score = np.where(n > 0, 1.0 / odds, 0.0)
    rejected = (n == 0) | ((least > model.limit[best]) if model.limit is not None else False)
    return [model.langs[b] if k else UNKNOWN for b, k in zip(best, n)], score, rejected


def learn(docs: DataFrame, learnable: F.Column | None = None) -> Model:
    """Fit and calibrate on rows with a language that ``learnable`` admits.

    A hash of the id picks ``TRAIN_DOCS`` documents of each language for the counts and others for
    the calibration (about as many; all where there are fewer). Counts are summed by Spark.
    Calibration fits the scale of the probability by log-loss, and for each language the entropy
    above which a text is rejected: a quarter above that of the worst of its own texts.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if learnable is not None:
        rows = rows.where(learnable)
    per_lang = dict(rows.groupBy("lang").count().collect())  # one row for each language
    if not per_lang:
        return fit({})
    u = F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1_000_000)) / F.lit(1e6)
    n = F.create_map(*[F.lit(x) for kv in per_lang.items() for x in kv])[F.col("lang")]
    train = u < F.least(F.lit(0.8), F.lit(float(TRAIN_DOCS)) / n)
    check = (u >= F.lit(0.8)) & (u < F.lit(0.8) + F.least(F.lit(0.2), F.lit(float(CALIBRATION_DOCS)) / F.lit(float(sum(per_lang.values())))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                names, index = np.unique(np.array(part.column("lang").to_pylist(), dtype=object), return_inverse=True)
                gram, doc = ngrams(*characters(part.column("text").to_pylist()))
                for j, name in enumerate(names):
                    g, c = np.unique(gram[index[doc] == j], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(c, pa.int64())], ["lang", "gram", "n"])

    sums = rows.where(train).select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    sums = materialize(sums, "op6-counts")
    counts = {}
    for lang in sorted(per_lang):
        got = sums.where(F.col("lang") == lang).orderBy(F.desc("n"), "gram").limit(MOST_NGRAMS).toPandas()
        if len(got):
            counts[lang] = (got["gram"].to_numpy().view(np.uint64), got["n"].to_numpy().astype(np.int64))
            order = np.argsort(counts[lang][0])
            counts[lang] = tuple(x[order] for x in counts[lang])
    model = fit(counts)
    if not model.langs:
        return model
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MOST_NGRAMS rows a language at most

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                h, n = entropies(shared.value, part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array(n, pa.int64()), pa.array([x.tolist() for x in h], pa.list_(pa.float64()))], ["lang", "n", "h"])

    seen = rows.where(check).select("lang", "text").mapInArrow(measure, "lang string, n long, h array<double>").toPandas()
    seen = seen[(seen["n"] > 0) & seen["lang"].isin(model.langs)]
    if not len(seen):
        return model
    h, n = np.stack(seen["h"].to_numpy()), seen["n"].to_numpy()
    true = np.array([model.langs.index(x) for x in seen["lang"]])
    best, loss = 1.0, np.inf
    for scale in np.geomspace(0.02, 8.0, 30):
        z = -scale * (h - h.min(1)[:, None]) * np.sqrt(n)[:, None] * np.log(2)
        got = -(z[np.arange(len(n)), true] - np.log(np.exp(z).sum(1))).mean()
        if got < loss:
            best, loss = scale, got
    own = h[np.arange(len(n)), true]
    worst = np.array([own[true == j].max() if (true == j).any() else own.max() for j in range(len(model.langs))])
    model.scale, model.limit = float(best), 1.25 * worst
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Predict every whole text: all columns, and lang_pred, score (0 to 1) and rejected.

    A text that is null or has no letter is ``und`` with score 0 and rejected; a text much less
    predictable than any of its language's calibration texts is rejected, too. Predictions use
    the text only. Repeated rows agree; columns of the result's names are replaced; an empty
    table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                lang, score, out = decide(shared.value, *entropies(shared.value, part.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in kept), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(out, pa.bool_())], [*kept, "lang_pred", "score", "rejected"]
                )

    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return docs.select(*kept).mapInArrow(predict, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from the folds that are not held out, predict all documents."""
    docs = documents(spark, sf_dir)
    fold = F.pmod(crc_of_id("doc_id"), F.lit(FOLDS))
    model = learn(docs, fold != HELD_OUT)
    return identify(docs.select("doc_id", (fold == HELD_OUT).alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
