"""Language identification: averaged hashed subword embeddings and calibrated rejection.

The softmax has a class more than there are languages: texts of no language, made from
training texts by moving or replacing their letters. Rows that didn't teach the model set its
temperature and the least score that is accepted, so that texts of other languages, which
resemble no class, are rejected.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import subword
from .common import cut, remainder, tidy, utf8, values
from .op3_quality import fit

FEATURES = subword.Features(bits=15, high=3, letters=True)
UNDETERMINED = "und"
#: About so many documents of a language teach the model, chosen by a hash of id and text, and at
#: most this share of them; the others calibrate it.
PER_LANGUAGE, FIT_SHARE = 800, 0.8
MAX_LANGUAGES = 200
#: Of the calibrating rows this share also gives a text of no language.
NOISE_SHARE = 0.125
#: What the loss of a rightly labelled row weighs, for that of a text of no language rejected.
COST = 50
TEMPERATURES = tuple(2 ** (k / 4) for k in range(-8, 9))
#: Log odds of scores are counted in bins of this width, up to this bound at either end.
WIDTH, BOUND = 0.02, 20.0
#: Alphabets that letters are replaced from.
ALPHABETS = ((0x61, 0x7B), (0x3B1, 0x3CA), (0x430, 0x450), (0x5D0, 0x5EB), (0x3041, 0x3097), (0x4E00, 0x5000))


def noise(text: str) -> str:
    """A text of no language: the letters of ``text`` moved about, or each replaced by another."""
    text = text.lower()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    rng = np.random.default_rng(zlib.crc32(text.encode("utf-8", "surrogatepass")))
    at = np.flatnonzero(subword.is_letter(codes))
    kind = int(rng.integers(0, 2 * len(ALPHABETS)))
    if kind < len(ALPHABETS):
        found, which = np.unique(codes[at], return_inverse=True)
        letters = rng.permutation(np.arange(*ALPHABETS[kind]))
        codes[at] = np.resize(letters, len(found))[which]
    else:
        codes[at] = codes[at][rng.permutation(len(at))]
    return codes.tobytes().decode("utf-32-le", "surrogatepass")


def share_of(*columns: str) -> Column:
    """A hash of the columns as a number from 0 to 1."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def fit_share(lang: Column, counts: dict[str, int], per_language: int) -> Column:
    """The share of its language's rows, by ``share_of``, that teach the model."""
    share = F.lit(0.0)
    for name in sorted(counts):
        share = F.when(lang == name, F.lit(min(FIT_SHARE, per_language / counts[name]))).otherwise(share)
    return share


def language_counts(known: DataFrame, lang: str) -> dict[str, int]:
    counts = {r[lang]: r["n"] for r in known.groupBy(lang).agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return counts


def train_language(known: DataFrame, counts: dict[str, int], per_language: int = PER_LANGUAGE, features: subword.Features = FEATURES) -> dict | None:
    """Fit on a bounded hashed sample of each language of ``known`` (id, text, lang), and on texts
    of no language, about as many as of one language. None if no row has a letter."""
    names = sorted(counts)

    def each(texts: pa.Array, also: pa.Array) -> pa.Array:
        empty = (np.empty(0, np.int32), np.empty(0, np.float32))
        rows = []
        for x, n in zip(values(texts), also.to_pylist(), strict=True):
            text = x.decode("utf-8", "replace")
            rows.append((*subword.bag(text, features), *(subword.bag(noise(text), features) if n else empty)))
        return pa.StructArray.from_arrays([pa.array([r[i].tobytes() for r in rows], pa.binary()) for i in range(4)], names=["ids", "shares", "noise_ids", "noise_shares"])

    bags = F.arrow_udf(tidy(each), "struct<ids:binary,shares:binary,noise_ids:binary,noise_shares:binary>").asNondeterministic()
    u = share_of("id", "text")
    picked = known.where(u < fit_share(F.col("lang"), counts, per_language)).withColumn("u", u)
    picked = picked.select("id", "lang", "u", bags(utf8("text"), share_of("text", "id") < 1 / max(1, len(names))).alias("b"))
    # rows equal in id and text teach once, so that a row that is repeated often doesn't crowd out others
    rows = picked.select("id", "lang", "u", "b.*").dropDuplicates(["u"]).limit(2 * per_language * max(1, len(names))).collect()
    rows.sort(key=lambda r: (r.u, str(r.id)))
    taught = [(r.ids, r.shares, names.index(r.lang)) for r in rows if len(r.ids)]
    if not taught:
        return None
    taught += [(r.noise_ids, r.noise_shares, len(names)) for r in rows if len(r.noise_ids)]
    return fit(taught, len(names) + 1, features) | {"names": names}


def logits(text: Column, also: Column, model: dict) -> Column:
    """struct<z, noise>: the classes' logits of binary UTF-8 texts, null without a letter, and
    where ``also`` those of the text of no language made from it."""

    def of(text: str) -> np.ndarray | None:
        return subword.logits(text, model) if any(map(str.isalpha, text)) else None

    def each(texts: pa.Array, flags: pa.Array) -> pa.Array:
        z, n = [], []
        for x, f in zip(values(texts), flags.to_pylist(), strict=True):
            s = x.decode("utf-8", "replace")
            z.append(of(s))
            n.append(of(noise(s)) if f and z[-1] is not None else None)
        return pa.StructArray.from_arrays([pa.array(x, pa.list_(pa.float64())) for x in (z, n)], names=["z", "noise"])

    return F.arrow_udf(tidy(each), "struct<z:array<double>,noise:array<double>>").asNondeterministic()(text, also)


def log_total(z: Column, temperature: float) -> Column:
    """The logarithm of the sum of the exponentials of ``z`` less its greatest, over the temperature."""
    return F.ln(F.aggregate(F.transform(z, lambda x: F.exp((x - F.array_max(z)) / temperature)), F.lit(0.0), lambda a, x: a + x))


def best_of(z: Column, languages: int, temperature: float) -> Column:
    """The probability of the likeliest language, without the class of no language."""
    return F.exp((F.array_max(F.slice(z, 1, languages)) - F.array_max(z)) / temperature - log_total(z, temperature))


def log_odds(p: Column) -> Column:
    return F.least(F.lit(BOUND), F.greatest(F.lit(-BOUND), F.ln(F.greatest(p, F.lit(1e-300)) / F.greatest(1.0 - p, F.lit(1e-300)))))


def temperature_of(rows: DataFrame) -> float:
    """That of ``TEMPERATURES`` at which rows (z, truth: the place of the right class) are likeliest; 1 without rows."""
    loss = lambda t: F.sum(log_total(F.col("z"), t) - (F.get("z", F.col("truth")) - F.array_max("z")) / t)
    found = rows.agg(*[loss(t).alias(str(k)) for k, t in enumerate(TEMPERATURES)]).first()
    return 1.0 if found[0] is None else min(zip(found, TEMPERATURES, strict=True))[1]


def calibrate(scored: DataFrame, cost: float = COST) -> float:
    """The log odds below which documents are rejected, from (score, wanted) of calibrating rows.

    wanted: whether the row is rightly predicted; others are texts of no language and wrong
    predictions. All are counted by log odds in bins. The share of unwanted rows below the
    threshold, less ``cost`` times that of wanted ones, is greatest; of equal thresholds the
    middle is taken. Without rows of both kinds nothing is below it.
    """
    bins = scored.groupBy(F.floor((log_odds(F.col("score")) + BOUND) / WIDTH).cast("int").alias("bin"), "wanted").agg(F.count("*").alias("n")).collect()
    n = np.zeros((2, int(2 * BOUND / WIDTH) + 2))
    for r in bins:
        n[int(r.wanted), r.bin + 1] = r["n"]
    if not n.sum(axis=1).all():
        return -np.inf
    gain = (np.cumsum(n, axis=1) / n.sum(axis=1, keepdims=True) * [[1], [-cost]]).sum(axis=0)
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float((best[0] + best[-1]) / 2 * WIDTH - BOUND)


def held_out(key):
    return F.coalesce(remainder(key, 4) == 2, F.lit(False))


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: tuple[str, ...] = (), per_language: int = PER_LANGUAGE) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, rejected, and ``carry``.

    lang_pred is a learned value, or ``und`` with score 0 where the text is null or has no
    letter. score: the calibrated probability of lang_pred. rejected: ``und``, or a score under
    the calibrated threshold. Only rows outside the held-out fold that have text and language
    teach or calibrate; the language column is never an input of a prediction. Without such
    rows all is ``und``. Repeated rows get the same result; an empty table gives no rows.
    """
    key, lang = F.col(id_col), F.col(lang_col).cast("string")
    known = docs.select(key.alias("id"), F.col(text_col).alias("text"), lang.alias("lang"))
    known = known.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out("id"))
    counts = language_counts(known, "lang")
    model = train_language(known, counts, per_language) if counts else None
    named = [F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]
    carried = [F.col(f"c{i}").alias(c) for i, c in enumerate(carry)]
    base = docs.select(key.alias("doc_id"), F.col(text_col).alias("text"), lang.alias("lang"), held_out(id_col).alias("held_out"), *named)
    if model is None:
        return base.select("doc_id", "held_out", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"), *carried)
    names = model["names"]
    tells = F.col("text").isNotNull() & F.col("lang").isNotNull() & ~F.col("held_out") & (share_of("doc_id", "text") >= fit_share(F.col("lang"), counts, per_language))
    truth = F.when(tells, F.array_position(F.array(*map(F.lit, names)), F.col("lang")).cast("int") - 1)
    rows = base.withColumn("truth", truth).withColumn("p", logits(utf8("text"), F.col("truth").isNotNull() & (share_of("text", "doc_id") < NOISE_SHARE), model))
    rows = cut(rows.select("doc_id", "held_out", "truth", "p.z", "p.noise", *[f"c{i}" for i in range(len(carry))]))
    told = rows.where("truth is not null and z is not null")
    temperature = temperature_of(told)
    k = len(names)
    likeliest = F.array_position(F.slice("z", 1, k), F.array_max(F.slice("z", 1, k))).cast("int") - 1
    right = told.select(best_of(F.col("z"), k, temperature).alias("score"), (likeliest == F.col("truth")).alias("wanted"))
    none = rows.where("noise is not null").select(best_of(F.col("noise"), k, temperature).alias("score"), F.lit(False).alias("wanted"))
    least = calibrate(right.unionByName(none))
    score = F.when(F.col("z").isNull(), 0.0).otherwise(best_of(F.col("z"), k, temperature))
    pred = F.when(F.col("z").isNull(), UNDETERMINED).otherwise(F.get(F.array(*map(F.lit, names)), likeliest))
    out = rows.select("doc_id", "held_out", pred.alias("lang_pred"), score.alias("score"), "z", *[f"c{i}" for i in range(len(carry))])
    return out.select("doc_id", "held_out", "lang_pred", "score", (F.col("z").isNull() | (log_odds(F.col("score")) < least)).alias("rejected"), *carried)
