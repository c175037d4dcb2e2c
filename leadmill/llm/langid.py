"""Language identification by error-correcting output codes.

Each language has a codeword of bits. For every bit, a logistic classifier on hashed byte
n-grams predicts whether a text's language has it set. A text's language is the one whose
codeword has the smallest logistic loss against the bits' outputs, each bit weighted by how
well it did in training. Two languages with nearly the same loss are flagged as ambiguous.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from leadmill.llm.folds import held_out

DIMS = 4096
#: The classifiers are fitted on at most so many documents, and so many of a language.
MAX_TRAIN = 4000
MAX_PER_LANGUAGE = 800
UNKNOWN = "und"
#: Probabilities nearer than this are ambiguous.
MARGIN = 0.2

_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = [b if chr(b).isalpha() else 32 for b in range(128)]


def features(text: str) -> np.ndarray:
    """Unit vector of the square roots of hashed counts of 2- and 3-grams of bytes."""
    b = _FOLD[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)]
    b = b[np.concatenate(([True], (b[1:] != 32) | (b[:-1] != 32)))].astype(np.uint32)
    two = b[:-1] * np.uint32(257) + b[1:]
    three = two[:-1] * np.uint32(65599) + b[2:] * np.uint32(40503)
    n = np.bincount((two * np.uint32(2654435761)) >> np.uint32(20), minlength=DIMS)
    n += np.bincount((three * np.uint32(2246822519)) >> np.uint32(20), minlength=DIMS)
    v = np.sqrt(n.astype(np.float32))
    return v / max(float(np.sqrt(v @ v)), 1e-9)


def codewords(n: int) -> np.ndarray:
    """n rows of bits, as 1 and -1.

    Up to five languages get the exhaustive code. More get, of 200 random codes of about
    10 log2(n) bits, the one whose nearest two codewords are furthest apart.
    """
    if n == 0:
        return np.zeros((0, 0), np.float32)
    if n <= 5:
        columns = [[1 - 2 * (c >> r & 1) for r in range(n)] for c in range(1, 1 << max(0, n - 1))]
        return np.array(columns, np.float32).reshape(-1, n).T
    rng = np.random.default_rng(7)
    bits = int(np.ceil(10 * np.log2(n)))
    best = None
    for _ in range(200):
        m = np.where(rng.random((n, bits)) < 0.5, 1, -1).astype(np.float32)
        m[0, np.abs(m.sum(0)) == n] *= -1  # each bit must tell some languages apart
        agree = m @ m.T - 2 * bits * np.eye(n)
        if best is None or agree.max() < best[0]:
            best = agree.max(), m
    return best[1]


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, list[bool]]:
        """Language, score and whether the choice is ambiguous."""
        known = [bool(t and self.languages and _LETTER.search(t)) for t in texts]
        names, scores, doubt = [UNKNOWN] * len(texts), np.zeros(len(texts)), [False] * len(texts)
        at = [k for k, x in enumerate(known) if x]
        for i in range(0, len(at), 256):
            part = at[i : i + 256]
            x = np.stack([features(texts[k]) for k in part])
            out = x @ self.weights + self.bias
            # Loss of each language's codeword: sum over bits of trust * log(1 + exp(-bit * out)).
            loss = np.logaddexp(0, -self.code[None] * out[:, None, :]) @ self.trust
            p = np.exp(loss.min(1, keepdims=True) - loss)
            p /= p.sum(1, keepdims=True)
            order = np.sort(p, 1)[:, ::-1]
            for k, row, top in zip(part, p, order):
                names[k] = self.languages[int(row.argmax())]
                scores[k] = min(1.0, float(top[0]))
                doubt[k] = bool(len(top) > 1 and top[0] - top[1] < MARGIN)
        return names, scores, doubt


def fit(x: np.ndarray, labels: np.ndarray, languages: list[str]) -> Model:
    """All bits' classifiers at once, by gradient descent with momentum; classes weigh alike."""
    code = codewords(len(languages))
    bits = code.shape[1]
    w, bias = np.zeros((x.shape[1], bits), np.float32), np.zeros(bits, np.float32)
    target = code[labels]
    share = np.bincount(labels, minlength=len(languages))[labels]
    weight = (1 / (share * len(languages)))[:, None].astype(np.float32)
    dw, db = np.zeros_like(w), np.zeros_like(bias)
    for _ in range(150 if bits else 0):
        out = x @ w + bias
        g = -target * weight / (1 + np.exp(target * out))
        dw = 0.9 * dw + x.T @ g + 1e-6 * w
        db = 0.9 * db + g.sum(0)
        w -= 8.0 * dw
        bias -= 0.5 * db
    right = ((x @ w + bias) * target > 0).astype(np.float32)
    trust = np.clip((right * weight).sum(0), 0.05, 1) if bits else np.zeros(0, np.float32)
    return Model(languages, code, w, bias, trust)


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> Model:
    """Fit on a bounded sample of the documents outside the held-out fold that have a language.

    Of each language, the same number of documents is taken at most; which ones, a hash of
    their ids and texts decides. Null texts are left out.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    ).where(~held_out("id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return fit(np.zeros((0, DIMS), np.float32), np.zeros(0, np.int64), [])
    each = min(MAX_PER_LANGUAGE, max(1, MAX_TRAIN // len(languages)))
    cut = F.create_map(*[F.lit(v) for c in languages for v in (c, counts[c])])
    share = F.lit(1 << 30) * (each / cut[F.col("lang")])
    chosen = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) < share)

    def work(batches):
        for pdf in batches:
            vectors = [features(t).astype(np.float16).tobytes() for t in pdf["text"]]
            yield pd.DataFrame({"lang": pdf["lang"], "x": vectors})

    # Repeated rows count once, however often they come up; partial results drop them early.
    one = chosen.select("id", "lang", "text").distinct().select("lang", "text")
    got = one.mapInPandas(work, "lang string, x binary").toPandas()
    got = got.sort_values(["lang", "x"], ignore_index=True)
    x = np.stack([np.frombuffer(v, np.float16) for v in got["x"]]).astype(np.float32)
    seen = sorted(set(got["lang"]))
    return fit(x, np.searchsorted(seen, got["lang"]), seen)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"):
    """One row per row of docs: its id, lang_pred, score (0 to 1) and ambiguous.

    Texts that are null or have no letter get `und` and score 0, as do all if no language was
    learned. Whole texts are read; other columns are neither read nor carried.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            names, scores, doubt = model.predict(pdf["text"].tolist())
            yield pd.DataFrame(
                {"id": pdf["id"], "lang_pred": names, "score": scores, "ambiguous": doubt}
            )

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(
        work, f"id {kind}, lang_pred string, score double, ambiguous boolean"
    )
    return out.withColumnRenamed("id", id_col)
