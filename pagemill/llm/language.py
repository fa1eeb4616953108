"""Language identification by a convolutional network over bytes, trained and applied in numpy.

Byte embeddings, filters of several widths, ReLU, max pooling over a fixed-length window, softmax. A text is
cut into windows that cover all of its bytes; its class probabilities are the windows' mean, weighted by bytes.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import pieces, task

WINDOW, WIDTHS, FILTERS, EMBEDDING = 256, (2, 3, 4), 16, 8
#: Bounds of the labelled sample: rows, and windows of each. The fit never sees more, whatever the corpus.
SAMPLE_ROWS, SAMPLE_WINDOWS = 4_000, 3
UNDETERMINED = "und"
#: Invented texts without a language for each labelled one, in the model that rejects.
NEGATIVES = 0.5
#: What it takes to be rejected: letters, and the score of having no language.
LEAST_LETTERS, SURE = 100, 0.9
# First and last letters of scripts that texts without a known language are invented from.
SCRIPTS = {"Greek": (0x3B1, 0x3C9), "Cyrillic": (0x430, 0x44F), "Armenian": (0x561, 0x586), "Hebrew": (0x5D0, 0x5EA), "Arabic": (0x621, 0x64A), "Devanagari": (0x905, 0x939), "Bengali": (0x985, 0x9B9), "Thai": (0xE01, 0xE30), "Georgian": (0x10D0, 0x10F0), "Hiragana": (0x3042, 0x3093), "Han": (0x4E00, 0x9FA5), "Hangul": (0xAC00, 0xD7A3)}
LETTER = regex.compile(r"\p{L}")


@dataclass
class ByteCNN:
    """The trained network; ``tables[width]`` are embedding and filter folded into one lookup per offset."""

    classes: list[str]
    embedding: np.ndarray
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    dense: np.ndarray
    dense_bias: np.ndarray

    def tables(self) -> dict[int, np.ndarray]:
        return {k: np.ascontiguousarray(np.einsum("be,kef->kbf", self.embedding, w).astype(np.float32)) for k, w in self.filters.items()}

    def pooled(self, windows: np.ndarray, tables: dict[int, np.ndarray]) -> np.ndarray:
        """Max-pooled, rectified features of windows (rows of bytes)."""
        n, length = windows.shape
        out = []
        for k, t in tables.items():
            acc = t[0][windows[:, : length - k + 1]]
            for j in range(1, k):
                acc += t[j][windows[:, j : length - k + 1 + j]]
            out.append(np.maximum(acc.max(axis=1) + self.bias[k], 0))
        return np.concatenate(out, axis=1)

    def probabilities(self, windows: np.ndarray, tables: dict[int, np.ndarray], step: int = 512) -> np.ndarray:
        parts = [np.zeros((0, len(self.classes)), np.float64)]
        for i in range(0, len(windows), step):
            z = self.pooled(windows[i : i + step], tables) @ self.dense + self.dense_bias
            z = np.exp(z.astype(np.float64) - z.max(axis=1, keepdims=True))
            parts.append(z / z.sum(axis=1, keepdims=True))
        return np.concatenate(parts)


def windows_of(raw: bytes, window: int = WINDOW) -> np.ndarray:
    """The bytes cut into rows of ``window``, the last one zero-padded."""
    rows = max(1, -(-len(raw) // window))
    out = np.zeros(rows * window, np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(rows, window)


def train(texts: list[bytes], labels: list[str], epochs: int = 12, batch: int = 128, rate: float = 0.01, seed: int = 11) -> ByteCNN | None:
    """Fit the network by Adam on one window per text; None where there is nothing to learn from."""
    classes = sorted(set(labels))
    if not classes:
        return None
    rng = np.random.default_rng(seed)
    x = np.stack([windows_of(t[:WINDOW])[0] for t in texts])
    y = np.array([classes.index(c) for c in labels])
    p: dict[object, np.ndarray] = {"e": rng.normal(0, 0.5, (256, EMBEDDING))}
    p |= {("w", k): rng.normal(0, (2 / (k * EMBEDDING)) ** 0.5, (k, EMBEDDING, FILTERS)) for k in WIDTHS}
    p |= {("b", k): np.zeros(FILTERS) for k in WIDTHS}
    p |= {"d": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(classes))), "c": np.zeros(len(classes))}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    t = 0
    steps = max(epochs * len(x) // batch, 150)
    order = np.zeros(0, int)
    for _ in range(steps):
        if len(order) < min(batch, len(x)):
            order = rng.permutation(len(x))
        idx, order = order[:batch], order[batch:]
        xb, yb = x[idx], y[idx]
        emb = p["e"][xb]
        feats, picks = [], []
        for k in WIDTHS:
            n = WINDOW - k + 1
            acc = sum(emb[:, j : j + n] @ p["w", k][j] for j in range(k))
            at = acc.argmax(axis=1)
            top = np.take_along_axis(acc, at[:, None], axis=1)[:, 0] + p["b", k]
            feats.append(np.maximum(top, 0))
            picks.append((at, top > 0))
        h = np.concatenate(feats, axis=1)
        z = h @ p["d"] + p["c"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        z[np.arange(len(yb)), yb] -= 1
        z /= len(yb)
        g = {"d": h.T @ z + 1e-4 * p["d"], "c": z.sum(axis=0), "e": np.zeros_like(p["e"])}
        dh = z @ p["d"].T
        rows = np.arange(len(yb))[:, None]
        for i, k in enumerate(WIDTHS):
            at, on = picks[i]
            d = dh[:, i * FILTERS : (i + 1) * FILTERS] * on
            g["b", k] = d.sum(axis=0)
            gw = np.empty_like(p["w", k])
            for j in range(k):
                seen = emb[rows, at + j]  # rows x filters x embedding
                gw[j] = np.einsum("nfe,nf->ef", seen, d)
                np.add.at(g["e"], xb[rows, at + j], np.einsum("nf,ef->nfe", d, p["w", k][j]))
            g["w", k] = gw
        t += 1
        for key, grad in g.items():
            m[key] = 0.9 * m[key] + 0.1 * grad
            v[key] = 0.999 * v[key] + 0.001 * grad * grad
            p[key] = (p[key] - rate * (m[key] / (1 - 0.9**t)) / (np.sqrt(v[key] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return ByteCNN(classes, p["e"], {k: p["w", k] for k in WIDTHS}, {k: p["b", k] for k in WIDTHS}, p["d"], p["c"])


def invented(texts: list[str], count: int, seed: int = 17) -> list[str]:
    """``count`` texts of no language: letters of ``texts`` in another order, random letters, code, digits, scripts that ``texts`` lack."""
    rng = random.Random(seed)
    seen = {name for name, (a, b) in SCRIPTS.items() if any(a <= ord(c) <= b for t in texts for c in set(t))}
    foreign = [v for k, v in SCRIPTS.items() if k not in seen]
    word = lambda letters, low=1, high=9: "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))
    low = "abcdefghijklmnopqrstuvwxyz"

    def shuffled() -> str:
        letters = [c for c in rng.choice(texts) if not c.isspace()]
        rng.shuffle(letters)
        it = iter(letters)
        return " ".join(iter(lambda: "".join(c for _, c in zip(range(rng.randint(1, 9)), it, strict=False)), ""))

    def code() -> str:
        name = lambda: word(low, 1, 6) + rng.choice(("", "_" + word(low, 1, 5), str(rng.randint(0, 99)), word(low, 2, 5).capitalize()))
        line = lambda: rng.choice((f"{name()} = {name()}({name()}, {rng.randint(0, 999)});", f"if ({name()} < {name()}) {{", f"  return {name()}[{name()}];", "}", f"def {name()}({name()}):", f"for {name()} in {name()}.{name()}():", f"<{name()} {name()}='{name()}'>", f"{name()}->{name()} += 0x{rng.randrange(1 << 32):x};", f"import {name()}.{name()}", f"// {name()} {name()}"))
        return "\n".join(line() for _ in range(rng.randint(3, 14)))

    def other() -> str:
        a, b = rng.choice(foreign)
        letters = [chr(rng.randint(a, b)) for _ in range(40)]
        return " ".join(word(letters) for _ in range(40))

    makers = [shuffled, shuffled, code, lambda: " ".join(word(low) for _ in range(40)), lambda: word(low + low.upper() + "0123456789+/", 40, 250), lambda: " ".join(word("0123456789abcdef", 1, 16) for _ in range(20)), *([other] * 2 if foreign else [])]
    return [rng.choice(makers)()[:WINDOW] for _ in range(count)]


def _remainder(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rejecting: bool = False) -> ByteCNN | None:
    """Train on windows at hashed places of at most SAMPLE_ROWS labelled rows outside the held-out fold.

    ``rejecting`` adds invented texts as one more class, ``und``.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL AND text != ''").where(_remainder(F.col("id")) != 0)
    cut = [F.substring("text", (F.pmod(F.xxhash64("id", F.lit(k)), F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1) + 1).cast("int"), WINDOW).alias(f"w{k}") for k in range(SAMPLE_WINDOWS)]
    # a hash threshold leaves about twice the bound, whatever the number of rows, for the final choice by the same hash
    share = min(1.0, 2 * SAMPLE_ROWS / max(1, rows.count()))
    hashed = rows.withColumn("h", F.xxhash64("id", "text")).where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = hashed.select("lang", *cut, "h").orderBy(F.pmod("h", F.lit(1 << 30)), "h", "lang").limit(SAMPLE_ROWS).collect()
    texts, labels = [], []
    for r in sample:
        for w in {r[f"w{k}"] for k in range(SAMPLE_WINDOWS)}:
            if LETTER.search(w):
                texts.append(w.encode("utf-8"))
                labels.append(r.lang)
    order = sorted(range(len(texts)), key=lambda i: (texts[i], labels[i]))
    if rejecting and order:
        none = invented([texts[i].decode("utf-8") for i in order], max(1, int(NEGATIVES * len(texts))))
        texts, labels = texts + [t.encode("utf-8")[:WINDOW] for t in none], labels + [UNDETERMINED] * len(none)
        order = sorted(range(len(texts)), key=lambda i: (texts[i], labels[i]))
    return train([texts[i] for i in order], [labels[i] for i in order])


@task("language")
def _predictions(batches: Iterator[pa.RecordBatch], model: ByteCNN | None, column: str) -> Iterator[tuple[pa.RecordBatch, list[str], np.ndarray]]:
    """Slices of the batches with the language and score of each text."""
    tables = model.tables() if model else {}
    for batch in batches:
        for part, data, offsets in pieces(batch, column, limit=500_000):
            texts = part.column(part.schema.get_field_index(column))
            letters = np.array([bool(t.is_valid and LETTER.search(t.as_py())) for t in texts], bool)
            n, langs, scores = len(offsets) - 1, [UNDETERMINED] * part.num_rows, np.zeros(part.num_rows)
            if model and letters.any():
                sizes = np.diff(offsets)
                rows = np.where(letters, -(-sizes // WINDOW), 0)
                ends = np.cumsum(rows)
                flat = np.zeros((int(ends[-1]) if n else 0) * WINDOW, np.uint8)
                for k in np.flatnonzero(letters):
                    at = int(ends[k] - rows[k]) * WINDOW
                    flat[at : at + sizes[k]] = data[offsets[k] : offsets[k + 1]]
                prob = model.probabilities(flat.reshape(-1, WINDOW), tables)
                own = np.flatnonzero(rows)
                weight = np.full(len(prob), WINDOW, float)
                weight[ends[own] - 1] = sizes[own] - (rows[own] - 1) * WINDOW
                mean = np.add.reduceat(prob * weight[:, None], ends[own] - rows[own]) / sizes[own, None]
                best = mean.argmax(axis=1)
                for k, b, s in zip(own, best, mean[np.arange(len(own)), best], strict=True):
                    langs[k], scores[k] = model.classes[b], min(1.0, float(s))
            yield part, langs, scores


def _predict(batches: Iterator[pa.RecordBatch], model: ByteCNN | None) -> Iterator[pa.RecordBatch]:
    for part, langs, scores in _predictions(batches, model, "text"):
        yield pa.record_batch([part.column(0), part.column(2), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])


def keep_identified(df: DataFrame, model: ByteCNN | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows, all columns as they are, whose text has a language.

    Without ``model`` one is trained that also knows texts of no language (shuffled letters, code, unknown scripts);
    a text of LEAST_LETTERS letters or more goes where that class, ``und``, has a score of at least SURE over its whole
    length: a short one full of numbers and names says too little. A null or letterless text goes. With nothing labelled there is no model and every text goes; ties go to the first class in
    order; repeated rows are judged each for itself; an empty table stays empty. Narrow: no shuffle.
    """
    model = model or fit(df, id_col, text_col, lang_col, rejecting=True)

    def stays(lang: str, score: float, text: pa.Scalar) -> bool:
        if lang != UNDETERMINED or model is None:
            return lang != UNDETERMINED
        letters = len(LETTER.findall(text.as_py() or ""))
        return 0 < letters and (letters < LEAST_LETTERS or score < SURE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, langs, scores in _predictions(batches, model, text_col):
            texts = part.column(part.schema.get_field_index(text_col))
            yield part.filter(pa.array([stays(*x) for x in zip(langs, scores.tolist(), texts, strict=True)], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def identify(df: DataFrame, model: ByteCNN | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text; without ``model`` one is trained on the rows themselves.

    A null text or one without letters is ``und`` with score 0, and so is every text if nothing is labelled;
    a null id counts as the empty string for the fold; repeated rows and ids are predicted row by row; equal
    probabilities give the first language in order; an empty table gives no rows; other columns are ignored.
    Narrow: no shuffle; the model is a few kilobytes.
    """
    model = model or fit(df, id_col, text_col, lang_col)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (_remainder(F.col(id_col)) == 0).alias("held_out"))
    return rows.mapInArrow(lambda it: _predict(it, model), "doc_id long, held_out boolean, lang_pred string, score double")
