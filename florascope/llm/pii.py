"""Personal items in free text: found by a character tagger and replaced by typed placeholders.

A bidirectional LSTM with CRF transitions reads the text in overlapping windows; the windows' tags are reconciled into one tag for
each character, and the decoded spans are the items. A check follows that can only bring a span to whole words and to the borders of
the written form lying over most of it, or drop what can't be of its kind (pii_forms.check). A second decoding that lowers the
score of 'outside' by LENIENT gives doubtful spans; one of them counts only if it is exactly what its form and the words beside it,
or the list of names, make an item (pii_forms.confirmed).

Only stretches that could hold an item are read by the network: around an at sign, around five digits or more, around a number beside
a capitalised word, around two capitalised words. No item of the five kinds does without one of these.

The tagger is trained from at most TRAIN_PIECES pieces of the table's own texts (chosen by hash, from anywhere in them), labelled
by pii_forms.label_spans with a list of names, and from as many sentences of pii_synth. Its weights are a table in the shared
folder: queries over the same table read them instead of training anew.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread, stage
from .pii_forms import Names, check, confirmed, expand, label_spans
from .pii_synth import Maker
from .tagger import KINDS, OVERLAP, WINDOW, Tagger, encode, reconcile, spans, windows

#: Bounds of the training sample: pieces of texts, characters of a piece, listed names, sentences made up.
TRAIN_PIECES, PIECE, TRAIN_NAMES, TRAIN_MADE = 4000, 1500, 4000, 20_000
STEPS, BATCH, RATE = 3000, 32, 0.01
LENIENT = 5.0
#: Characters of a training window: items are shorter, and a step costs by its length.
TRAIN_WINDOW = 112
#: Characters read before and after what may be an item.
BEFORE, AFTER = 32, 28
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id": "[ID]", "address": "[ADDRESS]", "name": "[NAME]"}
_S = "[ \u00a0]"
_GATE = regex.compile(
    rf"@|[\[({{]{_S}?(?i:at){_S}?[\])}}]|\d(?:[ \u00a0./()\-]{{0,2}}\d){{4,}}"
    rf"|\d\p{{L}}?,?{_S}(?:\p{{L}}+{_S}){{0,2}}\p{{Lu}}|\p{{Lu}}\p{{L}}+{_S}\d{{1,4}}\p{{L}}?,"
    rf"|(?:\p{{Lu}}[\p{{L}}\p{{M}}'’\-]*,?|\p{{Lu}}\.){_S}\p{{Lu}}|\p{{Lo}}{{2}}"
)


def stretches(text: str) -> list[tuple[int, int]]:
    """Parts of the text that the tagger has to read, in order, without overlaps."""
    out: list[tuple[int, int]] = []
    for m in _GATE.finditer(text):
        a, b = max(0, m.start() - BEFORE), min(len(text), m.end() + AFTER)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def tags_of(length: int, found: list[tuple[int, int, str]]) -> np.ndarray:
    y = np.zeros(length, np.int64)
    for a, b, kind in found:
        k = 1 + 2 * KINDS.index(kind)
        y[a:b] = k + 1
        y[a] = k
    return y


def training_windows(texts: list[str], names: Names, made: int = TRAIN_MADE, seed: int = 11) -> tuple[np.ndarray, np.ndarray, Names]:
    """Windows over labelled stretches of the texts and over sentences made up from them, their tags, and the names expanded by the texts."""
    rng = np.random.default_rng(seed)
    names = expand(texts, names)
    xs, ys = [], []

    def add(text: str, found: list[tuple[int, int, str]], doubt: list[tuple[int, int]], keep: float) -> None:
        codes, tags = encode(text), tags_of(len(text), found)
        for a, b in stretches(text):
            # A stretch rarely begins where a text's stretch would be cut: it is read from a little further on or back.
            a = max(0, a - int(rng.integers(0, 24)))
            for at in range(a, max(b - OVERLAP, a + 1), TRAIN_WINDOW - OVERLAP):
                end = min(at + TRAIN_WINDOW, b)
                if any(x < end and at < y for x, y in doubt) or (not tags[at:end].any() and rng.random() > keep):
                    continue
                x, y = np.zeros(TRAIN_WINDOW, np.uint8), np.zeros(TRAIN_WINDOW, np.int64)
                x[: end - at], y[: end - at] = codes[at:end], tags[at:end]
                xs.append(x)
                ys.append(y)

    for text in texts:
        add(text, *label_spans(text, names), 1.0)
    maker = Maker(rng, sorted(names.given), sorted(names.family))
    bases = [s for t in texts for s in regex.split(r"(?<=[.!?])\s|\n", t) if 20 < len(s) < 160]
    for _ in range(made if bases else 0):
        base = bases[int(rng.integers(len(bases)))]
        # A sentence with items of its own, or doubtful ones, isn't built upon.
        if any(label_spans(base, names)):
            continue
        text, found = maker.sentence(base)
        add(text, found, [], 0.6)
    if not xs:
        return np.zeros((0, TRAIN_WINDOW), np.uint8), np.zeros((0, TRAIN_WINDOW), np.int64), names
    order = rng.permutation(len(xs))
    return np.stack(xs)[order], np.stack(ys)[order], names


@dataclass
class Model:
    """A trained tagger with the names it was trained with."""

    tagger: Tagger
    names: Names = field(default_factory=Names)


#: Weight tables of this session, by the plan of the texts they were trained on.
_TRAINED: dict[tuple, DataFrame] = {}


def train(df: DataFrame, text_col: str, names: DataFrame | None = None, steps: int = STEPS) -> Model | None:
    """A tagger fitted on the bounded sample of df; None if there is no text. names: (given, family), of which TRAIN_NAMES are used.

    Within a session the same plan over the same files is trained on once; a table rewritten under its old path isn't read again.
    """
    key = (df.sparkSession.sparkContext.applicationId, df.select(text_col).semanticHash(), names is not None and names.semanticHash(), steps)
    if key not in _TRAINED:
        weights = _fit(df, text_col, names, steps)
        if weights is None:
            return None
        _TRAINED[key] = weights
    tagger = Tagger()
    tagger.p, given, family = pickle.loads(_TRAINED[key].first().weights)
    return Model(tagger, Names(given, family))


def _fit(df: DataFrame, text_col: str, names: DataFrame | None, steps: int) -> DataFrame | None:
    """The trained weights as a table of one row in the shared folder."""
    t = F.col(text_col)
    length = F.length(t)
    total = df.agg(F.sum(F.ceil(length / PIECE))).first()[0]
    if not total:
        return None
    # Pieces below a threshold of their hash, so that each task passes on its share of the bound and no more.
    share = min(1.0, 1.3 * TRAIN_PIECES / total)
    pieces = df.where(length > 0).select(t.alias("t"), F.posexplode(F.sequence(F.lit(1), length, F.lit(PIECE))).alias("i", "at"))
    chance = F.xxhash64(F.xxhash64("t"), "i")
    sample = pieces.withColumn("h", chance).where(F.pmod("h", F.lit(1 << 20)) <= int(share * (1 << 20))).select("h", F.expr(f"substring(t, at, {PIECE})").alias("t"))
    sample = sample.orderBy("h", "t").limit(TRAIN_PIECES)
    listed: list[list[str]] = [[], []]
    if names is not None:
        for k, c in enumerate(("given", "family")):
            words = names.select(F.explode(F.split(F.lower(c), r"[ \-]+")).alias("w")).where(F.length("w") > 2).distinct()
            listed[k] = [r.w for r in words.orderBy(F.xxhash64("w"), "w").limit(TRAIN_NAMES).collect()]

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts = [x for b in batches for x in b["t"]]
        model = Tagger()
        x, y, known = training_windows(texts, Names(set(listed[0]), set(listed[1])))
        if len(x):
            model.fit(x, y, steps, BATCH, RATE)
        yield pd.DataFrame({"weights": [pickle.dumps((model.p, known.given, known.family))]})

    # One task of the cluster trains (a retried one comes to the same weights); about 100 kB come back.
    return stage(sample.coalesce(1).mapInPandas(fit, "weights binary"), "tagger")


Spans = list[tuple[int, int, str]]


def decoded(model: Model, texts: list[str], favours: tuple[float, ...] = (0.0, LENIENT), cells: int = 1 << 17) -> list[list[Spans]]:
    """Spans that the tagger gives in whole texts, for each favour and text."""
    cut: list[tuple[int, int, range, list[int]]] = []
    parts: list[np.ndarray] = []
    for i, text in enumerate(texts):
        codes = None
        for a, b in stretches(text):
            codes = encode(text) if codes is None else codes
            w, starts = windows(codes[a:b])
            cut.append((i, a, range(len(parts), len(parts) + len(w)), starts))
            parts += w
    sizes = np.array([len(p) for p in parts], int)
    tags: list[list[np.ndarray]] = [[np.zeros(0, np.int8)] * len(parts) for _ in favours]
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        # Windows of about the same length go together.
        n = max(1, min(len(order) - at, cells // int(sizes[order[min(len(order) - 1, at + cells // WINDOW)]])))
        group = order[at : at + n]
        x = np.zeros((n, int(sizes[group].max())), np.uint8)
        for r, g in enumerate(group):
            x[r, : sizes[g]] = parts[g]
        for out, got in zip(tags, model.tagger.viterbi(x, favours), strict=True):
            for g, y in zip(group, got, strict=True):
                out[g] = y[: sizes[g]]
        at += n
    found: list[list[Spans]] = [[[] for _ in texts] for _ in favours]
    for out, got in zip(found, tags, strict=True):
        for i, a, which, starts in cut:
            y = reconcile([got[w] for w in which], starts)
            if y.any():
                out[i] += [(a + x, a + z, k) for x, z, k in spans(y)]
    return found


def checked(text: str, strict: Spans, lenient: Spans = (), names: Names | None = None) -> Spans:
    """The decoded spans with their borders checked, without overlaps (the earlier, then the longer one holds)."""
    out = {(*at, kind) for a, b, kind in strict if (at := check(text, a, b, kind, names))}
    for a, b, kind in lenient:
        if (a, b, kind) not in out and (at := check(text, a, b, kind, names)) and not any(x < at[1] and at[0] < y for x, y, _ in out):
            if confirmed(text, *at, kind, names or Names()):
                out.add((*at, kind))
    kept: Spans = []
    for x in sorted(out, key=lambda x: (x[0], -x[1])):
        if not kept or x[0] >= kept[-1][1]:
            kept.append(x)
    return kept


def _texts(batches: Iterator[pd.DataFrame], model: Model) -> Iterator[tuple[pd.DataFrame, list[Spans]]]:
    for b in batches:
        b.columns = ["id", "text"]
        size = b["text"].str.len().fillna(0).to_numpy()
        group = np.cumsum(size) // 2_000_000
        for _, part in b.groupby(group, sort=True):
            texts = [t if isinstance(t, str) else "" for t in part["text"]]
            yield part, [checked(t, x, y, model.names) for t, x, y in zip(texts, *decoded(model, texts), strict=True)]


def find_personal(df: DataFrame, id_col: str, text_col: str, model: Model | None = None, names: DataFrame | None = None) -> DataFrame:
    """(id_col, pii_kind, pii_value), distinct: each item exactly as it stands in its text.

    Kinds: email, phone, id, address, name. Null, empty and blank texts have none; an empty table gives no rows; texts of any
    length are read whole; other columns aren't read. model: one that is trained already; names: a list of names to train it with.
    """
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, pii_kind string, pii_value string"
    model = model or train(df, text_col, names)
    if model is None:
        return df.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, found in _texts(batches, model):
            rows = {(i, k, t[a:b]) for i, t, x in zip(part["id"], part["text"], found, strict=True) for a, b, k in x}
            yield pd.DataFrame(sorted(rows, key=repr), columns=[id_col, "pii_kind", "pii_value"])

    found = spread(df.select(id_col, text_col).where(F.length(text_col) > 0)).mapInPandas(run, schema)
    return found.distinct()


def mask_personal(df: DataFrame, id_col: str, text_col: str, model: Model | None = None, names: DataFrame | None = None) -> DataFrame:
    """(id_col, text_col, n_masked), one row for each row of df, items replaced by [EMAIL], [PHONE], [ID], [ADDRESS], [NAME].

    Null texts stay null, empty ones empty; everything else in a text stays as it is.
    """
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, `{text_col}` string, n_masked int"
    model = model or train(df, text_col, names)
    if model is None:
        return df.select(id_col, text_col, F.lit(0).cast("int").alias("n_masked"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, found in _texts(batches, model):
            texts = []
            for t, x in zip(part["text"], found, strict=True):
                for a, b, k in reversed(x):
                    t = t[:a] + PLACEHOLDER[k] + t[b:]
                texts.append(t)
            yield pd.DataFrame({id_col: part["id"], text_col: texts, "n_masked": [len(x) for x in found]})

    return spread(df.select(id_col, text_col)).mapInPandas(run, schema)
