"""Quality rules with line labelling: a linear-chain CRF marks each line as content or boilerplate.

Counts over the words of a text decide the base rules. A conditional random field over a document's
lines (indicator features of a line, one transition matrix) is trained by gradient ascent on a bounded
sample of labelled documents. Their quality label is one for a whole document, so line labels are made in three ways that
let them change within a document: lines of a good document are content; a poor document has boilerplate, but
those of its lines that look like content to a first model of single lines are content (some line always stays
boilerplate); and documents are put together from good ones with runs of boilerplate, of poor documents and of the usual
menus, banners and footers, around and between their lines. Viterbi decoding labels every line, and the share of words
in content lines decides whether a document is kept.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, raw, unpacked

WINDOW = 8
_SYMBOLS = b"#*$%&|<>"
_UPPER, _DIGITS, _ENDS = bytes(range(65, 91)), b"0123456789", (b".", b"!", b"?", b":", b";")
_WHITE = b" \t\n\x0b\x0c\r"
_MARKS = b".,:;!?()[]|<>/\"'"
#: Feature groups and how many values each has; a line has one value of each.
GROUPS = {"words": 8, "symbols": 6, "pipes": 4, "upper": 5, "digits": 4, "exclaim": 4, "length": 6, "end": 3, "place": 4, "short": 4, "again": 4, "capitals": 4, "cues": 3}
# Words that are common in menus, banners and footers, in lower case.
CUES = frozenset(
    b"copyright rights reserved login logout register subscribe newsletter cookie cookies privacy policy terms conditions contact about home menu search share tweet follow facebook twitter instagram rss sitemap help faq "
    b"imprint impressum datenschutz kontakt startseite anmelden accueil connexion mentions inicio contacto aviso advertisement sponsored related comments reply previous next back top skip click here read more sign up welcome shop cart checkout account powered posted tags categories accept decline bienvenue bienvenido willkommen".split()
)
# Usual menus, banners and footers, for documents that are put together. {} is a number.
BOILERPLATE = (
    "Home | About us | Contact | Login",
    "Home > News > Archive > Page {}",
    "Menu",
    "Skip to main content",
    "Search this site",
    "Startseite | Kontakt | Impressum | Datenschutz",
    "Accueil | Nouvelles | Contact | Connexion",
    "Inicio | Noticias | Contacto | Aviso legal",
    "Sign up for our newsletter",
    "Subscribe to our RSS feed",
    "Share on Facebook | Tweet | Email",
    "Follow us on Twitter, Facebook and Instagram",
    "We use cookies to improve this site. Accept | Decline",
    "This website uses cookies. Read our privacy policy.",
    "Advertisement",
    "Related articles",
    "Read more",
    "Click here to read more comments ({})",
    "Leave a reply",
    "< Previous | Next >",
    "Back to top",
    "Page {} of {}",
    "Copyright (c) {} Example Ltd. All rights reserved.",
    "© {} All rights reserved. Terms of use | Privacy policy | Sitemap",
    "Terms and conditions",
    "Login / Register",
    "Cart ({})",
    "Tags: news, archive, {}",
    "Posted by admin on {}",
    "Powered by Example CMS {}",
)
FEATURES = sum(GROUPS.values()) + 1
_SYMBOL_STEPS, _PIPE_STEPS, _UPPER_STEPS = (0.02, 0.1, 0.3, 0.7, 1.5), (0.01, 0.15, 0.4), (0.02, 0.1, 0.3, 0.6)
_DIGIT_STEPS, _EXCLAIM_STEPS, _LENGTH_STEPS, _SHORT_STEPS = (0.01, 0.1, 0.3), (0.01, 0.2, 0.8), (3, 4.5, 6, 8, 11), (0.05, 0.2, 0.4)
_AGAIN_STEPS, _CAPITAL_STEPS, _CUE_STEPS = (0.01, 0.3, 0.7), (0.3, 0.6, 0.95), (0.01, 0.25)
_OFFSETS = np.cumsum([0, *GROUPS.values()])[:-1]


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of `window` (a power of two) words found twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter(map(seen.setdefault, words, range(len(words))), np.int64, len(words))
    if len(seen) == len(words):
        return 0
    span = 1
    while span < window:  # ids of windows of twice the words, exactly
        pairs = ids[:-span] * len(words) + ids[span:]
        span *= 2
        if span < window and len(words) < 1 << 15:  # four ids of 15 bits fit as they are
            pairs = pairs[:-span] * len(words) ** 2 + pairs[span:]
            span *= 2
        if (np.diff(np.sort(pairs)) > 0).all():
            return 0
        _, ids = np.unique(pairs, return_inverse=True)
    again = np.bincount(ids)[ids] > 1
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover) > 0).sum())


def base_counts(data: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of UTF-8 text."""
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    # Code points are bytes but those that continue one.
    chars = len(data.translate(None, _WHITE + bytes(range(0x80, 0xC0))))
    return len(words), chars, len(data) - len(data.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words)


def line_features(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Indices (lines, groups) of the features that hold, and the words of each line. A blank line has words 0."""
    out, counts = np.empty((len(lines), len(GROUPS)), np.int64), np.empty(len(lines), np.int64)
    last = len(lines) - 1
    for i, line in enumerate(lines):
        words = line.split()
        n = counts[i] = len(words)
        m, size = n or 1, len(line) or 1
        body = line.rstrip()
        out[i] = (
            min(7, n.bit_length()),
            bisect_right(_SYMBOL_STEPS, (size - len(line.translate(None, _SYMBOLS))) / m),
            bisect_right(_PIPE_STEPS, line.count(b"|") / m),
            bisect_right(_UPPER_STEPS, (size - len(line.translate(None, _UPPER))) / size),
            bisect_right(_DIGIT_STEPS, (size - len(line.translate(None, _DIGITS))) / size),
            bisect_right(_EXCLAIM_STEPS, line.count(b"!") / m),
            bisect_right(_LENGTH_STEPS, (size - n + 1) / m),
            0 if body.endswith(_ENDS) else 1 if body else 2,
            0 if last == 0 else 1 if i == 0 else 2 if i == last else 3,
            bisect_right(_SHORT_STEPS, sum(map((4).__gt__, map(len, words))) / m),
            bisect_right(_AGAIN_STEPS, sum(map(bytes.__eq__, words, words[1:])) / m),
            bisect_right(_CAPITAL_STEPS, (n - sum(map(bytes.islower, words))) / m),
            bisect_right(_CUE_STEPS, len(CUES.intersection(line.lower().translate(None, _MARKS).split())) / m),
        )
    return out + _OFFSETS, counts


@dataclass
class Crf:
    """state: (FEATURES, 2) weights, the last row a bias; move: (2, 2) from label to label. Label 1 is content."""

    state: np.ndarray
    move: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        return self.state[features].sum(axis=1) + self.state[-1]

    def viterbi(self, features: np.ndarray) -> np.ndarray:
        """The likeliest labels of a document's lines; equal ones: content."""
        s = self.scores(features).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b = s[0]
        back = []
        for x, y in s[1:]:
            p, q = a + m00 > b + m10, a + m01 > b + m11  # came from label 0
            back.append((p, q))
            a, b = (a + m00 if p else b + m10) + x, (a + m01 if q else b + m11) + y
        labels = [0 if a > b else 1]
        for p, q in reversed(back):
            labels.append(0 if (q if labels[-1] else p) else 1)
        return np.array(labels[::-1])


def fit_crf(docs: list[np.ndarray], labels: list[np.ndarray], *, rounds: int = 80, rate: float = 1.0, l2: float = 1e-3, chained: bool = True) -> Crf:
    """Maximise the conditional likelihood by gradient steps with momentum; forward-backward over all documents at once.

    labels: one for each line. Documents weigh the same, whatever their length, and so do both labels in all.
    chained: learn transitions too, else they stay 0.
    """
    order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
    docs, labels = [docs[i] for i in order], [np.asarray(labels[i], np.int64) for i in order]
    size = np.array([len(d) for d in docs])
    n, longest = len(docs), int(size.max())
    ones = np.array([y.mean() for y in labels])
    share = np.clip(ones.mean(), 1e-3, 1 - 1e-3)
    weight = (0.5 * ones / share + 0.5 * (1 - ones) / (1 - share)) / size / n
    live = [int((size > t).sum()) for t in range(longest)]  # documents that have a line t come first
    rows = np.concatenate([np.stack([docs[i][t] for i in range(live[t])]) for t in range(longest)])
    y = np.concatenate([[labels[i][t] for i in range(live[t])] for t in range(longest)])
    of = np.concatenate([np.arange(k) for k in live])
    at = np.r_[0, np.cumsum(live)]
    state, move = np.zeros((FEATURES, 2)), np.zeros((2, 2))
    vs, vm = np.zeros_like(state), np.zeros_like(move)
    for _ in range(rounds):
        s = state[rows].sum(axis=1) + state[-1]
        alpha, beta = np.empty_like(s), np.zeros_like(s)
        alpha[: at[1]] = s[: at[1]]
        for t in range(1, longest):
            prev = alpha[at[t - 1] : at[t - 1] + live[t]]
            alpha[at[t] : at[t + 1]] = s[at[t] : at[t + 1]] + np.logaddexp(prev[:, :1] + move[0], prev[:, 1:] + move[1])
        for t in range(longest - 2, -1, -1):
            nxt = beta[at[t + 1] : at[t + 2]] + s[at[t + 1] : at[t + 2]]
            beta[at[t] : at[t] + live[t + 1]] = np.logaddexp(nxt[:, :1] + move[:, 0], nxt[:, 1:] + move[:, 1])
        z = np.empty(n)
        for t in range(longest):
            done = slice(live[t + 1] if t + 1 < longest else 0, live[t])
            z[done] = np.logaddexp.reduce(alpha[at[t] : at[t + 1]][done], axis=1)
        miss = -np.exp(alpha + beta - z[of][:, None])
        miss[np.arange(len(of)), y] += 1
        miss *= weight[of][:, None]
        gs, gm = np.zeros_like(state), np.zeros_like(move)
        for k in range(rows.shape[1]):
            for lab in (0, 1):
                gs[:, lab] += np.bincount(rows[:, k], miss[:, lab], FEATURES)
        gs[-1] = miss.sum(axis=0)
        for t in range(1, longest if chained else 0):
            k = live[t]
            pair = alpha[at[t - 1] : at[t - 1] + k][:, :, None] + move + (beta + s)[at[t] : at[t + 1]][:, None, :] - z[:k, None, None]
            gm -= (np.exp(pair) * weight[:k, None, None]).sum(axis=0)
            np.add.at(gm, (y[at[t - 1] : at[t - 1] + k], y[at[t] : at[t + 1]]), weight[:k])
        vs, vm = 0.9 * vs + gs - l2 * state, 0.9 * vm + gm - l2 * move
        state, move = state + rate * vs, move + rate * vm
    return Crf(state, move)


def line_labels(docs: list[np.ndarray], counts: list[np.ndarray], quality: list[int]) -> list[np.ndarray]:
    """A label for each line: 1 in good documents; in poor ones 1 too where a model of single lines says so, but never for all words.

    The line that looks least like content stays boilerplate, and so do others until they hold half the words or more.
    """
    whole = [np.full(len(d), q) for d, q in zip(docs, quality)]
    single = fit_crf(docs, whole, rounds=40, chained=False)
    out = []
    for d, n, y in zip(docs, counts, whole):
        if y[0] == 0:
            s = single.scores(d)
            margin = s[:, 1] - s[:, 0]
            order = np.argsort(margin, kind="stable")
            held = np.cumsum(n[order]) - n[order] >= 0.5 * n.sum()  # what comes before holds half the words
            y = np.zeros(len(d), np.int64)
            y[order[held & (margin[order] > 0)]] = 1
        out.append(y)
    return out


def put_together(good: list[list[bytes]], poor: list[list[bytes]], *, seed: int = 43) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Lines and labels of documents with boilerplate above, below and, at times, within the lines of each good one; some lose their closing marks."""
    rng = np.random.default_rng(seed)
    said = [b.encode() for b in BOILERPLATE]

    def run() -> list[bytes]:
        if poor and rng.random() < 0.4:
            own = poor[rng.integers(len(poor))]
            at = int(rng.integers(len(own)))
            return own[at : at + 1 + int(rng.integers(4))]
        return [x.replace(b"{}", b"%d" % rng.integers(1, 3000)) for x in (said[i] for i in rng.integers(len(said), size=1 + int(rng.integers(5))))]

    for lines in good:
        if rng.random() < 0.25:  # content may lack closing marks
            lines = [x.rstrip(b".!? ") or x for x in lines]
        cut = int(rng.integers(1, len(lines))) if len(lines) > 1 and rng.random() < 0.4 else len(lines)
        parts = [(run() if rng.random() < 0.8 else [], 0), (lines[:cut], 1), (run() if cut < len(lines) else [], 0), (lines[cut:], 1), (run() if rng.random() < 0.8 else [], 0)]
        yield [x for own, _ in parts for x in own], np.array([y for own, y in parts for _ in own])


def train(sample: DataFrame, *, max_lines: int = 400) -> Crf | None:
    """Fit on a bounded sample(doc_id, text, label 0 or 1), read whole in one task (see common.labelled_sample). None without both labels.

    Documents of more than max_lines lines aren't learnt from.
    """
    rows = sample.where("text is not null").select("doc_id", raw(F.col("text")).alias("text"), "label")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, quality = [], []
        for b in batches:
            for x, y in zip(b.column(1), b.column(2).to_pylist()):
                own = [w for w in x.as_buffer().to_pybytes().split(b"\n") if w.strip()]
                if 0 < len(own) <= max_lines:
                    lines.append(own)
                    quality.append(y)
        if len(set(quality)) == 2:
            docs, counts = (list(c) for c in zip(*map(line_features, lines)))
            labels = line_labels(docs, counts, quality)
            poor = [[x for x, y in zip(own, lab) if y == 0] for own, lab, q in zip(lines, labels, quality) if q == 0]
            for own, lab in put_together([own for own, q in zip(lines, quality) if q == 1], poor):
                if len(own) <= max_lines:
                    docs.append(line_features(own)[0])
                    labels.append(lab)
            m = fit_crf(docs, labels)
            yield pa.RecordBatch.from_arrays([pa.array([m.state.tobytes()], pa.binary()), pa.array([m.move.tobytes()], pa.binary())], names=["state", "move"])

    got = rows.repartitionByRange(1, "doc_id").sortWithinPartitions("doc_id", "label").mapInArrow(fit, "state binary, move binary").collect()
    return Crf(np.frombuffer(bytes(got[0].state)).reshape(FEATURES, 2), np.frombuffer(bytes(got[0].move)).reshape(2, 2)) if got else None


def content_share(data: bytes, crf: Crf | None) -> float:
    """Share of the words that are in lines labelled content; 1 without a model, 0 without words."""
    lines = [x for x in data.split(b"\n") if x.strip()]
    if not lines:
        return 0.0
    if crf is None:
        return 1.0
    features, counts = line_features(lines)
    return float(counts[crf.viterbi(features) == 1].sum() / counts.sum())


_RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_share double"


def _judged(docs: DataFrame, crf: Crf | None, min_words: int, max_repeat: int, min_share: float) -> tuple[DataFrame, dict[str, Column]]:
    """docs packed, and the result columns over it."""
    shared = docs.sparkSession.sparkContext.broadcast(crf)
    names = [c.split()[0] for c in _RESULT.split(", ")]

    @F.pandas_udf(_RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(*base_counts(x), content_share(x, shared.value)) for x in texts], columns=names)

    own = {n: F.col(f"q.{n}") for n in names}
    failed = (own["n_words"] < min_words) | (100 * own["n_repeat_words"] > max_repeat * own["n_words"])
    return packed(docs, q=run(raw(F.col("text")))), own | {"base_failed": failed, "kept": ~failed & (own["content_share"] >= min_share)}


def assess(docs: DataFrame, crf: Crf | None, *, min_words: int = 20, max_repeat: int = 30, min_share: float = 0.5) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words long, content_share double, base_failed, kept boolean.

    base_failed: fewer than min_words words, or over max_repeat per cent of them in repeated windows of eight
    words. kept: not base_failed, and the content share is min_share or more. Null and empty texts have
    no words and fail. Without a model every line is content. Columns of docs of these names are replaced, all others stay.
    """
    rows, own = _judged(docs, crf, min_words, max_repeat, min_share)
    return unpacked(rows, docs, new=own)


def keep_good(docs: DataFrame, crf: Crf | None, *, min_words: int = 20, max_repeat: int = 30, min_share: float = 0.5) -> DataFrame:
    """The rows of docs that assess() keeps, with all their own columns and no others."""
    rows, own = _judged(docs, crf, min_words, max_repeat, min_share)
    return unpacked(rows.where(own["kept"]), docs)
