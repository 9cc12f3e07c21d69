"""Quality rules by labelling a document's lines: Viterbi decoding of a linear-chain conditional random field.

Each line with a word is a node with a handful of features; the chain has two labels, content and
boilerplate. The sample says which documents are good, not which lines, so line labels are latent: they
are guessed from a line-by-line fit, with lines that several documents share as boilerplate, under
the constraint that lines against their document's label hold at most ODD_SHARE of its words; then
the chain is fitted to the guess by gradient ascent and guesses again. A document is kept when the
basic counts do not fail it and lines labelled content hold at least KEEP_SHARE of its words.

Defined results: null, empty and blank texts have no words, fail the basic counts and are not kept;
equal path scores decode as content; with no labelled rows every line is content; an empty table gives an
empty table. Texts are read whole, however long; repeated rows are judged alike; only the columns asked for
pass through, and names of the results must not be among them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Share of a document's words that content lines must hold.
KEEP_SHARE = 0.5
#: Bounds of the fit: documents, characters of each; lines of a chain, of which a document may give several; steps of gradient ascent.
FIT_DOCS, FIT_CHARS, FIT_LINES, STEPS = 1500, 20_000, 30, 60
#: A line that so many documents of the sample hold is boilerplate; a guess as sure as SURE may go against the document's label.
SHARED, SURE, ROUNDS = 3, 0.9, 2
#: Share of the words that lines labelled against their document may hold at most in the fit.
ODD_SHARE = 0.1
N_FEATURES = 12
CONTENT, BOILERPLATE = 0, 1


def words(text: str) -> list[bytes]:
    """Maximal runs of characters other than ASCII white space: what bytes.split cuts at."""
    return text.encode("utf-8", "replace").split()


def repeat_words(w: list[bytes]) -> tuple[int, set[int]]:
    """Words in 3-word windows found twice or more, and their positions."""
    grams = list(zip(w, w[1:], w[2:]))
    if len(set(grams)) == len(grams):
        return 0, set()
    seen = Counter(grams)
    hit: set[int] = set()
    for i, g in enumerate(grams):
        if seen[g] > 1:
            hit.update((i, i + 1, i + 2))
    return len(hit), hit


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    w = words(text)
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(w), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(w)[0]


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(lines, N_FEATURES) and the words of each line, for the lines with a word, top to bottom."""
    rows, sizes, seen = [], [], set()
    for line in text.split("\n"):
        w = line.encode("utf-8", "replace").split()
        if not w:
            continue
        n, chars = len(w), len(line)
        tail = line.rstrip(BLANKS)[-1:]
        rows.append((1.0, min(n, 64) / 64, n < 4, min(1.0, sum(map(line.count, SYMBOLS)) / n), min(1.0, line.count("!!") / n), line.count("|") > 1, line.upper() == line and line.lower() != line, line in seen, len(set(w)) / n, tail in ".!?", tail.isalnum(), min(1.0, chars / n / 16)))
        seen.add(line)
        sizes.append(n)
    return np.array(rows, np.float64).reshape(-1, N_FEATURES), np.array(sizes, np.int64)


def viterbi(emit: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The best label path; ``emit`` is (lines, 2), ``move`` (from, to). Content wins a tie."""
    (aa, ab), (ba, bb) = move.tolist()
    e = emit.tolist()
    a, b = e[0]
    back = []
    for x, y in e[1:]:
        from_b_to_a, from_b_to_b = b + ba > a + aa, b + bb > a + ab
        back.append((from_b_to_a, from_b_to_b))
        a, b = (b + ba if from_b_to_a else a + aa) + x, (b + bb if from_b_to_b else a + ab) + y
    label = BOILERPLATE if b > a else CONTENT
    path = [label]
    for step in reversed(back):
        label = int(step[label])
        path.append(label)
    return np.array(path[::-1], np.int8)


def _ascend(chains: list[np.ndarray], gold: list[np.ndarray], per: np.ndarray, w: np.ndarray, move: np.ndarray, steps: int) -> None:
    """Fits ``w`` and ``move`` in place to the labels of the chains' lines, each line of a chain weighing ``per``."""
    n, most = len(chains), max(map(len, chains))
    x, live, label = np.zeros((n, most, N_FEATURES)), np.zeros((n, most), bool), np.zeros((n, most), np.int64)
    observed = np.zeros_like(move)
    for i, (f, y) in enumerate(zip(chains, gold)):
        x[i, : len(f)], live[i, : len(f)], label[i, : len(f)] = f, True, y
        np.add.at(observed, (y[:-1], y[1:]), per[i])
    pace = [np.zeros_like(w), np.zeros_like(move)]
    for _ in range(steps):
        p, expected = _posterior(x, live, per, w, move)
        diff = (np.eye(2)[label] - p) * (live * per[:, None])[:, :, None]
        for target, g, m in zip((w, move), (np.einsum("ntf,ntk->fk", x, diff) - 1e-4 * w, observed - expected - 1e-4 * move), pace):
            m *= 0.9
            m += g
            target += 2.0 * m


def _posterior(x: np.ndarray, live: np.ndarray, per: np.ndarray, w: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(label probabilities of every line, expected moves) by the forward and backward sums."""
    most = x.shape[1]
    e = x @ w
    fwd, bwd = np.zeros_like(e), np.zeros_like(e)
    fwd[:, 0] = e[:, 0]
    for t in range(1, most):
        nxt = np.logaddexp(fwd[:, t - 1, :1] + move[0], fwd[:, t - 1, 1:] + move[1]) + e[:, t]
        fwd[:, t] = np.where(live[:, t, None], nxt, fwd[:, t - 1])
    z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
    expected = np.zeros_like(move)
    for t in range(most - 2, -1, -1):
        after = e[:, t + 1] + bwd[:, t + 1]
        nxt = np.logaddexp(move[:, 0] + after[:, :1], move[:, 1] + after[:, 1:])
        on = live[:, t + 1, None]
        bwd[:, t] = np.where(on, nxt, bwd[:, t + 1])
        joint = fwd[:, t, :, None] + move + after[:, None, :] - z[:, None, None]
        expected += (np.exp(np.minimum(joint, 0)) * (on * per[:, None])[:, :, None]).sum(0)
    return np.exp(np.minimum(fwd + bwd - z[:, None, None], 0)), expected


def constrained(boiler: np.ndarray, sizes: np.ndarray, good: bool, shared: np.ndarray) -> np.ndarray:
    """Line labels of one document from the chance that each is boilerplate: its own label is the rule, sure guesses differ, the words decide.

    Where these would hold too many of the words, the least sure guesses are taken back.
    """
    odd = (boiler > SURE) | shared if good else (boiler < 1 - SURE) & ~shared
    total, held = sizes.sum(), sizes[odd].sum()
    for i in np.flatnonzero(odd)[np.argsort(np.abs(boiler[odd] - 0.5), kind="stable")]:
        if held <= ODD_SHARE * total:
            break
        odd[i] = False
        held -= sizes[i]
    return np.where(odd, BOILERPLATE if good else CONTENT, CONTENT if good else BOILERPLATE)


def fit(sample: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(emission weights (N_FEATURES, 2), transition weights (2, 2)): latent line labels and the chain fitted to them, by turns."""
    w, move = np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
    docs = [(t, f, sizes, y == 1) for t, y in sample for f, sizes in [line_features(t)] if len(f)]
    if not docs:
        return w, move
    holds = Counter(x for t, *_ in docs for x in {y.strip(BLANKS) for y in t.split("\n")})
    shared = [np.array([holds[x.strip(BLANKS)] >= SHARED for x in t.split("\n") if x.strip(BLANKS)]) for t, *_ in docs]
    # the rarer label weighs as much as the other, and a document as much as another
    good = np.array([y for *_, y in docs])
    weight = np.where(good, 0.5 / max(good.sum(), 1), 0.5 / max((~good).sum(), 1))
    cuts = [(i, a) for i, (_, f, _, _) in enumerate(docs) for a in range(0, len(f), FIT_LINES)]
    chains = [docs[i][1][a : a + FIT_LINES] for i, a in cuts]
    per = np.array([weight[i] / len(docs[i][1]) for i, _ in cuts])
    cut = lambda labels: [labels[i][a : a + FIT_LINES] for i, a in cuts]
    labels = [np.full(len(f), CONTENT if y else BOILERPLATE) for _, f, _, y in docs]
    lines = [x[None] for f in chains for x in f]
    _ascend([f for f in lines], [y[k : k + 1] for y in cut(labels) for k in range(len(y))], np.repeat(per, list(map(len, chains))), w, move, STEPS // 2)
    for turn in range(ROUNDS):
        for k, (_, f, sizes, y) in enumerate(docs):
            if turn:
                p = _posterior(f[None], np.ones((1, len(f)), bool), np.ones(1), w, move)[0][0, :, BOILERPLATE]
            else:  # line by line
                e = f @ w
                p = 1 / (1 + np.exp(np.clip(e[:, CONTENT] - e[:, BOILERPLATE], -50, 50)))
            labels[k] = constrained(p, sizes, bool(y), shared[k])
        w, move = np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
        _ascend(chains, cut(labels), per, w, move, STEPS)
    return w, move


def judge(text: str | None, w: np.ndarray, move: np.ndarray) -> tuple[int, int, int, int, int, bool, float, bool]:
    """The base counts, base_failed, the content share of the words, and kept."""
    counts = base_counts(text)
    failed = counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEAT_PERCENT * counts[0]
    if not counts[0]:
        return *counts, True, 0.0, False
    f, sizes = line_features(text or "")
    path = viterbi(f @ w, move)
    share = float(sizes[path == CONTENT].sum() / sizes.sum())
    return *counts, failed, share, not failed and share >= KEEP_SHARE


COLUMNS = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()), ("content_share", T.DoubleType()), ("kept", T.BooleanType())]


def apply_rules(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` with the counts and verdicts of each whole text."""
    w, move = model
    names = [n for n, _ in COLUMNS]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = pd.DataFrame([judge(t, w, move) for t in b["__text"]], columns=names, index=b.index)
            yield pd.concat([b[list(keep)], found], axis=1)

    return docs.select(*keep, docs[text].alias("__text")).mapInPandas(run, T.StructType([*[docs.schema[c] for c in keep], *[T.StructField(n, t) for n, t in COLUMNS]]))
